"""Operators over request logs whose state is bounded: limiter, cache, debounce, latest request.

The greedy ones can't be window functions, as each decision depends on the one before.  Rows are
hashed by key, sorted within the partition and read as a stream, so a key's state is bounded and a
key that holds a large part of all rows is never gathered in memory.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.operators.ordering import with_next


def _scan(df: DataFrame, key: str, seconds: str, tie: str, make: Callable[[], Callable], extra: str) -> DataFrame:
    """``df`` with the columns ``extra`` that a fresh decider per key gives to each of its (seconds, tie) in order."""
    names = [f.split()[0] for f in extra.split(", ")]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, decide = object(), None
        for frame in frames:
            out = []
            for k, at, row in zip(frame[key].tolist(), frame[seconds].tolist(), frame[tie].tolist()):
                if k != current:
                    current, decide = k, make()
                out.append(decide(at, row))
            yield pd.concat([frame, pd.DataFrame(out, columns=names, index=frame.index)], axis=1)

    return df.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, seconds, tie).mapInPandas(run, f"{shape}, {extra}")


class SlidingWindow:
    """At most ``most`` allowed requests within any ``window`` seconds; denied ones are not recorded."""

    def __init__(self, most: int, window: float, times: list[float] = ()):
        self.most, self.window, self.times = most, window, deque(times)

    def check(self, now: float) -> tuple[bool, int]:
        while self.times and self.times[0] <= now - self.window:
            self.times.popleft()
        if len(self.times) < self.most:
            self.times.append(now)
            return True, 0
        wait = (self.times[0] if self.times else now) + self.window - now
        return False, max(1, int(wait + 0.99))


def rate_limit(df: DataFrame, client: str, seconds: str, tie: str, most: int = 120, window: float = 60.0) -> DataFrame:
    """``df`` with allowed and retry_after; rows of a null client are left out."""

    def make():
        state = SlidingWindow(most, window)
        return lambda at, _: state.check(at)

    return _scan(df, client, seconds, tie, make, "allowed boolean, retry_after int")


def ttl_cache(df: DataFrame, key: str, seconds: str, tie: str, ttl: float = 300.0) -> DataFrame:
    """``df`` with cached and first_tie, the ``tie`` of the row that filled the entry; hits don't prolong it."""
    kind = dict(df.dtypes)[tie]

    def make():
        held: list = []

        def decide(now: float, row) -> tuple[bool, object]:
            if held and now - held[0] < ttl:
                return True, held[1]
            held[:] = [now, row]
            return False, row

        return decide

    return _scan(df, key, seconds, tie, make, f"cached boolean, first_tie {kind}")


class BoundedCache:
    """A cache of limited size and age: when full, the oldest quarter goes (or everything)."""

    def __init__(self, most: int = 1000, ttl: float = 300.0, clear_all: bool = False):
        self.most, self.ttl, self.clear_all, self.items = most, ttl, clear_all, OrderedDict()

    def get(self, key, now: float):
        item = self.items.get(key)
        if item is None or now - item[0] >= self.ttl:
            return None
        return item[1]

    def put(self, key, value, now: float) -> None:
        if len(self.items) >= self.most:
            for old in list(self.items)[: len(self.items) if self.clear_all else max(1, self.most // 4)]:
                del self.items[old]
        self.items.pop(key, None)
        self.items[key] = (now, value)


def bounded_cache(df: DataFrame, cache: str, key: str, seconds: str, tie: str, most: int = 1000, ttl: float = 300.0, clear_all: bool = False) -> DataFrame:
    """``df`` with cached and held: whether each request of a cache finds its key, and how many entries the cache then has.

    One cache (a worker's, by the column ``cache``) holds at most ``most`` keys of at most ``ttl`` seconds; when a new
    one comes to a full cache the oldest quarter goes, or everything.  Its requests are read in order as a stream.
    """
    rows = df.withColumn("__row", F.struct(F.col(tie).alias("tie"), F.col(key).cast("string").alias("key")))

    def make():
        held = BoundedCache(most, ttl, clear_all)

        def decide(now: float, row) -> tuple[bool, int]:
            hit = held.get(row["key"], now) is not None
            if not hit:
                held.put(row["key"], True, now)
            return hit, len(held.items)

        return decide

    return _scan(rows, cache, seconds, "__row", make, "cached boolean, held int").drop("__row")


def debounce(df: DataFrame, source: str, at: str, tie: str, value: str, wait_ms: int = 200) -> DataFrame:
    """The rows that no later row of the same source follows within ``wait_ms``; blank values cancel and never come out."""
    rows = with_next(df, [source], [at, tie], "__next")
    gap = F.unix_micros(F.col(f"__next.{at}").cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    last = rows.where((gap >= wait_ms * 1000) | F.col("__next").isNull()).drop("__next")
    return last.where(F.trim(F.coalesce(F.col(value).cast("string"), F.lit(""))) != "")


def latest_wins(df: DataFrame, session: list[str], at: str, tie: str) -> DataFrame:
    """``df`` with ``stale``: a later request of the session has replaced this one."""
    rows = with_next(df, session, [at, tie], "__next")
    return rows.withColumn("stale", F.col("__next").isNotNull()).drop("__next")


def client_list(df: DataFrame, request: str, suggestion: str, place: str, most: int = 10) -> DataFrame:
    """The first ``most`` suggestions of each request that differ by more than case and outer space."""
    shown = df.withColumn("shown", F.trim(F.col(suggestion))).where("shown != ''")
    first = Window.partitionBy(request, F.lower("shown")).orderBy(place)
    kept = shown.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    position = F.row_number().over(Window.partitionBy(request).orderBy(place))
    return kept.withColumn("position", position).where(F.col("position") <= most)


# Attributes of input fields that hold something private, or a search.
SENSITIVE_TYPES = ("password", "email", "tel", "number", "hidden", "file", "submit", "button", "reset", "checkbox", "radio")
SENSITIVE_AUTOCOMPLETE = ("current-password", "new-password", "cc-number", "cc-csc", "cc-exp", "cc-type", "one-time-code", "bday", "transaction-amount")
SENSITIVE_NAME = "(?i)pass|pwd|password|secret|credit|card|cvv|cvc|token|auth|otp|pin|ssn|tax|security|bank"
SEARCH_NAME = r"(?i)search|query|\bq\b|suggest|autocomplete|lookup|find"


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _named() -> Column:
    return F.concat_ws(" ", *[_text(c) for c in ("name", "id", "placeholder", "aria_label", "class_name")])


def is_sensitive_field() -> Column:
    """Over columns type, autocomplete, name, id, placeholder, aria_label, class_name."""
    kind = F.when(_text("type") == "", "text").otherwise(F.lower("type"))
    return kind.isin(*SENSITIVE_TYPES) | F.lower(_text("autocomplete")).isin(*SENSITIVE_AUTOCOMPLETE) | _named().rlike(SENSITIVE_NAME)


def is_search_field() -> Column:
    """Over the same columns and role, form_role, form_action."""
    hint = (F.lower(_text("type")) == "search") | (F.lower(_text("role")) == "searchbox") | (F.lower(_text("form_role")) == "search")
    return ~is_sensitive_field() & (hint | F.lower(_text("form_action")).contains("search") | _named().rlike(SEARCH_NAME))


# Schemes of pages that belong to the browser.
INTERNAL_PAGES = "^(chrome|chrome-extension|edge|about|devtools|view-source):"


def is_internal_page(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike(INTERNAL_PAGES), F.lit(True))


def validate_settings(df: DataFrame, url: str = "api_base_url", top_k: str = "top_k", debounce: str = "debounce_ms") -> DataFrame:
    """``df`` with valid, the list of errors, and usable values: defaults where a setting is wrong or missing."""
    checks = (
        (F.trim(F.col(url)).rlike("^https?://"), "address must be http or https", "clean_url", F.regexp_replace(F.trim(F.col(url)), "/+$", ""), "http://localhost"),
        (F.col(top_k).between(1, 20), "number of suggestions must lie from 1 to 20", "clean_top_k", F.col(top_k), 5),
        (F.col(debounce).between(50, 1000), "wait must lie from 50 to 1000 ms", "clean_debounce_ms", F.col(debounce), 200),
    )
    good = [F.coalesce(test, F.lit(False)) for test, *_ in checks]
    errors = F.filter(F.array(*[F.when(~ok, F.lit(message)) for ok, (_, message, *_) in zip(good, checks)]), lambda e: e.isNotNull())
    clean = {name: F.when(ok, value).otherwise(default) for ok, (_, _, name, value, default) in zip(good, checks)}
    return df.withColumns({"errors": errors, "valid": good[0] & good[1] & good[2], **clean})
