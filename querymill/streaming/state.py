"""Streaming forms of the stateful operators, and of lookups over a stream of requests."""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from querymill.functions import text
from querymill.operators import index
from querymill.operators.requests import SlidingWindow

#: The state store that transformWithState asks for.
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session with some settings, which are set back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield spark
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class _Limiter(StatefulProcessor):
    """Keeps the times of a client's allowed requests."""

    def __init__(self, most: int, window: float, ttl_ms: int | None):
        self.most, self.window, self.ttl_ms = most, window, ttl_ms

    def init(self, handle) -> None:
        self.times = handle.getListState("times", T.StructType([T.StructField("at", T.DoubleType())]), self.ttl_ms)

    def handleInputRows(self, key, rows, timer_values):
        frame = pd.concat(list(rows)).sort_values(["at", "request_id"], kind="stable")
        state = SlidingWindow(self.most, self.window, [t[0] for t in self.times.get()])
        decided = [state.check(float(at)) for at in frame["at"]]
        self.times.put([(t,) for t in state.times])
        yield pd.DataFrame({"client": key[0], "request_id": frame["request_id"].values, "allowed": [d[0] for d in decided], "retry_after": [d[1] for d in decided]})

    def close(self) -> None:
        pass


def _mode(expire_after: float | None) -> tuple[int | None, str]:
    return (None, "None") if expire_after is None else (int(expire_after * 1000), "ProcessingTime")


def rate_limit_stream(requests: DataFrame, most: int = 120, window: float = 60.0, expire_after: float | None = None) -> DataFrame:
    """(client, request_id, allowed, retry_after) over a stream of (client, request_id long, at double seconds).

    A client's state goes once it has been idle for ``expire_after`` seconds of processing time.  A
    live stream should set it to the window and the delay its requests may have; a replay, whose
    clock isn't the requests', leaves it out; with it, an availableNow run doesn't end by itself.
    """
    ttl, mode = _mode(expire_after)
    rows = requests.where("client is not null").groupBy("client")
    return rows.transformWithStateInPandas(_Limiter(most, window, ttl), "client string, request_id long, allowed boolean, retry_after int", "Append", mode)


class _Cache(StatefulProcessor):
    """Keeps when an entry was filled and by which request."""

    def __init__(self, ttl: float, state_ms: int | None):
        self.ttl, self.state_ms = ttl, state_ms

    def init(self, handle) -> None:
        self.entry = handle.getValueState("entry", "at double, first long", self.state_ms)

    def handleInputRows(self, key, rows, timer_values):
        frame = pd.concat(list(rows)).sort_values(["at", "request_id"], kind="stable")
        held = self.entry.get() if self.entry.exists() else None
        out = []
        for at, request in zip(frame["at"], frame["request_id"]):
            hit = held is not None and at - held[0] < self.ttl
            if not hit:
                held = (float(at), int(request))
            out.append((key[0], int(request), hit, held[1]))
        self.entry.update(held)
        yield pd.DataFrame(out, columns=["key", "request_id", "cached", "first_request"])

    def close(self) -> None:
        pass


def ttl_cache_stream(requests: DataFrame, ttl: float = 300.0, expire_after: float | None = None) -> DataFrame:
    """(key, request_id, cached, first_request) over a stream of (key, request_id long, at double seconds).

    ``expire_after`` is as for ``rate_limit_stream``.
    """
    state_ms, mode = _mode(expire_after)
    rows = requests.where("key is not null").groupBy("key")
    return rows.transformWithStateInPandas(_Cache(ttl, state_ms), "key string, request_id long, cached boolean, first_request long", "Append", mode)


def debounce_stream(keys: DataFrame, wait: str = "200 milliseconds", watermark: str = "1 second") -> DataFrame:
    """(source, at, value): the last of each burst of (source, ts timestamp, value) rows, unless blank."""
    bursts = keys.withWatermark("ts", watermark).groupBy("source", F.session_window("ts", wait).alias("burst"))
    last = bursts.agg(F.max("ts").alias("at"), F.max_by("value", "ts").alias("value"))
    return last.where(F.trim("value") != "").select("source", "at", "value")


def suggestion_stream(requests: DataFrame, cache: DataFrame, limit: int = 10, hot_length: int = 6) -> DataFrame:
    """Each request of (request_id, prefix) of a short prefix with its cached candidates: a join of the stream with the static cache.

    ``answer_stream`` also answers prefixes longer than the cache's.
    """
    typed = requests.withColumn("typed", text.normalize_prefix(F.col("prefix")))
    short = typed.where((F.length("typed") > 0) & (F.length("typed") <= hot_length)).drop("prefix")
    best = cache.where(F.col("rank") <= limit).select(F.col("prefix").alias("typed"), "rank", "normalized_query", "popularity")
    return short.join(best, "typed")


def answer_stream(requests: DataFrame, queries: DataFrame, cache: DataFrame, out: str, limit: int = 10, **settings) -> DataStreamWriter:
    """A writer of (request_id, prefix, rank, normalized_query, source) for a stream of (request_id, prefix), long prefixes included.

    Each batch looks its distinct prefixes up in the cache or among all queries and overwrites
    its own folder below ``out``, so a batch that is run again leaves the same rows.
    """

    def answer(batch: DataFrame, number: int) -> None:
        asked = batch.select("request_id", "prefix").where("prefix is not null")
        found = index.candidates(queries, cache, asked.select("prefix"), limit, **settings).select(F.col("typed").alias("prefix"), "rank", "normalized_query", "source")
        asked.join(found, "prefix").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return requests.writeStream.foreachBatch(answer)


def request_counts_stream(requests: DataFrame, window: str = "1 minute", watermark: str = "5 minutes") -> DataFrame:
    """(start, kind, n, total) per event-time window over a stream of (ts timestamp, kind, value)."""
    grouped = requests.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), "kind")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "kind", "n", "total")
