"""Filling containers of fixed capacity with texts by bin completion.

Texts are spread by hash over blocks of bounded size, and each block is packed on its own: at most
one container a block is left badly filled, so the loss shrinks with the block size and no task
grows with the data.  Within a block best fit decreasing gives the first solution; bin completion
then fills containers around the largest text left, trying undominated fillings in order of their
waste and dropping a branch once its waste can no longer beat the best solution known.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.llm.tokens import settings_rows, token_sizes

BLOCK_DOCS = 16_384
_MOST_TASKS = 5_000
#: Steps that the search of one block and capacity may take, one a partial filling looked at; None searches to the end.
SEARCH_STEPS = 250_000
#: Partial fillings looked at for one container and fillings kept for it, in each pass of the search; the last has no limit.
PASSES = ((100, 1), (1_000, 4), (None, None))


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of sizes: each size, largest first, goes where least room remains."""
    rooms: list[int] = []
    by_room: dict[int, list[list[int]]] = {}
    done: list[list[int]] = []
    for size in sorted(sizes, reverse=True):
        at = bisect_left(rooms, size)
        if at == len(rooms):
            room, container = capacity, []
            done.append(container)
        else:
            room = rooms[at]
            container = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        container.append(size)
        left = room - size
        if left:
            if not by_room.get(left):
                insort(rooms, left)
                by_room[left] = []
            by_room[left].append(container)
    return done


def least_containers(sizes: list[int], capacity: int) -> int:
    """A lower bound: total size, and for each threshold the texts that can't share a container."""
    if not sizes:
        return 0
    total = sum(sizes)
    bound = -(-total // capacity)
    ordered = sorted(sizes)
    prefix = [0]
    for s in ordered:
        prefix.append(prefix[-1] + s)
    half = bisect_right(ordered, capacity // 2)
    for small in sorted(set(ordered[:half]))[:: max(1, half // 64)] + [0]:
        big = bisect_right(ordered, capacity - small)  # from here on alone
        alone, paired = len(ordered) - big, big - half
        low = bisect_left(ordered, small)
        spare = paired * capacity - (prefix[big] - prefix[half])
        rest = prefix[half] - prefix[low] - spare
        bound = max(bound, alone + paired + max(0, -(-rest // capacity)))
    return bound


def _dominated(filling: tuple[int, ...], by: tuple[int, ...]) -> bool:
    """Whether the sizes of ``filling`` can be placed within the sizes of ``by`` as containers."""
    if len(filling) > 6 or sum(filling) > sum(by):
        return False

    def place(i: int, room: tuple[int, ...]) -> bool:
        if i == len(filling):
            return True
        return any(r >= filling[i] and place(i + 1, (*room[:k], r - filling[i], *room[k + 1 :])) for k, r in enumerate(room))

    return place(0, by)


class _Steps:
    """What a search may still spend, and whether anything was left out for that."""

    def __init__(self, most: int | None):
        self.left, self.cut = (1 << 62 if most is None else most), False


def undominated_fillings(
    room: int, sizes: list[int], counts: dict[int, int], most_waste: int, steps: _Steps | None = None, looked: int | None = None, width: int | None = None
) -> list[tuple[int, ...]]:
    """The undominated fillings of ``room`` from ascending distinct ``sizes`` that waste at most ``most_waste``, least waste first.

    ``looked`` and ``width`` bound the partial fillings looked at and the fillings kept; where that
    leaves something out, ``steps.cut`` is set.
    """
    steps = steps or _Steps(None)
    found: list[tuple[int, tuple[int, ...]]] = []
    most_here = min(steps.left, looked if looked is not None else steps.left)
    nodes, full = 0, 0
    # room left, largest size that may follow, sizes chosen, smallest size left out though it was there
    stack: list[tuple[int, int, tuple[int, ...], int]] = [(room, bisect_right(sizes, room) - 1, (), room + 1)]
    while stack:
        if nodes >= most_here or (width is not None and full >= width):
            steps.cut = True
            break
        left, at, chosen, skipped = stack.pop()
        nodes += 1
        at = min(at, bisect_right(sizes, left) - 1)
        while at >= 0 and counts.get(sizes[at], 0) <= chosen.count(sizes[at]):
            at -= 1
        if left == 0 or at < 0:
            # a filling that a size left out would still fit into is dominated by the one with it
            if left <= most_waste and left < skipped:
                found.append((left, chosen))
                full += left == 0
            continue
        size = sizes[at]
        if at > 0 or size <= most_waste:
            stack.append((left, at - 1, chosen, min(skipped, size)))  # without this size
        stack.append((left - size, at, (*chosen, size), skipped))
    steps.left -= nodes
    found.sort(key=lambda f: (f[0], tuple(-s for s in f[1])))
    kept: list[tuple[int, ...]] = []
    for _, filling in found:
        if width is not None and len(kept) == width:
            steps.cut = True
            break
        if not any(_dominated(filling, k) for k in kept):
            kept.append(filling)
    return kept


def _complete(sizes: list[int], capacity: int, best: list[list[int]], bound: int, steps: _Steps, looked: int | None, width: int | None) -> list[list[int]]:
    """The best solution of one depth-first pass over the fillings of each container, ``best`` if it finds none with fewer containers."""
    total = sum(sizes)
    counts = Counter(sizes)
    distinct = sorted(counts)

    def take(size: int) -> None:
        counts[size] -= 1
        if not counts[size]:
            distinct.pop(bisect_left(distinct, size))

    def give(size: int) -> None:
        if not counts[size]:
            insort(distinct, size)
        counts[size] += 1

    # one entry a container: its fillings still to try, the one in use, its waste
    path: list[list] = []
    waste = 0
    while len(best) > bound:
        if steps.left <= 0:
            steps.cut = True
            break
        allowed = (len(best) - 1) * capacity - total
        if distinct and waste <= allowed:
            largest = distinct[-1]
            take(largest)
            options = undominated_fillings(capacity - largest, distinct, counts, allowed - waste, steps, looked, width)
            path.append([largest, options[::-1], None, 0])
        elif not distinct and len(path) < len(best):
            best = [[p[0], *p[2]] for p in path]
        # use the next filling of the deepest container that has one
        while path:
            entry = path[-1]
            if entry[2] is not None:
                for size in entry[2]:
                    give(size)
                waste -= entry[3]
                entry[2] = None
            if entry[1]:
                entry[2] = entry[1].pop()
                entry[3] = capacity - entry[0] - sum(entry[2])
                waste += entry[3]
                for size in entry[2]:
                    take(size)
                break
            give(entry[0])
            path.pop()
        if not path:
            break
    return best


def bin_completion(sizes: list[int], capacity: int, search_steps: int | None = SEARCH_STEPS) -> tuple[list[list[int]], bool]:
    """(containers as lists of sizes, whether fewer are impossible): branch and bound from best fit decreasing.

    Passes look at ever more fillings of each container, the last at all; each may take a half of
    the steps that are left, the last all.  The search ends early at the lower bound, or when a
    pass leaves nothing out; ``search_steps=None`` lets it end in no other way.
    """
    best = best_fit_decreasing(sizes, capacity)
    bound = least_containers(sizes, capacity)
    left = search_steps
    for number, (looked, width) in enumerate(PASSES):
        if len(best) <= bound:
            return best, True
        last = looked is None
        # the first pass may go on until it has come down to the last text once
        steps = _Steps(left if last or left is None else min(left, max(left // 2, 0 if number else 10 * len(sizes))))
        began = steps.left
        best = _complete(sizes, capacity, best, bound, steps, looked, width)
        if not steps.cut:
            return best, True
        if left is not None:
            left -= began - steps.left
    return best, len(best) <= bound


def pack_block(frame: pd.DataFrame, capacity: int, search_steps: int | None = SEARCH_STEPS) -> tuple[list[tuple], bool]:
    """(container, doc_id, piece, start_token, n_tokens) rows, containers numbered from 0; and whether fewer are impossible."""
    rows: list[tuple] = []
    by_size: dict[int, list[tuple]] = {}
    sizes: list[int] = []
    container = 0
    for doc, n in zip(frame["doc_id"], frame["n_tokens"]):
        full, rest = divmod(int(n), capacity)
        for piece in range(full):
            rows.append((container, doc, piece, piece * capacity, capacity))
            container += 1
        if rest or not full:
            by_size.setdefault(rest, []).append((doc, full, full * capacity, rest))
            if rest:
                sizes.append(rest)
    packed, least = bin_completion(sizes, capacity, search_steps)
    first = container
    for filling in packed:
        for size in filling:
            rows.append((container, *by_size[size].pop()))
        container += 1
    for empty in by_size.get(0, []):
        rows.append((first if packed else 0, *empty))
    return rows, least


_OUT = "capacity_id int, container_id long, doc_id long, piece int, start_token long, n_tokens long, block_least boolean"


def _pack(block_docs: int, search_steps: int | None):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        block, capacity_id, capacity = (int(x) for x in key)
        frame = frame.sort_values(["n_tokens", "doc_id"], ascending=[False, True], na_position="last", kind="stable")
        out, offset = [], 0
        # a hash block is about block_docs texts; a larger one (ids that aren't unique) is cut, interleaved so that every part has all sizes
        parts = max(1, round(len(frame) / block_docs))
        for p in range(parts):
            rows, least = pack_block(frame.iloc[p::parts], capacity, search_steps)
            out.extend((capacity_id, (block << 32) + offset + c, *rest, least) for c, *rest in rows)
            offset += max((r[0] for r in rows), default=-1) + 1
        columns = ["capacity_id", "container_id", "doc_id", "piece", "start_token", "n_tokens", "block_least"]
        result = pd.DataFrame(out, columns=columns)
        return result.astype({"doc_id": "Int64"}) if len(result) else result

    return run


def _usable(capacities: DataFrame) -> list[tuple[int, int]]:
    return sorted(map(tuple, settings_rows(capacities.select("capacity_id", "capacity_tokens").where("capacity_tokens >= 1 and capacity_id is not null").distinct())))


def _each_capacity(capacities: DataFrame) -> Column:
    """A row of (id, tokens) for each capacity of the table of settings."""
    none = F.array().cast("array<struct<id:int,tokens:int>>")
    rows = [F.struct(F.lit(int(c)).alias("id"), F.lit(int(n)).alias("tokens")) for c, n in _usable(capacities)]
    return F.explode(F.array(*rows) if rows else none)


def pack_texts(
    df: DataFrame,
    capacities: DataFrame,
    record: str = "doc_id",
    text: str = "text",
    tokenizer_path: str | None = None,
    block_docs: int = BLOCK_DOCS,
    search_steps: int | None = SEARCH_STEPS,
) -> DataFrame:
    """Every text assigned to containers of each capacity: (capacity_id, container_id, doc_id, piece, start_token, n_tokens, block_least).

    A text longer than a container fills containers of its own and leaves its rest as one more
    item; no other text is divided.  No container holds more than its capacity.  block_least says
    that the texts of this block can't be packed into fewer containers; where it is false the
    search ended at ``search_steps`` with the best found.  ``search_steps=None`` always searches to
    the end, which only suits small blocks.

    Null texts are left out, empty texts take no room and go to a container of their block, a null
    id is kept, repeated rows are texts of their own, an empty table gives no row; capacities that
    are null or below 1 are left out.  Other columns may have any name.  ``capacities``
    (capacity_id, capacity_tokens) is a small table of settings.
    """
    wanted = _usable(capacities)
    if not wanted:
        return df.sparkSession.createDataFrame([], _OUT)
    blocks = max(1, -(-df.count() // block_docs))
    sizes = token_sizes(df, text, {record: "doc_id"}, tokenizer_path).where("n_tokens is not null")
    sizes = sizes.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens")
    spread = sizes.select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(blocks)).alias("block"), _each_capacity(capacities).alias("c"))
    keyed = spread.select("doc_id", "n_tokens", "block", F.col("c.id").alias("capacity_id"), F.col("c.tokens").alias("capacity"))
    # packing costs time, not bytes: a fixed number of partitions keeps blocks from being merged into few tasks
    spread = keyed.repartition(min(blocks * len(wanted), _MOST_TASKS), "block", "capacity_id", "capacity")
    return spread.groupBy("block", "capacity_id", "capacity").applyInPandas(_pack(block_docs, search_steps), _OUT)


def packing_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_id, n_containers, n_tokens, least_containers, unused_share, least_share) of a packing.

    least_containers bounds the number from below by the tokens alone; least_share is the share of
    texts whose block has been proven to need no fewer containers.
    """
    total = packed.groupBy("capacity_id").agg(
        F.count_distinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.avg(F.col("block_least").cast("double")).alias("least_share")
    )
    room = F.col("n_containers") * F.col("capacity_tokens")
    return total.join(capacities, "capacity_id").select(
        "capacity_id", "n_containers", "n_tokens",
        F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"),
        (1 - F.col("n_tokens") / room).alias("unused_share"), "least_share",
    )


def packing_checks(df: DataFrame, packed: DataFrame, capacities: DataFrame, record: str = "doc_id", text: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """(capacity_id, n_texts, every_token_once, within_capacity, divided_only_if_longer, nearly_full) of a packing of ``df``.

    nearly_full: at most one container a block and one in a hundred more than the tokens fill.
    Null ids are left out of the token counts, as texts without one can't be told apart.
    """
    sizes = token_sizes(df, text, {record: "doc_id"}, tokenizer_path).where("n_tokens is not null")
    whole = sizes.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("texts"))
    each = _each_capacity(capacities)
    wanted = whole.select("*", each.alias("c")).select("doc_id", "size", "texts", F.col("c.id").alias("capacity_id"), F.col("c.tokens").alias("capacity_tokens"))
    docs = packed.groupBy("capacity_id", "doc_id").agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("pieces"), F.count_if(F.col("piece") == 0).alias("begun"))
    met = wanted.join(docs, ["capacity_id", "doc_id"], "full")
    once = (F.col("size") == F.col("placed")) & (F.col("texts") == F.col("begun"))
    divided = F.col("pieces") <= F.greatest(F.col("texts"), F.ceil(F.col("size") / F.col("capacity_tokens")) + F.col("texts") - 1)
    ok = lambda c: F.coalesce(F.bool_and(F.coalesce(c, F.lit(False)) | F.col("doc_id").isNull()), F.lit(True))
    texts = met.groupBy("capacity_id").agg(F.sum("texts").alias("n_texts"), ok(once).alias("every_token_once"), ok(divided).alias("divided_only_if_longer"))
    rooms = packed.groupBy("capacity_id", "container_id").agg(F.sum("n_tokens").alias("n")).join(capacities.select("capacity_id", "capacity_tokens").distinct(), "capacity_id")
    least = F.ceil(F.sum("n") / F.max("capacity_tokens"))
    blocks = F.count_distinct(F.shiftright("container_id", 32))
    held = rooms.groupBy("capacity_id").agg(
        F.bool_and(F.col("n") <= F.col("capacity_tokens")).alias("within_capacity"), (F.count(F.lit(1)) <= least * F.lit(1.01) + blocks).alias("nearly_full")
    )
    return texts.join(held, "capacity_id").select("capacity_id", "n_texts", "every_token_once", "within_capacity", "divided_only_if_longer", "nearly_full")
