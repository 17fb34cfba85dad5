"""Records that are the same but for spacing, letter case, punctuation or the order of fields.

Canonical hashes, of eight bytes each, go to the partition of their filter block, where two
Bloom filters are built and merged, of hashes seen once and of hashes seen again; together they hold
every hash that may occur twice anywhere.  Only such rows are shuffled, by their exact canonical
text; all others are singletons and leave at once.  The filter has a fixed number of bits a row;
where it is larger than may be broadcast, it is built and asked in several parts, one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.runtime import written

#: Bits of one filter block; a hash sets all its bits within one block.
BLOCK_BITS = 1 << 16
_WORDS = BLOCK_BITS // 64
_PROBES = 4

_FACET = r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+:[\p{L}\p{N}]+)[^\p{L}\p{N}]*$"


def canonical_record(text: Column) -> Column:
    """Lower-case letters and digits of the text in order, then its facets sorted; null without letter or digit.

    A facet is a piece between white space made of letters and digits around one colon, whatever
    punctuation stands at its ends.
    """
    low = F.lower(text)
    pieces = F.split(low, r"(?U)[\s\x1c-\x1f]+")
    facets = F.array_sort(F.transform(F.filter(pieces, lambda p: p.rlike(_FACET)), lambda p: F.regexp_extract(p, _FACET, 1)))
    words = F.array_join(F.filter(pieces, lambda p: ~p.rlike(_FACET)), "")
    letters = lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")
    with_facets = F.concat(letters(words), F.lit(" "), F.array_join(facets, " "))
    key = F.when(F.contains(text, F.lit(":")), with_facets).otherwise(F.concat(letters(low), F.lit(" ")))
    return F.when(text.isNotNull() & (F.length(F.trim(key)) > 0), key)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """The bit positions of each hash in its block."""
    x = hashes.view(np.uint64)
    return np.stack([(x >> np.uint64(s)) & np.uint64(BLOCK_BITS - 1) for s in (12, 24, 36, 48)[:_PROBES]], axis=1).astype(np.int64)


_FLUSH_HASHES = 500_000


def _once_a_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, h) to one row a block: the hashes that the task saw once and those it saw again, eight bytes each."""
    held: list[np.ndarray] = []
    n = 0

    def flush() -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held)
        values, first, counts = np.unique(rows[:, 1], return_index=True, return_counts=True)
        block = rows[first, 0]
        order = np.argsort(block, kind="stable")
        values, counts, block = values[order], counts[order], block[order]
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        once, again = [], []
        for v, c in zip(np.split(values, starts[1:]), np.split(counts, starts[1:])):
            once.append(v[c == 1].tobytes())
            again.append(v[c > 1].tobytes())
        for i in range(0, len(starts), 10_000):
            part = slice(i, i + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(block[starts[part]], pa.int64()), pa.array(once[part], pa.binary()), pa.array(again[part], pa.binary())], names=["block", "once", "again"])

    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
            n += batch.num_rows
        if n >= _FLUSH_HASHES:
            yield from flush()
            held, n = [], 0
    if n:
        yield from flush()


def _merge(key: tuple, tasks: pa.Table) -> pa.Table:
    """The filter of what is repeated in one block: a hash whose bits an earlier task has set, or that its own task saw again."""
    once, again = np.zeros(BLOCK_BITS, dtype=bool), np.zeros(BLOCK_BITS, dtype=bool)
    for single, twice in zip(tasks.column("once").to_pylist(), tasks.column("again").to_pylist()):
        bits = _bits(np.frombuffer(single, dtype=np.int64))
        seen = bits[once[bits].all(axis=1)]
        repeated = _bits(np.frombuffer(twice, dtype=np.int64))
        again[seen] = again[repeated] = True
        once[bits] = once[repeated] = True
    words = np.packbits(again, bitorder="little").view(np.int64)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "again": pa.array([words], pa.list_(pa.int64()))})


def filter_blocks(rows: int, bits_per_row: int = 16) -> int:
    """Blocks of the filter for ``rows`` rows."""
    return max(1, -(-rows * bits_per_row // BLOCK_BITS))


def repeat_filter(hashes: DataFrame) -> DataFrame:
    """The merged filter of possibly repeated hashes of (block, h): (block, again)."""
    parts = hashes.select("block", "h").mapInArrow(_once_a_task, "block long, once binary, again binary")
    return written(parts.groupBy("block").applyInArrow(_merge, "block long, again array<long>"), "repeat-filter")


def may_repeat(rows: DataFrame, again: DataFrame) -> DataFrame:
    """``rows`` (with ``block`` and ``h``) and the boolean ``repeat``: false only if no other row has its hash.

    ``again``, whose size the caller bounds, is broadcast.
    """
    joined = rows.join(F.broadcast(again), "block", "left")

    def bit(shift: int) -> Column:
        at = F.shiftrightunsigned("h", shift).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")
        word = F.expr("again")[F.shiftright(at, 6)]
        return F.call_function("shiftrightunsigned", word, at.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1

    test = bit(12) & bit(24) & bit(36) & bit(48)
    return joined.withColumn("repeat", F.coalesce(test, F.lit(False))).drop("again", "block")


def _unsigned_mod(h: Column, blocks: int) -> Column:
    """The remainder of the 64-bit value taken as unsigned."""
    high, low = F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.pmod(F.pmod(high, F.lit(blocks)) * F.lit((1 << 32) % blocks) + low, F.lit(blocks))


def collapse_copies(
    df: DataFrame,
    record: str,
    text: str,
    copies: str,
    copy_ids: str,
    bits_per_row: int = 16,
    most_bytes: int = 64 << 20,
) -> tuple[DataFrame, DataFrame]:
    """Records whose ``text`` is the same but for its writing: (records, members).

    members: (qid_a, qid_b), the smallest record id of a group and each other id of it, once.
    records: (qid, n_copies), one row per group, singletons included.  n_copies counts the
    distinct ids of the group, those listed in ``copy_ids`` (a comma list) included, and for each
    record as many more as ``copies`` says beyond its list; of rows of one id the largest number
    counts.  A null list is empty, a null or negative number is 0.

    Rows with a null id, a null text or a text without letter or digit are left out; a row
    delivered again is the same record; ids are compared as text; an empty table gives empty
    results; other columns may have any name.  Groups are exact: the filter only decides which
    rows need the shuffle.  It takes ``bits_per_row`` however many rows there are; beyond
    ``most_bytes`` rows are written by part of the filter, and each part is broadcast on its own.
    """
    blocks, most_blocks = filter_blocks(df.count(), bits_per_row), max(1, most_bytes * 8 // BLOCK_BITS)
    parts = -(-blocks // most_blocks)
    rows = df.select(
        df[record].cast("string").alias("qid"),
        canonical_record(df[text]).alias("key"),
        F.greatest(F.coalesce(df[copies].cast("long"), F.lit(0)), F.lit(0)).alias("n"),
        F.coalesce(df[copy_ids], F.lit("")).alias("ids"),
    ).where("qid is not null and key is not null")
    rows = rows.withColumn("h", F.xxhash64("key")).withColumn("block", _unsigned_mod(F.col("h"), blocks))
    # the canonical form is made once; each part is read twice, for its filter and to ask it
    if parts == 1:
        keyed = written(rows, "canonical")
        pieces = [keyed]
    else:
        keyed = written(rows.withColumn("part", F.floor(F.col("block") / most_blocks).cast("int")), "canonical", "part")
        pieces = [keyed.where(F.col("part") == p).drop("part") for p in range(parts)]
    asked = [written(may_repeat(piece, repeat_filter(piece)), "records") for piece in pieces]
    rows = asked[0]
    for more in asked[1:]:
        rows = rows.unionByName(more)
    repeated, single = rows.where("repeat"), rows.where("not repeat")
    names = lambda ids: F.filter(F.transform(F.split(ids, ","), lambda x: F.trim(x)), lambda x: x != "")
    # a group's key is long, its smallest id short: join on the hash and the id from here on
    smallest = repeated.groupBy("key").agg(F.min("qid").alias("qid_a"))
    grouped = repeated.join(smallest, "key").select("qid_a", "qid", "n", "ids")
    members = grouped.where("qid != qid_a").select("qid_a", F.col("qid").alias("qid_b")).distinct()
    listed = grouped.groupBy("qid_a", "qid").agg(F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_set(names(F.col("ids"))))).alias("ids"))
    listed = listed.withColumn("ids", F.array_except("ids", F.array("qid")))
    unnamed = F.greatest(F.col("n") - F.size("ids"), F.lit(0))
    named = listed.select("qid_a", F.explode(F.array_append("ids", F.col("qid"))).alias("member"), F.lit(0).cast("long").alias("more"))
    counted = (
        named.distinct().groupBy("qid_a").agg(F.count(F.lit(1)).alias("c"))
        .unionByName(listed.groupBy("qid_a").agg(F.sum(unnamed).alias("c")))
        .groupBy("qid_a").agg(F.sum("c").alias("n_copies"))
    )
    alone = single.withColumn("ids", F.array_except(F.array_distinct(names(F.col("ids"))), F.array("qid")))
    alone = alone.select("qid", (F.lit(1) + F.greatest(F.col("n"), F.size("ids").cast("long"))).alias("n_copies"))
    records = alone.unionByName(counted.withColumnRenamed("qid_a", "qid"))
    return records, members
