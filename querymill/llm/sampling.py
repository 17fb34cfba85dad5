"""Uniform samples: fixed size by block acceptance-rejection, and a stable one by permutation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querymill.operators.ordering import numbered
from querymill.runtime import file_path, written

_GROUPS = "file string, row_group int, n_rows long"
_PLACE = ["file", "row_group", "offset"]
_MOST_TASKS = 1_000


def _opened(uri: str):
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = (fs.LocalFileSystem(), file_path(uri)) if uri.startswith("file:") or "://" not in uri else fs.FileSystem.from_uri(uri)
    return pq.ParquetFile(path, filesystem=system)


def _footers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for uri in frame["file"]:
            meta = _opened(uri).metadata
            out += [(uri, g, meta.row_group(g).num_rows) for g in range(meta.num_row_groups)]
        yield pd.DataFrame(out, columns=["file", "row_group", "n_rows"])


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_group, n_rows) of every Parquet row group under ``path``; only footers are read, by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"))
    return files.mapInPandas(_footers, _GROUPS)


def _drawn(below: int, *parts) -> Column:
    """A number from 0 below ``below`` that depends on the parts alone: the first 15 hexadecimal digits of their MD5."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % F.lit(below)


def _rows_at(places: DataFrame, columns: list[str], shape: T.StructType, tasks: int) -> DataFrame:
    """The rows at (file, row_group, offset, draw), with the draw: each row group that holds one is read once, by one task."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = T.StructType([*[shape[c] for c in columns], T.StructField("draw", T.LongType())])
    target = to_arrow_schema(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                source = _opened(row["file"])
                there = [c for c in columns if c in source.schema_arrow.names]
                found = source.read_row_group(row["row_group"], columns=there).take([h["offset"] for h in row["hits"]])
                n = found.num_rows
                given = [found.column(f.name).cast(f.type) if f.name in there else pa.nulls(n, f.type) for f in target][:-1]
                table = pa.Table.from_arrays([*given, pa.array([h["draw"] for h in row["hits"]], pa.int64())], schema=target)
                yield from table.to_batches()

    hits = F.sort_array(F.collect_list(F.struct("offset", "draw"))).alias("hits")
    groups = places.repartition(tasks, "file", "row_group").groupBy("file", "row_group").agg(hits)
    return groups.mapInArrow(run, kept)


def block_sample(
    spark: SparkSession, path: str, columns: list[str], k: int, seed: int = 0, arrived: Column | None = None
) -> DataFrame:
    """``k`` rows of the Parquet table at ``path``, every row with the same chance: (columns...).

    A draw picks a row group uniformly and an offset below the size of the largest group; it is
    rejected if the group has no such row or an earlier draw hit the same row, so accepted draws
    are uniform over rows, however many there are: their number is never counted.  Draws are
    numbered and made from the number and the seed alone, and the first ``k`` accepted ones win:
    the same files give the same sample.  Draws are made in rounds of doubling size until ``k``
    are accepted; only the row groups of accepted draws are read, each by one task.

    ``arrived`` is a condition on ``columns`` for the rows seen so far; draws that hit other rows
    are rejected too.  Rows count as they stand, nulls, blanks and repeated rows included.  Once
    there were four draws for each possible place and still fewer than ``k`` rows, hardly more than
    ``k`` can exist: the places not yet hit follow in an order of their hashes.  So if no more than
    ``k`` rows exist, all come out; an empty table gives no row.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    shape = spark.read.parquet(path).schema
    groups = numbered(row_groups(spark, path).where("n_rows > 0"), ["file", "row_group"], "g").withColumn("g", F.col("g") - 1)
    n_groups, largest = groups.agg(F.count(F.lit(1)), F.coalesce(F.max("n_rows"), F.lit(0))).first()
    if not k or not n_groups:
        return spark.createDataFrame([], T.StructType([shape[c] for c in columns]))
    tasks = min(n_groups, k, _MOST_TASKS)
    first, size, places, rows = 0, 2 * k + 100, None, None
    while True:
        if first < 4 * n_groups * largest:
            tries = spark.range(first, first + size).select(
                F.col("id").alias("draw"), _drawn(n_groups, seed, "group", F.col("id")).alias("g"), _drawn(largest, seed, "row", F.col("id")).alias("offset")
            )
            hits = tries.join(groups, "g").where("offset < n_rows").groupBy(*_PLACE).agg(F.min("draw").alias("draw"))
        else:
            every = groups.select("file", "row_group", "g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1)).alias("offset"))
            hits = every.select(*_PLACE, (F.lit(first) + _drawn(1 << 59, seed, "rest", F.col("g"), F.col("offset"))).alias("draw"))
        last = first >= 4 * n_groups * largest
        hits = written(hits if places is None else hits.join(places, _PLACE, "left_anti"), "draws")
        places = hits if places is None else places.unionByName(hits)
        if arrived is not None:
            found = written(_rows_at(hits, columns, shape, tasks).where(arrived), "arrived")
            rows = found if rows is None else rows.unionByName(found)
        if last or (places if arrived is None else rows).count() >= k:
            break
        first, size = first + size, first + size
    if arrived is None:
        rows = _rows_at(written(places.orderBy("draw").limit(k), "chosen"), columns, shape, tasks)
    return rows.orderBy("draw").limit(k).select(*columns)


def fresh_rows(n_old: int, n_new: int, k: int, seed: int) -> int:
    """How many of ``k`` rows drawn without replacement come from the new part: a hypergeometric draw, row by row from an urn."""
    import hashlib

    fresh = 0
    for i in range(min(k, n_old + n_new)):
        number = int(hashlib.md5(f"{seed}|urn|{i}".encode()).hexdigest()[:15], 16)
        fresh += number % (n_old + n_new - i) < n_new - fresh
    return fresh


def merge_samples(old: DataFrame, n_old: int, new: DataFrame, n_new: int, k: int, seed: int) -> DataFrame:
    """A uniform sample of ``k`` of ``n_old + n_new`` rows from uniform samples of either part.

    How many come from the new part is a hypergeometric draw; which ones, a hash of seed and row.
    Each part must hold at least the smaller of ``k`` and its number of rows.  Pieces can thus be
    added one after the other, with another seed each, without reading the earlier ones again.
    """
    k = min(k, n_old + n_new)
    fresh = fresh_rows(n_old, n_new, k, seed)
    key = lambda part: F.md5(F.concat_ws("|", F.lit(str(seed)), *[part[c].cast("string") for c in part.columns]))
    pick = lambda part, n: part.orderBy(key(part), *part.columns).limit(n)
    return pick(old, k - fresh).unionByName(pick(new, fresh))


# The identifier domain has 60 bits: two halves of 30 bits, so that a half times a 31-bit constant
# stays within a 64-bit integer in any SQL engine.
_HALF = (1 << 30) - 1
DOMAIN = 1 << 60
#: Fixed odd constants of the round function, one pair a round.
_ROUNDS = [(668265263, 374761393), (974634777, 842893061), (741103597, 927538811), (536870909, 613566757), (805306457, 402653189), (715827883, 858993463)]


def text_identifier(text: Column) -> Column:
    """The text's number in the 60-bit domain: the first 15 hexadecimal digits of its MD5; two texts may share one."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; plain nesting would copy its expression at each use."""
    return F.transform(F.array(value), use)[0]


def _round(half: Column, step: Column) -> Column:
    low = lambda x: x.bitwiseAND(F.lit(_HALF))
    fold = lambda bits: lambda x: x.bitwiseXOR(F.shiftright(x, bits))
    first = _let(low(half.bitwiseXOR(step["key"]) * step["a"]), fold(15))
    return _let(low(first * step["b"]), fold(13))


def permuted(identifier: Column, seed: int) -> Column:
    """The identifier's place under the Feistel permutation of the domain that ``seed`` names."""
    steps = F.array(*[
        F.struct(F.lit(key).cast("long").alias("key"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"))
        for key, (a, b) in zip(round_keys(seed), _ROUNDS)
    ])
    halves = F.struct(F.shiftright(identifier, 30).alias("l"), identifier.bitwiseAND(F.lit(_HALF)).alias("r"))
    step = lambda h, s: F.struct(h["r"].alias("l"), h["l"].bitwiseXOR(_round(h["r"], s)).alias("r"))
    return F.aggregate(steps, halves, step, lambda h: h["l"] * F.lit(1 << 30) + h["r"])


def round_keys(seed: int) -> list[int]:
    """A 30-bit key per round, from the seed by a linear congruential step."""
    keys, x = [], seed & ((1 << 62) - 1)
    for _ in _ROUNDS:
        x = (x * 6364136223846793005 + 1442695040888963407) & ((1 << 64) - 1)
        keys.append((x >> 33) & _HALF)
    return keys


def stable_sample(df: DataFrame, text: str, rate: float, seed: int = 0) -> DataFrame:
    """Distinct values of ``text`` whose permuted identifier lies under ``rate`` x domain size: (text).

    A Feistel network permutes the 60-bit domain of identifiers without collisions and without
    state (texts that share an identifier are chosen together), so the choice depends on the value and the seed alone: the same for every run, order and file
    layout, and a chosen value stays chosen when rows are added.  A larger rate keeps all members
    of a smaller one.  Null is left out; the empty text is a value like any other; repeated rows
    give one value; an empty table gives no row.  The filter precedes the shuffle.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate must lie between 0 and 1")
    values = df.select(df[text].alias("t")).where("t is not null")
    chosen = values.where(permuted(text_identifier(F.col("t")), seed) < F.lit(int(rate * DOMAIN)))
    return chosen.select("t").distinct().toDF(text)
