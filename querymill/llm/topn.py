"""Top N items within every group by partition lower bounds.

Each input partition is sorted locally and lets at most N distinct items of a group go on; the
N-th of them bounds the group's N-th best item from below.  The best bound of each group is joined
back, rows below it are dropped, and what is left is combined and ranked.  The input is read once,
and what is shuffled is at most N items of each group and partition, however many rows a group has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querymill.runtime import written


def _local_best(n: int, schema: pa.Schema):
    """Rows sorted by group, falling score and item: the first ``n`` distinct items of each group, the n-th marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seen = object(), set()
        for batch in batches:
            keep, last = [], []
            for i, (g, item) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if g != group:
                    group, seen = g, set()
                if len(seen) < n and item not in seen:
                    seen.add(item)
                    keep.append(i)
                    last.append(len(seen) == n)
            if keep:
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(keep)).columns, pa.array(last)], schema=schema)

    return run


def _descending(score: Column, kind: T.DataType) -> Column:
    """A value that sorts upwards as ``score`` sorts downwards, without overflow."""
    return F.bitwise_not(score) if isinstance(kind, T.IntegralType) else -score


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, rank_col: str = "new_rank") -> DataFrame:
    """The ``n`` best items of every group: (group, <rank_col> int, item, score).

    Order: score descending, then item ascending by code point; ranks run from 1 without gaps.
    An item that stands several times in a group counts once, with its highest score, so repeated
    rows change nothing.  Rows with a null group, item or score (or a NaN score) are left out;
    groups with fewer than ``n`` items give what they have; an empty table gives no row.  Empty
    and very long texts are ordinary values.  Columns are taken by position internally, so other
    columns may have any name.

    Bounds and survivors meet in the partitioning by group that the ranking needs anyway, or in
    a broadcast if Spark finds the bounds small; nothing is hinted.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    names = [group, rank_col, item, score]
    rows = df.select(df[group].alias("g"), df[score].alias("s"), df[item].alias("i"))
    kinds = {f.name: f.dataType for f in rows.schema}
    rows = rows.where("g is not null and s is not null and i is not null")
    if isinstance(kinds["s"], (T.DoubleType, T.FloatType)):
        rows = rows.where(~F.isnan("s"))
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = T.StructType([*(T.StructField(c, kinds[c]) for c in "gsi"), T.StructField("nth", T.BooleanType())])
    local = rows.sortWithinPartitions("g", F.desc("s"), "i").mapInArrow(_local_best(n, to_arrow_schema(shape)), shape)
    local = written(local, "topn-local")
    best = local.where("nth").groupBy("g").agg(F.min(F.struct(_descending(F.col("s"), kinds["s"]).alias("d"), F.col("i"), F.col("s"))).alias("b"))
    bounds = best.select("g", F.col("b.s").alias("bs"), F.col("b.i").alias("bi"))
    kept = local.select("g", "s", "i").join(bounds, "g", "left").where("bs is null or s > bs or (s = bs and i <= bi)")
    unique = kept.groupBy("g", "i").agg(F.max("s").alias("s"))
    order = Window.partitionBy("g").orderBy(F.desc("s"), "i")
    ranked = unique.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    return ranked.select("g", "r", "i", "s").toDF(*names)
