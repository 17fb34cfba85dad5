"""Per-key results when a few keys hold most records.

Rows are combined within each input task, range partitioned by (field, key, value, source task)
with Spark's sampled quantiles, so that a heavy key covers as many partitions as its size asks
for, and reduced in sorted order to one partial state per key and partition.  Keys that lie
inside one partition are complete; only the first and last key of each partition, at most two
per partition, are stitched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querymill.runtime import written

_FLUSH_ROWS = 200_000


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count equal (field, key, value) rows within bounded buffers."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).group_by(["field_name", "key_text", "value"]).aggregate([("n", "sum")])
        yield from table.rename_columns(["field_name", "key_text", "value", "n"]).to_batches(max_chunksize=20_000)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _FLUSH_ROWS:
            yield from flush()
            held, rows = [], 0
    if held:
        yield from flush()


_STATE = "field_name string, key_text string, n_rows long, n_values long, first_value string, last_value string, task int, edge boolean"


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One state per key of a sorted partition: rows, distinct values, first and last value."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    names = ["field_name", "key_text", "n_rows", "n_values", "first_value", "last_value", "task", "edge"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_()]
    out: list[list] = []
    current: list | None = None
    first = True

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def differs(column: pa.Array) -> np.ndarray:
        """Whether each value but the first is another than the one before; null is a value."""
        here, before = column[1:], column[:-1]
        return pc.fill_null(pc.not_equal(here, before), pc.xor(pc.is_null(here), pc.is_null(before))).to_numpy(zero_copy_only=False)

    for batch in batches:
        if not batch.num_rows:
            continue
        field, key, value, n = batch.columns
        change = differs(field) | differs(key)
        starts = np.flatnonzero(np.r_[True, change])
        # a new value begins where the key or the value changes and the value is no null
        new = np.r_[True, change | differs(value)] & pc.is_valid(value).to_numpy(zero_copy_only=False)
        begun = np.flatnonzero(new)
        at = np.searchsorted(begun, starts)
        ends = np.r_[starts[1:], len(new)]
        has = (at < len(begun)) & (begun[np.minimum(at, len(begun) - 1)] < ends if len(begun) else False)
        firsts = value.take(pa.array(np.where(has, begun[np.minimum(at, max(0, len(begun) - 1))] if len(begun) else 0, 0), mask=~has)).to_pylist()
        lasts = value.take(pa.array(ends - 1)).to_pylist()
        rows, values = np.add.reduceat(n.to_numpy(), starts).tolist(), np.add.reduceat(new.astype(np.int64), starts).tolist()
        keys = zip(field.take(pa.array(starts)).to_pylist(), key.take(pa.array(starts)).to_pylist(), rows, values, firsts, lasts)
        for f, k, c, v, low, high in keys:
            if current is not None and current[0] == f and current[1] == k:
                current[2] += c
                current[3] += v - (low is not None and low == current[5])
                current[4] = low if current[4] is None else current[4]
                current[5] = current[5] if high is None else high
                continue
            if current is not None:
                current[7] = first
                first = False
                out.append(current)
                if len(out) >= 20_000:
                    yield emit()
                    out = []
            current = [f, k, c, v, low, high, task, False]
    if current is not None:
        current[7] = True
        out.append(current)
    if out:
        yield emit()


def key_counts(
    df: DataFrame, keys: list[str], value: str, partitions: int | None = None, rows_col: str = "n_rows", values_col: str = "n_queries"
) -> DataFrame:
    """Rows and distinct non-null ``value`` per value of each column in ``keys``.

    Returns (field_name, key_text, <rows_col>, <values_col>), one row per key column and value.
    Null keys are left out, a null ``value`` counts as a row but not as a value, blank keys and
    trailing spaces are keys like any other, repeated rows all count, an empty table gives no
    row.  Other columns of ``df`` are not read and may have any name.
    """
    if not keys:
        raise ValueError("at least one key column is needed")
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = F.explode(F.array(*[F.struct(F.lit(k).alias("field_name"), df[k].cast("string").alias("key_text")) for k in keys]))
    long = (
        df.select(pieces.alias("k"), df[value].cast("string").alias("value"))
        .where("k.key_text is not null")
        .select("k.field_name", "k.key_text", "value", F.lit(1).cast("long").alias("n"))
    )
    combined = long.mapInArrow(_combine, "field_name string, key_text string, value string, n long")
    # written, as sampling the quantiles would combine everything once more
    combined = written(combined.withColumn("source_task", F.spark_partition_id()), "combined")
    order = ["field_name", "key_text", "value", "source_task"]
    states = (
        combined.repartitionByRange(partitions, *order)
        .sortWithinPartitions(*order)
        .select("field_name", "key_text", "value", "n")
        .mapInArrow(_states, _STATE)
    )
    states = written(states, "key-states")
    whole = states.where("not edge").select("field_name", "key_text", "n_rows", "n_values")
    same_key = Window.partitionBy("field_name", "key_text").orderBy("task")
    stitched = (
        states.where("edge")
        .withColumn("before", F.lag("last_value").over(same_key))
        .groupBy("field_name", "key_text")
        .agg(
            F.sum("n_rows").alias("n_rows"),
            # a value that runs across a boundary was counted on both sides
            (F.sum("n_values") - F.count_if(F.col("first_value") == F.col("before"))).alias("n_values"),
        )
    )
    return whole.unionByName(stitched).select(
        "field_name", "key_text", F.col("n_rows").alias(rows_col), F.col("n_values").alias(values_col)
    )


def heavy_keys(df: DataFrame, keys: list[str], value: str, share: float = 0.025, partitions: int | None = None) -> DataFrame:
    """The keys that at least ``share`` of all rows of ``df`` hold: (field_name, key_text, n_rows, n_queries).

    All rows count in the denominator, those with a null key included.  Ties at the border are in.
    """
    least = math.ceil(Fraction(str(share)) * df.count())
    return key_counts(df, keys, value, partitions).where(F.col("n_rows") >= F.lit(least))
