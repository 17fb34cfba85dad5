"""Line numbers, runs of equal values, batches and shards without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.runtime import written

_IN_PARTITION = (1 << 33) - 1


def numbered(df: DataFrame, order: list[str], out: str = "line") -> DataFrame:
    """``df`` with consecutive numbers from 1 in the given order.

    Rows are range partitioned and sorted locally; a row's number is its place in the partition
    and the size of those before, of which there is one number per partition.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)).alias("__at")
    )
    placed = written(placed, "numbered")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__start"))
    return placed.join(starts, "__part").withColumn(out, F.col("__start") + F.col("__at") + 1).drop("__part", "__at", "__start")


def islands(df: DataFrame, value: str, line: str, block: int = 100_000) -> DataFrame:
    """``df`` with ``group_id``: lines of an equal value (null equals null) that follow one another share one.

    Lines are taken in blocks; of each block only its last value and its number of runs go on.
    """
    rows = df.withColumn("__block", F.floor(F.col(line) / block))
    order = Window.partitionBy("__block").orderBy(line)
    ends = rows.groupBy("__block").agg(F.max_by(F.struct(F.col(value).alias("v")), line).alias("__end"))
    ahead = Window.orderBy("__block")
    ends = ends.select("__block", F.lag("__end").over(ahead).alias("__before"))
    rows = rows.join(ends, "__block")
    first = F.row_number().over(order) == 1
    same = F.when(first, F.col("__before").isNotNull() & F.col("__before.v").eqNullSafe(F.col(value))).otherwise(F.lag(value).over(order).eqNullSafe(F.col(value)))
    flagged = rows.withColumn("__start", F.when(same, 0).otherwise(1)).drop("__before")
    runs = flagged.groupBy("__block").agg(F.sum("__start").alias("__runs"))
    offset = F.coalesce(F.sum("__runs").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("__block", offset.alias("__offset"))
    counted = flagged.withColumn("__own", F.sum("__start").over(order)).join(runs, "__block")
    return counted.withColumn("group_id", F.col("__own") + F.col("__offset")).drop("__block", "__start", "__own", "__offset")


def with_next(df: DataFrame, key: list[str], order: list[str], out: str = "following") -> DataFrame:
    """``df`` with a struct of the ``order`` columns of the next row of the same key, null for the last.

    Rows are range partitioned by key and order, so a key that holds a large part of all rows
    covers several partitions; where it goes on in a later one, that one's first row is the next.
    Null is a key like any other.
    """
    place = F.struct(*order)
    parts = written(df.repartitionByRange(*key, *order).withColumn("__part", F.spark_partition_id()), "ordered")
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(key)]
    firsts = parts.groupBy("__part", *key).agg(F.min(place).alias("__first"))
    later = F.lead("__first").over(Window.partitionBy(*key).orderBy("__part"))
    renamed = [F.col(c).alias(f"__k{i}") for i, c in enumerate(key)]
    firsts = firsts.select(F.col("__part").alias("__p"), *renamed, later.alias("__later")).where("__later is not null")
    inside = F.lead(place).over(Window.partitionBy("__part", *key).orderBy(*order))
    rows = parts.withColumn("__inside", inside)
    on = F.col("__part") == F.col("__p")
    for s in same:
        on = on & s
    joined = rows.join(firsts, on & F.col("__inside").isNull(), "left")
    return joined.withColumn(out, F.coalesce("__inside", "__later")).select(*df.columns, out)


def running_counts(df: DataFrame, group: str, value: str, n: str) -> DataFrame:
    """``df``, one row per (group, value), with the rows of its group before it and up to it: (..., __from, __upto).

    Rows are range partitioned by group and value, so a group of many values covers several partitions.
    """
    parts = written(df.repartitionByRange(group, value).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(F.sum(n).alias("__n"))
    ahead = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__g", "__p", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    inside = F.sum(n).over(Window.partitionBy("__part", group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    rows = parts.withColumn("__inside", inside)
    joined = rows.join(starts, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")))
    upto = F.col("__start") + F.col("__inside")
    return joined.withColumn("__upto", upto).withColumn("__from", F.col("__upto") - F.col(n)).drop("__part", "__p", "__g", "__start", "__inside")


def shuffle_key(seed: int, *columns: str) -> Column:
    """A key whose order is a shuffle that the seed and the row alone decide."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def epochs(df: DataFrame, columns: list[str], n: int, seed: int = 0, shards: int = 1, mine: int = 0) -> DataFrame:
    """``n`` passes over ``df`` in an order of their own: (epoch, line, ...), of one worker's shard of the lines."""
    passes = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else df.where("false").withColumn("epoch", F.lit(0))
    keyed = passes.withColumn("__key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), *[F.col(c).cast("string") for c in columns])))
    size = df.count()
    lines = numbered(keyed, ["epoch", "__key", *columns]).drop("__key").withColumn("line", F.col("line") - 1 - F.col("epoch") * F.lit(size))
    return shard(lines, "line", shards, mine)


def mini_batches(df: DataFrame, order: list[str], size: int = 64, out: str = "batch") -> DataFrame:
    """``df`` with the number from 0 of its batch of ``size`` rows in the given order."""
    return numbered(df, order, "__line").withColumn(out, F.floor((F.col("__line") - 1) / size)).drop("__line")


def shard(df: DataFrame, line: str, shards: int, mine: int) -> DataFrame:
    """Every ``shards``-th line, from line ``mine``."""
    return df.where(F.pmod(F.col(line), F.lit(shards)) == mine)
