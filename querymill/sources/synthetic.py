"""Invented query logs for tests and trials: every row depends on its number and the seed alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.functions import text

TOPICS = ("garden bench", "night train", "violin lessons", "stone oven", "river map", "wool jacket", "ceramic bowl", "chess opening", "solar panel", "oak table", "ferry times", "mountain hut")
TAILS = ("near me", "for beginners", "prices", "2026", "c++ vs rust", "df.sort('x')", "¿cuándo?", "crème brûlée", "東京", "московская", "how-to", "best of")


def _drawn(below: int, *parts: object) -> Column:
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % F.lit(below)).cast("int")


def synthetic_queries(spark: SparkSession, n: int, seed: int = 1337) -> DataFrame:
    """``n`` rows (qid, original_query, normalized_query); every fiftieth repeats the text before it, every third is written in capitals."""
    number = F.col("id") - F.when(F.col("id") % 50 == 49, 1).otherwise(0)
    pick = lambda words, what: F.element_at(F.array(*map(F.lit, words)), _drawn(len(words), seed, what, number) + 1)
    query = F.concat_ws(" ", pick(TOPICS, "topic"), pick(TAILS, "tail"), _drawn(400, seed, "number", number).cast("string"))
    rows = spark.range(n).select("id", query.alias("normalized_query"))
    shown = F.when(F.col("id") % 3 == 0, F.upper("normalized_query")).otherwise(F.col("normalized_query"))
    return rows.select(F.concat(F.lit("S"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("qid"), shown.alias("original_query"), "normalized_query")


def write_splits(spark: SparkSession, path: str, n: int, dev_share: float = 0.1, seed: int = 1337, force: bool = False) -> DataFrame:
    """The rows written under ``path`` by split, equal texts in one split, and read back: (..., split)."""
    rows = synthetic_queries(spark, n, seed).withColumn("split", text.split_bucket(F.col("normalized_query"), dev_share))
    rows.write.partitionBy("split").mode("overwrite" if force else "errorifexists").parquet(path)
    return spark.read.parquet(path)
