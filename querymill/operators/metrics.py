"""Ranking quality, losses, latency and service counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.operators.ordering import running_counts
from querymill.runtime import written


def rerank(df: DataFrame, group: list[str], score: str, place: str, top_k: int | None = None) -> DataFrame:
    """``df`` with ``rank`` by falling score, then by the original place; the first ``top_k`` of each group."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), place))
    ranked = df.withColumn("rank", rank)
    return ranked if top_k is None else ranked.where(F.col("rank") <= max(0, top_k))


def keep_first(df: DataFrame, group: list[str], key: Column, place: str) -> DataFrame:
    """The first row of each key within a group."""
    rank = F.row_number().over(Window.partitionBy(*group, "__key").orderBy(place))
    return df.withColumn("__key", key).withColumn("__rank", rank).where("__rank = 1").drop("__key", "__rank")


def pool_metrics(ranked: DataFrame, group: list[str], top_k: int = 5) -> DataFrame:
    """One row of means over groups of (rank, relevant boolean) rows.

    Groups without a relevant row are counted as missing and not evaluated.
    """
    hit = F.col("relevant")
    first = F.min(F.when(hit, F.col("rank")))
    per = ranked.groupBy(*group).agg(
        first.alias("first"), F.max("rank").alias("pool"), F.count_if(hit & (F.col("rank") <= top_k)).alias("hits"), F.count_if(hit).alias("relevant")
    )
    found = F.col("first").isNotNull()
    k = F.least(F.lit(top_k), F.col("pool"))
    mean = lambda value: F.coalesce(F.avg(F.when(found, value)), F.lit(0.0))
    return per.agg(
        F.count_if(found).alias("n_evaluated"),
        F.count_if(~found).alias("n_target_missing"),
        mean((F.col("first") == 1).cast("double")).alias("precision_at_1"),
        mean(F.col("hits") / k).alias("precision_at_k"),
        mean(F.col("hits") / F.col("relevant")).alias("recall_at_k"),
        mean(F.when(F.col("first") <= top_k, F.lit(1.0) / F.col("first")).otherwise(0.0)).alias("mrr_at_k"),
        mean((F.col("hits") > 0).cast("double")).alias("hit_rate_at_k"),
    )


def rank_checks(ranked: DataFrame, group: str, rank: str, score: str) -> DataFrame:
    """(group, n_rows, ranks_whole, scores_fall): whether ranks run from 1 without gaps and scores never rise along them."""
    before = F.lag(score).over(Window.partitionBy(group).orderBy(rank))
    rows = ranked.select(group, F.col(rank).alias("r"), F.coalesce(F.col(score) <= before, F.lit(True)).alias("falls"))
    whole = (F.min("r") == 1) & (F.max("r") == F.count(F.lit(1))) & (F.count_distinct("r") == F.count(F.lit(1)))
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), whole.alias("ranks_whole"), F.bool_and("falls").alias("scores_fall"))


def latency_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """Exact percentiles with linear interpolation, mean and extremes per group.

    Equal values are counted first; the two values around each percentile are found by their place
    among the running counts, which no task holds for a whole group.
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    counted = written(rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")), "values")
    n = F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0)
    totals = counted.groupBy(F.col("g").alias("h")).agg(F.sum(n).alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum(n)).alias("avg_ms"), F.min("v").alias("min_ms"), F.max("v").alias("max_ms"))
    placed = running_counts(counted.where("v is not null"), "g", "v", "c")
    met = placed.join(totals.select("h", "n"), F.col("g").eqNullSafe(F.col("h")))
    found = []
    for name, p in (("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99)):
        at = F.lit(p) * (F.col("n") - 1)
        there = lambda rank: F.max(F.when((F.col("__from") <= rank) & (rank < F.col("__upto")), F.col("v")))
        low, high, part = there(F.floor(at)), there(F.ceil(at)), F.max(at - F.floor(at))
        found.append((low + (high - low) * part).alias(name))
    per = met.groupBy("h").agg(*found).withColumnRenamed("h", "k")
    joined = totals.join(per, F.col("h").eqNullSafe(F.col("k")), "left")
    return joined.select(F.col("h").alias(group), "n", "avg_ms", "min_ms", "max_ms", "p50_ms", "p95_ms", "p99_ms")


def half_even(value: Column, digits: int) -> Column:
    """``value`` rounded to ``digits`` places, ties to the even digit."""
    return F.bround(value, digits)


def latency_overall(summary: DataFrame, group: str) -> DataFrame:
    """The mean of the groups' percentiles, and the group with the worst p99."""
    worst = F.max(F.struct("p99_ms", group))
    means = [F.avg(c).alias(f"mean_{c}") for c in ("avg_ms", "p50_ms", "p95_ms", "p99_ms")]
    return summary.agg(*means, worst.alias("w")).select(*[f"mean_{c}" for c in ("avg_ms", "p50_ms", "p95_ms", "p99_ms")], F.col("w.p99_ms").alias("worst_p99_ms"), F.col(f"w.{group}").alias("worst_group"))


def bce_loss(df: DataFrame, logit: str, label: str) -> DataFrame:
    """Mean binary cross-entropy of logits, in the form that doesn't overflow."""
    x, y = F.col(logit), F.col(label)
    return df.agg(F.avg(F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))).alias("bce_loss"))


def hinge_loss(df: DataFrame, group: list[str], score: str, label: str, margin: float) -> DataFrame:
    """Mean of max(0, margin - (positive - negative)) over the pairs within a group; 0 without a pair."""
    side = lambda wanted, name: df.where(F.col(label) == wanted).select(*group, F.col(score).alias(name))
    pairs = side(1, "__p").join(side(0, "__n"), group)
    return pairs.agg(F.coalesce(F.avg(F.greatest(F.lit(0.0), F.lit(margin) - (F.col("__p") - F.col("__n")))), F.lit(0.0)).alias("hinge_loss"))


def service_counters(df: DataFrame, served: Column, latency: str, at: str, tie: str) -> DataFrame:
    """One row: requests, served ones, failed ones, mean and last latency of those served."""
    last = F.max_by(F.when(served, F.col(latency)), F.when(served, F.struct(at, tie)))
    return df.agg(
        F.count(F.lit(1)).alias("total_requests"), F.count_if(served).alias("served_requests"), F.count_if(~served).alias("failed_requests"),
        F.coalesce(F.avg(F.when(served, F.col(latency))), F.lit(0.0)).alias("avg_latency_ms"), last.alias("last_latency_ms"),
    )
