"""Training pairs: a query with its own prefixes, and other queries for the same prefixes.

Choices that need randomness are ordered by a hash of the seed and the row, so they are the same
in every run and layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.functions import text
from querymill.operators.index import lookup_batch
from querymill.runtime import written


def _shuffle_key(seed: int, *parts: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def pair_sources(df: DataFrame) -> DataFrame:
    """One row per normalized_query: the smallest qid and the number of other rows; texts with control characters are dropped."""
    kept = df.where(F.col("qid").isNotNull() & (F.coalesce(F.col("normalized_query"), F.lit("")) != "") & ~text.has_control(F.col("normalized_query")))
    return kept.groupBy("normalized_query").agg(F.min("qid").alias("qid"), (F.count(F.lit(1)) - 1).alias("duplicate_count"))


def positives(sources: DataFrame, min_length: int = 1, max_length: int = 20, include_whitespace: bool = True, most: int = 8) -> DataFrame:
    """(prefix, query) for each prefix of each query, case kept."""
    found = text.generate_prefixes(F.col("normalized_query"), min_length, max_length, include_whitespace, most)
    rows = sources.select(F.explode(found).alias("prefix"), F.col("normalized_query").alias("query"))
    return rows.where(~text.has_control(F.col("prefix")))


def _pools(pairs: DataFrame, queries: DataFrame, pool: int, exclude: DataFrame | None, ascii_only: bool) -> DataFrame:
    """``pairs`` with ``candidates``: at most ``pool`` queries of the index for the prefix, without those of ``exclude`` and the query itself.

    Each distinct prefix is looked up once and has one row, so the join moves the pairs at most once, however many a prefix has.
    """
    # written, as it is asked for several times
    asked = written(pairs.select("prefix").distinct().withColumn("key", text.normalize_prefix(F.col("prefix"), ascii_only=ascii_only)), "asked")
    found = lookup_batch(queries, asked.select("key").distinct(), pool, matched="key").select("key", F.col("normalized_query").alias("candidate"))
    found = found.where(~text.has_control(F.col("candidate")))
    if exclude is not None:
        found = found.join(exclude.select(F.col("normalized_query").alias("candidate")).distinct(), "candidate", "left_anti")
    by_key = found.groupBy("key").agg(F.collect_list("candidate").alias("candidates"))
    joined = pairs.join(asked.join(by_key, "key").select("prefix", "candidates"), "prefix", "left")
    others = F.filter(F.coalesce("candidates", F.array().cast("array<string>")), lambda c: c != F.col("query"))
    return joined.select(*pairs.columns, others.alias("candidates"))


def candidate_pools(pairs: DataFrame, queries: DataFrame, pool: int = 50, exclude: DataFrame | None = None, ascii_only: bool = False) -> DataFrame:
    """(prefix, query, candidate): other queries of the index for the prefix, none of them in ``exclude``."""
    pools = _pools(pairs.select("prefix", "query"), queries, pool, exclude, ascii_only)
    return pools.select("prefix", "query", F.explode("candidates").alias("candidate"))


def reservoir(sources: DataFrame, size: int, exclude: DataFrame | None = None, seed: int = 1337) -> DataFrame:
    """``size`` queries, each equally likely, none of them in ``exclude``: (candidate)."""
    rows = sources
    if exclude is not None:
        rows = rows.join(exclude.select("normalized_query").distinct(), "normalized_query", "left_anti")
    picked = rows.select(F.col("normalized_query").alias("candidate")).distinct()
    return picked.orderBy(_shuffle_key(seed ^ 0x5EED5EED, "candidate"), "candidate").limit(size)


def _first(candidates: Column, n: Column | int, seed: int) -> Column:
    """The first ``n`` of an array of candidates of (prefix, query) in an order that seed and row alone decide."""
    keyed = F.transform(candidates, lambda c: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), "query", "prefix", c)).alias("k"), c.alias("c")))
    return F.transform(F.slice(F.array_sort(keyed), F.lit(1), F.lit(n) if isinstance(n, int) else n), lambda x: x["c"])


def generate_pairs(
    df: DataFrame,
    queries: DataFrame,
    exclude: DataFrame | None = None,
    min_length: int = 1,
    max_length: int = 20,
    most: int = 8,
    include_whitespace: bool = True,
    negatives: int = 4,
    pool: int = 50,
    seed: int = 1337,
    ascii_only: bool = False,
) -> DataFrame:
    """(prefix, query, candidate, label, source): the positive of each prefix, up to ``negatives`` others.

    Negatives come from the index (index_retrieved) and, where it has too few, from a reservoir
    of other queries (random_fallback).  The reservoir is small by construction, max(pool,
    8 x negatives) rows, and is broadcast as one array.
    """
    # each row becomes many and each of these is dear, so the partitions must not be merged by their bytes
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sources = written(pair_sources(df).repartition(tasks, "normalized_query"), "pair-sources")
    own = positives(sources, min_length, max_length, include_whitespace, most)
    spare = reservoir(sources, max(pool, 8 * negatives), exclude, seed).agg(F.array_sort(F.collect_list("candidate")).alias("spare")).first()[0]
    rows = _pools(own, queries, pool, exclude, ascii_only)
    rows = rows.select("prefix", "query", _first(F.col("candidates"), negatives, seed).alias("chosen"))
    filler = F.array_except(F.array(*map(F.lit, spare)).cast("array<string>"), F.array_append("chosen", F.col("query")))
    short = F.lit(negatives) - F.size("chosen")
    fallback = F.when(short > 0, _first(filler, short, seed)).otherwise(F.array().cast("array<string>"))
    labelled = lambda found, label, source: F.transform(found, lambda c: F.struct(c.alias("candidate"), F.lit(label).alias("label"), F.lit(source).alias("source")))
    every = F.concat(labelled(F.array("query"), 1, "positive"), labelled(F.col("chosen"), 0, "index_retrieved"), labelled(fallback, 0, "random_fallback"))
    return rows.select("prefix", "query", F.explode(every).alias("e")).select("prefix", "query", "e.candidate", "e.label", "e.source")


def pool_stats(pairs: DataFrame, pools: DataFrame, negatives: int = 4) -> DataFrame:
    """One row about the pools: prefixes, sizes, prefixes without candidates and with too few."""
    sizes = pools.groupBy("prefix", "query").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return pairs.join(sizes, ["prefix", "query"], "left").agg(
        F.count(F.lit(1)).alias("prefixes_generated"), F.coalesce(F.sum(n), F.lit(0)).alias("candidate_pool_queries"),
        F.min(n).alias("candidate_pool_min"), F.max(n).alias("candidate_pool_max"), F.avg(n).alias("candidate_pool_avg"),
        F.count_if(n == 0).alias("prefixes_without_index_negatives"), F.count_if(n < negatives).alias("negative_shortfalls"),
    )


def source_counts(df: DataFrame) -> DataFrame:
    """One row about ``pair_sources``: rows seen, rejected for a missing id, an empty text or control characters, unique and duplicate ones."""
    blank = F.col("qid").isNull() | (F.coalesce(F.col("normalized_query"), F.lit("")) == "")
    dirty = ~blank & text.has_control(F.col("normalized_query"))
    groups = df.groupBy(blank.alias("blank"), dirty.alias("dirty"), "normalized_query").agg(F.count(F.lit(1)).alias("n"))
    kept = ~F.col("blank") & ~F.col("dirty")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    counted = groups.agg(
        total(F.lit(True)).alias("rows_seen"), total(F.col("blank")).alias("rejected_blank"), total(F.col("dirty")).alias("rejected_control"),
        F.count_if(kept).alias("unique_queries"), total(kept).alias("kept"),
    )
    return counted.withColumn("duplicates", F.col("kept") - F.col("unique_queries")).drop("kept")


def label_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n_pairs"))


def sanitize(pairs: DataFrame) -> DataFrame:
    """Pairs without a control character in prefix or candidate; null fields pass."""
    return pairs.where(~text.has_control(F.col("prefix")) & ~text.has_control(F.col("candidate")))


def sanitize_counts(pairs: DataFrame) -> DataFrame:
    """One row: pairs scanned, written and skipped, and the fields with control characters."""
    p, c = text.has_control(F.col("prefix")), text.has_control(F.col("candidate"))
    return pairs.agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(~p & ~c).alias("written"), F.count_if(p | c).alias("skipped"),
        F.count_if(p).alias("prefix_fields"), F.count_if(c).alias("candidate_fields"),
    )


def control_audit(pairs: DataFrame, samples: int = 20) -> DataFrame:
    """The first ``samples`` fields that hold a control character: (field, value)."""
    fields = pairs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("prefix", "candidate")])).alias("f"))
    return fields.select("f.*").where(text.has_control(F.col("value"))).distinct().orderBy("field", "value").limit(samples)
