"""The prefix index: a cache of the best queries per short prefix, and exact lookup of any prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querymill.functions import text
from querymill.runtime import written


def _order(*first: str):
    return [*first, F.desc("popularity"), F.asc("normalized_query")]


def explode_prefixes(queries: DataFrame, min_length: int = 1, max_length: int = 6, include_whitespace: bool = True, most: int = 20) -> DataFrame:
    """``queries`` with a row per prefix of match_key."""
    found = text.generate_prefixes(F.col("match_key"), min_length, max_length, include_whitespace, most)
    return queries.withColumn("prefix", F.explode(found))


def hot_prefix_cache(
    queries: DataFrame, top_k: int = 50, min_length: int = 1, max_length: int = 6, include_whitespace: bool = True, most: int = 20
) -> DataFrame:
    """The ``top_k`` queries of every prefix by popularity, then text.

    Each input task drops what can't be among its prefix's best before the shuffle, so one-letter
    prefixes, which hold a large part of all rows, stay small.
    """
    staged = explode_prefixes(queries, min_length, max_length, include_whitespace, most)
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy(*_order()))
    ranked = staged.withColumn("rank", rank).where(F.col("rank") <= top_k)
    return ranked.select("prefix", "rank", "match_key", "normalized_query", "qid", "original_query", "duplicate_count", "popularity")


def popular(queries: DataFrame, limit: int) -> DataFrame:
    """The most popular queries, which an empty prefix asks for."""
    return queries.orderBy(*_order()).limit(max(0, limit))


def lookup(queries: DataFrame, prefix: str, limit: int = 100, case_sensitive: bool = False) -> DataFrame:
    """The best ``limit`` queries that start with one prefix: a pushed-down filter and a top-N."""
    typed = queries.sparkSession.range(1).select(text.normalize_prefix(F.lit(prefix), case_sensitive)).first()[0]
    return queries.where(F.col("match_key").startswith(typed)).orderBy(*_order()).limit(max(0, limit))


#: Prefixes asked for up to which they are broadcast; each is at most ``max_length`` characters there.
_FEW = 10_000


def lookup_batch(queries: DataFrame, prefixes: DataFrame, limit: int = 100, max_length: int = 20, matched: str = "prefix") -> DataFrame:
    """The best ``limit`` queries of every normalized prefix in ``prefixes``: the matching columns, (prefix, rank, ...).

    Queries are exploded to the lengths asked for and ranked within each prefix before anything is
    joined, so each input task drops what can't be among the best of a one-letter prefix.  If few
    prefixes are asked for, only theirs are exploded.  Prefixes longer than ``max_length`` are joined
    on their first ``max_length`` characters and compared in full.  The empty prefix gives the most
    popular queries.
    """
    if limit <= 0:
        return queries.where("false").select(F.lit("").alias(matched), F.lit(0).alias("rank"), "*")
    asked = prefixes.select(F.col(matched).alias("asked")).where("asked is not null").distinct()
    sizes = dict(asked.groupBy(F.least(F.length("asked"), F.lit(max_length + 1))).count().collect())  # at most max_length + 2 rows
    lengths = sorted(n for n in sizes if 0 < n <= max_length)
    columns = ["asked", "rank", *queries.columns]
    ranked_in = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy(*_order()))).where(F.col("rank") <= limit)
    first = popular(queries, limit).withColumn("rank", F.row_number().over(Window.orderBy(*_order())))
    found = first.withColumn("asked", F.lit("")).join(asked, "asked", "left_semi").select(*columns)
    if lengths:
        short = asked.where(F.length("asked").between(1, max_length))
        own = F.array(*[F.when(F.length("match_key") >= n, F.substring("match_key", 1, n)) for n in lengths])
        heads = queries.withColumn("asked", F.explode(own)).where("asked is not null")
        few = sum(sizes[n] for n in lengths) <= _FEW
        best = ranked_in(heads.join(F.broadcast(short), "asked", "left_semi")) if few else ranked_in(heads).join(short, "asked", "left_semi")
        found = best.select(*columns).unionByName(found)
    if sizes.get(max_length + 1):
        long = asked.where(F.length("asked") > max_length).withColumn("head", F.substring("asked", 1, max_length))
        hits = queries.where(F.length("match_key") > max_length).withColumn("head", F.substring("match_key", 1, max_length)).join(long, "head")
        found = ranked_in(hits.where(F.col("match_key").startswith(F.col("asked")))).select(*columns).unionByName(found)
    return found.withColumnRenamed("asked", matched)


def candidates(
    queries: DataFrame, cache: DataFrame, prefixes: DataFrame, limit: int = 100, hot_length: int = 6, hot_top_k: int = 50, max_length: int = 20
) -> DataFrame:
    """Candidates of every typed prefix, with the place they were found: hot_cache or range_scan.

    A prefix of at most ``hot_length`` characters is answered by the cache if the cache is
    complete for it (fewer than ``hot_top_k`` rows) or holds at least ``limit`` rows; all other
    prefixes are looked up among all queries.  The rows are the same either way.
    """
    # written, as each use would run the normalization again
    typed = written(prefixes.select("prefix").distinct().select(F.col("prefix").alias("typed"), text.normalize_prefix(F.col("prefix")).alias("prefix")), "typed")
    keys = typed.select("prefix").distinct()
    short = keys.where((F.length("prefix") > 0) & (F.length("prefix") <= hot_length))
    # the cache is cut off exactly for the prefixes that have a row of its last rank
    answered = short.join(cache.where(F.col("rank") == hot_top_k).select("prefix"), "prefix", "left_anti") if limit > hot_top_k else short
    fields = ["prefix", "rank", "qid", "original_query", "normalized_query", "popularity", "duplicate_count"]
    hot = cache.join(answered, "prefix", "left_semi").where(F.col("rank") <= limit).select(*fields, F.lit("hot_cache").alias("source"))
    rest = keys.join(answered, "prefix", "left_anti")
    scanned = lookup_batch(queries, rest, limit, max_length).select(*fields, F.lit("range_scan").alias("source"))
    found = hot.unionByName(scanned)
    return typed.join(found, "prefix").select(
        "typed", F.col("prefix").alias("matched_prefix"), F.length("prefix").alias("prefix_match_length"), *fields[1:], "source"
    )


class PrefixIndex:
    """A written index: ``build`` it from a query log, ``open`` it again, ask it for candidates."""

    def __init__(self, queries: DataFrame, cache: DataFrame, hot_length: int = 6, hot_top_k: int = 50):
        self.queries, self.cache, self.hot_length, self.hot_top_k = queries, cache, hot_length, hot_top_k

    @classmethod
    def build(cls, log: DataFrame, path: str, hot_length: int = 6, hot_top_k: int = 50, force: bool = False, **settings) -> PrefixIndex:
        """Write queries sorted by match_key, so that row groups prune prefix scans, and the cache by prefix length."""
        from querymill.operators.corpus import dedup_query_log

        spark = log.sparkSession
        mode = "overwrite" if force else "errorifexists"
        queries = dedup_query_log(log, **settings)
        queries.repartitionByRange("match_key").sortWithinPartitions("match_key").write.mode(mode).parquet(f"{path}/queries")
        cache = hot_prefix_cache(spark.read.parquet(f"{path}/queries"), hot_top_k, 1, hot_length)
        cache.withColumn("prefix_length", F.length("prefix")).write.mode(mode).partitionBy("prefix_length").parquet(f"{path}/hot_prefix_cache")
        return cls.open(spark, path, hot_length, hot_top_k)

    @classmethod
    def open(cls, spark: SparkSession, path: str, hot_length: int = 6, hot_top_k: int = 50) -> PrefixIndex:
        cache = spark.read.parquet(f"{path}/hot_prefix_cache").drop("prefix_length")
        return cls(spark.read.parquet(f"{path}/queries"), cache, hot_length, hot_top_k)

    def get_candidates(self, prefixes: DataFrame, limit: int | None = 100) -> DataFrame:
        if not limit or limit < 0:
            return candidates(self.queries, self.cache, prefixes.where("false"), 1, self.hot_length, self.hot_top_k)
        return candidates(self.queries, self.cache, prefixes, limit, self.hot_length, self.hot_top_k)

    def get_top_candidates(self, prefixes: DataFrame, limit: int = 5) -> DataFrame:
        return self.get_candidates(prefixes, limit)

    def inspect(self) -> DataFrame:
        """Rows of both tables."""
        rows = lambda df, name: df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        return rows(self.queries, "queries").unionByName(rows(self.cache, "hot_prefix_cache"))

    def statistics(self) -> DataFrame:
        """Rows, distinct keys, first and last key of both tables: what a planner would keep of them."""
        of = lambda df, name, key: df.agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"), F.min(key).alias("first_key"), F.max(key).alias("last_key")
        ).select(F.lit(name).alias("table_name"), "*")
        return of(self.queries, "queries", "match_key").unionByName(of(self.cache, "hot_prefix_cache", "prefix"))

    def samples(self, prefixes: list[str], limit: int = 5) -> DataFrame:
        """The best queries of some prefixes, to look at an index by."""
        return self.get_candidates(self.queries.sparkSession.createDataFrame([(p,) for p in prefixes], "prefix string"), limit)
