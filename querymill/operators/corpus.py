"""The query log: validity, matching keys and one row per distinct query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.functions import text

REQUIRED = ("qid", "original_query", "normalized_query")


def required_columns(df: DataFrame, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Only the required columns; an error names those that are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def _valid() -> Column:
    present = lambda c: F.col(c).isNotNull()
    return present("qid") & present("original_query") & present("normalized_query") & (F.col("normalized_query") != "") & (F.col("match_key") != "")


def keyed(df: DataFrame, case_sensitive: bool = False, ascii_only: bool = False) -> DataFrame:
    """The required columns and ``match_key``."""
    rows = required_columns(df)
    return rows.withColumn("match_key", text.normalize_prefix(F.col("normalized_query"), case_sensitive, ascii_only))


def valid_rows(df: DataFrame, **key: bool) -> DataFrame:
    return keyed(df, **key).where(_valid())


def rejected_rows(df: DataFrame, samples: int = 10, **key: bool) -> DataFrame:
    """The first ``samples`` rows by qid that validity drops."""
    return keyed(df, **key).where(~F.coalesce(_valid(), F.lit(False))).orderBy("qid", "original_query", "normalized_query").limit(samples)


def dedup_query_log(df: DataFrame, popularity: str = "duplicate_count", **key: bool) -> DataFrame:
    """One row per (match_key, normalized_query), the one of the smallest qid.

    duplicate_count counts the other rows, repeated ids included.  popularity is duplicate_count
    + 1, or 1 for ``popularity='neutral'``.  The ids of the other rows are in ``duplicates``: as a
    list they would not fit into a row where one query makes up much of the log.
    """
    if popularity not in ("duplicate_count", "neutral"):
        raise ValueError(f"unknown popularity {popularity!r}")
    grouped = (
        valid_rows(df, **key)
        .groupBy("match_key", "normalized_query")
        .agg(F.min(F.struct("qid", "original_query")).alias("first"), F.count(F.lit(1)).alias("n"))
    )
    return grouped.select(
        "match_key", "normalized_query", F.col("first.qid").alias("qid"), F.col("first.original_query").alias("original_query"),
        (F.col("n") - 1).alias("duplicate_count"),
        (F.col("n") if popularity == "duplicate_count" else F.lit(1).cast("long")).alias("popularity"),
    )


def duplicates(df: DataFrame, **key: bool) -> DataFrame:
    """(normalized_query, qid, duplicate_qid, n_rows): the other rows of each query, by id.

    The query's own id is among them if it was delivered more than once, with one row less.
    """
    rows = valid_rows(df, **key)
    canonical = rows.groupBy("normalized_query").agg(F.min("qid").alias("qid"))
    counted = rows.groupBy("normalized_query", F.col("qid").alias("duplicate_qid")).agg(F.count(F.lit(1)).alias("n"))
    joined = counted.join(canonical, "normalized_query")
    n = F.col("n") - (F.col("duplicate_qid") == F.col("qid")).cast("long")
    return joined.select("normalized_query", "qid", "duplicate_qid", n.alias("n_rows")).where("n_rows > 0")


def with_duplicate_lists(queries: DataFrame, others: DataFrame) -> DataFrame:
    """``queries`` with duplicate_qids, a sorted comma list; for logs whose largest group fits into a row."""
    repeated = F.explode(F.array_repeat("duplicate_qid", F.col("n_rows").cast("int")))
    lists = others.select("normalized_query", repeated.alias("d")).groupBy("normalized_query").agg(F.array_join(F.sort_array(F.collect_list("d")), ",").alias("duplicate_qids"))
    return queries.join(lists, "normalized_query", "left").withColumn("duplicate_qids", F.coalesce("duplicate_qids", F.lit("")))


def build_stats(df: DataFrame, **key: bool) -> DataFrame:
    """One row: rows seen, rejected, processed, unique and duplicate queries."""
    rows = keyed(df, **key).withColumn("ok", F.coalesce(_valid(), F.lit(False)))
    groups = rows.groupBy("ok", "match_key", "normalized_query").agg(F.count(F.lit(1)).alias("n"))
    counted = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_seen"),
        F.coalesce(F.sum(F.when(~F.col("ok"), F.col("n"))), F.lit(0)).alias("rejected"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("processed"),
        F.count_if("ok").alias("unique_queries"),
    )
    return counted.withColumn("duplicates", F.col("processed") - F.col("unique_queries"))


def index_report(df: DataFrame, hot_top_k: int = 50, hot_length: int = 6, **key: bool) -> DataFrame:
    """``build_stats`` with the prefixes that are staged for the cache and the rows it gets."""
    from querymill.operators import index

    per = index.explode_prefixes(dedup_query_log(df, **key), 1, hot_length).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    hot = per.agg(F.count(F.lit(1)).alias("n_prefixes"), F.coalesce(F.sum(F.least(F.col("n"), F.lit(hot_top_k))), F.lit(0)).alias("n_hot_rows"))
    return build_stats(df, **key).join(hot, on=F.lit(True), how="inner")  # one row each


def split_by_text(df: DataFrame, dev_share: float) -> DataFrame:
    """``split``: the same text always falls into the same split."""
    return df.withColumn("split", text.split_bucket(F.col("normalized_query"), dev_share))


def leaked_texts(train: DataFrame, dev: DataFrame) -> DataFrame:
    """Texts that stand in both splits."""
    return train.select("normalized_query").intersect(dev.select("normalized_query"))
