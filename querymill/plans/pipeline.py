"""Whole runs: build an index, make pairs, fit a vocabulary, train and evaluate a ranker."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from querymill.functions import text
from querymill.operators import corpus, index, metrics, ordering, pairs, ranker, vocab
from querymill.runtime import session, written
from querymill.sources import synthetic, tables


def build_index(spark: SparkSession, source: str, target: str, force: bool = False, report: str | None = None) -> index.PrefixIndex:
    log = tables.read_queries(spark, source)
    built = index.PrefixIndex.build(log, target, force=force)
    if report:
        tables.write_report(corpus.index_report(log), report)
    return built


def make_pairs(spark: SparkSession, train: str, dev: str, built: index.PrefixIndex, target: str, force: bool = False, **settings) -> DataFrame:
    """Pairs of the training queries with no negative that is a dev query, written as JSON lines."""
    excluded = pairs.pair_sources(tables.read_queries(spark, dev))
    made = pairs.generate_pairs(tables.read_queries(spark, train), built.queries, excluded, **settings)
    tables.write_pairs(made.select("prefix", "candidate", "label", "source"), target, force)
    return tables.read_pairs(spark, target)


def evaluate(
    dev: DataFrame, built: index.PrefixIndex, tokenizer: vocab.Tokenizer | None = None, model: ranker.RankerModel | None = None, pool: int = 50, top_k: int = 5, most: int = 8
) -> DataFrame:
    """Metrics of every prefix of every dev row, ranked by the index or, given a model, re-ranked by it."""
    asked = dev.where("qid is not null and normalized_query != ''").select(F.col("normalized_query").alias("target"), F.monotonically_increasing_id().alias("line"))
    asked = written(asked.withColumn("prefix", F.explode(text.generate_prefixes(F.col("target"), 1, 20, True, most))), "asked")
    found = built.get_candidates(asked.select("prefix").distinct(), pool)
    rows = asked.join(found.select(F.col("typed").alias("prefix"), "rank", F.col("normalized_query").alias("candidate")), "prefix", "left")
    if model is not None:
        scored = ranker.score_pairs(rows.where("candidate is not null").select("prefix", "candidate").distinct(), tokenizer, model)
        rows = metrics.rerank(rows.withColumnRenamed("rank", "place").join(scored, ["prefix", "candidate"], "left"), ["line", "prefix"], "score", "place")
    relevant = F.coalesce(F.col("candidate") == F.col("target"), F.lit(False))
    return metrics.pool_metrics(rows.withColumn("relevant", relevant), ["line", "prefix"], top_k)


def evaluate_pairs(labelled: DataFrame, tokenizer: vocab.Tokenizer | None = None, model: ranker.RankerModel | None = None, order: list[str] | None = None, top_k: int = 5) -> DataFrame:
    """Metrics of a file of labelled pairs: runs of lines of one prefix are groups, ranked as they stand or re-ranked by a model.

    ``order`` gives the lines; without it they are ordered by prefix, falling label and candidate.
    """
    rows = labelled.where("prefix is not null and candidate is not null and label is not null")
    rows = rows.withColumn("__down", -F.col("label"))
    lines = ordering.numbered(rows, order or ["prefix", "__down", "candidate"]).drop("__down")
    grouped = ordering.islands(lines, "prefix", "line")
    if model is not None:
        grouped = ranker.score_pairs(grouped, tokenizer, model)
        ranked = metrics.rerank(grouped, ["group_id"], "score", "line")
    else:
        ranked = grouped.withColumn("rank", F.row_number().over(Window.partitionBy("group_id").orderBy("line")))
    return metrics.pool_metrics(ranked.withColumn("relevant", F.col("label") == 1), ["group_id"], top_k)


def fit_tokenizer(spark: SparkSession, source: str, target: str, config: vocab.TokenizerConfig = vocab.TokenizerConfig()) -> vocab.Tokenizer:
    fitted = vocab.Tokenizer.fit_pairs(tables.read_pairs(spark, source), config)
    fitted.save(target)
    return fitted


def train_ranker(spark: SparkSession, pairs_path: str, dev_path: str, tokenizer_path: str, target: str, report: str | None = None, config: dict | None = None, **settings) -> list[dict]:
    """Fit a ranker on written pairs, save its best epoch as a checkpoint and report every epoch."""
    tokenizer = vocab.Tokenizer.load(spark, tokenizer_path)
    shape = ranker.RankerConfig(tokenizer.vocab_size, **(config or {}))
    model, history = ranker.train(tokenizer, tables.read_pairs(spark, pairs_path), tables.read_pairs(spark, dev_path), shape, **settings)
    best = max(history, key=lambda h: h["mrr_at_5"], default={"epoch": 0})
    ranker.save_checkpoint(spark, target, model, best["epoch"], best)
    if report and history:
        tables.write_report(spark.createDataFrame([Row(**h) for h in history]), report)
    return history


#: Prefixes, short and long, that a benchmark asks for unless others are given.
BENCHMARK_PREFIXES = ("w", "wh", "wha", "what", "what is", "how to find", "best", "where", "the", "zzzzzz")


def benchmark(built: index.PrefixIndex, prefixes: tuple[str, ...] = BENCHMARK_PREFIXES, limit: int = 100, warm_up: int = 2, timed: int = 10) -> DataFrame:
    """(prefix, n_rows, n, avg_ms, min_ms, max_ms, p50_ms, p95_ms, p99_ms) of lookups of one prefix at a time, as the driver sees them."""
    spark = built.queries.sparkSession
    taken = []
    for prefix in prefixes:
        asked = spark.createDataFrame([(prefix,)], "prefix string")
        for i in range(warm_up + timed):
            began = time.perf_counter()
            found = len(built.get_candidates(asked, limit).collect())  # at most ``limit`` rows
            if i >= warm_up:
                taken.append((prefix, found, (time.perf_counter() - began) * 1000))
    rows = spark.createDataFrame(taken, "prefix string, n_rows int, ms double")
    counts = rows.groupBy("prefix").agg(F.max("n_rows").alias("n_rows"))
    return counts.join(metrics.latency_summary(rows, "prefix", "ms"), "prefix")


def throughput(built: index.PrefixIndex, sizes: tuple[int | None, ...] = (10, 1_000, None), limit: int = 100, max_length: int = 20) -> list[dict]:
    """Prefixes and result rows a second for batches of some and of all prefixes of the index."""
    every = built.queries.select(F.explode(text.generate_prefixes(F.col("match_key"), 1, max_length)).alias("prefix")).distinct()
    found = []
    for size in sizes:
        asked = written(every if size is None else every.orderBy(F.md5("prefix")).limit(size), "asked")
        n = asked.count()
        began = time.perf_counter()
        rows = built.get_candidates(asked, limit).agg(F.count("rank")).first()[0]
        took = time.perf_counter() - began
        found.append({"prefixes": n, "rows": rows, "sec": round(took, 3), "prefixes_per_sec": round(n / took), "rows_per_sec": round(rows / took)})
    return found


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="querymill")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, says: str, *places: str, **options) -> None:
        """A command with positional places and options, given by their defaults; a default of False makes a flag."""
        made = commands.add_parser(name, help=says)
        for place in places:
            made.add_argument(place)
        for option, default in options.items():
            flag = f"--{option.replace('_', '-')}"
            made.add_argument(flag, action="store_true") if default is False else made.add_argument(flag, default=default, type=type(default) if default is not None else str)

    command("build-index", "deduplicate a query log and build the prefix index", "source", "target", force=False, report=None)
    command("inspect", "the sizes of an index", "index")
    command("make-pairs", "training pairs of a query log, none of them with a dev query as a negative", "train", "dev", "index", "target", force=False, report=None, negatives=4, pool=50)
    command("sanitize-pairs", "drop pairs with control characters", "source", "target", report=None)
    command("fit-tokenizer", "fit a vocabulary over pairs", "source", "target", max_vocab_size=20_000, max_char_vocab_size=2_000)
    command("train", "train the re-ranker", "pairs", "dev", "tokenizer", "target", report=None, epochs=3, max_examples=20_000, embedding_dim=128, hidden_dim=256)
    command("evaluate", "ranking metrics of pairs, as they stand or re-ranked", "pairs", tokenizer=None, checkpoint=None, report=None, top_k=5)
    command("benchmark", "time lookups of single prefixes", "index", report=None, limit=100, timed=10)
    command("synthetic", "write an invented query log by split", "target", rows=20_000, seed=1337, force=False)
    ask = commands.add_parser("lookup", help="the best queries of some prefixes")
    ask.add_argument("index")
    ask.add_argument("prefixes", nargs="+")
    ask.add_argument("--limit", type=int, default=10)
    given = parser.parse_args(args)
    spark = session("querymill")

    def told(frame: DataFrame) -> None:
        if given.report:
            tables.write_report(frame, given.report)
        frame.show(1_000, truncate=False)

    if given.command == "build-index":
        build_index(spark, given.source, given.target, given.force, given.report)
    elif given.command == "make-pairs":
        built = index.PrefixIndex.open(spark, given.index)
        told(pairs.label_counts(make_pairs(spark, given.train, given.dev, built, given.target, given.force, negatives=given.negatives, pool=given.pool)))
    elif given.command == "sanitize-pairs":
        print(json.dumps(tables.sanitize_pairs(spark, given.source, given.target, given.report)))
    elif given.command == "fit-tokenizer":
        print(fit_tokenizer(spark, given.source, given.target, vocab.TokenizerConfig(max_vocab_size=given.max_vocab_size, max_char_vocab_size=given.max_char_vocab_size)).vocab_size)
    elif given.command == "train":
        shape = {"embedding_dim": given.embedding_dim, "hidden_dim": given.hidden_dim}
        print(json.dumps(train_ranker(spark, given.pairs, given.dev, given.tokenizer, given.target, given.report, shape, epochs=given.epochs, max_examples=given.max_examples)))
    elif given.command == "evaluate":
        opened = ranker.Ranker.open(spark, given.tokenizer, given.checkpoint) if given.checkpoint else None
        told(evaluate_pairs(tables.read_pairs(spark, given.pairs), opened and opened.tokenizer, opened and opened.model, top_k=given.top_k))
    elif given.command == "benchmark":
        told(benchmark(index.PrefixIndex.open(spark, given.index), limit=given.limit, timed=given.timed))
    elif given.command == "synthetic":
        synthetic.write_splits(spark, given.target, given.rows, seed=given.seed, force=given.force).groupBy("split").count().show()
    elif given.command == "inspect":
        built = index.PrefixIndex.open(spark, given.index)
        built.inspect().show(truncate=False)
        built.statistics().show(truncate=False)
        built.samples(list(BENCHMARK_PREFIXES)).orderBy("typed", "rank").show(100, truncate=False)
    else:
        index.PrefixIndex.open(spark, given.index).samples(given.prefixes, given.limit).orderBy("typed", "rank").show(1000, truncate=False)


if __name__ == "__main__":
    main()
