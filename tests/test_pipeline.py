from querymill.operators import index, ranker, vocab
from querymill.plans import pipeline

DDL = "qid string, original_query string, normalized_query string"
WORDS = ("red", "green", "blue", "oak", "steel", "lamp", "table")


def test_whole_run(spark, tmp_path, capsys):
    path = lambda name: str(tmp_path / name)
    texts = [f"{a} {b}" for a in WORDS for b in WORDS]
    rows = [(f"Q{i:03d}", t.title(), t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows[:40], DDL).write.parquet(path("train"))
    spark.createDataFrame([*rows[:3], *rows[40:]], DDL).write.parquet(path("dev"))
    built = pipeline.build_index(spark, path("train"), path("index"), report=path("report"))
    assert spark.read.json(path("report")).first().unique_queries == 40
    made = pipeline.make_pairs(spark, path("train"), path("dev"), built, path("pairs"), most=4, negatives=2)
    excluded = {t for _, _, t in [*rows[:3], *rows[40:]]}
    assert made.count() > 160 and not {r.candidate for r in made.where("label = 0").collect()} & excluded
    dev = spark.read.parquet(path("dev"))
    plain = pipeline.evaluate(dev, built, most=4).first()
    assert (plain.n_evaluated, plain.n_target_missing) == (12, 36) and plain.hit_rate_at_k > 0
    tokenizer = vocab.Tokenizer.fit_pairs(made)
    model = ranker.RankerModel(ranker.RankerConfig(tokenizer.vocab_size, 8, 8))
    scored = pipeline.evaluate(dev, built, tokenizer, model, most=4).first()
    assert (scored.n_evaluated, scored.n_target_missing) == (12, 36)
    same = ranker.RankerModel(ranker.RankerConfig(tokenizer.vocab_size, 8, 8))
    same.p["out"] *= 0
    assert pipeline.evaluate(dev, built, tokenizer, same, most=4).first() == plain  # ties keep the index's order


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(pipeline, "session", lambda *_: spark)
    source, target = str(tmp_path / "log"), str(tmp_path / "index")
    spark.createDataFrame([("Q1", "Red lamp", "red lamp"), ("Q2", "Red", "red")], DDL).write.parquet(source)
    pipeline.main(["build-index", source, target])
    pipeline.main(["lookup", target, "red", "--limit", "1"])
    pipeline.main(["inspect", target])
    out = capsys.readouterr().out
    assert "red" in out and "hot_prefix_cache" in out
    assert index.PrefixIndex.open(spark, target).queries.count() == 2


def test_commands_from_log_to_ranker(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(pipeline, "session", lambda *_: spark)
    path = lambda name: str(tmp_path / name)
    run = lambda *args: pipeline.main([str(a) for a in args])
    run("synthetic", path("log"), "--rows", 300)
    for split in ("train", "dev"):
        spark.read.parquet(path("log")).where(f"split = '{split}'").drop("split").write.parquet(path(split))
    run("build-index", path("train"), path("index"), "--report", path("built"))
    assert spark.read.json(path("built")).first().n_hot_rows > 0
    run("make-pairs", path("train"), path("dev"), path("index"), path("pairs"), "--report", path("counts"), "--negatives", 2)
    run("make-pairs", path("dev"), path("train"), path("index"), path("devpairs"))
    assert {r.source for r in spark.read.json(path("counts")).collect()} >= {"positive", "index_retrieved"}
    run("fit-tokenizer", path("pairs"), path("tokenizer"))
    run("train", path("pairs"), path("devpairs"), path("tokenizer"), path("model"), "--epochs", 1, "--max-examples", 200, "--embedding-dim", 8, "--hidden-dim", 8, "--report", path("epochs"))
    model, epoch, measured = ranker.load_checkpoint(spark, path("model"))
    assert epoch == 1 and measured["n_evaluated"] > 0 and spark.read.json(path("epochs")).first().mrr_at_5 == measured["mrr_at_5"]
    run("evaluate", path("devpairs"), "--tokenizer", path("tokenizer"), "--checkpoint", path("model"), "--report", path("scored"))
    run("evaluate", path("devpairs"), "--report", path("plain"))
    plain = spark.read.json(path("plain")).first()
    assert plain.precision_at_1 == 1.0 and spark.read.json(path("scored")).first().n_evaluated == plain.n_evaluated
    run("benchmark", path("index"), "--timed", 1, "--report", path("timed"))
    assert spark.read.json(path("timed")).count() == len(pipeline.BENCHMARK_PREFIXES)
    opened = ranker.Ranker.open(spark, path("tokenizer"), path("model"))
    built = index.PrefixIndex.open(spark, path("index"))
    found = opened.suggest(spark.createDataFrame([("ga",), ("zzz",)], "prefix string"), built, 3).collect()
    assert [r.prefix for r in found] == ["ga"] and len(found[0].suggestions) == 3
    ranked = opened.rank(spark.createDataFrame([("ga", "garden", 1), ("ga", "gate", 2)], "prefix string, candidate string, place int"), ["prefix"], "place", 1)
    assert ranked.count() == 1
    assert [t["prefixes"] for t in pipeline.throughput(built, (3, None))][0] == 3


def test_pair_file_metrics(spark):
    """Runs of lines are groups: a prefix that comes back later is a group of its own."""
    lines = [("a", "x", 1), ("a", "y", 0), ("b", "x", 0), ("b", "y", 1), ("a", "z", 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(lines)], "n int, prefix string, candidate string, label int")
    got = pipeline.evaluate_pairs(df, order=["n"]).first()
    assert (got.n_evaluated, got.n_target_missing, got.precision_at_1, got.mrr_at_k) == (2, 1, 0.5, 0.75)
    # the driver's metrics of a sample agree with those of the plan
    import numpy as np

    same = ranker.ranking(np.array([2.0, 1.0, 2.0, 1.0, 0.0]), np.array([1, 0, 0, 1, 0]), np.array(["a", "a", "b", "b", "c"]))
    assert all(same[k] == got[k] for k in same)
    assert ranker.ranking(np.array([]), np.array([]), np.array([]))["n_evaluated"] == 0
