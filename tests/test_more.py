"""Operators on nulls, ties, repeated and empty rows, and names that clash, beside brute force."""

import json
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from querymill.operators import index, metrics, ordering, pairs, requests, urls
from querymill.plans import sites
from querymill.sources import synthetic, tables


def test_latency_of_many_and_of_few(spark):
    rng = random.Random(1)
    data = [("a", rng.choice([1.0, 2.5, 7.0]), 1) for _ in range(300)] + [("b", rng.random(), 1) for _ in range(257)] + [("one", 4.0, 1), ("none", None, 1), (None, 3.0, 1), (None, 5.0, 1), ("a", None, 1)]
    df = spark.createDataFrame([(*r, 9) for r in data], "kind string, ms double, n int, v int").repartition(7)
    groups = defaultdict(list)
    for g, v, _ in data:
        groups[g] += [v] if v is not None else []
    got = {r.kind: r for r in metrics.latency_summary(df, "kind", "ms").collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g].n == len(values)
        for name, p in (("p50_ms", 50), ("p95_ms", 95), ("p99_ms", 99)):
            assert got[g][name] == (pytest.approx(np.percentile(values, p)) if values else None)
        assert got[g].avg_ms == (pytest.approx(np.mean(values)) if values else None)
    assert metrics.latency_summary(df.limit(0), "kind", "ms").count() == 0


def test_running_counts_of_a_heavy_group(spark):
    df = spark.range(5_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"), F.col("id").alias("v"), F.lit(2).cast("long").alias("c")).repartition(6)
    got = {(r.g, r.v): (r["__from"], r["__upto"]) for r in ordering.running_counts(df, "g", "v", "c").collect()}
    for name, test in (("hot", lambda i: i % 3 > 0), ("cold", lambda i: i % 3 == 0)):
        mine = [i for i in range(5_000) if test(i)]
        assert all(got[name, v] == (2 * k, 2 * k + 2) for k, v in enumerate(mine))


def test_rank_checks_find_faults(spark):
    rows = [("ok", 1, 3.0), ("ok", 2, 3.0), ("gap", 1, 2.0), ("gap", 3, 1.0), ("rise", 1, 1.0), ("rise", 2, 2.0), ("tie", 1, 1.0), ("tie", 1, 1.0)]
    got = {r[0]: tuple(r)[1:] for r in metrics.rank_checks(spark.createDataFrame(rows, "g string, k int, s double"), "g", "k", "s").collect()}
    assert got == {"ok": (2, True, True), "gap": (2, False, True), "rise": (2, True, False), "tie": (2, False, True)}


def test_bounded_cache_like_the_class(spark):
    rng = random.Random(2)
    data = [(rng.choice(["w1", "w2", None]), rng.choice("abcdefgh"), float(t), t) for t in range(400)]
    df = spark.createDataFrame(data, "worker string, key string, at double, tie long").repartition(5)
    for most, clear in ((4, False), (3, True)):
        got = {r.tie: (r.cached, r.held) for r in requests.bounded_cache(df, "worker", "key", "at", "tie", most, 60.0, clear).collect()}
        want, caches = {}, {}
        for worker, key, at, tie in data:
            if worker is None:
                continue
            cache = caches.setdefault(worker, requests.BoundedCache(most, 60.0, clear))
            hit = cache.get(key, at) is not None
            if not hit:
                cache.put(key, True, at)
            want[tie] = (hit, len(cache.items))
        assert got == want and max(n for _, n in want.values()) <= most
    assert requests.bounded_cache(df.limit(0), "worker", "key", "at", "tie").count() == 0


def test_a_key_column_that_is_no_identifier(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 1.0)], "`client id` string, n long, at double")
    assert [r.allowed for r in requests.rate_limit(df, "client id", "at", "n", 1, 10.0).orderBy("n").collect()] == [True, False]


def test_epochs_shuffle_and_shard(spark):
    df = spark.createDataFrame([(i, "x" if i % 5 else None) for i in range(60)], "n int, line2 string")
    passes = ordering.epochs(df, ["n"], 3, 1).collect()
    for e in range(3):
        mine = sorted((r.line, r.n) for r in passes if r.epoch == e)
        assert [line for line, _ in mine] == list(range(60)) and sorted(n for _, n in mine) == list(range(60))
    orders = [tuple(n for _, n in sorted((r.line, r.n) for r in passes if r.epoch == e)) for e in range(3)]
    assert len(set(orders)) == 3
    both = [ordering.epochs(df, ["n"], 2, 1, 2, k).collect() for k in range(2)]
    assert sum(map(len, both)) == 120 and not {(r.epoch, r.line) for r in both[0]} & {(r.epoch, r.line) for r in both[1]}
    assert ordering.epochs(df, ["n"], 0).count() == 0 and ordering.epochs(df.limit(0), ["n"], 2).count() == 0


def test_pairs_of_a_hot_prefix(spark):
    """Two hundred queries of one first letter: pools stay within their bound, choices don't depend on the layout."""
    rows = [(f"Q{i:03d}", f"a{i:03d} query", f"a{i:03d} query") for i in range(200)] + [("Z", "zeta", "zeta"), (None, "x", "x"), ("E", "", ""), ("N", None, None)]
    log = spark.createDataFrame(rows, "qid string, original_query string, normalized_query string")
    from querymill.operators import corpus

    queries = corpus.dedup_query_log(log)
    made = pairs.generate_pairs(log, queries, None, most=3, negatives=4, pool=10)
    got = made.collect()
    per = defaultdict(list)
    for r in got:
        per[r.prefix, r["query"]].append((r.label, r.source))
    assert len(per) == 200 * 3 + 3 and all(sorted(v)[-1] == (1, "positive") and len(v) == 5 for v in per.values())
    assert {r.source for r in got if r["query"] == "zeta"} == {"positive", "random_fallback"}
    assert sorted(map(tuple, got)) == sorted(map(tuple, pairs.generate_pairs(log.repartition(9), queries, None, most=3, negatives=4, pool=10).collect()))
    assert pairs.generate_pairs(log.limit(0), queries, None).count() == 0
    counts = pairs.source_counts(log).first()
    assert (counts.rows_seen, counts.rejected_blank, counts.unique_queries, counts.duplicates) == (204, 3, 201, 0)


@pytest.mark.parametrize("few", [10_000, 0])
def test_lookup_of_few_and_of_many(spark, monkeypatch, few):
    monkeypatch.setattr(index, "_FEW", few)
    queries = spark.createDataFrame([(f"{c}{i:02d} machine learning tutorial", i % 4) for c in "ab" for i in range(30)], "match_key string, popularity int").withColumn("normalized_query", F.col("match_key"))
    asked = spark.createDataFrame([("a",), ("a0",), ("b12 machine learning tut",), ("",), ("zz",), (None,), ("a",)], "prefix string")
    got = defaultdict(list)
    for r in index.lookup_batch(queries, asked, 5, 20).orderBy("prefix", "rank").collect():
        got[r.prefix].append((r["rank"], r.normalized_query))
    for p in ("a", "a0", "b12 machine learning tut", ""):
        best = sorted((r for r in queries.collect() if r.match_key.startswith(p)), key=lambda r: (-r.popularity, r.normalized_query))[:5]
        assert got[p] == [(k, r.normalized_query) for k, r in enumerate(best, 1)]
    assert set(got) == {"a", "a0", "b12 machine learning tut", ""}


def test_site_checks_share_entries(spark):
    asked = spark.createDataFrame(
        [(1, "https://sample.org/a?x", 0.0), (2, "https://sample.org/b", 10.0), (3, "https://SAMPLE.org/c", 400.0), (4, "nodot", 1.0), (5, None, 2.0), (6, "http://bad.org", 3.0), (7, "http://sample.org", 3.0)],
        "n long, address string, at double",
    )
    registry = tables.read_registry(spark, [{"domain": "sample.org", "organization": "S"}])
    feed = spark.createDataFrame([("list", "BAD.org", True, "MALWARE", True, 0), ("far", "bad.org", False, None, False, 1)], urls.FEED)
    got = {r.n: r for r in sites.check_sites(asked, "address", "n", "at", registry, feed, 300.0).collect()}
    assert [got[n].cached for n in range(1, 8)] == [False, True, False, False, False, False, False]
    assert got[2].url == "https://sample.org/a" and got[3].url == "https://sample.org/c" and got[7].url == "http://sample.org/"
    assert got[4].domain == "nodot" and got[5].domain == "unknown" and not got[4].is_valid
    assert got[6].known_threat and got[6].threat_type == "MALWARE" and got[6].unavailable_checks == ["far"] and got[1].organization == "S"
    health = sites.site_health(sites.check_sites(asked, "address", "n", "at", registry, feed, 300.0), registry).first()
    assert (health.registry_entries, health.checks, health.cached, health.invalid, health.matched, health.threats) == (1, 7, 1, 2, 4, 1)
    assert sites.check_sites(asked.limit(0), "address", "n", "at", registry, feed).count() == 0


def test_synthetic_splits(spark, tmp_path):
    made = synthetic.write_splits(spark, str(tmp_path / "s"), 500, 0.2)
    assert made.count() == 500 and {r.split for r in made.select("split").distinct().collect()} == {"train", "dev"}
    assert made.groupBy("normalized_query").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert made.groupBy("normalized_query").count().where("count > 1").count() >= 9
    assert synthetic.synthetic_queries(spark, 0).count() == 0
    with pytest.raises(Exception):
        synthetic.write_splits(spark, str(tmp_path / "s"), 5)


def test_configuration_files(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"top_k": 5}))
    assert tables.read_config(str(tmp_path / "c.json")) == {"top_k": 5}
    with pytest.raises(FileNotFoundError):
        tables.read_config(str(tmp_path / "none.json"))


def test_entry_without_a_library_of_the_subpackage():
    """With xxhash missing the core's queries still load."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), 'p5_found' in q, any(n.startswith('p4') for n in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True)
    n, core, llm = done.stdout.split()
    assert int(n) > 70 and core == "True" and llm == "False"
