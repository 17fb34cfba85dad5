from collections import defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querymill.llm import sampling, topn

DDL = "prefix string, normalized_query string, popularity long, g string, s int, salt int, i string, bs int"


def brute(rows, n):
    best = defaultdict(dict)
    for g, i, s, *_ in rows:
        if None not in (g, i, s):
            best[g][i] = max(s, best[g].get(i, s))
    out = []
    for g, items in best.items():
        ranked = sorted(items.items(), key=lambda x: (-x[1], x[0]))[:n]
        out += [(g, r, i, s) for r, (i, s) in enumerate(ranked, 1)]
    return sorted(out, key=repr)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], DDL).repartition(parts)


@pytest.mark.parametrize("broadcast_bytes", ["-1", "10485760"])
def test_top_n_with_ties_repeats_nulls_and_clashing_names(spark, rows, broadcast_bytes):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast_bytes)
    data = [("a", f"q{k % 40:02d}", k % 7) for k in range(400)] + [("b", "", 5), ("b", "x" * 50_000, 5), ("b", "", 5)]
    data += [(None, "q", 1), ("c", None, 1), ("c", "q", None), ("", "q", 0), ("a", "q00", 2**62), ("a", "q01", -(2**63))]
    try:
        got = topn.top_n(frame(spark, data), "prefix", "normalized_query", "popularity", 10)
        assert got.columns == ["prefix", "new_rank", "normalized_query", "popularity"]
        assert rows(got) == brute(data, 10)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_at_most_n_items_of_a_group_leave_a_partition(spark, monkeypatch):
    left = []
    monkeypatch.setattr(topn, "written", lambda df, name: left.append(df) or df)
    data = [("hot", f"q{k % 50}", k) for k in range(3000)] + [("cold", "q", 1)]
    topn.top_n(frame(spark, data, 4), "prefix", "normalized_query", "popularity", 3).collect()
    per = left[0].groupBy(F.spark_partition_id(), "g").count().collect()
    assert len(per) >= 5 and max(r["count"] for r in per) == 3


def test_top_n_of_nothing(spark, rows):
    assert rows(topn.top_n(frame(spark, []), "prefix", "normalized_query", "popularity", 3)) == []
    with pytest.raises(ValueError):
        topn.top_n(frame(spark, []), "prefix", "normalized_query", "popularity", 0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("pqrstuv"), st.integers(0, 3)), max_size=60), st.integers(1, 4))
def test_top_n_like_brute_force(spark, rows, data, n):
    assert rows(topn.top_n(frame(spark, data), "prefix", "normalized_query", "popularity", n)) == brute(data, n)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sample") / "t.parquet")
    frame = spark.range(3000).select(F.concat(F.lit("Q"), "id").alias("qid"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("normalized_query"), (F.col("id") % 4).cast("int").alias("piece"))
    # files of very different sizes, with small row groups
    frame.repartitionByRange(5, F.pow(F.col("id"), 3)).write.option("parquet.block.size", 2048).parquet(path)
    return path


def test_sample_has_the_size_and_no_repeats(spark, table):
    got = [r[0] for r in sampling.block_sample(spark, table, ["qid"], 500, seed=1).collect()]
    assert len(got) == len(set(got)) == 500
    assert sorted(got) == sorted(r[0] for r in sampling.block_sample(spark, table, ["qid"], 500, seed=1).collect())
    assert sorted(got) != sorted(r[0] for r in sampling.block_sample(spark, table, ["qid"], 500, seed=2).collect())


def test_sample_is_uniform(spark, table):
    seen = defaultdict(int)
    for seed in range(12):
        for (q,) in sampling.block_sample(spark, table, ["qid"], 600, seed=seed).collect():
            seen[int(q[1:]) // 500] += 1
    # 1200 expected in each sixth; the standard deviation is about 29
    assert len(seen) == 6 and all(1060 < n < 1340 for n in seen.values())


def test_sample_of_what_arrived_of_all_and_of_nothing(spark, table, tmp_path):
    arrived = sampling.block_sample(spark, table, ["qid", "piece"], 100, seed=3, arrived=F.col("piece") < 2).collect()
    assert len({r.qid for r in arrived}) == 100 and {r.piece for r in arrived} == {0, 1}
    assert sampling.block_sample(spark, table, ["qid"], 5000).count() == 3000
    assert sampling.block_sample(spark, table, ["qid"], 0).count() == 0
    spark.createDataFrame([], "qid string").write.parquet(str(tmp_path / "e.parquet"))
    assert sampling.block_sample(spark, str(tmp_path / "e.parquet"), ["qid"], 5).count() == 0


def test_sample_over_many_unequal_row_groups(spark, tmp_path):
    """Chi-square over rows of 30 groups of 1 to 97 rows in several files."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 0
    for f in range(6):
        shape = pa.schema([("n", pa.int64())])
        with pq.ParquetWriter(tmp_path / f"f{f}.parquet", shape) as writer:
            for g in range(5):
                size = 1 + (f * 5 + g) ** 2 * 97 // 29**2
                writer.write_table(pa.table({"n": range(n, n + size)}, schema=shape))
                n += size
    assert sampling.row_groups(spark, str(tmp_path)).count() == 30
    seen, rounds, k = np.zeros(n), 25, 200
    for seed in range(rounds):
        got = [r.n for r in sampling.block_sample(spark, str(tmp_path), ["n"], k, seed=seed).collect()]
        assert len(set(got)) == k
        seen[got] += 1
    share = k / n
    chi = ((seen - rounds * share) ** 2 / (rounds * share * (1 - share))).sum()
    assert n - 5 * (2 * n) ** 0.5 < chi < n + 5 * (2 * n) ** 0.5


def test_only_row_groups_that_are_hit_are_read(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    with pq.ParquetWriter(tmp_path / "t.parquet", pa.schema([("n", pa.int64()), ("x", pa.string())])) as writer:
        for g in range(40):
            writer.write_table(pa.table({"n": range(g * 10, g * 10 + 10), "x": ["y"] * 10}))
    groups = sampling.row_groups(spark, str(tmp_path)).collect()
    places = spark.createDataFrame([(g.file, g.row_group, o, g.row_group) for g in groups if g.row_group % 13 == 0 for o in (0, 7)], "file string, row_group int, offset long, draw long")
    shape = spark.read.parquet(str(tmp_path)).schema
    got = sampling._rows_at(places, ["n"], shape, 3).collect()
    assert sorted((r.n, r.draw) for r in got) == sorted((g * 10 + o, g) for g in (0, 13, 26, 39) for o in (0, 7))


def test_merged_samples_are_uniform(spark):
    old, new = spark.range(0, 300), spark.range(300, 400)
    seen = defaultdict(int)
    for seed in range(30):
        part = lambda df, i: df.orderBy(F.xxhash64(F.lit(f"{i}{seed}"), "id")).limit(100)
        got = [r.id for r in sampling.merge_samples(part(old, "a"), 300, part(new, "b"), 100, 100, seed).collect()]
        assert len(set(got)) == 100
        for i in got:
            seen[i // 100] += 1
    assert sum(sampling.fresh_rows(300, 100, 40, i) for i in range(200)) == pytest.approx(2000, abs=150) and sampling.fresh_rows(0, 5, 9, 1) == 5
    assert all(640 < n < 860 for n in seen.values()) and sum(seen.values()) == 3000
    assert sampling.merge_samples(old, 300, new, 100, 1000, 1).count() == 400 and sampling.merge_samples(old, 300, new, 100, 0, 1).count() == 0


def test_permutation_has_no_collisions_and_inverts_nothing_away(spark):
    df = spark.range(50_000).select(sampling.permuted(F.col("id"), 7).alias("p"))
    stats = df.agg(F.count_distinct("p"), F.min("p"), F.max("p"), F.avg("p")).first()
    assert stats[0] == 50_000 and stats[1] >= 0 and stats[2] < sampling.DOMAIN
    assert abs(stats[3] / sampling.DOMAIN - 0.5) < 0.01


def test_stable_sample_grows_only(spark, rows):
    texts = [(f"text {k}", k) for k in range(2000)] + [(None, 1), ("", 2), ("text 1", 3), ("long " * 20_000, 4)]
    some = spark.createDataFrame(texts[:1200], "t string, x int").repartition(3)
    every = spark.createDataFrame(texts, "t string, x int").repartition(7)
    a, b = set(rows(sampling.stable_sample(some, "t", 0.2))), set(rows(sampling.stable_sample(every, "t", 0.2)))
    assert a <= b and {t for (t,) in b - a}.isdisjoint({t for t, _ in texts[:1200]})
    assert 320 < len(b) < 480
    assert b <= set(rows(sampling.stable_sample(every, "t", 0.3)))
    assert len(rows(sampling.stable_sample(every, "t", 1.0))) == 2002 and rows(sampling.stable_sample(every, "t", 0.0)) == []
    assert rows(sampling.stable_sample(every.limit(0), "t", 0.5)) == []
