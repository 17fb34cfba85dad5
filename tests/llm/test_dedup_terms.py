from collections import Counter, defaultdict
import re

import pytest
from pyspark.sql import functions as F

from querymill.llm import dedup, terms

DDL = "qid string, original_query string, duplicate_count long, duplicate_qids string, key string, h long, block int, n int, ids string"


def frame(spark, data, parts=3):
    return spark.createDataFrame([(*r, "k", 1, 2, 3, "i") for r in data], DDL).repartition(parts)


def key(t):
    if t is None:
        return None
    facets, rest = [], ""
    for p in t.lower().split():
        m = re.fullmatch(r"[\W_]*([^\W_]+:[^\W_]+)[\W_]*", p)
        if m:
            facets.append(m.group(1))
        else:
            rest += re.sub(r"[\W_]+", "", p)
    return (rest, tuple(sorted(facets))) if rest or facets else None


DATA = [
    ("Q3", "Red  lamp size:xl", 0, None), ("Q1", "size:XL; red-LAMP", 1, "Q9"), ("Q2", "(red lamp) Size:xl!", 3, "Q8, Q9,Q1"), ("Q2", "(red lamp) Size:xl!", 2, ""),
    ("Q4", "red lamp", None, None), ("Q5", "re dlamp", -2, "Q5,Q5"), ("Q6", None, 5, None), ("Q7", "?! --", 0, None), (None, "red lamp", 0, None), ("Q10", "x" * 60_000, 0, "Q11"),
    ("Q12", "size:xl sort:new", 0, ""), ("Q13", "sort:new size:xl", 0, ""), ("Q14", "a:b:c d", 0, ""), ("Q15", "abc d", 2, ""), ("Q16", "", 0, ""),
]


@pytest.mark.parametrize("most_bytes", [64 << 20, 1])
def test_copies(spark, rows, most_bytes):
    records, members = dedup.collapse_copies(frame(spark, DATA), "qid", "original_query", "duplicate_count", "duplicate_qids", most_bytes=most_bytes)
    groups = defaultdict(set)
    for q, t, *_ in DATA:
        if q and key(t):
            groups[key(t)].add(q)
    assert rows(members) == sorted((min(g), q) for g in groups.values() for q in g if q != min(g))
    got = dict(rows(records))
    assert set(got) == {min(g) for g in groups.values()}
    # Q1, Q2, Q3 with Q8, Q9: five named, none unnamed; Q5 repeats only itself; Q15 says two more
    assert got["Q1"] == 5 and got["Q4"] == 2 and got["Q10"] == 2 and got["Q12"] == 2 and got["Q14"] == 4


def test_no_repeat_is_missed_in_many_rows(spark):
    data = spark.range(20_000).select((F.col("id") % 15_000).cast("string").alias("q"), F.xxhash64((F.col("id") % 15_000)).alias("h")).repartition(6)
    data = data.withColumn("block", dedup._unsigned_mod(F.col("h"), dedup.filter_blocks(20_000)))
    flagged = dedup.may_repeat(data, dedup.repeat_filter(data)).where("repeat").select("q").distinct().count()
    assert 5_000 <= flagged < 5_600  # all repeats, few others


def test_filter_in_parts_lets_no_more_pass(spark, monkeypatch, rows):
    """20,000 rows, a tenth of them repeated, with a filter of which one block in five may be broadcast."""
    data = spark.range(20_000).select(
        F.concat(F.lit("Q"), "id").alias("qid"), F.concat(F.lit("Text "), F.col("id") % 18_000).alias("original_query"), F.lit(0).alias("duplicate_count"), F.lit("").alias("duplicate_qids")
    )
    asked = []
    monkeypatch.setattr(dedup, "may_repeat", lambda r, a, real=dedup.may_repeat: asked.append(real(r, a)) or asked[-1])
    records, members = dedup.collapse_copies(data, "qid", "original_query", "duplicate_count", "duplicate_qids", most_bytes=dedup.BLOCK_BITS // 8)
    assert len(asked) == dedup.filter_blocks(20_000) == 5
    passed = sum(a.where("repeat").count() for a in asked)
    assert 4_000 <= passed < 4_800
    assert members.count() == 2_000 and records.count() == 18_000


def test_block_agrees_with_unsigned_numbers(spark):
    hashes = [0, -1, 2**63 - 1, -(2**63), 123456789012345]
    got = spark.createDataFrame([(h,) for h in hashes], "h long").select("h", dedup._unsigned_mod(F.col("h"), 37)).collect()
    assert [r[1] for r in got] == [h % 2**64 % 37 for h in hashes]


def test_no_rows(spark, rows):
    records, members = dedup.collapse_copies(frame(spark, []), "qid", "original_query", "duplicate_count", "duplicate_qids")
    assert rows(records) == [] and rows(members) == []


def brute_terms(data):
    n, r = Counter(), Counter()
    for p, c in data:
        found = [("prefix", p)] if p else []
        found += [("candidate", t) for t in (terms.terms(c) if c else [])]
        n.update(found)
        r.update(set(found))
    mark = lambda k: "rare" if k < 3 else "common" if k * 10 > len(data) else None
    return sorted(((f, t, n[f, t], r[f, t], mark(r[f, t])) for f, t in r), key=repr)


TERMS = [("a", "Red red LAMP"), ("a", "red"), ("a ", "ｒｅｄ lamp"), ("", "?!"), (None, None), ("b", "\x08ctl x"), ("a", "Red red LAMP"), ("c", "w " * 30_000), ("d", "é é x²")] + [(f"p{k}", f"t{k} common") for k in range(40)]


@pytest.mark.parametrize("limit", [{}, {"most_rows": 5}, {"most_bytes": 2_000}])
def test_terms_also_when_spilled_again_and_again(spark, rows, limit):
    df = spark.createDataFrame([(*r, 1, "x") for r in TERMS], "prefix string, candidate string, h long, term string").repartition(5)
    got = terms.term_counts(df, ["prefix"], ["candidate"], partitions=2, **limit)
    assert rows(got) == brute_terms(TERMS)


def test_spilled_files_are_deleted(spark, tmp_path):
    df = spark.createDataFrame(TERMS, "prefix string, candidate string")
    for address in (f"{tmp_path}/a", f"file://{tmp_path}/b"):
        assert terms.term_counts(df, ["prefix"], ["candidate"], partitions=2, most_rows=5, spill_dir=address).count() > 40
    assert not list(tmp_path.rglob("*.parquet")) and (tmp_path / "a").exists() and (tmp_path / "b").exists()


def test_terms_of_nothing(spark, rows):
    assert rows(terms.term_counts(spark.createDataFrame([], "prefix string, candidate string"), ["prefix"], ["candidate"])) == []
