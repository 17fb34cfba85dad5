import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from querymill.llm import overlap

DDL = "qid string, normalized_query string, split string, source string, id int, text string, train int, key string"


def near(a: str, b: str) -> bool:
    if a == b:
        return True
    x, y = Counter(a.split()), Counter(b.split())
    if sum((x - y).values()) <= 1 and sum((y - x).values()) <= 1:
        return True
    if abs(len(a) - len(b)) > 2:
        return False
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row = row, [i]
        for j, d in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return row[-1] <= 2


def brute(data):
    train, other = [], []
    for q, t, s, *_ in data:
        c = overlap.canonical(t)
        if q and c and s:
            (train if s == "train" else other).append((q, c))
    return sorted({(min(a, b), max(a, b)) for a, x in other for b, y in train if a != b and near(x, y)})


def variants(seed: int, n: int):
    rng = random.Random(seed)
    words = "red green blue oak steel lamp table how to find the best of a in on kit plan".split()
    data = []
    for k in range(n):
        base = " ".join(rng.choice(words) for _ in range(rng.randint(1, 8)))
        data.append((f"Q{len(data)}", base, "train", "s"))
        for _ in range(2):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(t) + 1)
                kind = rng.random()
                if kind < 0.4:
                    t.insert(at, rng.choice("abcdefg "))
                elif t and kind < 0.7:
                    t.pop(min(at, len(t) - 1))
                elif t:
                    t[min(at, len(t) - 1)] = rng.choice("abcxyz ")
            text = "".join(t)
            if rng.random() < 0.3:
                w = text.split()
                rng.shuffle(w)
                text = " ".join(w)
            if rng.random() < 0.3:
                text = text.upper() + " !?"
            data.append((f"Q{len(data)}", text, rng.choice(["dev", "test", "train"]), "s" if rng.random() < 0.8 else None))
    return data


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, "t", 0, "k") for r in data], DDL).repartition(3)


@pytest.mark.parametrize("group_pairs", [overlap.GROUP_PAIRS, 12])
def test_pairs_like_brute_force_also_with_refined_keys(spark, rows, group_pairs):
    data = variants(4, 60) + [("Z1", "a", "train", "s"), ("Z2", "b", "dev", "s"), ("Z3", "日本 語", "dev", "s"), ("Z4", "日本 語ー", "train", "s")]
    pairs, _ = overlap.split_overlap(frame(spark, data), "qid", "normalized_query", "split", "source", group_pairs=group_pairs)
    assert rows(pairs) == brute(data)


@pytest.mark.parametrize("limits", [{"FILTER_BYTES": 1}, {"_BROADCAST_KEYS": 0}])
def test_pairs_are_the_same_without_the_filter(spark, rows, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(overlap, name, value)
    data = variants(10, 40)
    pairs, _ = overlap.split_overlap(frame(spark, data), "qid", "normalized_query", "split", "source")
    assert rows(pairs) == brute(data)


def test_key_filter_misses_no_key(spark, monkeypatch):
    keys = spark.range(30_000).select((F.xxhash64("id")).alias("key")).repartition(5)
    bits = overlap._key_filter(keys)
    own = np.array([r.key for r in keys.collect()], dtype=np.int64)
    other = np.array([r.key for r in spark.range(30_000, 60_000).select(F.xxhash64("id").alias("key")).collect()], dtype=np.int64)
    assert overlap._passes(own, bits).all() and overlap._passes(other, bits).mean() < 0.03
    assert len(bits) == 8
    # with less room it lets more pass, but misses none
    monkeypatch.setattr(overlap, "FILTER_BYTES", 3 * overlap._BLOCK_BITS // 8)
    bits = overlap._key_filter(keys)
    assert len(bits) == 3 and overlap._passes(own, bits).all() and overlap._passes(other, bits).mean() < 0.2
    monkeypatch.setattr(overlap, "FILTER_BYTES", overlap._BLOCK_BITS // 8)
    assert overlap._key_filter(keys) is None


def test_hot_half_of_many_texts(spark, rows):
    """A third of the texts share their first half; edits stand in the second."""
    rng = random.Random(5)
    data = []
    for k in range(60):
        tail = "".join(rng.choice("abcdefghij") for _ in range(22))
        data.append((f"T{k}", f"the common beginning of it all {tail}", "train", "s"))
        at = rng.randrange(20)
        data.append((f"D{k}", f"the common beginning of it all {tail[:at]}{tail[at + 1:]}x", "dev", "s"))
    pairs, _ = overlap.split_overlap(frame(spark, data), "qid", "normalized_query", "split", "source", group_pairs=4)
    assert rows(pairs) == brute(data)


def test_nulls_blanks_repeats_and_long_texts(spark, rows):
    long = "word " * 30_000
    data = [("A", "Same text", "train", "s"), ("B", "same, TEXT!", "dev", None), ("B", "same, TEXT!", "dev", None), (None, "same text", "test", "s"), ("C", None, "dev", "s"), ("D", "?!", "dev", "s")]
    data += [("E", "??", "train", "s"), ("F", "same text", None, "s"), ("A", "same text", "dev", "s"), ("L1", long, "train", "s"), ("L2", long + "x", "test", "s")]
    pairs, report = overlap.split_overlap(frame(spark, data), "qid", "normalized_query", "split", "source")
    assert rows(pairs) == [("A", "B"), ("L1", "L2")]
    assert rows(report) == sorted([("dev", None, 1, 1), ("dev", "s", 1, 1), ("test", "s", 1, 1)], key=repr)
    pairs, report = overlap.split_overlap(frame(spark, []), "qid", "normalized_query", "split", "source")
    assert rows(pairs) == [] and rows(report) == []


def test_keys_meet_for_every_two_edits():
    rng = random.Random(6)
    for _ in range(3000):
        a = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 12)))
        t = list(a)
        for _ in range(2):
            at = rng.randrange(len(t) + 1)
            k = rng.random()
            if k < 0.34:
                t.insert(at, rng.choice("ab c"))
            elif t and k < 0.67:
                t.pop(min(at, len(t) - 1))
            elif t:
                t[min(at, len(t) - 1)] = "z"
        b = "".join(t)
        keys = lambda x, probe: {overlap.edit_key(x, s, probe) for s in overlap.edit_states(len(x), probe)} - {None}
        assert keys(a, False) & keys(b, True)
        assert all(overlap.edit_keys(x, probe) == keys(x, probe) for x in (a, b) for probe in (False, True))
        finer = lambda x, probe: {(overlap.edit_key(x, s, probe), overlap.edit_key(x, f, probe)) for s in overlap.edit_states(len(x), probe) for f in overlap.finer_states(s, probe) if overlap.edit_key(x, s, probe) is not None}
        assert finer(a, False) & finer(b, True)


def test_groups_across_arrow_batches(spark, rows):
    """Key groups that begin in one Arrow batch and end inside the next."""
    data = variants(7, 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        pairs, _ = overlap.split_overlap(frame(spark, data), "qid", "normalized_query", "split", "source")
        assert rows(pairs) == brute(data)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edits_on_both_sides_of_a_part_border(spark, rows):
    """Texts of 32 characters that share all but the eight around their middle; edits stand at both ends of these."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzабвгдежзиклмнопрстуфхцчшщыэюя"
    data = []
    for k in range(30):
        text = list("shared abcde" + "".join(rng.choice(letters) for _ in range(8)) + "and the ende")
        text[15] = " "
        data.append((f"T{k}", "".join(text), "train", "s"))
        kind = k % 3
        if kind == 0:  # two replacements in different words
            text[12], text[19] = "1", "2"
        elif kind == 1:  # an insertion and a deletion
            text[12], text[19] = text[12] + "1", ""
        else:
            text[12], text[19] = "", text[19] + "1"
        data.append((f"D{k}", "".join(text), "dev", "s"))
    pairs, _ = overlap.split_overlap(frame(spark, data), "qid", "normalized_query", "split", "source", group_pairs=1)
    assert rows(pairs) == brute(data)
    assert len(brute(data)) >= 30


@pytest.mark.parametrize("group_pairs", [overlap.GROUP_PAIRS, 6])
def test_groups_across_partitions(spark, rows, group_pairs):
    """Keys of a third of all texts, spread over many small partitions: one-word texts, a bag less one word, a shared half."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    data = []
    for k in range(40):
        data.append((f"T{k}", word(5), "train", "s"))
        data.append((f"D{k}", word(6), "dev", "s"))
        data.append((f"T1{k}", f"lamp oak {word(7)} table", "train", "s"))
        data.append((f"D1{k}", f"table {word(9)} lamp oak", "test", "s"))
        tail = word(18)
        data.append((f"T2{k}", f"one beginning of them all {tail}", "train", "s"))
        data.append((f"D2{k}", f"one beginning of them all {tail[:7]}x{tail[8:]}", "dev", None))
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "24", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        pairs, report = overlap.split_overlap(frame(spark, data), "qid", "normalized_query", "split", "source", group_pairs=group_pairs)
        assert rows(pairs) == brute(data) and len(brute(data)) > 3_200
        assert sum(r.n_overlapping for r in report.collect()) == 120
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
