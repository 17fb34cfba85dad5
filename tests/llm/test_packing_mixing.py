import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from querymill.llm import mixing, packing, tokens

DOCS = "doc_id long, text string, source string, block int, n_tokens string, k int"


def optimal(sizes, capacity):
    """The fewest containers, by trying all placements."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[i]:
                k = rooms.index(room)
                place(i + 1, rooms[:k] + [room - sizes[i]] + rooms[k + 1 :])
        place(i + 1, rooms + [capacity - sizes[i]])

    place(0, [])
    return best


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(1)
    improved = 0
    for _ in range(10_000):
        capacity = rng.choice([10, 20, 50, 60, 100])
        low, high = rng.choice([(1, capacity), (capacity // 8, capacity // 2), (capacity // 5, capacity // 2), (2, 2 * capacity // 3)])
        sizes = [rng.randint(max(1, low), high) for _ in range(rng.randint(1, 12))]
        got, least = packing.bin_completion(sizes, capacity)
        assert least and Counter(itertools.chain(*got)) == Counter(sizes) and all(sum(b) <= capacity for b in got)
        first, bound = len(packing.best_fit_decreasing(sizes, capacity)), packing.least_containers(sizes, capacity)
        if first > bound:  # else the bound itself proves it
            assert bound <= len(got) == optimal(sorted(sizes, reverse=True), capacity)
            improved += first > len(got)
    assert improved > 20


def test_bin_completion_where_a_full_container_misleads():
    """The fullest container around the largest size is none of the best solution's."""
    sizes = [21, 9, 2, 18, 29, 20, 9, 26, 34, 21, 30, 28, 39, 14]
    for steps in (packing.SEARCH_STEPS, None):
        got, least = packing.bin_completion(sizes, 60, steps)
        assert len(got) == 5 and least
    # a search that may take no step gives best fit decreasing and says so
    assert packing.bin_completion(sizes, 60, 0) == (packing.best_fit_decreasing(sizes, 60), False)


def test_packing_checks_find_faults(spark):
    texts = [(k, "word " * (k * 7 % 90), "s") for k in range(40)]
    caps = spark.createDataFrame([(1, 64)], "capacity_id int, capacity_tokens int")
    packed = packing.pack_texts(docs(spark, texts), caps)
    check = lambda df: tuple(packing.packing_checks(docs(spark, texts), df, caps).first())
    assert check(packed) == (1, 40, True, True, True, True)
    assert check(packed.where("doc_id != 5"))[2] is False
    assert check(packed.withColumn("container_id", F.lit(0).cast("long")))[3] is False
    assert packing.packing_report(packed, caps).first().n_containers == packed.select("container_id").distinct().count()


def docs(spark, data):
    return spark.createDataFrame([(*d, 1, "x", 2) for d in data], DOCS).repartition(3)


def test_packing(spark, data=None):
    rng = random.Random(2)
    texts = [(k, "word " * rng.randint(0, 900), "s") for k in range(300)] + [(900, None, "s"), (901, "", "s"), (None, "null id", "s"), (902, "y" * 70_000, "s"), (5, "again", "s")]
    caps = spark.createDataFrame([(1, 64), (2, 512), (3, None), (4, 0)], "capacity_id int, capacity_tokens int")
    got = packing.pack_texts(docs(spark, texts), caps, block_docs=100).collect()
    encoding = tokens.tokenizer(f"{tokens.TOKENIZER_DIR}/{tokens.VOCABULARY}")
    sizes = Counter((d, tokens.count_tokens(encoding, t)) for d, t, _ in texts if t is not None)
    for cap_id, cap in ((1, 64), (2, 512)):
        mine = [r for r in got if r.capacity_id == cap_id]
        room = defaultdict(int)
        for r in mine:
            room[r.container_id] += r.n_tokens
        assert max(room.values()) <= cap
        per = defaultdict(list)
        for r in mine:
            per[r.doc_id].append(r)
        assert set(per) == {d for d, _ in sizes}
        for d, rs in per.items():
            if d != 5:
                ((_, n),) = [k for k in sizes if k[0] == d]
                rs.sort(key=lambda r: r.piece)
                assert sum(r.n_tokens for r in rs) == n and len(rs) == max(1, -(-n // cap))
                assert [r.start_token for r in rs] == [i * cap for i in range(len(rs))]
        total = sum(room.values())
        assert len(room) <= -(-total // cap) * 1.12 + 4
    assert {r.capacity_id for r in got} == {1, 2}
    assert packing.pack_texts(docs(spark, []), caps).count() == 0
    assert packing.pack_texts(docs(spark, texts), caps.limit(0)).count() == 0


def test_capped_shares():
    tokens_by = {"a": 100, "b": 1000}
    assert mixing.capped_shares(tokens_by, {"a": 0.5, "b": 0.5}, {"a": 10, "b": 1}, 1000) == pytest.approx({"a": 0.5, "b": 0.5})
    assert mixing.capped_shares(tokens_by, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 1}, 1000) == pytest.approx({"a": 0.2, "b": 0.8})
    assert mixing.capped_shares(tokens_by, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, 5000) == pytest.approx({"a": 0.02, "b": 0.2})


def test_temperature():
    have, none = {"a": 1000, "b": 10}, {"a": 10**9, "b": 10**9}
    assert mixing.temperature_shares(have, 0) == pytest.approx({"a": 0.5, "b": 0.5})
    assert mixing.temperature_shares(have, 1)["b"] == pytest.approx(10 / 1010)
    for goal in (0.02, 0.3, 0.6):  # the first is more concentrated than the sources are
        exponent, shares, _ = mixing.temperature_mix(have, none, goal)
        assert mixing.entropy(shares) == pytest.approx(goal, rel=1e-6) and (exponent > 1) == (goal == 0.02)
    # no exponent can concentrate equal sources; the entropy of the mix says so
    _, shares, _ = mixing.temperature_mix({"a": 5, "b": 5, "c": 5}, {"a": 1, "b": 1, "c": 1}, 0.2)
    assert mixing.entropy(shares) == pytest.approx(1.0986, rel=1e-3)


def test_temperature_within_limits():
    have, limits = {"a": 1000, "b": 10}, {"a": 4, "b": 4}
    # without a budget the limits set what is spent: b is taken four times, and has half of all
    _, shares, spend = mixing.temperature_mix(have, limits, 0.6931471)
    assert shares["b"] * spend == pytest.approx(40, rel=0.05)
    # with one, the exponent rises until b's limit holds
    exponent, shares, spend = mixing.temperature_mix(have, limits, 0.6931471, 1000)
    assert spend == 1000 and shares["b"] * spend == pytest.approx(40, rel=1e-6) and 0 < exponent < 1
    # more than the limits give at any exponent
    exponent, shares, spend = mixing.temperature_mix(have, {"a": 1, "b": 1}, 0.6, 5000)
    assert exponent == 1 and spend == 1010


def test_mix_by_temperature(spark):
    data = [(k, "w " * 20, "big" if k % 10 else "small") for k in range(2000)]
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 9)], "source string, target_share double, max_repeats int")
    for budget in (None, 30_000):
        selection, shares = mixing.mix_sources(docs(spark, data), targets, budget=budget, by_temperature=True)
        report = {r.source: r for r in shares.collect()}
        assert sum(r.reached_share for r in report.values()) == pytest.approx(1.0)
        assert report["big"].reached_entropy == pytest.approx(report["big"].target_entropy, abs=0.01)
        most = Counter((r.source, r.doc_id) for r in selection.collect())
        assert max(n for (s, _), n in most.items() if s == "big") == 1 and max(n for (s, _), n in most.items() if s == "small") <= 9
        got = {r.source: (r.within_repeats, r.entropy_reached) for r in mixing.mix_checks(selection, shares).collect()}
        assert got == {"big": (True, True), "small": (True, True)}


@pytest.mark.parametrize("budget", [None, 40_000])
def test_mix(spark, budget):
    rng = random.Random(3)
    data = [(k, "w " * rng.randint(1, 60), "big" if k % 4 else "small") for k in range(1200)]
    data += [(9001, None, "big"), (9002, "", "big"), (9003, "text", None), (None, "no id", "small"), (9004, "text", "other")]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 2), ("absent", 0.2, 3), (None, 0.1, 1), ("other", None, 1)], "source string, target_share double, max_repeats int")
    selection, shares = mixing.mix_sources(docs(spark, data), targets, budget=budget)
    taken = selection.collect()
    report = {r.source: r for r in shares.collect()}
    assert set(report) == {"big", "small", "absent"} and report["absent"].reached_tokens == 0
    most = Counter((r.source, r.doc_id) for r in taken)
    assert max(n for (s, _), n in most.items() if s == "big") == 1 and max(n for (s, _), n in most.items() if s == "small") <= 2
    assert len({(r.source, r.doc_id, r["pass"]) for r in taken}) == len(taken)
    by = Counter()
    for r in taken:
        by[r.source] += r.n_tokens
    assert by["big"] == report["big"].reached_tokens and by["small"] == report["small"].reached_tokens
    if budget is None:
        assert report["small"].reached_share == pytest.approx(0.375, abs=0.01)
    again = mixing.mix_sources(docs(spark, data).repartition(7), targets, budget=budget)[0].collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, taken))


def test_mix_of_nothing(spark, rows):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    selection, shares = mixing.mix_sources(docs(spark, []), targets)
    assert rows(selection) == [] and rows(shares.select("source", "target_share", "max_repeats", "available_tokens", "reached_tokens", "reached_share")) == [("a", 1.0, 1, 0, 0, 0.0)]
    selection, shares = mixing.mix_sources(docs(spark, [(1, "x", "a")]), targets.limit(0))
    assert rows(selection) == [] and rows(shares) == []
