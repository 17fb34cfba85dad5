import datetime as dt
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from querymill.operators import corpus, heavy_keys, index, metrics, ordering, pairs, ranker, requests, urls, vocab
from querymill.runtime import shared_dir

LOG = [
    ("Q001", "machine learning", "machine learning"), ("Q002", "machine learning course", "machine learning course"), ("Q003", "machine learning tutorial", "machine learning tutorial"),
    ("Q004", "Machine Learning Tutorial", "machine learning tutorial"), ("Q005", "python tutorial", "python tutorial"),
]
DDL = "qid string, original_query string, normalized_query string"


def log(spark, extra=()):
    return spark.createDataFrame([*LOG, *extra], DDL)


def test_dedup(spark, rows):
    bad = [(None, "x", "x"), ("Q9", "x", ""), ("Q9", "x", None), ("Q8", "  ", "  ")]
    got = {r.normalized_query: r for r in corpus.dedup_query_log(log(spark, bad)).collect()}
    assert len(got) == 4
    third = got["machine learning tutorial"]
    assert (third.qid, third.duplicate_count, third.popularity) == ("Q003", 1, 2)
    again = log(spark, [("Q003", "again", "machine learning tutorial")])
    assert rows(corpus.duplicates(again)) == [("machine learning tutorial", "Q003", "Q003", 1), ("machine learning tutorial", "Q003", "Q004", 1)]
    lists = {r.qid: r.duplicate_qids for r in corpus.with_duplicate_lists(corpus.dedup_query_log(again), corpus.duplicates(again)).collect()}
    assert lists["Q003"] == "Q003,Q004" and lists["Q001"] == ""
    assert tuple(corpus.build_stats(log(spark, bad)).first()) == (9, 4, 5, 4, 1)
    assert {r.popularity for r in corpus.dedup_query_log(log(spark), "neutral").collect()} == {1}
    with pytest.raises(ValueError):
        corpus.dedup_query_log(log(spark), "other")
    with pytest.raises(ValueError, match="normalized_query"):
        corpus.required_columns(log(spark).drop("normalized_query"))
    assert rows(corpus.dedup_query_log(log(spark).limit(0))) == []


def test_index_round_trip(spark, tmp_path, rows):
    path = str(tmp_path / "index")
    built = index.PrefixIndex.build(log(spark), path, hot_length=3, hot_top_k=2)
    asked = spark.createDataFrame([("m",), ("MACHINE learning t",), ("",), ("zzz",), ("p",)], "prefix string")
    got = defaultdict(list)
    for r in built.get_candidates(asked, 10).orderBy("typed", "rank").collect():
        got[r.typed].append((r.normalized_query, r.source))
    scan, hot = "range_scan", "hot_cache"
    best = ["machine learning tutorial", "machine learning", "machine learning course"]
    assert got["m"] == [(q, scan) for q in best]
    assert got["MACHINE learning t"] == [(best[0], scan)] and got["p"] == [("python tutorial", hot)]
    assert [q for q, _ in got[""]] == [*best, "python tutorial"] and "zzz" not in got
    assert [r.normalized_query for r in built.get_candidates(asked.where("prefix = 'm'"), 2).orderBy("rank").collect()] == best[:2]
    assert built.get_candidates(asked, 0).count() == 0 and built.get_candidates(asked, None).count() == 0
    assert dict(rows(index.PrefixIndex.open(spark, path).inspect()))["queries"] == 4
    with pytest.raises(Exception):
        index.PrefixIndex.build(log(spark), path)


def test_lookup_of_prefixes_longer_than_the_join_key(spark):
    queries = corpus.dedup_query_log(log(spark))
    asked = spark.createDataFrame([("machine learning tu",)], "prefix string")
    assert [r.normalized_query for r in index.lookup_batch(queries, asked, 5, max_length=4).collect()] == ["machine learning tutorial"]


def test_pairs(spark):
    dev = log(spark).where("qid = 'Q002'")
    train = log(spark, [("Q7", "bad\x08", "bad\x08")]).where("qid != 'Q002'")
    queries = corpus.dedup_query_log(log(spark))
    made = pairs.generate_pairs(train, queries, dev, 1, 12, 5, True, 2, 10)
    got = made.collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, pairs.generate_pairs(train.repartition(3), queries, dev, 1, 12, 5, True, 2, 10).collect()))
    assert all(r.candidate != "machine learning course" for r in got) and all("\x08" not in r.candidate for r in got)
    assert all(r.candidate == r["query"] for r in got if r.label) and all(r.candidate != r["query"] for r in got if not r.label)
    assert all(r.candidate.startswith(r.prefix) for r in got if r.source == "index_retrieved")
    per = Counter((r["query"], r.prefix, r.label) for r in got)
    assert all(n == 1 for (_, _, label), n in per.items() if label) and all(n <= 2 for n in per.values())


def test_tokenizer(spark, tmp_path):
    texts = spark.createDataFrame([("machine learning",), ("machine learning course",), ("café near me",), ("machine learning",), (None,)], "text string")
    fitted = vocab.Tokenizer.fit(texts)
    assert fitted.words["learning"] == 4 and fitted.words["machine"] == 5
    assert min(fitted.chars.values()) == 4 + len(fitted.words)
    df = spark.createDataFrame([("mach", "machine zq"), (None, None), ("x " * 500, "y " * 500)], "prefix string, candidate string")
    got = fitted.encode_pairs(df, 10).collect()
    c = fitted.chars
    assert got[0].ids == [2, c["m"], c["a"], c["c"], 3, 5, 1, 1, 3] and got[0].length == 9 and got[0].padded == [*got[0].ids, 0] and got[0].mask == [1] * 9 + [0]
    assert got[1].ids == [2, 3, 3] and len(got[2].ids) == 10
    fitted.save(str(tmp_path / "t"))
    again = vocab.Tokenizer.load(spark, str(tmp_path / "t"))
    assert (again.words, again.chars, again.config) == (fitted.words, fitted.chars, fitted.config)
    small = vocab.Tokenizer.fit(texts, vocab.TokenizerConfig(mode="word", max_vocab_size=6))
    assert small.vocab_size == 6 and not small.chars


def test_heavy_keys(spark, rows):
    data = [("a", "k", "v1")] * 300 + [("a", "k", f"v{i}") for i in range(300)] + [(None, "k", None), ("a ", None, "v1"), ("", "z", None)] + [(f"p{i}", f"m{i % 7}", "v") for i in range(100)]
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in data], "prefix string, match_key string, qid string, n int, value string, task int").repartition(6)
    for partitions in (1, 5, 16):
        got = rows(heavy_keys.key_counts(df, ["prefix", "match_key"], "qid", partitions))
        want = []
        for i, field in enumerate(("prefix", "match_key")):
            seen = defaultdict(list)
            for d in data:
                if d[i] is not None:
                    seen[d[i]].append(d[2])
            want += [(field, k, len(v), len(set(v) - {None})) for k, v in seen.items()]
        assert got == sorted(want, key=repr)
    assert {r[:2] for r in rows(heavy_keys.heavy_keys(df, ["prefix", "match_key"], "qid", 0.5))} == {("prefix", "a"), ("match_key", "k")}
    assert rows(heavy_keys.key_counts(df.limit(0), ["prefix"], "qid")) == [] and rows(heavy_keys.heavy_keys(df.limit(0), ["prefix"], "qid")) == []


def test_rate_limit_and_cache(spark):
    data = [("a", i, float(t)) for i, t in enumerate([0, 1, 2, 3, 9.5, 10, 10.5, 11, 12])] + [("b", 100, 5.0), (None, 101, 5.0)]
    df = spark.createDataFrame(data, "client string, n long, at double").repartition(3)
    got = {r.n: (r.allowed, r.retry_after) for r in requests.rate_limit(df, "client", "at", "n", 3, 10.0).collect()}
    assert [got[i][0] for i in range(9)] == [True, True, True, False, False, True, False, True, True] and got[3][1] == 7 and got[100] == (True, 0) and 101 not in got
    got = {r.n: (r.cached, r.first_tie) for r in requests.ttl_cache(df, "client", "at", "n", 10.0).collect()}
    assert got[0] == (False, 0) and got[4] == (True, 0) and got[5] == (False, 5) and got[8] == (True, 5)
    cache = requests.BoundedCache(4, 10)
    for k in range(5):
        cache.put(k, k, 0)
    assert cache.get(0, 1) is None and cache.get(4, 1) == 4 and cache.get(4, 10) is None


def test_debounce_and_latest(spark):
    base = dt.datetime(2024, 1, 1)
    typed = [("f", i, base + dt.timedelta(milliseconds=t), v) for i, (t, v) in enumerate([(0, "d"), (100, "de"), (150, "deep"), (900, "deep l"), (1000, " ")])]
    df = spark.createDataFrame(typed, "source string, n long, ts timestamp, value string")
    assert [r.value for r in requests.debounce(df, "source", "ts", "n", "value", 200).collect()] == ["deep"]
    many = spark.createDataFrame([("hot" if i % 3 else None, i) for i in range(3000)], "k string, t int").repartition(7)
    got = ordering.with_next(many, ["k"], ["t"]).collect()
    last = {"hot": 2999, None: 2997}
    step = lambda r: None if r.t == last[r.k] else next(x for x in range(r.t + 1, r.t + 4) if ("hot" if x % 3 else None) == r.k)
    assert len(got) == 3000 and all((r.following.t if r.following else None) == step(r) for r in got)
    assert Counter(r.stale for r in requests.latest_wins(df, ["source"], "ts", "n").collect()) == {True: 4, False: 1}


URLS = [
    ("https://example.com/checkout?session_id=1#payment", dict(normalized_url="https://example.com/checkout", validation_error=None)),
    ("http://admin:pw@banking-portal.com/login", dict(has_userinfo=True, normalized_url="http://banking-portal.com/login")),
    ("wikipedia.org", dict(normalized_url="https://wikipedia.org/", scheme="https")), ("https://news.bbc.co.uk/world", dict(apex_domain="bbc.co.uk", subdomain="news")),
    ("https://a.b.c.d.example.com", dict(subdomain_depth=4)), ("https://paypal.verification-portal.net/login", dict(suspicious_tokens=["paypal"])),
    ("https://xn--e1afmkfd.xn--p1ai/", dict(is_punycode_or_idn=True)), ("https://аpple.com", dict(is_punycode_or_idn=True, hostname="xn--pple-43d.com")),
    ("http://93.184.216.34/path", dict(is_ip=True, is_private_or_local=False)), ("http://192.168.1.100:8080/", dict(is_ip=True, is_private_or_local=True, port=8080)),
    ("http://localhost:8000", dict(is_private_or_local=True, port=8000, is_ip=False)), ("http://[::1]:8080/test", dict(is_ip=True, is_private_or_local=True, hostname="::1", port=8080)),
    ("", dict(validation_error=urls.NO_ADDRESS)), (None, dict(validation_error=urls.NO_ADDRESS)),
    ("ftp://ftp.example.com/file.zip", dict(scheme="ftp", normalized_url="")), ("https://", dict(validation_error=urls.NO_HOST)), ("not_a_valid_url", dict(apex_domain="not_a_valid_url", subdomain="")),
    ("example.com/r?u=http://x", dict(validation_error=urls.NO_HOST)), ("HTTP://Example.COM.:80/A", dict(normalized_url="http://example.com/A", port=80)), ("https://x.org:99999/", dict(port=99999)),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(URLS)], "n int, url string")
    got = {r.n: r.asDict() for r in urls.analyze_urls(df, "url").collect()}
    for i, (url, want) in enumerate(URLS):
        assert {k: got[i][k] for k in want} == want, url
        # both paths agree on every field
        assert {k: got[i][k] for k in urls._NAMES} == {k: urls.analyze(url)[k] for k in urls._NAMES}, url
    assert urls.analyze_urls(df.limit(0), "url").count() == 0


def test_registry_and_threats(spark):
    registry = spark.createDataFrame(
        [("wiki.org", "W", True, 0), ("deep.wiki.org", "D", True, 1), ("exact.com", "E", False, 2), ("b.exact.com", "B", False, 3), (" Wiki.org ", "W2", True, 4)],
        "domain string, organization string, allow_subdomains boolean, ordinal int",
    )
    hosts = spark.createDataFrame([("en.wiki.org",), ("x.deep.wiki.org",), ("deep.wiki.org",), ("a.exact.com",), ("exact.com",), (None,)], "hostname string")
    got = {r.hostname: r.organization for r in urls.suffix_lookup(hosts, "hostname", registry).collect()}
    assert got == {"en.wiki.org": "W2", "x.deep.wiki.org": "W2", "deep.wiki.org": "D", "a.exact.com": None, "exact.com": "E", None: None}
    feed = spark.createDataFrame([("list", "BAD.com", True, "MALWARE", True, 0), ("other", "bad.com", True, "PHISHING", True, 1), ("off", "ok.com", True, "X", False, 2)], "provider string, key string, hit boolean, threat_type string, available boolean, ordinal int")
    got = {r.h: (r.known_threat, r.threat_type, r.provider_hits) for r in urls.threat_lookup(spark.createDataFrame([("bad.com",), ("ok.com",)], "h string"), "h", feed).collect()}
    assert got == {"bad.com": (True, "MALWARE", ["list", "other"]), "ok.com": (False, None, [])}
    got = {r.h: (r.known_threat, r.unavailable_checks) for r in urls.threat_lookup(spark.createDataFrame([("Malware.Wicar.org",), ("ok.com",), ("x",)], "h string"), "h", feed.unionByName(urls.sample_threats(spark))).collect()}
    assert got == {"Malware.Wicar.org": (True, []), "ok.com": (False, ["off"]), "x": (False, [])}


def test_metrics(spark):
    ranked = spark.createDataFrame([("g", 1, False), ("g", 2, True), ("g", 3, False), ("h", 1, True), ("m", 1, False)], "g string, rank int, relevant boolean")
    got = metrics.pool_metrics(ranked, ["g"]).first()
    assert (got.n_evaluated, got.n_target_missing, got.precision_at_1, got.mrr_at_k, got.recall_at_k) == (2, 1, 0.5, 0.75, 1.0)
    assert metrics.pool_metrics(ranked.limit(0), ["g"]).first().mrr_at_k == 0.0
    scored = spark.createDataFrame([("a", 2.0, 1), ("a", -1.0, 0)], "p string, s double, l int")
    assert metrics.hinge_loss(scored, ["p"], "s", "l", 0.3).first()[0] == 0.0
    assert metrics.hinge_loss(scored.withColumn("s", -F.col("s")), ["p"], "s", "l", 0.3).first()[0] == pytest.approx(3.3)
    assert metrics.hinge_loss(scored.limit(0), ["p"], "s", "l", 0.3).first()[0] == 0.0
    lines = spark.createDataFrame([(i, v) for i, v in enumerate(["a", "a", "b", None, None, "a"])], "line int, v string")
    for block in (1, 2, 3, 100):
        assert [r.group_id for r in ordering.islands(lines.repartition(3), "v", "line", block).orderBy("line").collect()] == [1, 1, 2, 3, 3, 4]
    got = ordering.numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5), ["x"]).collect()
    assert all(r.line == r.x + 1 for r in got)
    assert ordering.shard(lines, "line", 3, 1).count() == 2 and ordering.numbered(lines.limit(0), ["line"], "n").count() == 0
    pages = spark.createDataFrame([("about:blank",), ("CHROME://settings",), ("https://about.org",), (None,), ("view-source:https://x.org",), ("edge.com",)], "u string")
    assert [r[0] for r in pages.select(requests.is_internal_page(F.col("u"))).collect()] == [True, True, False, True, True, False]


def test_ranker_gradient_and_parameters():
    assert ranker.RankerModel(ranker.RankerConfig(21_996)).parameters() == 3_606_529
    model = ranker.RankerModel(ranker.RankerConfig(12, 3, 4, dropout=0.0), 1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    ids, lengths, labels = np.array([[2, 5, 3, 7, 3], [2, 6, 3, 0, 0]]), np.array([5, 3]), np.array([1, 0])
    for loss in (ranker.bce(labels), ranker.pairwise_hinge(labels, np.array([0, 0]), 5.0)):
        _, grads = model.gradients(ids, lengths, loss)
        for name in model.p:
            at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
            keep, eps = model.p[name][at], 1e-3
            model.p[name][at] = keep + eps
            up = loss(model.forward(ids, lengths))[0]
            model.p[name][at] = keep - eps
            down = loss(model.forward(ids, lengths))[0]
            model.p[name][at] = keep
            assert grads[name][at] == pytest.approx((up - down) / (2 * eps), rel=2e-2, abs=1e-4), name
    alone = model.score([ids[1, :3]], [3])[0]
    assert alone == pytest.approx(model.score(list(ids), lengths)[1]) == pytest.approx(ranker.RankerModel.from_bytes(model.to_bytes()).score([ids[1]], [3])[0])


def test_train_and_suggest(spark):
    words = ["red", "green", "blue", "oak"]
    data = [(w[:2], w, 1) for w in words] + [(w[:2], v, 0) for w in words for v in words if v != w]
    df = spark.createDataFrame(data, "prefix string, candidate string, label int")
    tokenizer = vocab.Tokenizer.fit_pairs(df, vocab.TokenizerConfig(max_seq_length=12))
    model, history = ranker.train(tokenizer, df, df, ranker.RankerConfig(tokenizer.vocab_size, 16, 16, dropout=0.0, max_seq_length=12), epochs=25, batch=16, patience=25, rate=2e-2)
    assert history[-1]["loss"] < history[0]["loss"] and max(h["mrr_at_5"] for h in history) > 0.8
    queries = corpus.dedup_query_log(log(spark, [("Q6", "Deep Learning", "deep learning"), ("Q7", "deep learning", "Deep  learning")]))
    found = ranker.suggest(spark.createDataFrame([("deep",), ("m",), (" ",), (None,)], "prefix string"), queries, index.hot_prefix_cache(queries), tokenizer, model, 2)
    got = {r.prefix: [s.text for s in r.suggestions] for r in found.collect()}
    assert set(got) == {"deep", "m"} and len(got["deep"]) == 1 and len(got["m"]) == 2


def test_streams(spark, tmp_path):
    from querymill.streaming import state

    src = str(tmp_path / "in")
    data = [("a", i, float(i)) for i in range(5)] + [("b", 10, 0.0)]
    spark.createDataFrame(data, "client string, request_id long, at double").coalesce(1).write.parquet(src)

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    stream = spark.readStream.schema("client string, request_id long, at double").parquet(src)
    got = {r.request_id: r.allowed for r in run(state.rate_limit_stream(stream, 3, 10.0), "limited")}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 10: True}
    # with expiry a query goes on looking for expired state, so it is stopped by hand
    live = state.rate_limit_stream(stream, 3, 10.0, expire_after=3600).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "live")).start()
    end = time.time() + 60
    while time.time() < end and spark.table("live").count() < 6:
        time.sleep(0.5)
    live.stop()
    assert spark.table("live").where("allowed").count() == 4
    got = {r.request_id: (r.cached, r.first_request) for r in run(state.ttl_cache_stream(stream.withColumnRenamed("client", "key"), 3.0), "cached")}
    assert got == {0: (False, 0), 1: (True, 0), 2: (True, 0), 3: (False, 3), 4: (True, 3), 10: (False, 10)}
    keys = stream.select(F.col("client").alias("source"), F.timestamp_seconds("at").alias("ts"), F.col("request_id").cast("string").alias("value"))
    assert isinstance(run(state.debounce_stream(keys, "200 milliseconds", "0 seconds"), "debounced"), list)
    cache = index.hot_prefix_cache(corpus.dedup_query_log(log(spark)))
    asked = stream.select("request_id", F.lit("Py").alias("prefix"))
    assert {r.normalized_query for r in run(state.suggestion_stream(asked, cache), "suggested")} == {"python tutorial"}


def test_sources(spark, tmp_path):
    from querymill.sources import tables

    src, out = str(tmp_path / "p.jsonl"), str(tmp_path / "clean")
    spark.createDataFrame([("a", "ab", 1, "positive"), ("b", "b\x08c", 0, "x"), ("c", "cd", 0, "y")], tables.PAIR_SCHEMA).write.json(src)
    assert tables.sanitize_pairs(spark, src, out, str(tmp_path / "r")) == {"scanned": 3, "written": 2, "skipped": 1, "prefix_fields": 0, "candidate_fields": 1}
    assert tables.read_pairs(spark, out).count() == 2
    with pytest.raises(ValueError):
        tables.sanitize_pairs(spark, out, out)
    log(spark).write.parquet(str(tmp_path / "q"))
    assert tables.read_queries(spark, str(tmp_path / "q"), 2).count() == 2
    registry = tables.read_registry(spark, [{"domain": " A.org "}, {"domain": ""}, {"domain": "b.org", "allow_subdomains": False}]).collect()
    assert [(r.domain, r.organization, r.allow_subdomains) for r in registry] == [("a.org", "Verified Organization", True), ("b.org", "Verified Organization", False)]


def test_shared_folder_comes_from_the_session(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_dir(spark) == named if named else shared_dir(spark).startswith("file:")
