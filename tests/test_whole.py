"""Registered queries against brute force on fixtures that hold what the tables lack."""

import re
import unicodedata
from collections import Counter

import pytest

from querymill.operators import ranker, registry, vocab

TEXTS = [("ｓｔｏ", "ｓｔｏｒａｇｅ box"), ("sto", "storage BOX"), ("éc", "écru straße"), ("éc", "écru STRASSE"), (None, "x"), ("a", None)]


def folded(text: str) -> list[str]:
    text = unicodedata.normalize("NFKC", text).casefold()
    return re.findall(r"\w+|[^\w\s]", unicodedata.normalize("NFKC", text))


def save(spark, tmp_path, name: str, rows, ddl: str) -> str:
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def pair_folder(spark, tmp_path, texts=TEXTS) -> str:
    return save(spark, tmp_path, "training_pairs", [(p, c, 1, "s") for p, c in texts], "prefix string, candidate string, label int, source string")


def test_tokens_are_normalized(spark, tmp_path):
    folder = pair_folder(spark, tmp_path)
    texts = {t for pair in TEXTS for t in pair if t is not None}
    words = Counter(w for t in texts for w in folded(t))
    assert {r.text: r.tokens for r in registry.pretokenized(spark, folder).collect()} == {t: folded(t) for t in texts}
    assert {r.token: r.frequency for r in registry.word_frequency(spark, folder).collect()} == words
    chars = Counter()
    for w, n in words.items():
        for c in w:
            chars[c] += n
    assert {r.token: r.frequency for r in registry.char_frequency(spark, folder).collect()} == chars
    found = registry.vocabulary(spark, folder).collect()
    assert {r.token for r in found if r.kind == "word"} == set(words)
    encoded = {(r.prefix, r.candidate): r.padded for r in registry.encoded_pairs(spark, folder).collect()}
    assert encoded["ｓｔｏ", "ｓｔｏｒａｇｅ box"] == encoded["sto", "storage BOX"]


def test_ranker_tokenizes_the_whole_way(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranker, "train", lambda *a, **k: (None, None))
    tokenizer, _ = registry._trained(spark, pair_folder(spark, tmp_path))
    assert "storage" in tokenizer.words and "ｓｔｏｒａｇｅ" not in tokenizer.words


def test_pairs_at_the_operators_own_sizes(spark, tmp_path):
    """70 queries of one stem, some of them dev queries, so that the pools of 50 are full, and one query alone."""
    texts = [f"common stem number {k:02d}" for k in range(70)] + ["zebra crossing"]
    rows = [(f"Q{k:02d}", t.title(), t, "dev" if k in (3, 60) else "train") for k, t in enumerate(texts)]
    folder = save(spark, tmp_path, "queries", rows, "qid string, original_query string, normalized_query string, split string")
    train, dev = {r[2] for r in rows if r[3] == "train"}, {r[2] for r in rows if r[3] == "dev"}
    own = {(t[:n], t) for t in train for n in range(1, 9)}
    # the index is built over the training queries; all are equally popular, so the text decides
    pools = {(p, q, c) for p, q in own for c in sorted(t for t in train if t.startswith(p))[:50] if c != q}
    assert {tuple(r) for r in registry.anti_leak_candidates(spark, folder).select("prefix", "query", "candidate").collect()} == pools
    sizes = Counter((p, q) for p, q, _ in pools)
    stats = registry.pair_pool_stats(spark, folder).first()
    assert stats.prefixes_generated == len(own) and stats.candidate_pool_queries == len(pools)
    assert stats.candidate_pool_max == max(sizes.values()) == 50
    assert stats.negative_shortfalls == sum(sizes[k] < 4 for k in own) == 8
    found = registry.generated_pairs(spark, folder).collect()
    assert {(r.prefix, r.query) for r in found if r.source == "positive"} == own
    negatives = Counter((r.prefix, r.query) for r in found if r.label == 0)
    assert all(negatives[k] == 4 for k in own)
    assert all((r.prefix, r.query, r.candidate) in pools for r in found if r.source == "index_retrieved")
    assert all(r.query == "zebra crossing" and r.candidate in train for r in found if r.source == "random_fallback")
    assert not {r.candidate for r in found} & dev


def test_vocabulary_of_production_size(spark, tmp_path, monkeypatch):
    """3,500 words and 300 characters, more than a vocabulary of 3,000 and 200 holds."""
    words = [f"word{k}" for k in range(3200)] + ["q" + chr(0x4E00 + k) for k in range(300)]
    folder = pair_folder(spark, tmp_path, [(w[:2], w) for w in words])
    found = registry.vocabulary(spark, folder).collect()
    assert {r.token for r in found if r.kind == "word"} == set(words) | {w[:2] for w in words}
    assert {r.token for r in found if r.kind == "char"} == set("".join(words))
    encoded = registry.encoded_pairs(spark, folder).collect()
    assert len(encoded) == len(words) and all(r.length == 5 for r in encoded)
    monkeypatch.setattr(ranker, "train", lambda *a, **k: (None, None))
    tokenizer, _ = registry._trained(spark, folder)
    assert set(words) <= set(tokenizer.words)


def test_suggestions_for_long_prefixes(spark, tmp_path):
    """Every prefix of up to 8 characters is asked; those beyond 6 go through the range scan."""
    texts = ["storage box", "storage bin", "stores", "st", "echo"]
    save(spark, tmp_path, "queries", [(f"Q{k}", t, t, "train") for k, t in enumerate(texts)], "qid string, original_query string, normalized_query string, split string")
    folder = pair_folder(spark, tmp_path, [(t[:2], t) for t in texts])
    found = {r.prefix: {s.text for s in r.suggestions} for r in registry.suggestions(spark, folder).collect()}
    assert set(found) == {t[:n] for t in texts for n in range(1, min(8, len(t)) + 1)}
    assert all(found[p] == {t for t in texts if t.startswith(p)} for p in found)
