import pytest
from pyspark.sql import functions as F

from querymill.functions import text


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("raw, want", [
    ("machine ", "machine "), ("  machine", "machine"), ("machine    lea", "machine lea"), ("ＭＡＣＨＩＮＥ", "machine"), ("Straße", "strasse"),
    ("日本語", "日本語"), ("МОСКВА", "москва"), ("café", "café"), ("", ""), (None, ""), ("　a b\x1cc", "a b c"), ("   ", ""),
])
def test_normalize_prefix(spark, raw, want):
    assert one(spark, raw, text.normalize_prefix) == want
    if raw is None or raw.isascii():
        assert one(spark, raw, lambda c: text.normalize_prefix(c, ascii_only=True)) == want


def test_generate_prefixes(spark):
    made = lambda v, *a, **k: one(spark, v, lambda c: text.generate_prefixes(c, *a, **k))
    assert made("machine", 2, 4) == ["ma", "mac", "mach"]
    assert made("machine", 1, 20, True, 3) == ["m", "ma", "mac"]
    assert made("machine learning", 7, 8) == ["machine", "machine "] and made("machine learning", 7, 8, False) == ["machine"]
    assert made("hi") == ["h", "hi"] and made("") == [] and made(None) == [] and made("hi", 3, 5) == [] and made("hi", 2, 1) == [] and made("hi", 0, 5) == []
    assert made("日本語😀", 4, 4) == ["日本語😀"]


def test_control_characters(spark):
    assert [one(spark, v, text.has_control) for v in ("a\x08b", "a\tb\r\n", "\x7f", None, "\x1b")] == [True, False, False, False, True]
    assert one(spark, "a\x08\x00b\x1b\x7fc\t", text.strip_control) == "abc\t"


def test_pretokenize(spark):
    for ascii_only in (True, False):
        made = one(spark, "Node.js vs C++ a_b\x08c", lambda c: text.pretokenize(c, ascii_only=ascii_only))
        assert made == ["node", ".", "js", "vs", "c", "+", "+", "a_bc"]
    assert one(spark, "Ｃafé 学習", text.pretokenize) == ["café", "学習"]


def test_client_functions(spark):
    assert one(spark, "<a href=\"x\">'&", text.escape_html) == "&lt;a href=&quot;x&quot;&gt;&#039;&amp;"
    assert tuple(one(spark, "Deep Learning", lambda c: text.highlight_prefix(c, F.lit(" deep ")))) == ("Deep", " Learning")
    assert tuple(one(spark, "Deep", lambda c: text.highlight_prefix(c, F.lit("x")))) == ("", "Deep")
    url = lambda k: one(spark, "a b&c", lambda c: text.request_url(F.lit("http://h//"), c, F.lit(k)))
    assert url(50) == "http://h/api/v1/suggestions?q=a%20b%26c&top_k=20" and url(0).endswith("top_k=5") and url(None).endswith("top_k=5") and url(-3).endswith("top_k=1")
    address = lambda f, h: one(spark, f, lambda c: text.client_address(c, F.lit(h).cast("string")))
    assert address("1.1.1.1, 2.2.2.2", "h") == "1.1.1.1" and address(None, "h") == "h" and address("", None) == "127.0.0.1" and address(" ,x", "h") == ""


def test_split_share(spark):
    assert one(spark, "machine learning", text.split_share) == pytest.approx(0.86197748, abs=1) and one(spark, None, text.split_share) is None
