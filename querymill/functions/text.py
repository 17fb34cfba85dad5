"""Scalar text functions as column expressions; Arrow functions only where the JVM has no counterpart."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space in the sense of Unicode; Java's (?U)\s lacks the four separator controls.
SPACE = r"(?U)[\s\x1c-\x1f]+"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
CONTROL_OR_DELETE = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def nfkc_casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


_SPACES = re.compile(r"\s+")


def _prefix(typed: str | None) -> str | None:
    return None if typed is None else _SPACES.sub(" ", unicodedata.normalize("NFKC", typed).lstrip())


@F.pandas_udf(T.StringType())
def _typed_prefix(texts: pd.Series) -> pd.Series:
    return texts.map(_prefix)


@F.pandas_udf(T.StringType())
def _folded_prefix(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _prefix(t).casefold())


def unless_ascii(text: Column, plain: Column, function) -> Column:
    """``plain`` for ASCII text, which never leaves the JVM; ``function``, an Arrow one, for any other."""
    odd = text.rlike(r"[^\x00-\x7f]")
    return F.when(odd, function(F.when(odd, text))).otherwise(plain)


def normalize_prefix(text: Column, case_sensitive: bool = False, ascii_only: bool = False) -> Column:
    """What a typed prefix is matched by: NFKC, no leading space, runs of space one space, case folded.

    A trailing space is kept, as it is part of what was typed.  Null gives the empty text.
    ``ascii_only`` stays in the JVM and is right for text that NFKC and case folding beyond
    lower case leave alone.
    """
    text = F.coalesce(text, F.lit(""))
    squeezed = F.regexp_replace(F.regexp_replace(text, "^" + SPACE, ""), SPACE, " ")
    plain = squeezed if case_sensitive else F.lower(squeezed)
    return plain if ascii_only else unless_ascii(text, plain, _typed_prefix if case_sensitive else _folded_prefix)


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def generate_prefixes(
    key: Column, min_length: int = 1, max_length: int = 20, include_whitespace: bool = True, most: int = 20
) -> Column:
    """The prefixes of ``key`` by growing length, at most ``most``; empty for an empty key or an empty range."""
    none = F.array().cast("array<string>")
    if min_length < 1 or max_length < min_length:
        return F.when(key.isNotNull(), none).otherwise(none)
    lengths = F.sequence(F.lit(min_length), F.least(F.lit(max_length), F.length(key)))
    found = F.transform(lengths, lambda n: F.substring(key, F.lit(1), n))
    if not include_whitespace:
        found = F.filter(found, lambda p: ~p.rlike(SPACE + "$"))
    return F.when(F.length(key) >= min_length, F.slice(found, 1, most)).otherwise(none)


def has_control(text: Column) -> Column:
    """A control character other than tab, line feed and carriage return; delete is allowed."""
    return F.coalesce(text.rlike(CONTROL), F.lit(False))


def strip_control(text: Column) -> Column:
    """Without control characters, delete included."""
    return F.regexp_replace(text, CONTROL_OR_DELETE, "")


def pretokenize(text: Column, lowercase: bool = True, ascii_only: bool = False) -> Column:
    """Words and single other characters of the stripped, NFKC, case-folded text."""
    text = strip_control(text)
    plain = F.lower(text) if lowercase else text
    text = plain if ascii_only else unless_ascii(text, plain, nfkc_casefold if lowercase else nfkc)
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def split_share(text: Column) -> Column:
    """A number from 0 to 1 that depends on the text alone."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def split_bucket(text: Column, dev_share: float) -> Column:
    return F.when(split_share(text) < dev_share, "dev").otherwise("train")


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def highlight_prefix(text: Column, query: Column) -> Column:
    """The part of a suggestion that was typed, and the rest: struct(matched, suffix)."""
    typed = F.trim(query)
    hit = (F.length(typed) > 0) & F.startswith(F.lower(text), F.lower(typed))
    return F.struct(
        F.when(hit, F.substring(text, F.lit(1), F.length(typed))).otherwise("").alias("matched"),
        F.when(hit, F.substring(text, F.length(typed) + 1, F.length(text))).otherwise(text).alias("suffix"),
    )


def request_url(base: Column, query: Column, top_k: Column) -> Column:
    """The address that asks for suggestions; ``top_k`` is held to 1..20, 5 if missing or 0."""
    k = F.greatest(F.lit(1), F.least(F.lit(20), F.when(F.coalesce(top_k, F.lit(0)) == 0, 5).otherwise(top_k)))
    encoded = F.replace(F.url_encode(F.coalesce(query, F.lit(""))), F.lit("+"), F.lit("%20"))
    for kept, code in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        encoded = F.replace(encoded, F.lit(code), F.lit(kept))
    clean = F.regexp_replace(F.trim(base), "/+$", "")
    return F.concat(clean, F.lit("/api/v1/suggestions?q="), encoded, F.lit("&top_k="), k.cast("string"))


def client_address(forwarded: Column, host: Column) -> Column:
    """The first hop of a forwarding header, else the peer, else the loopback address."""
    first = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    return F.when(F.coalesce(forwarded, F.lit("")) != "", first).otherwise(F.coalesce(F.nullif(host, F.lit("")), F.lit("127.0.0.1")))
