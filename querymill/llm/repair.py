"""One consistent form for text that looks the same but differs in its characters.

Characters without width go, compatibility forms and kinds of space are folded by NFKC, and
look-alike letters are repaired token by token: in a token of several scripts the dominant one is
determined, letters of the other are replaced by their look-alikes, and the result stands only if
the corpus vocabulary has it.  Tokens of one script stay as they are, whatever their letters.

To compare texts, tokens that the repair leaves and that consist of look-alikes are taken by
their Latin shapes; this enters the compared digest only, never a text that is given out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.runtime import written

# Letters of other scripts that are shaped like a Latin letter.
CYRILLIC = ("аеһіјкорсухѕԁԛԝӏүАВЕЅІЈКМНОРСТУХԚԜҺӀҮёїЁЇ", "aehijkopcyxsdqwlyABESIJKMHOPCTYXQWHIYëïËÏ")
GREEK = ("αγικνορυχόίάύϲΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ayikvopuxóíáúcABEZHIKMNOPTYXC")
ARMENIAN = ("օսհոցՕՍԼ", "ouhngOUL")

_LATIN = {a: b for theirs, ours in (CYRILLIC, GREEK, ARMENIAN) for a, b in zip(theirs, ours, strict=True)}

_TOKEN = re.compile(r"[^\W_]+")
_WIDTHLESS = re.compile(
    "[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿￹-￻\U000e0000-\U000e007f\U000e0100-\U000e01ef]"
)
_SPACES = re.compile("[   -   　]")


@lru_cache(maxsize=65_536)
def script(c: str) -> str | None:
    """The first word of a letter's Unicode name, which is its script; None if it is no letter."""
    if c.isascii():
        return "LATIN" if c.isalpha() else None
    return unicodedata.name(c, "UNKNOWN").split(" ")[0] if c.isalpha() else None


class Letters:
    """Letters of other scripts by the Latin letter they are shaped like, and back by script."""

    def __init__(self, table: dict[str, str]):
        self.to_latin = {ord(a): b for a, b in table.items()}
        self.from_latin: dict[str, dict[int, str]] = {}
        for a, b in table.items():
            self.from_latin.setdefault(script(a), {}).setdefault(ord(b), a)


def _based_on_ascii(c: str) -> bool:
    return script(c) == "LATIN" and unicodedata.normalize("NFD", c)[0].isascii()


def _confusables(checker) -> dict[str, str]:
    shape = lambda cs: [unicodedata.normalize("NFC", x) for x in checker.getSkeleton("\n".join(cs)).split("\n")]
    letters = [c for c in map(chr, (*range(0x41, 0xD800), *range(0xE000, 0x30000))) if c.isalpha() and unicodedata.normalize("NFKC", c) == c]
    latin: dict[str, list[str]] = {}
    ours = [c for c in letters if _based_on_ascii(c)]
    for c, s in zip(ours, shape(ours)):
        latin.setdefault(s, []).append(c)
    others = [c for c in letters if script(c) not in ("LATIN", "CJK", "HANGUL")]
    table = dict(_LATIN)
    for c, s in zip(others, shape(others)):
        if s in latin:  # I and l have one shape: a capital letter stands for the capital
            table.setdefault(c, next((x for x in latin[s] if x.isupper() == c.isupper()), latin[s][0]))
    return table


_table: dict[str, str] = {}


def look_alikes(spark: SparkSession) -> Letters:
    """The fixed letters above, then every letter of any other script that Unicode's confusables data
    (UTS 39), as the ICU library of Spark has it, gives the shape of a letter of A-Z or a-z."""
    if not _table:
        _table.update(_confusables(spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()))
    return Letters(_table)


def fold(text: str) -> str:
    """Without characters of no width, in NFKC, every kind of space a plain one; line ends and tabs stay."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", _WIDTHLESS.sub("", text))
    return _SPACES.sub(" ", text)


def proposals(token: str, letters: Letters) -> list[str]:
    """Forms of a token of several scripts that may be meant, the dominant script's first; none for a token of one script."""
    scripts: dict[str, int] = {}
    for c in token:
        s = script(c)
        if s:
            scripts[s] = scripts.get(s, 0) + 1
    if len(scripts) < 2:
        return []
    others = [s for s in scripts if s != "LATIN"]
    latin = token.translate(letters.to_latin)
    found = [latin] if all(script(c) in ("LATIN", None) for c in latin) else []
    if "LATIN" in scripts and len(others) == 1 and others[0] in letters.from_latin:
        own = token.translate(letters.from_latin[others[0]])
        if all(script(c) in (others[0], None) for c in own):
            found = [own, *found] if scripts[others[0]] > scripts["LATIN"] else [*found, own]
    return found


def _odd_tokens(text: str) -> Iterator[re.Match]:
    """The tokens of folded text that aren't plain ASCII."""
    for line in re.finditer(r"[^\n]+", text):
        if not line.group().isascii():
            yield from (t for t in _TOKEN.finditer(text, line.start(), line.end()) if not t.group().isascii())


def _replaced(text: str, form) -> str:
    """The text with each odd token in the form that ``form`` gives it."""
    out, at = [], 0
    for token in _odd_tokens(text):
        out += [text[at : token.start()], form(token.group())]
        at = token.end()
    return "".join([*out, text[at:]])


def repaired(text: str, accepted: dict[str, str]) -> str:
    """Folded text with the accepted replacement of each token that has one."""
    return _replaced(text, lambda t: accepted.get(t, t)) if accepted else text


def compared(text: str, letters: Letters) -> str:
    """What repaired text is compared by: a token wholly of look-alikes, or still of several scripts, by its Latin shapes."""

    def form(token: str) -> str:
        latin = token.translate(letters.to_latin)
        if latin == token or all(script(c) in ("LATIN", None) for c in latin):
            return latin
        return latin if len({script(c) for c in token} - {None}) > 1 else token

    return text if text.isascii() else _replaced(text, form)


def _hash(token: str) -> int:
    x = xxhash.xxh3_64_intdigest(token)
    return x - (1 << 64) if x >> 63 else x


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


_SCAN = pa.schema(
    [("kind", pa.string()), ("k", pa.int64()), ("doc_id", pa.int64()), ("raw", pa.binary()), ("form", pa.binary()), ("text", pa.string()), ("flagged", pa.bool_()),
     ("tokens", pa.list_(pa.string())), ("h", pa.int64()), ("token", pa.string()), ("proposal", pa.string()), ("place", pa.int32())]
)
_SCAN_DDL = "kind string, k long, doc_id long, raw binary, form binary, text string, flagged boolean, tokens array<string>, h long, token string, proposal string, place int"
_FLUSH_TOKENS = 300_000


def _scan(keep_text: bool, letters: Letters):
    """(k, doc_id, text) rows to one row a document, and per task the distinct tokens and proposals."""

    def table(kind: str, **columns: list) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        arrays = [pa.array([kind] * n, pa.string()) if f.name == "kind" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCAN]
        return pa.RecordBatch.from_arrays(arrays, schema=_SCAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: set[str] = set()
        proposed: set[tuple[str, str, int]] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            if words:
                yield table("word", h=[_hash(w) for w in words])
            if proposed:
                tokens, forms, places = zip(*proposed)
                yield table("proposal", h=[_hash(f) for f in forms], token=list(tokens), proposal=list(forms), place=list(places))
            words.clear()
            proposed.clear()

        for batch in batches:
            docs: dict[str, list] = {c: [] for c in ("k", "doc_id", "raw", "form", "text", "flagged", "tokens")}
            for k, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text is None:
                    if keep_text:
                        for c, v in zip(docs, (k, doc, None, None, None, False, None)):
                            docs[c].append(v)
                    continue
                folded = fold(text)
                wrong: list[str] = []
                found = set(_TOKEN.findall(folded))
                if not folded.isascii():
                    for token in [t for t in found if not t.isascii()]:
                        forms = proposals(token, letters)
                        if forms:
                            wrong.append(token)
                            proposed.update((token, f, p) for p, f in enumerate(forms))
                    found.difference_update(wrong)
                words |= found
                form = None if wrong else _digest(compared(folded, letters))
                for c, v in zip(docs, (k, doc, _digest(text), form, folded if wrong or keep_text else None, bool(wrong), sorted(wrong) or None)):
                    docs[c].append(v)
            yield table("document", **docs)
            if len(words) > _FLUSH_TOKENS:
                yield from flush()
        yield from flush()

    return run


def _apply(letters: Letters):
    """(k, doc_id, raw, text, repairs) rows to (k, doc_id, raw, form, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, doc, raw, text, repairs = batch.columns
            new = [repaired(t, {r["token"]: r["proposal"] for r in rs or ()}) for t, rs in zip(text.to_pylist(), repairs.to_pylist())]
            forms = [_digest(compared(t, letters)) for t in new]
            yield pa.RecordBatch.from_arrays([k, doc, raw, pa.array(forms, pa.binary()), pa.array(new, pa.string())], names=["k", "doc_id", "raw", "form", "text"])

    return run


def accepted_repairs(scan: DataFrame) -> DataFrame:
    """(token, proposal): for each token of several scripts the first proposal that the vocabulary has.

    The vocabulary holds every token of the corpus that has no proposal of its own, words of look-alikes only included.
    """
    odd = scan.where("kind = 'proposal'").select("token", "proposal", "place", "h").distinct()
    words = scan.where("kind = 'word'").select("h").distinct()
    known = odd.join(words, "h", "left_semi")
    return known.groupBy("token").agg(F.min(F.struct("place", "proposal")).alias("best")).select("token", F.col("best.proposal").alias("proposal"))


def _forms(df: DataFrame, record: str, text: str, keep_text: bool) -> DataFrame:
    """(doc_id, raw digest, form digest[, text]) of every document."""
    letters = look_alikes(df.sparkSession)
    rows = df.select(F.monotonically_increasing_id().alias("k"), df[record].cast("long").alias("doc_id"), df[text].alias("text"))
    scan = written(rows.mapInArrow(_scan(keep_text, letters), _SCAN_DDL), "scan")
    accepted = written(accepted_repairs(scan), "repairs")
    docs = scan.where("kind = 'document'")
    flagged = docs.where("flagged")
    repairs = (
        flagged.select("k", F.explode("tokens").alias("token")).join(accepted, "token")
        .groupBy("k").agg(F.collect_list(F.struct("token", "proposal")).alias("repairs"))
    )
    mended = (
        flagged.select("k", "doc_id", "raw", "text").join(repairs, "k", "left")
        .select("k", "doc_id", "raw", "text", "repairs")
        .mapInArrow(_apply(letters), "k long, doc_id long, raw binary, form binary, text string")
    )
    columns = ["doc_id", "raw", "form", *(["text"] if keep_text else [])]
    return docs.where("not flagged").select(*columns).unionByName(mended.select(*columns))


def consistent_text(df: DataFrame, record: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with every text in the one form; null texts stay null, empty ones empty.

    Letter case, accents, tabs, line ends and the number of spaces and lines are kept.  Repeated
    rows are kept; a null id is kept; an empty table gives no row; other columns may have any name.
    """
    return _forms(df, record, text, True).select(F.col("doc_id").alias(record), F.col("text").alias(text))


#: Copies of one text that one task pairs at a time.
_COPIES = 1_000


def looking_classes(df: DataFrame, record: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (doc_id, class_id, n_docs), the smallest id of those that look the same and their number.

    Null ids and texts are left out; an id given twice counts once for each of its forms.
    """
    forms = written(_forms(df, record, text, False).where("doc_id is not null and raw is not null").select("form", "doc_id").distinct(), "forms")
    classes = forms.groupBy("form").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_docs"))
    return forms.join(classes, "form").select("doc_id", "class_id", "n_docs")


def same_looking(df: DataFrame, record: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of documents whose texts differ but look the same: (doc_id_a, doc_id_b), doc_id_a < doc_id_b, once.

    Texts are repaired as in ``consistent_text``; what the repair leaves, as no form of it is in
    the vocabulary or all its letters are look-alikes of one script, is compared by its Latin shapes.
    Null ids and texts are left out; texts that are equal as they stand are no pair.  Forms are
    compared by 128-bit digests.  Copies of one text are never paired with each other; those of
    a text with many copies are spread over salts on either side.
    """
    forms = written(_forms(df, record, text, False).where("doc_id is not null"), "forms")
    raws = forms.groupBy("form", "raw").agg(F.ceil(F.count(F.lit(1)) / _COPIES).alias("salts"))
    several = raws.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("form")
    raws = written(raws.join(several, "form"), "raws")
    # a raw text stands for all its copies: only pairs of different texts are formed, each once
    side = lambda s: raws.select("form", F.col("raw").alias(f"raw_{s}"), F.col("salts").alias(f"salts_{s}"))
    texts = side("a").join(side("b"), "form").where("raw_a < raw_b").drop("form")
    docs = forms.select("raw", "doc_id").join(raws.select("raw", "salts"), "raw").distinct()
    docs = docs.select("raw", "doc_id", F.pmod(F.xxhash64("doc_id"), F.col("salts")).alias("salt"))
    for s in "ab":
        texts = texts.withColumn(f"salt_{s}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"salts_{s}") - 1)))
        texts = texts.join(docs.toDF(f"raw_{s}", s, f"salt_{s}"), [f"raw_{s}", f"salt_{s}"]).drop(f"raw_{s}", f"salt_{s}", f"salts_{s}")
    pairs = texts.where("a != b")
    return pairs.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()
