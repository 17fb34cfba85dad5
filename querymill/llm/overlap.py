"""Records of evaluation splits that also stand, exactly or almost, in the training split.

Exact copies are found by a join of the 128-bit hashes of canonical texts, evaluation with training.
Equal hashes find only equal texts, so for the rest every distinct canonical text hashes to a few
keys such that two texts that count as the same share at least one key:

* word keys: the hash of the bag of words, and of the bag less one word.  Texts that share one
  differ by at most one word on either side, so all their pairs are results;
* edit keys: the text is cut into four parts.  Two edits spoil at most two parts, so the rest
  stands unchanged in the other text at a known shift.  The training side hashes its rest once
  per choice of spoilt parts, the evaluation side once per choice and possible shift.

Training keys that a filter of the evaluation keys excludes never leave their task.  The others
are range partitioned by key and text, so a key that very many texts share covers several
partitions.  What lies within a partition meets there; what crosses a border, or makes too many
pairs for one task, is put out in chunks that are joined by key and salt.  An edit key that many
texts share is refined instead: the spoilt parts are halved again, for those rows only, until the
groups are small or the parts are single characters.  Candidates are verified on the texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querymill.functions.text import unless_ascii
from querymill.runtime import written

_MASK, _WHOLE, _HALF = (1 << 64) - 1, 1 << 64, 1 << 63
_digest = xxhash.xxh3_64_intdigest
_WORDS = re.compile(r"[^\W_]+")
#: Pairs a group of one edit key may give before the key is refined.
GROUP_PAIRS = 250_000
_CHUNK = 500
#: Share of pairs that look alike from which a group is compared as it stands.
_DENSE = 0.1
_NETS = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def canonical(text: str | None) -> str | None:
    """NFKC, lower case, each run of other characters than letters and digits one space, trimmed."""
    if text is None:
        return None
    return " ".join(_WORDS.findall(unicodedata.normalize("NFKC", text).lower()))


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical)


def canonical_text(text: Column) -> Column:
    """``canonical``, for ASCII text without leaving the JVM."""
    return unless_ascii(text, F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), _canonical)


def _signed(x: int) -> int:
    x &= _MASK
    return x - (1 << 64) if x >> 63 else x


@lru_cache(maxsize=200_000)
def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


@lru_cache(maxsize=20_000)
def _char_bit(char: str) -> int:
    return 1 << (ord(char) * 0x9E3779B1 >> 7 & 63)


def word_keys(text: str) -> set[int]:
    """Even 64-bit keys of the bag of words and of the bag less one word."""
    words = text.split(" ")
    hashes = [_word_hash(w) for w in words]
    total, n = sum(hashes), len(words)
    keys = {_bag(total, n)}
    keys.update(_bag(total - h, n - 1) for h in set(hashes))
    return keys


def _bag(total: int, n: int) -> int:
    return _signed(((total & _MASK) + n) * 0x9E3779B97F4A7C15 & _MASK & ~1)


def signature(text: str) -> int:
    """A bit per hashed character, toggled at each occurrence: an edit changes at most two bits."""
    bits = 0
    for c, n in Counter(text).items():
        if n & 1:
            bits ^= _char_bit(c)
    return _signed(bits)


# A state is (l, s1, e1, s2, e2, da, db): the training text's length, its two spoilt parts and by
# how much each part's length differs on the evaluation side; s2 = -1 if both edits lie in one part.
State = tuple[int, int, int, int, int, int, int]


def edit_states(n: int, probe: bool) -> Iterator[State]:
    """The choices of spoilt parts for a text of length ``n``; ``probe``: of the evaluation side."""
    for net in range(-2, 3) if probe else (0,):
        length = n - net
        if length < 0:
            continue
        cut = [k * length // 4 for k in range(5)]
        for p in range(4):
            yield (length, cut[p], cut[p + 1], -1, -1, net, 0)
        for a, b in _NETS if probe else ((0, 0),):
            if a + b == net:
                for p in range(4):
                    for q in range(p + 1, 4):
                        yield (length, cut[p], cut[p + 1], cut[q], cut[q + 1], a, b)


def finer_states(state: State, probe: bool) -> Iterator[State]:
    """The same choice with each spoilt part halved; the state itself if the parts are single characters."""
    l, s1, e1, s2, e2, a, b = state
    if s2 < 0:
        if e1 - s1 <= 1:
            yield state
            return
        h = (s1 + e1) // 2
        yield (l, s1, h, -1, -1, a, 0)
        yield (l, h, e1, -1, -1, a, 0)
        for x, y in _NETS if probe else ((0, 0),):
            if x + y == a:
                yield (l, s1, h, h, e1, x, y)
        return
    first = [(s1, (s1 + e1) // 2), ((s1 + e1) // 2, e1)] if e1 - s1 > 1 else [(s1, e1)]
    second = [(s2, (s2 + e2) // 2), ((s2 + e2) // 2, e2)] if e2 - s2 > 1 else [(s2, e2)]
    for x in first:
        for y in second:
            yield (l, *x, *y, a, b)


def edit_key(text: str, state: State, probe: bool) -> int | None:
    """Odd 64-bit key of what is left of the text without the spoilt parts."""
    l, s1, e1, s2, e2, a, b = state
    if not probe:
        a = b = 0
    if e1 + a < s1:
        return None
    if s2 < 0:
        rest = f"{l},{s1},{e1}\0{text[:s1]}\0{text[e1 + a:]}"
    else:
        if e2 + a + b < s2 + a:
            return None
        rest = f"{l},{s1},{e1},{s2},{e2}\0{text[:s1]}\0{text[e1 + a:s2 + a]}\0{text[e2 + a + b:]}"
    return _signed(xxhash.xxh3_64_intdigest(rest) | 1)


@lru_cache(maxsize=4_096)
def _cuts(n: int, probe: bool) -> list[tuple[str, int, int, int, int]]:
    """The label and the bounds of what is left, for each choice of spoilt parts of a text of length ``n``."""
    cuts = []
    for l, s1, e1, s2, e2, a, b in edit_states(n, probe):
        single = s2 < 0
        if e1 + a < s1 or (not single and e2 + a + b < s2 + a):
            continue
        label = f"{l},{s1},{e1}" if single else f"{l},{s1},{e1},{s2},{e2}"
        cuts.append((label, s1, e1 + a, -1 if single else s2 + a, -1 if single else e2 + a + b))
    return cuts


def edit_keys(text: str, probe: bool) -> set[int]:
    """``edit_key`` of every choice of spoilt parts."""
    keys = set()
    for label, x, y, z, w in _cuts(len(text), probe):
        rest = f"{label}\0{text[:x]}\0{text[y:]}" if z < 0 else f"{label}\0{text[:x]}\0{text[y:z]}\0{text[w:]}"
        key = _digest(rest) | 1
        keys.add(key - _WHOLE if key >= _HALF else key)
    return keys


#: Bits of one block of the filter of evaluation keys, the most and the fewest bits a key, and the bytes the filter may take.
_BLOCK_BITS, _BITS_A_KEY, _FEWEST_BITS, FILTER_BYTES = 1 << 16, 16, 4, 64 << 20
#: Keys up to which the training keys that pass the filter are broadcast, at eight bytes each.
_BROADCAST_KEYS = 2_000_000


def _filter_places(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The block of each key and its three bits there."""
    x = keys.view(np.uint64)
    block = (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(blocks)
    y = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return block.astype(np.int64), [(y >> np.uint64(s) & np.uint64(_BLOCK_BITS - 1)).astype(np.int64) for s in (16, 32, 48)]


def _by_block(blocks: int):
    """Keys of one task, each once, as eight bytes by block of the filter: (block, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.unique(batch.column(0).to_numpy(zero_copy_only=False))
            if not len(keys):
                continue
            block, _ = _filter_places(keys, blocks)
            order = np.argsort(block, kind="stable")
            keys, block = keys[order], block[order]
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            parts = [k.tobytes() for k in np.split(keys, starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(block[starts]), pa.array(parts, pa.binary())], names=["block", "keys"])

    return run


def _block_bits(blocks: int):
    def run(key: tuple, parts: pa.Table) -> pa.Table:
        bits = np.zeros(_BLOCK_BITS, dtype=bool)
        for part in parts.column("keys").to_pylist():
            for at in _filter_places(np.frombuffer(part, dtype=np.int64), blocks)[1]:
                bits[at] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    return run


def _key_filter(keys: DataFrame) -> np.ndarray | None:
    """A Bloom filter of the written keys, a row a block, gathered on the driver.

    It has 16 bits a key, or as many as FILTER_BYTES allows; None below four, as it would let too much pass.
    """
    n = keys.count()
    blocks = min(max(1, -(-n * _BITS_A_KEY // _BLOCK_BITS)), FILTER_BYTES * 8 // _BLOCK_BITS)
    if not blocks or n * _FEWEST_BITS > blocks * _BLOCK_BITS:
        return None
    parts = keys.select("key").mapInArrow(_by_block(blocks), "block long, keys binary").groupBy("block").applyInArrow(_block_bits(blocks), "block long, bits binary")
    bits = np.zeros((blocks, _BLOCK_BITS // 8), dtype=np.uint8)
    for block, row in parts.collect():
        bits[block] = np.frombuffer(row, dtype=np.uint8)
    return bits


def _passes(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    block, places = _filter_places(keys, len(bits))
    found = np.ones(len(keys), dtype=bool)
    for at in places:
        found &= (bits[block, at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return found


def _text_keys(probe: bool, known=None):
    """(id, text) to (key, id, probe, sig) of one side; with a broadcast filter only the keys that pass it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "id", "probe", "sig"]
        for batch in batches:
            keys, sigs, n = [], [], []
            for text in batch.column(1).to_pylist():
                own = edit_keys(text, probe) | word_keys(text)
                keys.extend(own)
                sigs.append(signature(text))
                n.append(len(own))
            columns = [np.array(keys, dtype=np.int64), np.repeat(batch.column(0).to_numpy(zero_copy_only=False), n), np.repeat(np.array(sigs, dtype=np.int64), n)]
            if known is not None:
                kept = _passes(columns[0], known.value)
                columns = [c[kept] for c in columns]
            key, ids, sig = columns
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(np.full(len(key), probe)), pa.array(sig)], names=names)

    return run


_KEYS = "key long, id long, probe boolean, sig long"


def _meeting_keys(texts: DataFrame) -> DataFrame:
    """The keys of either side that the other side may have: (key, id, probe, sig).

    The filter of the evaluation keys, whose number doesn't grow with the training split, keeps
    training keys that meet nothing from leaving their task; what passes then prunes the evaluation
    keys.  Where the filter would be too large for a broadcast, all keys go on; the result is the same.
    """
    evals = written(texts.where("eval").select("id", "text").mapInArrow(_text_keys(True), _KEYS), "eval-keys")
    bits = _key_filter(evals)
    known = None if bits is None else texts.sparkSession.sparkContext.broadcast(bits)
    trains = written(texts.where("train").select("id", "text").mapInArrow(_text_keys(False, known), _KEYS), "train-keys")
    if known is None:
        return evals.unionByName(trains)
    passed = written(trains.select("key").distinct(), "passed")
    if passed.count() > _BROADCAST_KEYS:
        return evals.unionByName(trains)
    return written(evals.join(F.broadcast(passed), "key", "left_semi").unionByName(trains), "keys")


_MET = "kind string, key long, evals array<long>, trains array<long>, sigs array<long>"
_LISTS = pa.list_(pa.int64())


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which signatures differ by no more bits than two edits change; unsigned, as popcount takes a signed number's magnitude."""
    return np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]) <= 4


def _blocks(key: int, e: np.ndarray, es: np.ndarray, t: np.ndarray, ts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(evaluation ids, training ids) lists whose pairs are the candidates of one key; edit keys only where the characters nearly agree."""
    for i in range(0, len(e), _CHUNK):
        for j in range(0, len(t), 8 * _CHUNK):
            if key & 1:
                agree = _alike(es[i : i + _CHUNK], ts[j : j + 8 * _CHUNK])
                for k in np.flatnonzero(agree.any(axis=1)):
                    yield e[i + k : i + k + 1], t[j : j + 8 * _CHUNK][agree[k]]
            else:
                yield e[i : i + _CHUNK], t[j : j + 8 * _CHUNK]


def _meet(limit: int | None):
    """Sorted (key, id, probe, sig) rows to candidates, and to chunks of what can't be settled within the partition.

    kind 'pairs' gives lists of evaluation and training ids that share a key.  'hot' and 'edge' give
    one side of a key's group at a time: 'hot' where a group of an edit key makes more than ``limit``
    pairs, unless most of them look alike, as refining it is then no use; 'edge' where a group may go
    on in another partition or makes too many pairs for this task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        none: list[int] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            types = (pa.string(), pa.int64(), _LISTS, _LISTS, _LISTS)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["kind", "key", "evals", "trains", "sigs"])

        def chunks(kind: str, key: int, ids: np.ndarray, probe: np.ndarray, sig: np.ndarray) -> None:
            for side in (True, False):
                mine, sigs = ids[probe == side], sig[probe == side]
                for i in range(0, len(mine), _CHUNK):
                    part = mine[i : i + _CHUNK]
                    out.append((kind, key, part if side else none, none if side else part, sigs[i : i + _CHUNK]))

        def close(key: int, ids: np.ndarray, probe: np.ndarray, sig: np.ndarray, edge: bool) -> None:
            if edge:
                chunks("edge", key, ids, probe, sig)
                return
            e, t, es, ts = ids[probe], ids[~probe], sig[probe], sig[~probe]
            if not len(e) or not len(t):
                return
            if limit is not None and len(e) * len(t) > limit:
                if not key & 1 or _alike(es[:_CHUNK], ts[:_CHUNK]).mean() >= _DENSE:
                    chunks("edge", key, ids, probe, sig)
                else:
                    chunks("hot", key, ids, probe, sig)
                return
            out.extend(("pairs", key, a, b, none) for a, b in _blocks(key, e, es, t, ts))

        held: list[tuple[np.ndarray, ...]] = []
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids, probe, sig = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            probe = probe.astype(bool)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[starts[1:], len(key)]
            probes = np.add.reduceat(probe.astype(np.int64), starts)
            for s, e, p in zip(starts.tolist(), ends.tolist(), probes.tolist()):
                if held and (s > 0 or key[0] != held[0][0][0]):
                    close(int(held[0][0][0]), *(np.concatenate([h[c] for h in held]) for c in (1, 2, 3)), first)
                    held, first = [], False
                if held or first or e == len(key):  # the group began in the last batch, or may go on in the next
                    held.append((key[s:e], ids[s:e], probe[s:e], sig[s:e]))
                elif p and p < e - s:
                    close(int(key[s]), ids[s:e], probe[s:e], sig[s:e], False)
            if len(out) >= 5_000:
                yield flush()
                out.clear()
        if held:
            close(int(held[0][0][0]), *(np.concatenate([h[c] for h in held]) for c in (1, 2, 3)), True)
        if out:
            yield flush()

    return run


def _meet_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, evals, esigs, trains, tsigs) chunks of either side of a key to (evals, trains) lists of candidates."""
    for batch in batches:
        evals, trains = [], []
        keys = batch.column(0).to_pylist()
        sides = [batch.column(c) for c in range(1, 5)]
        for i, key in enumerate(keys):
            e, es, t, ts = (np.asarray(c[i].values) for c in sides)
            for a, b in _blocks(key, e, es, t, ts):
                evals.append(a)
                trains.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(evals, _LISTS), pa.array(trains, _LISTS)], names=["evals", "trains"])


def _settle(keys: DataFrame, limit: int | None) -> tuple[list[DataFrame], DataFrame]:
    """Candidates among written (key, id, probe, sig) rows, as (evals, trains) lists, and the hot chunks: (key, evals, trains)."""
    parts = keys.select("key", "id", "probe", "sig").repartitionByRange("key", "id").sortWithinPartitions("key")
    met = written(parts.mapInArrow(_meet(limit), _MET), "met")
    edges = met.where("kind = 'edge'")
    odd = F.col("key").bitwiseAND(F.lit(1)) == 1
    sizes = edges.groupBy("key").agg(F.sum(F.size("evals")).alias("n"), F.sum(F.size("trains")).alias("m")).where("n > 0 and m > 0")
    over = F.lit(False) if limit is None else odd & (F.col("n") * F.col("m") > limit)
    # chunks of the training side per salt: with each chunk of evaluation ids they make a bounded number of rows
    sizes = written(sizes.select("key", over.alias("over"), F.ceil(F.col("m") / (16 * _CHUNK)).alias("salts")), "edge-keys")
    direct = edges.join(sizes.where("not over").select("key", "salts"), "key")
    left = direct.where("size(evals) > 0").select("key", "evals", F.col("sigs").alias("esigs"), F.explode(F.sequence(F.lit(1).cast("long"), "salts")).alias("salt"))
    right = direct.where("size(trains) > 0").select("key", "trains", F.col("sigs").alias("tsigs"), (F.pmod(F.xxhash64("trains"), F.col("salts")) + 1).alias("salt"))
    both = left.join(right, ["key", "salt"]).select("key", "evals", "esigs", "trains", "tsigs")
    found = [met.where("kind = 'pairs'").select("evals", "trains"), both.mapInArrow(_meet_chunks, "evals array<long>, trains array<long>")]
    hot = met.where("kind = 'hot'").unionByName(edges.join(sizes.where("over").select("key"), "key", "left_semi"))
    return found, hot.select("key", "evals", "trains")


def _finer(first: bool):
    """Hot (key, id, probe, text, states) rows to (key, id, probe, sig, states) rows of the halved parts.

    Adjacent parts leave the same rest at several shifts, so a key has a list of states.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, i, probe, text, states in zip(*(c.to_pylist() for c in batch.columns)):
                if first:
                    states = [s for s in edit_states(len(text), probe) if edit_key(text, s, probe) == key]
                found: dict[int, set[State]] = {}
                for s in states:
                    for f in finer_states(tuple(s), probe):
                        if (k := edit_key(text, f, probe)) is not None:
                            found.setdefault(_signed((k ^ (key * 2)) | 1), set()).add(f)
                sig = signature(text)
                out.extend((k, i, probe, sig, [list(f) for f in sorted(fs)]) for k, fs in found.items())
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.list_(pa.int32()))])], names=["key", "id", "probe", "sig", "states"])

    return run


def _shared(a: str, b: str) -> int:
    """Length of the common beginning, by halving steps of whole-string comparison."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def within_edits(a: str, b: str, most: int = 2) -> bool:
    """Whether at most ``most`` characters inserted, deleted or replaced turn one into the other.

    After the common beginning an edit must follow, so the tries are few however long the texts.
    """
    if abs(len(a) - len(b)) > most:
        return False
    n = _shared(a, b)
    a, b = a[n:], b[n:]
    if not a or not b or not most:
        return len(a) + len(b) <= most
    return within_edits(a[1:], b[1:], most - 1) or within_edits(a[1:], b, most - 1) or within_edits(a, b[1:], most - 1)


def same_words(a: str, b: str, most: int = 1) -> bool:
    """Whether neither bag of words has more than ``most`` words that the other lacks."""
    x, y = a.split(" "), b.split(" ")
    if abs(len(x) - len(y)) > most:
        return False
    common = (Counter(x) & Counter(y)).total()
    return len(x) - common <= most and len(y) - common <= most


@F.pandas_udf(T.BooleanType())
def near_texts_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x == y or within_edits(x, y) or same_words(x, y) for x, y in zip(a, b)], dtype=bool)


def near_texts(texts: DataFrame, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """Pairs of different near texts, one of them marked eval, the other train: (eval_id, train_id).

    ``texts`` holds one row (id long, text string, train boolean, eval boolean) per text.
    """
    found, hot = _settle(_meeting_keys(texts), group_pairs)
    first, states = True, None
    while not hot.isEmpty():
        rows = hot.select("key", F.explode("evals").alias("id"), F.lit(True).alias("probe")).unionByName(
            hot.select("key", F.explode("trains").alias("id"), F.lit(False).alias("probe"))
        )
        if first:
            rows = rows.withColumn("states", F.lit(None).cast("array<array<int>>"))
        else:
            rows = rows.join(states, ["key", "id", "probe"])
        fine = rows.join(texts.select("id", "text"), "id").select("key", "id", "probe", "text", "states")
        fine = written(fine.repartition("id", "key").mapInArrow(_finer(first), "key long, id long, probe boolean, sig long, states array<array<int>>"), "finer")
        # once every part is a single character, texts that share a key are nearly all true pairs
        divisible = not fine.where("exists(states, s -> s[2] - s[1] > 1 or s[4] - s[3] > 1)").isEmpty()
        more, hot = _settle(fine, group_pairs if divisible else None)
        states, first = fine.select("key", "id", "probe", "states"), False
        found += more
    groups = found[0]
    for f in found[1:]:
        groups = groups.unionByName(f)
    pairs = (
        groups.repartition(F.xxhash64("evals", "trains"))
        .select(F.explode("evals").alias("eval_id"), "trains")
        .select("eval_id", F.explode("trains").alias("train_id"))
        .where("eval_id != train_id")
        .distinct()
    )
    side = texts.select("id", "text")
    both = pairs.join(side.toDF("eval_id", "a"), "eval_id").join(side.toDF("train_id", "b"), "train_id")
    return both.where(near_texts_udf("a", "b")).select("eval_id", "train_id")


def split_overlap(
    df: DataFrame,
    record: str,
    text: str,
    split: str,
    source: str,
    train: tuple[str, ...] = ("train",),
    evaluation: tuple[str, ...] = ("dev", "test"),
    group_pairs: int = GROUP_PAIRS,
) -> tuple[DataFrame, DataFrame]:
    """Cross-split overlaps of ``text``: (pairs, report).

    pairs: (qid_a, qid_b), qid_a < qid_b, each pair of records once, one in an evaluation split
    and one in training, whose canonical texts are equal, at most two character edits apart, or
    differ by at most one word on either side.  report: (split, source, n_records, n_overlapping)
    counts the evaluation records by split and source, null sources as a group of their own.

    Rows with a null record id, text or split, rows of other splits and texts without letter or
    digit are left out; a record delivered again counts once; a record never pairs with itself.
    Copies of a text are compared once and expanded only in the result.  An empty table gives
    empty results.  Other columns may have any name.
    """
    rows = df.select(df[record].alias("qid"), canonical_text(df[text]).alias("text"), df[split].alias("split"), df[source].alias("source"))
    rows = rows.where(F.col("qid").isNotNull() & F.col("split").isin(*train, *evaluation)).where("text != ''")
    rows = written(rows.withColumn("train", F.col("split").isin(*train)).withColumn("h", F.unhex(F.md5("text"))), "records")
    evals = rows.where("not train").select(F.col("h").alias("eval_h"), "qid", "split", "source")
    trains = rows.where("train").select(F.col("h").alias("train_h"), F.col("qid").alias("other")).distinct()
    # exact copies: evaluation hashes joined with training hashes
    exact = evals.select("eval_h", "qid").distinct().join(trains, F.col("eval_h") == F.col("train_h")).select("qid", "other")
    texts = rows.groupBy("h", "text").agg(F.max("train").alias("train"), F.max(~F.col("train")).alias("eval"))
    # numbers are unique by construction; the table they are written to keeps them
    texts = written(texts.withColumn("id", F.monotonically_increasing_id()), "texts")
    near = near_texts(texts, group_pairs)
    hashes = lambda s: texts.select(F.col("id").alias(f"{s}_id"), F.col("h").alias(f"{s}_h"))
    near = written(near.join(hashes("eval"), "eval_id").join(hashes("train"), "train_id").select("eval_h", "train_h"), "near")
    almost = near.join(evals.select("eval_h", "qid").distinct(), "eval_h").join(trains, "train_h").select("qid", "other")
    pairs = exact.unionByName(almost).where("qid != other").select(F.least("qid", "other").alias("qid_a"), F.greatest("qid", "other").alias("qid_b")).distinct()
    touched = near.select("eval_h").unionByName(texts.where("train and eval").select(F.col("h").alias("eval_h"))).distinct().withColumn("hit", F.lit(1))
    report = (
        evals.join(touched, "eval_h", "left")
        .groupBy("split", "source", "qid")
        .agg(F.max("hit").alias("hit"))
        .groupBy("split", "source")
        .agg(F.count(F.lit(1)).alias("n_records"), F.count("hit").alias("n_overlapping"))
    )
    return pairs, report
