"""Sizes of texts in tokens of a public tokenizer, whose files are read where they are installed."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the vocabularies lie on every executor.
TOKENIZER_DIR = os.environ.get("QUERYMILL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The byte-level BPE whose ranks stand in the file at ``path``."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: A longer run without white space is encoded in pieces, as the merges of one run take more than linear time.
_RUN = 20_000


def count_tokens(encoding, text: str) -> int:
    """Tokens of the whole text."""
    if len(text) <= _RUN:
        return len(encoding.encode_ordinary(text))
    return sum(len(encoding.encode_ordinary(text[i : i + _RUN])) for i in range(0, len(text), _RUN))


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(path)
        for batch in batches:
            sizes = [None if t is None else count_tokens(encoding, t) for t in batch.column(0).to_pylist()]
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sizes, pa.int64())], names=[*batch.schema.names[1:], "n_tokens"])

    return run


def token_sizes(df: DataFrame, text: str, keep: dict[str, str], path: str | None = None) -> DataFrame:
    """(columns of ``keep`` under their new names, n_tokens): the size of each row's whole text; null for a null text.

    Texts of more than 20,000 characters are encoded in pieces of that length, which may add a
    token at a seam; the sizes are the same in every run and layout.
    """
    path = path or f"{TOKENIZER_DIR}/{VOCABULARY}"
    chosen = df.select(df[text].alias("text"), *[df[c].alias(name) for c, name in keep.items()])
    shape = T.StructType([*chosen.schema.fields[1:], T.StructField("n_tokens", T.LongType())])
    return chosen.mapInArrow(_count(path), shape)


def settings_rows(table: DataFrame, most: int = 1_000) -> list:
    """The rows of a small table of settings; an error if it has more than ``most``."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of settings may have {most} rows")
    return rows
