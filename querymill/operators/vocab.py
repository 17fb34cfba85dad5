"""A word and character vocabulary fitted over distinct texts, and pairs encoded by it."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querymill.functions import text
from querymill.runtime import written

PAD, UNK, CLS, SEP = 0, 1, 2, 3
SPECIALS = 4


@dataclass(frozen=True)
class TokenizerConfig:
    mode: str = "hybrid"
    lowercase: bool = True
    max_vocab_size: int = 20_000
    max_char_vocab_size: int = 2_000
    min_frequency: int = 1
    max_seq_length: int = 40
    ascii_only: bool = False


def distinct_texts(pairs: DataFrame) -> DataFrame:
    """Every prefix and candidate once: (text)."""
    return pairs.select(F.explode(F.array("prefix", "candidate")).alias("text")).where("text is not null").distinct()


def tokens(texts: DataFrame, config: TokenizerConfig = TokenizerConfig()) -> DataFrame:
    """(token) of each text, repeats included."""
    return texts.select(F.explode(text.pretokenize(F.col("text"), config.lowercase, config.ascii_only)).alias("token"))


def word_frequency(texts: DataFrame, config: TokenizerConfig = TokenizerConfig()) -> DataFrame:
    return tokens(texts, config).groupBy("token").agg(F.count(F.lit(1)).alias("frequency"))


def char_frequency(words: DataFrame) -> DataFrame:
    """Characters of the counted tokens; each word is split once, however often it occurs."""
    chars = words.select(F.explode(F.split("token", "")).alias("token"), "frequency").where("token != ''")
    return chars.groupBy("token").agg(F.sum("frequency").alias("frequency"))


def _ranked(counted: DataFrame, kind: str, most: int) -> DataFrame:
    """The ``most`` commonest, by frequency, then token; the cut is a distributed top-N, the rank runs on what is left."""
    top = counted.orderBy(F.desc("frequency"), "token").limit(max(0, most))
    rank = F.row_number().over(Window.orderBy(F.desc("frequency"), "token"))
    return top.select(F.lit(kind).alias("kind"), "token", "frequency", rank.alias("rank"))


def vocabulary(texts: DataFrame, config: TokenizerConfig = TokenizerConfig()) -> DataFrame:
    """(kind, token, frequency, id): words from id 4, then characters; at most the configured sizes."""
    if config.mode not in ("hybrid", "word", "char"):
        raise ValueError(f"unknown mode {config.mode!r}")
    words = word_frequency(texts, config)
    parts, offset = [], SPECIALS - 1
    if config.mode != "char":
        kept = written(_ranked(words.where(F.col("frequency") >= config.min_frequency), "word", config.max_vocab_size - SPECIALS), "words")
        parts.append(kept.select("kind", "token", "frequency", (F.col("rank") + offset).alias("id")))
        offset += kept.count()
    if config.mode != "word":
        chars = _ranked(char_frequency(words), "char", config.max_char_vocab_size - SPECIALS)
        parts.append(chars.select("kind", "token", "frequency", (F.col("rank") + offset).alias("id")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def vocabulary_size(vocab: DataFrame) -> int:
    return vocab.count() + SPECIALS


class Tokenizer:
    """A fitted vocabulary; its size is capped by the configuration, so tasks get it as two broadcast dictionaries."""

    def __init__(self, vocab: DataFrame, config: TokenizerConfig = TokenizerConfig()):
        self.config = config
        self.vocab = written(vocab, "vocabulary")
        kinds = {"word": {}, "char": {}}
        for kind, token, number in self.vocab.select("kind", "token", "id").collect():
            kinds[kind][token] = number
        self.words, self.chars = kinds["word"], kinds["char"]

    @classmethod
    def fit(cls, texts: DataFrame, config: TokenizerConfig = TokenizerConfig()) -> Tokenizer:
        return cls(vocabulary(texts.select("text").where("text is not null").distinct(), config), config)

    @classmethod
    def fit_pairs(cls, pairs: DataFrame, config: TokenizerConfig = TokenizerConfig()) -> Tokenizer:
        return cls.fit(distinct_texts(pairs), config)

    @property
    def vocab_size(self) -> int:
        return len(self.words) + len(self.chars) + SPECIALS

    def save(self, path: str) -> None:
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.vocab.sparkSession.createDataFrame([(json.dumps(asdict(self.config)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")

    @classmethod
    def load(cls, spark, path: str) -> Tokenizer:
        config = TokenizerConfig(**json.loads(spark.read.text(f"{path}/config").first()[0]))
        return cls(spark.read.parquet(f"{path}/vocabulary"), config)

    def _ids(self, source: Column, spark) -> Column:
        """Ids of a text's tokens: tokens come from the JVM, the dictionaries are broadcast once."""
        tables = spark.sparkContext.broadcast((self.words, self.chars, self.config.mode == "word"))

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def ids(lists: pd.Series) -> pd.Series:
            words, chars, words_only = tables.value

            def of(token: str) -> list[int]:
                known = words.get(token)
                if known is not None:
                    return [known]
                return [UNK] if words_only else [chars.get(c, UNK) for c in token]

            return lists.map(lambda tokens: [i for t in tokens for i in of(t)])

        return ids(text.pretokenize(F.coalesce(source, F.lit("")), self.config.lowercase, self.config.ascii_only))

    def encode(self, df: DataFrame, column: str, out: str = "ids", max_length: int | None = None) -> DataFrame:
        """``df`` with the ids of a text, cut to ``max_length``; a null text has none."""
        n = max_length or self.config.max_seq_length
        return df.withColumn(out, F.slice(self._ids(F.col(column), df.sparkSession), 1, n))

    def encode_pairs(self, df: DataFrame, max_length: int | None = None) -> DataFrame:
        """``df`` with ids, padded ids, mask and length of [CLS] prefix [SEP] candidate [SEP]."""
        n = max_length or self.config.max_seq_length
        room = max(0, n - 3)
        half = room // 2
        spark = df.sparkSession
        parts = df.withColumns({"__p": self._ids(F.col("prefix"), spark), "__c": self._ids(F.col("candidate"), spark)})
        mark = lambda x: F.array(F.lit(x))
        ids = F.concat(mark(CLS), F.slice("__p", 1, half), mark(SEP), F.slice("__c", 1, room - half), mark(SEP))
        encoded = parts.withColumn("ids", F.slice(ids, 1, n)).drop("__p", "__c")
        return pad(encoded, n)


def pad(df: DataFrame, n: int) -> DataFrame:
    """``df`` with padded ids, the mask of real ones and their number."""
    length = F.least(F.size("ids"), F.lit(n))
    return (
        df.withColumn("padded", F.slice(F.concat("ids", F.array_repeat(F.lit(PAD), n)), 1, n))
        .withColumn("mask", F.slice(F.concat(F.transform("ids", lambda _: F.lit(1)), F.array_repeat(F.lit(0), n)), 1, n))
        .withColumn("length", length)
    )
