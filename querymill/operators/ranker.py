"""A recurrent re-ranker: scores (prefix, candidate) pairs in Arrow batches, trained in numpy.

The weights are bounded by the configuration and broadcast; each task scores its rows in batches
sorted by length, so short pairs are not padded to long ones.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import PandasUDFType

from querymill.functions import text
from querymill.operators import index, metrics
from querymill.operators.vocab import Tokenizer


@dataclass(frozen=True)
class RankerConfig:
    vocab_size: int
    embedding_dim: int = 128
    hidden_dim: int = 256
    bidirectional: bool = True
    dropout: float = 0.2
    max_seq_length: int = 40


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class RankerModel:
    """Embedding, one (bi)directional LSTM layer, the last real state of each direction, a linear logit.

    Gate order is input, forget, cell, output.  Padding never enters the recurrence.
    """

    def __init__(self, config: RankerConfig, seed: int = 0):
        self.config = config
        rng = np.random.default_rng(seed)
        d, h = config.embedding_dim, config.hidden_dim
        bound = 1 / np.sqrt(h)
        draw = lambda *shape: rng.uniform(-bound, bound, shape).astype(np.float32)
        self.p: dict[str, np.ndarray] = {"emb": rng.standard_normal((config.vocab_size, d)).astype(np.float32)}
        self.p["emb"][0] = 0
        for side in self.sides:
            self.p |= {f"w_{side}": draw(4 * h, d), f"u_{side}": draw(4 * h, h), f"b_{side}": draw(4 * h), f"c_{side}": draw(4 * h)}
        wide = h * len(self.sides)
        bound = 1 / np.sqrt(wide)
        self.p |= {"out": draw(wide), "bias": draw(1)}

    @property
    def sides(self) -> tuple[str, ...]:
        return ("fwd", "bwd") if self.config.bidirectional else ("fwd",)

    def parameters(self) -> int:
        return sum(v.size for v in self.p.values())

    def _run(self, side: str, x: np.ndarray, real: np.ndarray, keep: bool):
        h = self.config.hidden_dim
        gates = x @ self.p[f"w_{side}"].T + (self.p[f"b_{side}"] + self.p[f"c_{side}"])
        state, cell = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
        steps = range(x.shape[1]) if side == "fwd" else range(x.shape[1] - 1, -1, -1)
        saved = []
        for t in steps:
            g = gates[:, t] + state @ self.p[f"u_{side}"].T
            i, f, o = _sigmoid(g[:, :h]), _sigmoid(g[:, h : 2 * h]), _sigmoid(g[:, 3 * h :])
            n = np.tanh(g[:, 2 * h : 3 * h])
            m = real[:, t : t + 1]
            new_cell = f * cell + i * n
            squashed = np.tanh(new_cell)
            if keep:
                saved.append((t, m, i, f, o, n, cell, squashed, state))
            cell = np.where(m, new_cell, cell)
            state = np.where(m, o * squashed, state)
        return state, saved

    def forward(self, ids: np.ndarray, lengths: np.ndarray, keep: bool = False):
        real = np.arange(ids.shape[1])[None, :] < lengths[:, None]
        x = self.p["emb"][ids]
        runs = [self._run(side, x, real, keep) for side in self.sides]
        pooled = np.concatenate([r[0] for r in runs], axis=1)
        logits = pooled @ self.p["out"] + self.p["bias"][0]
        return (logits, x, pooled, [r[1] for r in runs]) if keep else logits

    def score(self, ids: list, lengths: list, batch: int = 64) -> np.ndarray:
        """Logits in the order given."""
        lengths = np.maximum(np.asarray(lengths, dtype=np.int64), 1)
        order = np.argsort(lengths, kind="stable")
        out = np.empty(len(lengths))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            n = int(lengths[rows].max())
            padded = np.zeros((len(rows), n), dtype=np.int64)
            for r, k in enumerate(rows):
                cut = np.asarray(ids[k])[:n]
                padded[r, : len(cut)] = cut
            out[rows] = self.forward(padded, lengths[rows])
        return out

    def gradients(self, ids: np.ndarray, lengths: np.ndarray, loss, rng: np.random.Generator | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """The loss and its gradient; ``loss(logits)`` gives the value and its derivative by the logits."""
        logits, x, pooled, saved = self.forward(ids, lengths, keep=True)
        mask = np.ones_like(pooled)
        if rng is not None and self.config.dropout > 0:
            mask = (rng.random(pooled.shape) >= self.config.dropout).astype(np.float32) / (1 - self.config.dropout)
            logits = (pooled * mask) @ self.p["out"] + self.p["bias"][0]
        value, d_logits = loss(logits)
        d_logits = d_logits.astype(np.float32)
        grads = {"out": (pooled * mask).T @ d_logits, "bias": np.array([d_logits.sum()], np.float32)}
        d_pooled = d_logits[:, None] * self.p["out"][None, :] * mask
        d_x = np.zeros_like(x)
        h = self.config.hidden_dim
        for k, side in enumerate(self.sides):
            d_state, d_cell = d_pooled[:, k * h : (k + 1) * h].copy(), np.zeros((len(x), h), np.float32)
            gw, gu, gb = np.zeros_like(self.p[f"w_{side}"]), np.zeros_like(self.p[f"u_{side}"]), np.zeros_like(self.p[f"b_{side}"])
            for t, m, i, f, o, n, cell, squashed, state in reversed(saved[k]):
                live_state, live_cell = d_state * m, d_cell * m
                inner = live_cell + live_state * o * (1 - squashed**2)
                d_gates = np.concatenate(
                    [inner * n * i * (1 - i), inner * cell * f * (1 - f), inner * i * (1 - n**2), live_state * squashed * o * (1 - o)], axis=1
                )
                gw += d_gates.T @ x[:, t]
                gu += d_gates.T @ state
                gb += d_gates.sum(axis=0)
                d_x[:, t] += d_gates @ self.p[f"w_{side}"]
                d_state = np.where(m, d_gates @ self.p[f"u_{side}"], d_state)
                d_cell = np.where(m, inner * f, d_cell)
            grads |= {f"w_{side}": gw, f"u_{side}": gu, f"b_{side}": gb, f"c_{side}": gb.copy()}
        emb = np.zeros_like(self.p["emb"])
        np.add.at(emb, ids.reshape(-1), d_x.reshape(-1, x.shape[2]))
        emb[0] = 0
        return value, grads | {"emb": emb}

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p, **{f"config_{k}": np.array(v) for k, v in asdict(self.config).items()})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> RankerModel:
        arrays = np.load(io.BytesIO(data))
        config = RankerConfig(**{k[7:]: arrays[k].item() for k in arrays.files if k.startswith("config_")})
        model = cls(config)
        model.p = {k: arrays[k] for k in arrays.files if not k.startswith("config_")}
        return model


def bce(labels: np.ndarray):
    def loss(logits: np.ndarray) -> tuple[float, np.ndarray]:
        value = np.mean(np.maximum(logits, 0) - logits * labels + np.log1p(np.exp(-np.abs(logits))))
        return float(value), (_sigmoid(logits) - labels) / len(logits)

    return loss


def pairwise_hinge(labels: np.ndarray, groups: np.ndarray, margin: float = 0.3):
    """Mean over the positive and negative pairs of equal group; 0 without one."""

    def loss(logits: np.ndarray) -> tuple[float, np.ndarray]:
        pair = (groups[:, None] == groups[None, :]) & (labels[:, None] == 1) & (labels[None, :] == 0)
        n = pair.sum()
        grad = np.zeros_like(logits)
        if not n:
            return 0.0, grad
        gap = margin - (logits[:, None] - logits[None, :])
        active = pair & (gap > 0)
        grad -= active.sum(axis=1) / n
        grad += active.sum(axis=0) / n
        return float(np.where(active, gap, 0).sum() / n), grad

    return loss


class AdamW:
    def __init__(self, model: RankerModel, rate: float = 1e-3, decay: float = 0.01, clip: float = 1.0):
        self.model, self.rate, self.decay, self.clip, self.t = model, rate, decay, clip, 0
        self.m = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.p.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        scale = min(1.0, self.clip / (norm + 1e-6))
        for k, g in grads.items():
            g = g * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g**2
            fixed_m, fixed_v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.model.p[k] = self.model.p[k] * (1 - self.rate * self.decay) - self.rate * fixed_m / (np.sqrt(fixed_v) + 1e-8)


def ranking(scores: np.ndarray, labels: np.ndarray, groups: np.ndarray, top_k: int = 5) -> dict[str, float]:
    """The means that ``metrics.pool_metrics`` gives, of a bounded sample on the driver."""
    frame = pd.DataFrame({"s": scores, "l": labels, "g": groups}).sort_values(["g", "s"], ascending=[True, False], kind="stable")
    frame["r"] = frame.groupby("g").cumcount() + 1
    hits = frame[frame.l == 1]
    first = hits.groupby("g").r.min()
    names = ("precision_at_1", "precision_at_k", "recall_at_k", "mrr_at_k", "hit_rate_at_k")
    if not len(first):
        return dict.fromkeys(names, 0.0) | {"n_evaluated": 0}
    within = hits[hits.r <= top_k].groupby("g").size().reindex(first.index, fill_value=0)
    pool, relevant = frame.groupby("g").size().loc[first.index], hits.groupby("g").size()
    values = ((first == 1), within / np.minimum(pool, top_k), within / relevant, pd.Series(np.where(first <= top_k, 1 / first, 0)), (within > 0))
    return {n: float(v.mean()) for n, v in zip(names, values)} | {"n_evaluated": len(first)}


def train(
    tokenizer: Tokenizer,
    pairs: DataFrame,
    dev: DataFrame,
    config: RankerConfig | None = None,
    epochs: int = 3,
    batch: int = 64,
    patience: int = 3,
    loss: str = "bce",
    margin: float = 0.3,
    rate: float = 1e-3,
    max_examples: int = 20_000,
    max_dev: int | None = None,
    max_steps: int | None = None,
    seed: int = 1337,
) -> tuple[RankerModel, list[dict]]:
    """Fit a ranker on a bounded sample of labelled pairs, keep the epoch best on dev MRR@5: (model, history).

    ``max_examples`` bounds the training sample and ``max_dev`` the dev sample (as many unless given),
    both the rows of smallest hash, so the samples are the same in every run.  ``max_steps`` ends
    the training after so many batches.  history has the loss and all ranking metrics of each epoch.
    """

    def sample(df: DataFrame, most: int) -> pd.DataFrame:
        rows = df.where("prefix is not null and candidate is not null and label is not null").select("prefix", "candidate", "label").distinct()
        hashed = rows.orderBy(F.xxhash64(F.lit(seed), "prefix"), "prefix", F.xxhash64(F.lit(seed), "candidate"), "candidate", "label").limit(most)
        return tokenizer.encode_pairs(hashed).select("prefix", "padded", "length", "label").toPandas()

    rows, held = sample(pairs, max_examples), sample(dev, max_examples if max_dev is None else max_dev)
    model = RankerModel(config or RankerConfig(tokenizer.vocab_size, max_seq_length=tokenizer.config.max_seq_length), seed)
    optimizer, rng = AdamW(model, rate), np.random.default_rng(seed)
    ids, lengths, labels = np.array(rows["padded"].tolist(), dtype=np.int64), rows["length"].to_numpy(), rows["label"].to_numpy()
    groups = rows["prefix"].factorize()[0]
    best, best_score, stale, history, steps = model.to_bytes(), -1.0, 0, [], 0
    for epoch in range(epochs):
        losses = []
        order = rng.permutation(len(ids))
        for i in range(0, len(order), batch):
            if max_steps is not None and steps >= max_steps:
                break
            steps += 1
            k = order[i : i + batch]
            n = int(lengths[k].max())
            objective = bce(labels[k]) if loss == "bce" else pairwise_hinge(labels[k], groups[k], margin)
            value, grads = model.gradients(ids[k, :n], lengths[k], objective, rng)
            optimizer.step(grads)
            losses.append(value)
        reached = ranking(model.score(held["padded"].tolist(), held["length"]) if len(held) else np.array([]), held["label"].to_numpy(), held["prefix"].to_numpy())
        score = reached["mrr_at_k"]
        history.append({"epoch": epoch + 1, "steps": steps, "loss": float(np.mean(losses)) if losses else 0.0, "mrr_at_5": score, **reached})
        if score > best_score:
            best, best_score, stale = model.to_bytes(), score, 0
        else:
            stale += 1
        if stale >= patience or (max_steps is not None and steps >= max_steps):
            break
    return RankerModel.from_bytes(best), history


def save_checkpoint(spark: SparkSession, path: str, model: RankerModel, epoch: int = 0, measured: dict | None = None) -> None:
    """Weights, configuration, epoch and metrics as a table of one row, on any file system."""
    row = (bytearray(model.to_bytes()), json.dumps(asdict(model.config)), epoch, json.dumps(measured or {}))
    spark.createDataFrame([row], _CHECKPOINT).coalesce(1).write.mode("overwrite").parquet(path)


_CHECKPOINT = "weights binary, config string, epoch int, metrics string"


def load_checkpoint(spark: SparkSession, path: str) -> tuple[RankerModel, int, dict]:
    """(model, epoch, metrics) of a saved checkpoint."""
    row = spark.read.schema(_CHECKPOINT).parquet(path).first()
    return RankerModel.from_bytes(bytes(row.weights)), row.epoch, json.loads(row.metrics)


class Ranker:
    """A vocabulary and a model, opened from where they were saved, that score, rank and suggest."""

    def __init__(self, tokenizer: Tokenizer, model: RankerModel):
        self.tokenizer, self.model = tokenizer, model

    @classmethod
    def open(cls, spark: SparkSession, tokenizer_path: str, checkpoint_path: str) -> Ranker:
        return cls(Tokenizer.load(spark, tokenizer_path), load_checkpoint(spark, checkpoint_path)[0])

    def score(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (prefix, candidate, ...) with their scores."""
        return score_pairs(pairs, self.tokenizer, self.model)

    def rank(self, pairs: DataFrame, group: list[str], place: str, top_k: int | None = None) -> DataFrame:
        """``pairs`` with score and rank within each group; ties keep their places."""
        return metrics.rerank(self.score(pairs), group, "score", place, top_k)

    def suggest(self, requests: DataFrame, built: index.PrefixIndex, top_k: int = 5, pool: int = 50) -> DataFrame:
        """(prefix, suggestions) for each prefix of ``requests`` from a built index."""
        return suggest(requests, built.queries, built.cache, self.tokenizer, self.model, top_k, pool)


def score_pairs(df: DataFrame, tokenizer: Tokenizer, model: RankerModel, out: str = "score") -> DataFrame:
    """``df`` (prefix, candidate, ...) with the model's logit of each pair."""
    kept = df.columns
    weights = df.sparkSession.sparkContext.broadcast(model.to_bytes())

    @F.pandas_udf(T.DoubleType(), functionType=PandasUDFType.SCALAR_ITER)
    def logits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ranker = RankerModel.from_bytes(weights.value)
        for ids, lengths in batches:
            yield pd.Series(ranker.score(ids.tolist(), lengths.tolist()))

    encoded = tokenizer.encode_pairs(df)
    return encoded.withColumn(out, logits("ids", "length")).select(*kept, out)


def suggest(
    requests: DataFrame, queries: DataFrame, cache: DataFrame, tokenizer: Tokenizer, model: RankerModel, top_k: int = 5, pool: int = 50, ascii_only: bool = False
) -> DataFrame:
    """(prefix, suggestions) for each distinct prefix: the pool's texts once each, those that start with it, by score."""
    asked = requests.select("prefix").where("trim(prefix) != ''").distinct()
    found = index.candidates(queries, cache, asked, max(pool, top_k)).withColumnRenamed("typed", "prefix")
    shown = F.trim(F.coalesce(F.nullif(F.col("original_query"), F.lit("")), F.col("normalized_query")))
    rows = found.withColumn("candidate", shown).withColumn("norm", text.normalize_prefix(F.col("candidate"), ascii_only=ascii_only))
    rows = metrics.keep_first(rows.where("norm != ''"), ["prefix"], F.col("norm"), "rank").where(F.col("norm").startswith(F.col("matched_prefix")))
    scored = score_pairs(rows.select("prefix", "candidate", F.col("rank").alias("place")), tokenizer, model)
    best = metrics.rerank(scored, ["prefix"], "score", "place", top_k)
    listed = F.array_sort(F.collect_list(F.struct("rank", F.col("candidate").alias("text"), "score")))
    return best.groupBy("prefix").agg(F.transform(listed, lambda s: F.struct(s["text"].alias("text"), s["score"].alias("score"))).alias("suggestions"))
