"""Mixing sources to target weights.

Token counts are raised to an exponent, which is bisected until the mix has the entropy of the
targets.  One exponent can't meet several targets at once, so what it leaves of each target is
named as a residual factor; the mix to targets is the temperature mix times its residuals, held
to the repetition limits by bisecting its level.  Left to itself the temperature mix raises the
exponent until the limits hold.  Weights are realised as whole passes over a source and one part
pass over a random permutation of blocks of documents, until the source's budget is spent.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querymill.llm.tokens import settings_rows, token_sizes
from querymill.runtime import written

BLOCK_DOCS = 4_096


def _bisect(test, low: float, high: float) -> float:
    """The border between ``low``, where ``test`` holds, and ``high``, where it doesn't; on the side where it holds."""
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if test(middle) else (low, middle)
    return low


def temperature_shares(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Shares proportional to token counts to the power ``exponent``: 1 as they are, 0 all equal, above 1 more concentrated."""
    most = max(tokens.values(), default=0)
    raised = {s: math.exp(exponent * math.log(n / most)) for s, n in tokens.items() if n > 0}
    total = sum(raised.values())
    return {s: x / total for s, x in raised.items()}


def entropy(shares: dict[str, float]) -> float:
    return -sum((x * math.log(x) for x in shares.values() if x > 0), 0.0)


#: Beyond this exponent the mix is all but the largest sources alone.
_STEEPEST = 4_096.0


def entropy_exponent(tokens: dict[str, int], target: float) -> float:
    """The smallest exponent from 0 whose mix has at most the entropy ``target``.

    Entropy falls as the exponent rises.  A target below that of the largest sources alone (equally
    large ones can't be told apart) can't be met: the steepest exponent comes out, and the caller
    sees from the mix's entropy that it was missed.
    """
    over = lambda e: entropy(temperature_shares(tokens, e)) > target * (1 + 1e-12) + 1e-12
    if not over(0.0):
        return 0.0
    high = 1.0
    while over(high):
        if high >= _STEEPEST:
            return _STEEPEST
        high *= 2
    low = _bisect(over, 0.0, high)
    return low if not over(low) else min(high, math.nextafter(low, math.inf))


def most_tokens(tokens: dict[str, int], limits: dict[str, int], shares: dict[str, float]) -> float:
    """The most tokens that can be spent at these shares within the repetition limits."""
    return min((limits[s] * tokens[s] / x for s, x in shares.items() if x > 0), default=0.0)


def temperature_mix(tokens: dict[str, int], limits: dict[str, int], target_entropy: float, budget: int | None = None) -> tuple[float, dict[str, float], int]:
    """(exponent, shares, tokens to spend): the mix of the target entropy, within the repetition limits.

    Without ``budget`` the limits set what is spent.  With it, the exponent moves from that of the
    target entropy towards 1, where all sources are repeated alike, as little as the limits need
    for the budget; if they don't hold at 1 either, less than the budget is spent there.
    """
    exponent = entropy_exponent(tokens, target_entropy)
    if budget is not None:
        short = lambda e: most_tokens(tokens, limits, temperature_shares(tokens, e)) < budget * (1 - 1e-12)
        if short(exponent):
            exponent = 1.0 if short(1.0) else _bisect(lambda e: not short(e), 1.0, exponent)
    shares = temperature_shares(tokens, exponent)
    room = most_tokens(tokens, limits, shares)
    return exponent, shares, int(room * (1 + 1e-9)) if budget is None else min(int(room * (1 + 1e-9)), budget)


def capped_shares(tokens: dict[str, int], targets: dict[str, float], limits: dict[str, int], budget: float) -> dict[str, float]:
    """The shares of ``budget`` nearest the targets: min(limit, level x target), the level bisected until they add up to 1."""
    most = {s: limits[s] * tokens[s] / budget for s in targets}
    fill = lambda level: sum(min(most[s], level * targets[s]) for s in targets)
    if sum(most.values()) <= 1:
        return most
    top = max(most[s] / targets[s] for s in targets)
    level = _bisect(lambda x: fill(x) <= 1, 0.0, top)
    return {s: min(most[s], level * targets[s]) for s in targets}


def _plan(sizes: DataFrame, targets: DataFrame, budget: int | None, by_temperature: bool) -> list[dict]:
    """What each usable target comes to, on the driver: one row per target."""
    wanted: dict[str, tuple[float, int]] = {}
    for source, share, limit in settings_rows(targets.select("source", "target_share", "max_repeats")):
        if source is not None and share is not None and limit is not None and share > 0:
            old = wanted.get(source, (0.0, 0))
            wanted[source] = (old[0] + share, max(old[1], limit))
    have = {r[0]: (r[1], r[2]) for r in sizes.where(F.col("source").isin(*wanted)).groupBy("source").agg(F.sum("n_tokens"), F.count(F.lit(1))).collect()} if wanted else {}
    usable = {s: have[s][0] for s in wanted if have.get(s, (0,))[0] and wanted[s][1] >= 1}
    limits = {s: wanted[s][1] for s in usable}
    total = sum(wanted[s][0] for s in usable)
    goal = {s: wanted[s][0] / total for s in usable}
    target_entropy = entropy(goal)
    exponent, natural, spend, tokens = 0.0, {}, 0, {}
    if usable:
        exponent, natural, spend = temperature_mix(usable, limits, target_entropy, budget if by_temperature else None)
        if by_temperature:
            tokens = {s: min(int(x * spend), limits[s] * usable[s]) for s, x in natural.items()}
        else:
            residual = {s: goal[s] / natural[s] for s in usable}
            shares = {s: natural[s] * residual[s] for s in usable}
            # without a budget: the most tokens at which every source still has exactly its share
            spend = budget or int(most_tokens(usable, limits, shares))
            got = capped_shares(usable, shares, limits, max(1, spend))
            tokens = {s: min(round(x * spend), limits[s] * usable[s]) for s, x in got.items()}
    return [
        dict(
            source=s, target_share=wanted[s][0], max_repeats=wanted[s][1], available=usable.get(s, 0), documents=have.get(s, (0, 0))[1], wanted=tokens.get(s, 0),
            temperature_share=natural.get(s, 0.0), residual=goal[s] / natural[s] if s in goal else None, exponent=exponent, target_entropy=target_entropy,
        )
        for s in sorted(wanted)
    ]


def _fill(frame: pd.DataFrame) -> pd.DataFrame:
    """The block in which a source's part pass ends: its documents in permuted order, each taken if it still fits."""
    frame = frame.assign(__o=frame["o"].to_numpy() >> 20).sort_values(["__o", "doc_id", "k", "n_tokens"], kind="stable").drop(columns="__o")
    left, extra = int(frame["part"].iloc[0] - frame["start"].iloc[0]), []
    for n in frame["n_tokens"].tolist():
        extra.append(int(n <= left))
        left -= n if n <= left else 0
    return frame.assign(extra=extra)


def mix_sources(
    df: DataFrame,
    targets: DataFrame,
    budget: int | None = None,
    by_temperature: bool = False,
    seed: int = 0,
    record: str = "doc_id",
    text: str = "text",
    source: str = "source",
    tokenizer_path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """A selection in which each source has its share of all tokens: (selection, shares).

    selection: (source, doc_id, pass, n_tokens), one row for each time a document is taken, pass
    counting from 1; no document is taken more often than its source's max_repeats.
    shares: (source, target_share, max_repeats, available_tokens, reached_tokens, reached_share,
    temperature_share, residual, exponent, target_entropy, reached_entropy): what was asked and
    reached, the share that the exponent alone gives and the factor it leaves to the target.

    Targets of sources without any token are spread over the others in proportion and reported
    as reached 0, with no residual.  Without ``budget`` the selection is the largest in which every
    other source reaches its share; with it, sources beyond their limit give what they have and
    the rest goes to the others in proportion to their targets.  ``by_temperature`` leaves the
    residuals out: the shares are those of the exponent that has the targets' entropy, or with a
    budget of the nearest one that keeps the limits.  An entropy that no exponent reaches, as the
    largest sources are equally large, shows in reached_entropy.  In the block in which a source's
    budget ends, documents that don't fit any more are passed over for later ones that do.

    Documents of a null source or one without target, null texts and texts without a token are
    left out; targets that are null or not positive too, repeated ones add up; a null id is kept;
    an empty table gives no selection.  ``targets`` is a small table of settings.
    """
    spark = df.sparkSession
    sizes = token_sizes(df, text, {record: "doc_id", source: "source"}, tokenizer_path).where("n_tokens > 0 and source is not null")
    sizes = sizes.withColumn("k", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    sizes = written(sizes, "sizes")
    rows = []
    for p in _plan(sizes, targets, budget, by_temperature):
        whole, part = divmod(p["wanted"], p["available"]) if p["available"] else (0, 0)
        given = [p[c] for c in ("source", "target_share", "max_repeats", "available", "temperature_share", "residual", "exponent", "target_entropy")]
        rows.append((*given, max(1, -(-p["documents"] // BLOCK_DOCS)), whole, part))
    shape = "source string, target_share double, max_repeats int, available_tokens long, temperature_share double, residual double, exponent double, target_entropy double, blocks long, whole long, part long"
    goal = spark.createDataFrame(rows, shape)
    docs = sizes.join(F.broadcast(goal.select("source", "blocks", "whole", "part")), "source")
    docs = docs.withColumn("o", F.xxhash64(F.lit(seed), "doc_id", "k")).withColumn("block", F.pmod("o", "blocks"))
    ahead = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    totals = docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    starts = totals.withColumn("start", F.coalesce(F.sum("block_tokens").over(ahead), F.lit(0)))
    placed = docs.join(starts, ["source", "block"])
    inside = F.col("start") + F.col("block_tokens") <= F.col("part")
    cut = (F.col("start") < F.col("part")) & ~inside
    sure = placed.where(~cut).withColumn("extra", inside.cast("int"))
    edge = placed.where(cut).groupBy("source", "block").applyInPandas(_fill, T.StructType([*placed.schema.fields, T.StructField("extra", T.IntegerType())]))
    taken = sure.unionByName(edge).withColumn("times", F.col("whole") + F.col("extra")).where("times > 0")
    selection = taken.select("source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("pass"), "n_tokens")
    reached = taken.groupBy("source").agg(F.sum(F.col("times") * F.col("n_tokens")).alias("reached_tokens"))
    everything = Window.partitionBy()  # one row per target
    shares = goal.join(reached, "source", "left").withColumn("reached_tokens", F.coalesce("reached_tokens", F.lit(0)))
    total = F.sum("reached_tokens").over(everything)
    shares = shares.withColumn("reached_share", F.when(total > 0, F.col("reached_tokens") / total).otherwise(F.lit(0.0)))
    part = F.col("reached_share")
    shares = shares.withColumn("reached_entropy", F.sum(F.when(part > 0, -part * F.log(part)).otherwise(0.0)).over(everything))
    return selection, shares.select(
        "source", "target_share", "max_repeats", "available_tokens", "reached_tokens", "reached_share", "temperature_share", "residual", "exponent", "target_entropy", "reached_entropy"
    )


def mix_checks(selection: DataFrame, shares: DataFrame, near: float = 0.02) -> DataFrame:
    """(source, target_share, max_repeats, expected_share, on_target, within_repeats, entropy_reached) of a mix without a budget.

    expected_share is the target's part in the targets of all sources with tokens; on_target and
    entropy_reached hold within ``near``.
    """
    times = selection.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("pass").alias("last")).groupBy("source").agg(F.max(F.greatest("n", "last")).alias("times"))
    everything = Window.partitionBy()  # one row per target
    usable = F.when(F.col("available_tokens") > 0, F.col("target_share")).otherwise(0.0)
    expected = F.round(usable / F.sum(usable).over(everything), 6)
    return shares.join(times, "source", "left").select(
        "source", "target_share", "max_repeats", expected.alias("expected_share"), (F.abs(F.col("reached_share") - expected) < near).alias("on_target"),
        (F.coalesce("times", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), (F.abs(F.col("reached_entropy") - F.col("target_entropy")) < near).alias("entropy_reached"),
    )
