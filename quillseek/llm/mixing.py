"""Mixing sources: tempered token shares, realised as whole and part permutations of each source."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillseek.llm.common import LIMITS, WORD, others, stored
from quillseek.operators.joins import broadcast_if_small, split_join

_PROBES = 32  # exponents tried in one pass over the sources
_ROUNDS = 4  # each narrows the bracket _PROBES times
_DIGIT = 12  # bits of a position that one refinement reads: 4096 blocks of a source
_LEVELS = 3


@dataclass(frozen=True)
class MixingConfig:
    """``target_entropy`` is a share of the largest possible entropy, log(sources). ``most_repeats`` bounds how
    often the most repeated source is read for each time the least repeated one is. ``budget`` is in tokens;
    None is the smallest budget that leaves out no document."""

    target_entropy: float = 0.95
    most_repeats: float = 2.0
    budget: int | None = None
    seed: int = 42


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _key(source: Column) -> Column:
    """A source as a join key; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _position(seed: int) -> Column:
    """A document's place in its source's permutation: 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 1)


def token_shares(sized: DataFrame) -> DataFrame:
    """Tokens and share of every source with tokens. Counts are combined before the shuffle."""
    sums = sized.groupBy("key").agg(F.sum("tokens").alias("total")).filter("total > 0")
    whole = sums.agg(F.sum("total")).first()[0]
    return sums.withColumn("share", F.col("total") / F.lit(whole))


def exponent(shares: DataFrame, config: MixingConfig) -> tuple[float, float]:
    """The exponent in [0, 1], and its normaliser over the sources.

    Both criteria are monotone in the exponent: entropy falls, repetition falls. The largest exponent
    that still has the target entropy is bracketed; if its repetition exceeds the limit, the smallest
    one within the limit is taken instead. Each round is one aggregate over the sources.
    """
    sources = shares.count()

    def probe(low: float, high: float) -> list[tuple[float, float, float, float]]:
        tried = [low + (high - low) * i / _PROBES for i in range(_PROBES + 1)]
        row = shares.agg(
            *(
                column
                for i, a in enumerate(tried)
                for column in (
                    F.sum(F.pow("share", F.lit(a))).alias(f"z{i}"),
                    F.sum(F.pow("share", F.lit(a)) * F.log("share")).alias(f"l{i}"),
                )
            ),
            F.min("share").alias("least"),
            F.max("share").alias("most"),
        ).first()
        found = []
        for i, a in enumerate(tried):
            z, logs = row[f"z{i}"], row[f"l{i}"]
            entropy = math.log(z) - a * logs / z
            found.append((a, entropy, (row["most"] / row["least"]) ** (1 - a), z))
        return found

    def bisect(meets) -> float:
        """The last exponent of [0, 1] that ``meets``, which holds up to some exponent."""
        low, high = 0.0, 1.0
        for _ in range(_ROUNDS):
            tried = probe(low, high)
            good = [a for a, entropy, repeats, _ in tried if meets(entropy, repeats)]
            if len(good) == len(tried):
                return high
            low = max(good, default=low)
            high = min(a for a, *_ in tried if a > low)
        return low

    wanted = config.target_entropy * math.log(sources)
    best = bisect(lambda entropy, repeats: entropy >= wanted - 1e-12)
    if probe(best, best)[0][2] > config.most_repeats:
        too_often = bisect(lambda entropy, repeats: repeats > config.most_repeats)
        best = min(1.0, too_often + 1 / _PROBES**_ROUNDS)
    return best, probe(best, best)[0][3]


def quotas(sized: DataFrame, config: MixingConfig) -> DataFrame:
    """``(key, weight, epochs, rest)``: whole permutations of each source, and tokens of the last one."""
    shares = stored(token_shares(sized), "mixing-shares")
    if shares.isEmpty():
        return shares.select("key", F.lit(0.0).alias("weight"), F.lit(1).alias("epochs"), F.lit(0.0).alias("rest"))
    power, norm = exponent(shares, config)
    weighed = shares.withColumn("weight", F.pow("share", F.lit(power)) / F.lit(norm))
    if config.budget is None:
        budget = weighed.agg(F.max(F.col("total") / F.col("weight"))).first()[0]
    else:
        budget = float(config.budget)
    repeats = F.lit(budget) * F.col("weight") / F.col("total")
    epochs = F.floor(repeats + F.lit(1e-9)).cast("int")
    rest = F.greatest(F.lit(0.0), F.lit(budget) * F.col("weight") - epochs * F.col("total"))
    return weighed.select("key", "weight", epochs.alias("epochs"), rest.alias("rest"))


def cut_points(sized: DataFrame, quota: DataFrame) -> DataFrame:
    """``(key, weight, epochs, cut)``: documents whose position's first bits are below ``cut`` are read once more.

    The permutation's tokens are counted by block, then within the block in which the rest runs out, and
    so on: no source is ever sorted, and a source has at most 4096 block rows in a window.
    """
    found = quota.select("*", F.lit(0).cast("long").alias("cut"))
    part = sized
    for level in range(_LEVELS):
        digits = F.shiftrightunsigned("position", 63 - _DIGIT * (level + 1))
        part = split_join(part, found.select("key", F.col("cut").alias("prefix")), ["key"], "inner", LIMITS)
        if level:
            part = part.filter(F.shiftrightunsigned("position", 63 - _DIGIT * level) == F.col("prefix"))
        part = part.drop("prefix")
        blocks = part.groupBy("key", digits.alias("block")).agg(F.sum("tokens").alias("tokens"))
        order = Window.partitionBy("key").orderBy("block")
        blocks = blocks.withColumn("upto", F.sum("tokens").over(order))
        blocks = blocks.join(broadcast_if_small(found.select("key", "rest"), LIMITS), "key").filter(F.col("upto") <= F.col("rest"))
        whole = blocks.groupBy("key").agg(F.max("upto").alias("used"), F.max("block").alias("last"))
        start = F.col("cut") * F.lit(1 << _DIGIT)
        found = stored(
            found.join(whole, "key", "left").select(
                "key",
                "weight",
                "epochs",
                (F.col("rest") - F.coalesce("used", F.lit(0))).alias("rest"),
                F.coalesce(F.col("last") + 1, start).alias("cut"),
            ),
            "mixing-cuts",
        )
    return found


def mix(docs: DataFrame, config: MixingConfig = MixingConfig()) -> DataFrame:
    """The documents in their mixed numbers, with ``epoch`` (from 1), ``position``, ``tokens`` and ``weight``.

    A source is read in whole permutations and a part of one more, so that its tokens meet its weight's
    share of the budget to within one document. Text never moves: only block counts are shuffled. Null
    is a source of its own; sources without tokens are read once; an empty table gives an empty result.
    Identical rows share a position and are taken together. Other columns are kept, unless they
    are called like a new one.
    """
    placed = docs.select(
        "*",
        _key(F.col("source")).alias("__key"),
        tokens_of(F.col("text")).alias("__tokens"),
        _position(config.seed).alias("__position"),
    )
    narrow = placed.select(
        F.col("__key").alias("key"), F.col("__tokens").alias("tokens"), F.col("__position").alias("position")
    )
    narrow = stored(narrow, "mixing-sizes")
    cuts = cut_points(narrow, stored(quotas(narrow, config), "mixing-quotas"))
    cuts = cuts.select(F.col("key").alias("__key"), F.col("weight").alias("__weight"), F.col("epochs").alias("__epochs"), F.col("cut").alias("__cut"))
    joined = split_join(placed, cuts, ["__key"], "left", LIMITS)
    once_more = F.shiftrightunsigned("__position", 63 - _DIGIT * _LEVELS) < F.col("__cut")
    copies = F.coalesce(F.col("__epochs"), F.lit(1)) + F.when(once_more, 1).otherwise(0)
    return joined.withColumn("__copies", copies).filter("__copies > 0").select(
        *others(docs, "epoch", "position", "tokens", "weight"),
        F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("epoch"),
        F.col("__position").alias("position"),
        F.col("__tokens").alias("tokens"),
        F.coalesce("__weight", F.lit(0.0)).alias("weight"),
    )
