"""Small plan helpers: broadcasting behind a size check, one row per key, one row per element."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillseek.config import SearchConfig
from quillseek.session import cut_lineage


def is_small(frame: DataFrame, config: SearchConfig) -> bool:
    """Whether the rows and their text fit the broadcast limits. One aggregate job, one row back."""
    size = F.lit(8 * len(frame.columns))
    for field in frame.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif kind in ("struct", "array", "map"):
            # Written out, nested values are about as long as they are in memory.
            size = size + F.coalesce(F.length(F.to_json(F.struct(field.name))), F.lit(0))
    seen = frame.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes"),
    ).first()
    return seen["rows"] <= config.max_broadcast_rows and seen["bytes"] <= config.max_broadcast_bytes


def broadcast_if_small(frame: DataFrame, config: SearchConfig) -> DataFrame:
    """A broadcast hint when the size check allows it; otherwise the join shuffles both sides. For keys
    that are unique on the other side, or nearly so."""
    return F.broadcast(frame) if is_small(frame, config) else frame


def hinted(frame: DataFrame, small: bool) -> DataFrame:
    """A broadcast hint for a frame whose size bound is already known."""
    return F.broadcast(frame) if small else frame


def split_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, config: SearchConfig,
    small: bool | None = None,
) -> DataFrame:
    """``left.join(right, keys, how)`` for a left side in which a few keys may hold most rows.

    A small right side is broadcast. Otherwise left keys are counted, which is combined map-side, and
    rows of hot keys never meet in one task: there are at most ``rows / hot_rows`` such keys, so their
    right rows are few and are broadcast, or spread over salts should even those be too many. All other
    rows are joined by a shuffle in which no key is large. ``how`` is inner, left, left_semi or left_anti.
    """
    if is_small(right, config) if small is None else small:
        return left.join(F.broadcast(right), keys, how)
    counted = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    hot = cut_lineage(counted.filter(F.col("rows") > config.hot_rows).select(*keys))
    if hot.isEmpty():
        return left.join(right, keys, how)
    hot = hinted(hot, is_small(hot, config))
    cold = left.join(hot, keys, "left_anti").join(right, keys, how)
    apart = left.join(hot, keys, "left_semi")
    wanted = cut_lineage(right.join(hot, keys, "left_semi"))
    if is_small(wanted, config):
        return cold.unionByName(apart.join(F.broadcast(wanted), keys, how))
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(config.salts)).cast("int")
    copies = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(config.salts - 1))))
    salted = apart.withColumn("salt", salt).join(copies, [*keys, "salt"], how).drop("salt")
    return cold.unionByName(salted)


def balanced(frame: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys together, in as many tasks as their size asks for: a key with much data gets several."""
    return frame.hint("rebalance", *(F.col(key) for key in keys))


def unnest(frame: DataFrame, keep: Sequence[str], array: Column, name: str = "item", pos: bool = False) -> DataFrame:
    """One row per array element.

    A plain explode makes the optimizer filter on the array's size below everything else, which
    computes an expensive array twice; the outer form with the filter after it does not.
    """
    if pos:
        rows = frame.select(*keep, F.posexplode_outer(array).alias("pos", name))
        return rows.filter(F.col("pos").isNotNull())
    return frame.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def latest(frame: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the highest ``order`` per key.

    An aggregate rather than a ranking window: each task keeps one row per key before the shuffle, so
    a key that holds a third of all rows sends at most one row per task.
    """
    rest = [c for c in frame.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("best")
    return frame.groupBy(*keys).agg(best).select(*keys, "best.*").select(*frame.columns)
