"""Connected components as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillseek.llm.common import LIMITS, stored
from quillseek.operators.joins import split_join


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (src, dst)``; the component is its smallest node.

    Alternating large-star and small-star rounds: each links nodes to smaller neighbours of their
    neighbours, so that the number of rounds grows with the logarithm of the longest path. The pairs of a
    round are written to the shared folder. A hub is met by ``split_join``, never gathered in a task.
    No more nodes have a lowest neighbour than pairs have ends, so small graphs are known without a job to be small.
    Pairs with a null end and loops are ignored; an empty table gives an empty result.
    """
    pairs = (
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .filter("src is not null and dst is not null and src != dst")
        .distinct()
    )
    pairs = stored(pairs, "components")
    before = None
    while (now := _state(pairs)) != before:
        before = now
        small = _small(2 * now[0])
        both = pairs.union(pairs.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = (
            split_join(both, lowest, ["u"], "inner", LIMITS, small)
            .filter("v > u")
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
            .distinct()
        )
        large = stored(large, "components")
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = split_join(large, lowest, ["u"], "inner", LIMITS, small).filter("v != low").select("v", "low")
        pairs = stored(small.union(lowest).toDF("u", "v").distinct(), "components")
    return pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
        pairs.select("v", "v").distinct()
    )


def _small(rows: int) -> bool | None:
    """Whether so many rows of two longs can be broadcast; None, to be measured, if they may be too many."""
    return True if rows <= LIMITS.max_broadcast_rows and 16 * rows <= LIMITS.max_broadcast_bytes else None


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
