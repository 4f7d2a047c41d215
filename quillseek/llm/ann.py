"""Approximate nearest neighbours: one-bit codes of rotated vectors, error bounds, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillseek.llm.common import LIMITS, stored
from quillseek.operators.joins import split_join


@dataclass(frozen=True)
class NeighbourConfig:
    """``nearest`` rows for each query. ``sureness`` widens the error bound of an estimate (in its standard
    deviations). ``rows`` and ``queries`` are distinct vectors in a block. Blocks of rows are dealt into ``groups`` that
    meet each block of queries once, or into as many as hold ``group_bytes`` of vectors each, if that is more."""

    nearest: int = 5
    every: int = 50
    sureness: float = 3.0
    rows: int = 4096
    queries: int = 512
    groups: int = 32
    group_bytes: int = 64 << 20
    seed: int = 42


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, vector, dim)`` of the rows that take part, repeated rows once."""
    kept = vectors.filter(
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    vector = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast("double"))  # one zero
    return kept.select("vec_id", vector.alias("vector"), F.size("embedding").alias("dim"))


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and the vectors with extreme ones scaled so that their squares stay finite."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    extreme = (largest > 1e150) | (largest < 1e-150)
    vectors = np.where(extreme, vectors / largest, vectors)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), vectors


def encode(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated vectors, and each code's inner product with its vector."""
    turned = units @ turn.T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(units.shape[1])


def _scan(queries: np.ndarray, rows: np.ndarray, codes: np.ndarray, fit: np.ndarray, turn: np.ndarray, keep: int, sureness: float):
    """For each query the rows that can be among its ``keep`` nearest, with exact cosines.

    A row's code and the query's table of sums by byte give an estimate of their inner product; the
    bound around it says which rows can still be among the nearest. Only those are compared exactly.
    """
    dim = rows.shape[1]
    spread = np.sqrt(np.maximum(0.0, 1 - fit**2)) / fit / np.sqrt(max(1, dim - 1)) * sureness
    units, scaled = unit(queries)
    norms = np.sqrt((rows * rows).sum(axis=1))
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(float)
    width = codes.shape[1] * 8
    for n, (q, vector) in enumerate(zip(units @ turn.T, scaled)):
        padded = np.zeros(width)
        padded[:dim] = q
        tables = bits @ padded.reshape(-1, 8).T  # for each byte value and byte: the sum where bits are set
        set_sum = np.zeros(len(rows))
        for j in range(codes.shape[1]):
            set_sum += tables[codes[:, j], j]
        estimate = (2 * set_sum - q.sum()) / np.sqrt(dim) / fit
        low = estimate - spread
        floor = np.partition(low, -keep)[-keep] if len(rows) > keep else -np.inf
        near = np.flatnonzero(estimate + spread >= floor)
        exact = (rows[near] * vector).sum(axis=1) / (norms[near] * np.sqrt((vector * vector).sum()))
        if len(near) > keep:
            cut = np.partition(exact, -keep)[-keep]
            near, exact = near[exact >= cut], exact[exact >= cut]
        yield n, near, exact


def _blocks(frame: DataFrame, size: int, ids: str) -> tuple[DataFrame, dict[int, int]]:
    """Distinct vectors packed into rows of about ``size`` vectors, and the number of blocks for each dimension."""
    counts = {r["dim"]: -(-r["count"] // size) for r in frame.groupBy("dim").count().collect()}
    if not counts:
        return frame.select("dim", F.lit(0).alias("block"), F.lit(b"").alias("vectors"), F.array().cast("array<array<long>>").alias("ids")).limit(0), counts
    number = F.coalesce(F.create_map(*(F.lit(x) for pair in counts.items() for x in pair))[F.col("dim")], F.lit(1))
    placed = frame.withColumn("block", F.pmod(F.xxhash64("vector"), number).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        vectors = table["vector"].combine_chunks()
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f8")
        return pa.table(
            {
                "dim": pa.array([table["dim"][0].as_py()], pa.int32()),
                "block": pa.array([table["block"][0].as_py()], pa.int32()),
                "vectors": pa.array([flat.tobytes()], pa.binary()),
                "ids": pa.array([table[ids].to_pylist()], pa.list_(pa.list_(pa.int64()))),
            }
        )

    packed = placed.groupBy("dim", "block").applyInArrow(pack, "dim int, block int, vectors binary, ids array<array<long>>")
    return packed, counts


def _groups(blocks: int, dim: int, config: NeighbourConfig) -> int:
    """How many groups the blocks of a dimension are dealt into."""
    return min(blocks, max(config.groups, -(-blocks * config.rows * 8 * dim // config.group_bytes)))


def _distinct(rows: DataFrame, most: int | None) -> DataFrame:
    """``(vector, dim, ids)``: each vector once with its smallest ids. The ranking's limit is applied before
    the shuffle, so a vector that a third of all rows share sends a few rows from each task."""
    rank = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.distinct().withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= most)
    return few.groupBy("vector", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def neighbours(vectors: DataFrame, config: NeighbourConfig = NeighbourConfig()) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the rows of largest cosine for every ``every``-th id.

    Vectors that are null, zero, of length 0 or hold null or non-finite components take no part; rows with a null id
    neither. Vectors are compared with those of their own length. A repeated row counts once; ties go to
    smaller ids; a query with fewer candidates has fewer rows; an empty table gives an empty result.

    Equal vectors are one entry with the few smallest ids that any answer can hold, and equal queries are
    asked once, so copies cost nothing. Blocks of queries meet groups of blocks of entries by an equality join, so a query is
    copied once for each group; every entry is tested by its code in each. What leaves a block is a few rows for each query.
    The join shuffles: its left side is estimated without the copies and would be broadcast, far larger, from the driver.
    """
    keep = config.nearest + 1  # one of them may be the query itself
    rows = stored(usable(vectors), "ann-rows")
    entries, row_blocks = _blocks(stored(_distinct(rows, keep), "ann-entries"), config.rows, "ids")
    asked = rows.filter(F.pmod("vec_id", F.lit(config.every)) == 0).distinct()
    asked = stored(asked.withColumn("ask", F.min("vec_id").over(Window.partitionBy("vector"))), "ann-asked")
    once = asked.filter("ask = vec_id").select("vector", "dim", F.array("ask").alias("asks"))
    queries, _ = _blocks(once, config.queries, "asks")
    if not row_blocks:
        return rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    groups = {dim: _groups(blocks, dim, config) for dim, blocks in row_blocks.items()}
    number = F.create_map(*(F.lit(x) for pair in groups.items() for x in pair))[F.col("dim")]
    spread = queries.select(
        "dim", F.col("vectors").alias("asked"), F.col("ids").alias("asks"), F.explode(F.sequence(F.lit(0), number - 1)).alias("group")
    )
    entries = entries.withColumn("group", F.pmod("block", number))
    seed, sureness = config.seed, config.sureness

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]  # one by one, as a row holds two blocks
                dim = row["dim"]
                data = unit(np.frombuffer(row["vectors"], "<f8").reshape(-1, dim))
                turn = rotation(dim, seed)
                codes, fit = encode(data[0], turn)
                found: list[tuple[int, int, float]] = []
                for n, near, scores in _scan(np.frombuffer(row["asked"], "<f8").reshape(-1, dim), data[1], codes, fit, turn, keep, sureness):
                    some = sorted((-s, i) for entry, s in zip(near.tolist(), scores.tolist()) for i in row["ids"][entry])
                    found += [(row["asks"][n][0], i, -s) for s, i in some[:keep]]
                ask, vec, score = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(ask, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], names=["ask", "vec_id", "score"])

    met = spread.hint("merge").join(entries, ["dim", "group"]).select("dim", "asked", "asks", "vectors", "ids")
    found = met.mapInArrow(meet, "ask long, vec_id long, score double")
    best = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    found = stored(found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= keep).drop("n"), "ann-found")
    askers = asked.select("ask", F.col("vec_id").alias("query_id")).distinct()
    answers = split_join(askers, found, ["ask"], "inner", LIMITS).filter("vec_id != query_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= config.nearest).select("query_id", "rank", "vec_id", "score")
