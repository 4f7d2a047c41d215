"""Exact search for the largest inner products: distances to pivots bound every score before it is computed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillseek.llm.common import NARROW, stored
from quillseek.operators.joins import broadcast_if_small, split_join

_EXACT = 2.0**52  # products of norms up to here: sums in doubles are exact
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class PivotConfig:
    """``nearest`` rows for each query, every ``every``-th id. ``pivots`` are chosen among ``sample`` vectors.
    ``rows`` and ``queries``: vectors in a block. ``step``: rows that are compared between two looks at the bound."""

    nearest: int = 5
    every: int = 50
    scale: int = 256
    pivots: int = 32
    sample: int = 512
    rows: int = 2048
    queries: int = 256
    step: int = 256


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """``(vec_id, dim, vector)``, repeated rows once: floor(scale * component) as little-endian doubles, in
    which whole numbers of any size are exact. Rows without an id, and vectors that are null or hold null or
    non-finite components, are left out; a component whose multiple is not finite counts as the largest double."""
    kept = vectors.filter(
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            with np.errstate(over="ignore"):
                flat = np.nan_to_num(np.floor(lists.flatten().to_numpy(zero_copy_only=False) * scale)) + 0.0  # no negative zero
            ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            data = flat.astype("<f8").tobytes()
            packed = pa.array([data[a * 8 : b * 8] for a, b in zip(ends[:-1], ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int32()), packed], names=["vec_id", "dim", "vector"])

    return kept.mapInArrow(pack, "vec_id long, dim int, vector binary").distinct()


def _matrix(packed: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<f8").reshape(len(packed), dim)


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows to all pivots."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(np.stack([((rows - p) ** 2).sum(axis=1) for p in pivots], axis=1)).astype(np.float32)


def chosen_pivots(sample: np.ndarray, many: int) -> np.ndarray:
    """Rows far from each other: each next one is farthest from those chosen."""
    chosen = [0]
    apart = np.nan_to_num(distances(sample, sample[:1])[:, 0])
    while len(chosen) < min(many, len(sample)) and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, np.nan_to_num(distances(sample, sample[chosen[-1:]])[:, 0]))
    return sample[chosen]


def _parted(frame: DataFrame, keys: list[str], size: int) -> DataFrame:
    """With a ``part`` for each row, so that parts of a key hold about ``size`` rows."""
    counts = frame.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("parts"))
    rows = split_join(frame, counts, keys, "inner", NARROW)
    return rows.withColumn("part", F.pmod(F.xxhash64("vector"), "parts").cast("int")).drop("parts")


def _pivot_table(entries: DataFrame, config: PivotConfig) -> DataFrame:
    """``(dim, pivots)``: chosen among a sample of each dimension, the vectors of smallest hash."""
    order = Window.partitionBy("dim").orderBy(F.xxhash64("vector"), "vector")
    few = entries.select("dim", "vector").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= config.sample).drop("n")
    many = config.pivots

    def choose(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        sample = _matrix(sorted(table["vector"].to_pylist()), dim)
        return pa.table({"dim": pa.array([dim], pa.int32()), "pivots": pa.array([chosen_pivots(sample, many).tobytes()], pa.binary())})

    return stored(few.groupBy("dim").applyInArrow(choose, "dim int, pivots binary"), "pivot-points")


_MEASURED = "dim int, cell int, vector binary, ids array<long>, dist binary"
_BLOCK = "dim int, cell int, part int, vectors binary, ids array<array<long>>, dist binary, low binary, high binary, norm double"


def _blocks(entries: DataFrame, pivots: DataFrame, size: int) -> DataFrame:
    """Entries ``(vector, dim, ids)`` in blocks of one cell (that of the nearest pivot), beside their distances
    to all pivots: the pivot table, computed once and stored."""

    def gather(table: pa.Table) -> pa.Table:
        return pa.table({"dim": table["dim"][:1], "vectors": pa.array([table["vector"].to_pylist()], pa.list_(pa.binary())), "ids": pa.array([table["ids"].to_pylist()], pa.list_(pa.list_(pa.int64())))})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                dim, vectors = row["dim"], row["vectors"]
                far = distances(_matrix(vectors, dim), np.frombuffer(row["pivots"], "<f8").reshape(-1, dim) if dim else np.zeros((1, 0)))
                cells = np.nan_to_num(far, nan=np.inf).argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim] * len(vectors), pa.int32()), pa.array(cells, pa.int32()), pa.array(vectors, pa.binary()), pa.array(row["ids"], pa.list_(pa.int64())), pa.array([x.tobytes() for x in far], pa.binary())],
                    names=["dim", "cell", "vector", "ids", "dist"],
                )

    def pack(table: pa.Table) -> pa.Table:
        dim, vectors = table["dim"][0].as_py(), table["vector"].to_pylist()
        far = np.frombuffer(b"".join(table["dist"].to_pylist()), "<f4").reshape(len(vectors), -1)
        with np.errstate(over="ignore"):
            norm = float((_matrix(vectors, dim) ** 2).sum(axis=1).max())
        one = {"vectors": b"".join(vectors), "dist": far.tobytes(), "low": far.min(axis=0).tobytes(), "high": far.max(axis=0).tobytes()}
        made = {k: pa.array([v], pa.binary()) for k, v in one.items()}
        made |= {k: table[k][:1] for k in ("dim", "cell", "part")} | {"ids": pa.array([table["ids"].to_pylist()], pa.list_(pa.list_(pa.int64()))), "norm": pa.array([norm])}
        return pa.table({k: made[k] for k in ("dim", "cell", "part", "vectors", "ids", "dist", "low", "high", "norm")})

    rough = _parted(entries, ["dim"], size).groupBy("dim", "part").applyInArrow(gather, "dim int, vectors array<binary>, ids array<array<long>>")
    measured = stored(rough.join(broadcast_if_small(pivots, NARROW), "dim").select("dim", "vectors", "ids", "pivots").mapInArrow(measure, _MEASURED), "pivot-measured")
    return stored(_parted(measured, ["dim", "cell"], size).groupBy("dim", "cell", "part").applyInArrow(pack, _BLOCK), "pivot-blocks")


def _bound(norm: np.ndarray | float, other: np.ndarray | float, gap: np.ndarray) -> np.ndarray:
    """The largest inner product of two vectors of these squared norms whose distance is ``gap`` at least. Widened
    by more than rounding can take away; not a number where the norms are too large to tell."""
    with np.errstate(over="ignore", invalid="ignore"):
        both = norm + other
        return (both - gap.astype(np.float64) ** 2) / 2 + both * 1e-6 + 1


_ROUND = np.float32(3e-7)  # more than a stored distance can be off, as a share of it


def least_gap(low: np.ndarray, high: np.ndarray, q_low: np.ndarray, q_high: np.ndarray) -> np.ndarray:
    """The largest lower bound that any pivot gives for distances between rows and queries whose distances
    to the pivots (a column each) lie in these ranges."""
    gap = np.zeros(len(low), dtype=np.float32)
    with np.errstate(over="ignore", invalid="ignore"):
        for p in range(low.shape[1]):
            np.fmax(gap, low[:, p] * (1 - _ROUND) - q_high[p] * (1 + _ROUND), out=gap)
            np.fmax(gap, q_low[p] * (1 - _ROUND) - high[:, p] * (1 + _ROUND), out=gap)
    return gap


def inner_products(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact, of whole numbers of any size; results past 64 bits count as the nearest 64-bit number."""
    with np.errstate(over="ignore", invalid="ignore"):
        reach = np.sqrt((query**2).sum()) * np.sqrt((rows**2).sum(axis=1))
        wide = ~(reach <= _EXACT)
        out = np.where(wide, 0.0, rows @ query).astype(np.int64)
    if wide.any():
        q = [int(x) for x in query]
        for i in np.flatnonzero(wide):
            out[i] = max(-_LONG - 1, min(_LONG, sum(a * int(b) for a, b in zip(q, rows[i]))))
    return out


def best_rows(query, norm, far, rows, norms, table, keep: int, floor: float, step: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of the ``keep`` largest scores, with all ties of the last, as far as they reach ``floor``; their scores;
    and how many rows were compared. Rows are compared in the order of their bounds until no bound reaches the
    ``keep``-th score found."""
    gap = least_gap(table, table, far, far)
    bound = np.nan_to_num(_bound(norm, norms, gap), nan=np.inf, posinf=np.inf)
    bound[~np.isfinite(gap)] = np.inf
    alive = np.flatnonzero(bound >= floor)
    alive = alive[np.argsort(-bound[alive], kind="stable")]
    places, scores, seen = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
    while seen < len(alive) and bound[alive[seen]] >= floor:
        some = alive[seen : seen + step]
        seen += len(some)
        places, scores = np.concatenate([places, some]), np.concatenate([scores, inner_products(query, rows[some])])
        if len(scores) >= keep:
            last = np.partition(scores, -keep)[-keep]
            floor = max(floor, float(last))
            places, scores = places[scores >= last], scores[scores >= last]
    return places, scores, seen


_FOUND = "dim int, cell int, part int, ask long, vec_id long, own boolean, score long, compared long"


def _meet(pairs: DataFrame, config: PivotConfig) -> DataFrame:
    """Best rows of each query of a block in a block of entries, never fewer than its answer can hold."""
    keep, step = config.nearest + 1, config.step  # one of them may be the query itself

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                dim, many, asked = row["dim"], len(row["ids"]), len(row["asks"])
                rows, queries = (np.frombuffer(row[k], "<f8").reshape(c, dim) for k, c in (("vectors", many), ("q_vectors", asked)))
                table, far = (np.frombuffer(row[k], "<f4").reshape(c, -1) for k, c in (("dist", many), ("q_dist", asked)))
                with np.errstate(over="ignore"):
                    norms, q_norms = (rows**2).sum(axis=1), (queries**2).sum(axis=1)
                floors = dict(row["floors"] or [])
                found: list[tuple] = []
                for i in range(asked):
                    ask = row["asks"][i][0]
                    places, scores, seen = best_rows(queries[i], q_norms[i], far[i], rows, norms, table, keep, floors.get(ask, -np.inf), step)
                    some = sorted((-int(s), x, int(p)) for p, s in zip(places, scores) for x in row["ids"][p])[:keep]
                    found += [(dim, row["q_cell"], row["q_part"], ask, x, bool((rows[p] == queries[i]).all()), -s, 0) for s, x, p in some]
                    found.append((dim, row["q_cell"], row["q_part"], ask, None, False, None, seen))
                columns = zip(*found)
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return stored(pairs.mapInArrow(search, _FOUND), "pivot-found")


def _can_meet(pairs: DataFrame) -> DataFrame:
    """Pairs of blocks of which some bound reaches the lowest floor of the queries' block."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row in batch.to_pylist():
                low, high, q_low, q_high = (np.frombuffer(row[k], "<f4") for k in ("low", "high", "q_low", "q_high"))
                gap = least_gap(low[None, :], high[None, :], q_low, q_high)
                keep.append(not (np.isfinite(gap[0]) and _bound(row["norm"], row["q_norm"], gap)[0] < row["floor"]))
            yield batch.select(["dim", "cell", "part", "q_cell", "q_part"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(test, "dim int, cell int, part int, q_cell int, q_part int")


def highest_products(vectors: DataFrame, config: PivotConfig = PivotConfig()) -> tuple[DataFrame, DataFrame]:
    """``(query_id, rank, vec_id, score)``, and ``(query_id, compared)``: rows that each distinct query was compared
    with; its smallest id stands for it.

    Queries are the rows whose id is divisible by ``every``; candidates all rows of the same number of components
    but the query's own. Scores are inner products of floor(scale * component). Rows without an id, and vectors that
    are null or hold null or non-finite components, take no part; zero and empty vectors do, with scores of 0.
    A repeated row counts once; an id with several vectors is several rows. Ties go to smaller ids; a query with
    fewer candidates has fewer rows; an empty table gives empty results; other columns are ignored.

    With squared norms and ``d`` a distance, the inner product is ``(|q|^2 + |x|^2 - d^2) / 2``, and ``d`` is at
    least ``|d(q, p) - d(x, p)|`` for every pivot ``p``. Equal vectors are one entry with the few smallest ids that
    an answer can hold, so copies cost nothing. Blocks hold entries of one cell. A block of queries first searches
    one block of its own cell; the scores found there are floors, below which whole blocks and then single rows
    need no comparison. Blocks that remain meet by an equality join.
    """
    keep = config.nearest + 1
    rows = stored(whole_vectors(vectors, config.scale), "pivot-rows")
    rank = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= keep)
    entries = stored(few.groupBy("vector", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "pivot-entries")
    pivots = _pivot_table(entries, config)
    blocks = _blocks(entries, pivots, config.rows)
    asked = rows.filter(F.pmod("vec_id", F.lit(config.every)) == 0)
    once = asked.groupBy("vector", "dim").agg(F.min("vec_id").alias("least"))
    once = stored(once.withColumn("ask", F.monotonically_increasing_id()), "pivot-asked")
    queries = _blocks(once.select("vector", "dim", F.array("ask").alias("ids")), pivots, config.queries)

    names = {"cell": "q_cell", "part": "q_part", "vectors": "q_vectors", "ids": "asks", "dist": "q_dist", "low": "q_low", "high": "q_high", "norm": "q_norm"}
    queries = queries.withColumnsRenamed(names)
    sent = queries.select("dim", "q_cell", "q_part", "q_vectors", "q_dist", "asks")
    home = blocks.filter("part = 0").select("dim", F.col("cell").alias("q_cell"), "vectors", "ids", "dist")
    first = _meet(sent.join(home, ["dim", "q_cell"]).withColumn("floors", F.lit(None).cast("map<long, double>")), config)

    place = Window.partitionBy("ask").orderBy(F.desc("score"))
    kth = first.filter("score is not null").withColumn("n", F.row_number().over(place)).filter(F.col("n") == keep)
    at = [F.col("dim"), F.col("cell").alias("q_cell"), F.col("part").alias("q_part")]
    floors = kth.groupBy(*at).agg(
        F.map_from_entries(F.collect_list(F.struct("ask", F.col("score").cast("double")))).alias("floors"), F.min("score").cast("double").alias("lowest"), F.count(F.lit(1)).alias("known")
    )
    floors = stored(floors, "pivot-floors")
    keys = ["dim", "q_cell", "q_part"]
    known = queries.select(*keys, "q_low", "q_high", "q_norm", F.size("asks").alias("many")).join(floors.drop("floors"), keys, "left")
    floor = F.when(F.col("known") == F.col("many"), F.col("lowest")).otherwise(F.lit(float("-inf"))).alias("floor")
    # Blocks' summaries meet in slots: 64 of them beside each summary of a block of queries.
    slots = max(1, blocks.count() // 64)
    left = known.select(*keys, "q_low", "q_high", "q_norm", floor, F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    slot = F.pmod(F.xxhash64("cell", "part"), F.lit(slots)).cast("int").alias("slot")
    right = blocks.select("dim", "cell", "part", "low", "high", "norm", slot)
    pairs = left.join(right, ["dim", "slot"]).filter("cell != q_cell or part != 0").drop("slot")
    pairs = stored(_can_meet(pairs.select("dim", "cell", "part", "q_cell", "q_part", "low", "high", "norm", "q_low", "q_high", "q_norm", "floor")), "pivot-pairs")
    whole = pairs.join(sent, keys).join(floors.select(*keys, "floors"), keys, "left")
    rest = _meet(whole.join(blocks.select("dim", "cell", "part", "vectors", "ids", "dist"), ["dim", "cell", "part"]), config)

    found = first.unionByName(rest)
    best = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    top = found.filter("score is not null").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= keep)
    top = stored(top.select("ask", "vec_id", "own", "score"), "pivot-top")
    askers = split_join(asked, once.drop("least"), ["vector", "dim"], "inner", NARROW).select("ask", F.col("vec_id").alias("query_id"))
    answers = split_join(askers, top, ["ask"], "inner", NARROW).filter(~(F.col("own") & (F.col("vec_id") == F.col("query_id"))))
    order = Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= config.nearest)
    work = found.groupBy("ask").agg(F.sum("compared").alias("compared"))
    compared = once.join(work, "ask").select(F.col("least").alias("query_id"), "compared")
    return ranked.select("query_id", "rank", "vec_id", "score"), compared
