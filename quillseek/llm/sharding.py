"""Sharding by histogram sort: splitters that halve the bytes exactly, found by counting, then one exchange."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillseek.llm.common import LIMITS, others, stored
from quillseek.operators.joins import broadcast_if_small

_BITS = 62  # of a key: 30 of the text's hash, 32 of the row's
_DIGIT = 10  # bits that one round of probes refines


@dataclass(frozen=True)
class ShardConfig:
    """``tolerance``: bytes a splitter may be off, as a share of a shard. ``piece_bytes``: what one task sorts."""

    shards: int = 16
    tolerance: float = 0.002
    piece_bytes: int = 16 << 20


def size_of(text: Column) -> Column:
    """UTF-8 bytes, none for null, plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def sort_key(text: Column, row: Column) -> Column:
    """Equal texts lie together, parted by the rows' own numbers: a boundary can go through a large group of copies, and
    through repeated rows too."""
    high = F.shiftrightunsigned(F.xxhash64(text), 34)
    return F.shiftleft(high, 32).bitwiseOR(F.xxhash64(row).bitwiseAND(F.lit((1 << 32) - 1)))


@dataclass
class _Bracket:
    """A splitter lies in ``[start, start + 2**bits)``; ``below`` bytes have smaller keys."""

    start: int
    bits: int
    below: int


def splitters(sized: DataFrame, config: ShardConfig) -> tuple[list[int], int]:
    """Keys at which shards begin, and all bytes.

    Every round cuts each open bracket into 1024 cells and counts the bytes of all rows in each: a
    combined aggregate of at most ``shards * 1024`` rows. A splitter is done when a cell's edge is within
    the tolerance, or cells are single keys; texts stay whole where an edge between texts will do.
    """
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    targets = [total * i / config.shards for i in range(1, config.shards)]
    slack = config.tolerance * total / config.shards
    brackets = [_Bracket(0, _BITS, 0) for _ in targets]
    done: list[int | None] = [None] * len(targets)
    while None in done:
        open_ = sorted({(b.start, b.bits) for b, d in zip(brackets, done) if d is None})
        which, cell = F.lit(None).cast("int"), F.lit(None).cast("long")
        for n, (start, bits) in enumerate(open_):
            inside = F.col("key").between(F.lit(start), F.lit(start + (1 << bits) - 1))
            which = F.when(inside, F.lit(n)).otherwise(which)
            cell = F.when(inside, F.shiftright(F.col("key") - F.lit(start), max(0, bits - _DIGIT))).otherwise(cell)
        counted = sized.select(which.alias("n"), cell.alias("cell"), "size").filter("n is not null")
        rows = counted.groupBy("n", "cell").agg(F.sum("size").alias("bytes")).collect()
        cells: dict[int, dict[int, int]] = {}
        for row in rows:
            cells.setdefault(row["n"], {})[row["cell"]] = row["bytes"]
        for i, (bracket, target) in enumerate(zip(brackets, targets)):
            if done[i] is not None:
                continue
            step = max(0, bracket.bits - _DIGIT)
            here = cells.get(open_.index((bracket.start, bracket.bits)), {})
            below, edge, size = bracket.below, 0, 0
            for edge in range(1 << (bracket.bits - step)):
                size = here.get(edge, 0)
                if below + size >= target:
                    break
                below += size
            start = bracket.start + (edge << step)
            if target - below <= slack:
                done[i] = start
            elif below + size - target <= slack:
                done[i] = start + (1 << step)
            elif step == 0:
                done[i] = start if target - below <= below + size - target else start + 1
            else:
                brackets[i] = _Bracket(start, step, below)
    return sorted(d for d in done if d is not None), total


def shard(docs: DataFrame, config: ShardConfig = ShardConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of the documents, with ``size``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    Shards have near equal bytes, whatever share of the rows is one text or one row repeated. Rows are stored under
    numbers of their own; only sizes and keys are read to find the splitters. Then rows move once, to pieces of a shard
    of bounded size, and are sorted there; a piece's first slot comes from the counts of the pieces before it. Null
    texts count one byte; an empty table gives an empty result. Columns called like a new one are replaced, others of
    any name are kept. ``doc_id`` and ``text`` may name fields of a struct.
    """
    kept = others(docs, "size", "shard", "slot")
    whole = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")
    numbered = docs.select(whole, F.col(doc_id).alias("id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("number"))
    placed = numbered.select("row", "id", "number", size_of(F.col("text")).alias("size"), sort_key(F.col("text"), F.col("number")).alias("key"))
    placed = stored(placed, "shard-rows")
    sized = placed.select("size", "key")
    starts, total = splitters(sized, config)
    pieces = max(1, -(-total // (config.shards * config.piece_bytes)))
    shard_of = F.lit(0)
    for start in starts:
        shard_of = shard_of + F.when(F.col("key") >= F.lit(start), 1).otherwise(0)
    at, piece = shard_of.cast("int").alias("shard"), F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(pieces)).cast("int").alias("piece")
    counts = sized.select(at, piece).groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "piece", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    first = broadcast_if_small(stored(first, "shard-slots"), LIMITS)  # a row for each piece
    within = Window.partitionBy("shard", "piece").orderBy("key", "id", "number")
    ranked = placed.select("row", "id", "number", "size", "key", at, piece).withColumn("rank", F.row_number().over(within))
    return ranked.join(first, ["shard", "piece"]).select("row.*", "size", "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"))
