"""Repair of conversations: faults of their rows, cheapest edits to a legal order of roles, and an audit of the edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillseek.llm.audits import EMPTY, INSERT, Run, ending, repaired
from quillseek.llm.common import stored

# What counts as blank, how a whole text ends, which roles may follow each other.
_SPACE = " \t\n\x0b\x0c\r"
_ENDS = ".!?"
_FOLLOWS = ("su", "ua", "au")


@dataclass(frozen=True)
class RepairConfig:
    """A segment, which one program runs over, ends at so many rows or characters."""

    rows: int = 2048
    chars: int = 1 << 20


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with faults by crc32 of ``conv_id:turn`` (a null is one space), modulo 20: 0 drops
    a row, 1 empties its text, 2 takes away its ``.!?``, 3 repeats it, 4 makes its role user. A null role or text is one space."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fate = F.pmod(F.crc32(name.cast("binary")), F.lit(20))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", _ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    kept = rows.filter("fate != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return kept.drop("copy")


_STREAM = ["conv_id", "started", "turn", "role", "head", "digest", "mid"]


def _in_order(rows: DataFrame, every: DataFrame) -> DataFrame:
    """All rows sorted over the partitions by conversation and turn, and among them a mark where each conversation begins
    and one before the first row of each role and text. A mark has the sort key of what it marks, so that no join is needed,
    and a conversation of any size is spread over as many partitions as it fills."""
    keyed = rows.select(
        "conv_id", F.lit(1).alias("started"), "turn", "role", F.substring("text", 1, 64).alias("head"), F.unhex(F.sha2("text", 256)).alias("digest"),
        F.monotonically_increasing_id().alias("mid"), F.lit(1).alias("kind"), "text",
    )
    keyed = stored(keyed, "conv-rows")
    first = keyed.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn", "head", "mid")).alias("at"))
    marks = first.select("conv_id", F.lit(1).alias("started"), "at.turn", "role", "at.head", "digest", "at.mid", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"))
    begins = every.select("conv_id").distinct().select(
        "conv_id", F.lit(0).alias("started"), *(F.lit(None).cast(keyed.schema[c].dataType).alias(c) for c in ("turn", "role", "head", "digest", "mid")), F.lit(-1).alias("kind"), F.lit(None).cast("string").alias("text"),
    )
    stream = keyed.unionByName(marks).unionByName(begins)
    order = [F.asc_nulls_first(c) for c in _STREAM]
    return stream.repartitionByRange(*order).sortWithinPartitions(*order, "kind").select("conv_id", "turn", "role", "text", "kind")


_LINES = "lines array<struct<role: string, text: string>>"
_FACTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")


@dataclass
class _Segment:
    """``seq``: its number within the partition. ``begins``: it holds the first row of its conversation."""

    conv_id: object
    begins: bool
    seq: int
    run: Run

    def __post_init__(self):
        self.lines: list[tuple[str, str]] = []
        self.facts = dict.fromkeys(_FACTS, 0)
        self.low = self.high = self.first = self.last = None
        self.chars = 0

    def add(self, turn, role: str, text: str, new: bool) -> None:
        bare = text.strip(_SPACE)
        fault = "blank" if not bare else "duplicate" if not new else "truncated" if bare[-1] not in _ENDS else None
        if fault:
            self.facts[fault] += 1
        initial = role[:1]
        self.facts["rows"] += 1
        if self.last is None:
            self.first = initial
        else:
            self.facts["illegal"] += self.last + initial not in _FOLLOWS
        self.last = initial
        if turn is not None:
            self.facts["turns"] += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.lines.append((role, text))
        self.chars += len(text)
        self.run.add(initial, fault in ("blank", "duplicate"), fault == "truncated")

    def row(self, part: int, whole: bool) -> dict:
        out = {"conv_id": self.conv_id, "part": part, "seq": self.seq, "whole": whole, "low": self.low, "high": self.high, "first": self.first, "last": self.last, **self.facts}
        spell = self.run.edits.spelled
        if whole:
            best, order = self.run.best[EMPTY], self.run.order(EMPTY)
            state, more, cost = ending({s: c for s, (c, _) in best.items()}, order)
            audit = spell(best[state][1]) + INSERT * more
            return out | {"cost": cost, "audit": audit, "lines": repaired(audit, self.lines, EMPTY), "ways": None}
        ways = []
        for start, best in self.run.best.items():
            order = self.run.order(start)
            ways += [(start, state, cost, order[state], spell(node)) for state, (cost, node) in best.items()]
        return out | {"cost": None, "audit": None, "lines": self.lines, "ways": ways}


def _segment_schema(rows: DataFrame) -> str:
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    facts = ", ".join(f"`{c}` long" for c in _FACTS)
    return (
        f"conv_id {kinds['conv_id']}, part long, seq long, whole boolean, low {kinds['turn']}, high {kinds['turn']}, first string, last string, {facts}, "
        f"cost long, audit string, {_LINES}, ways array<struct<start: int, state: int, cost: long, place: int, audit: string>>"
    )


def _batches(rows: Iterator[dict], schema: pa.Schema, weigh, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if size > most or len(held) >= 4096:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _segments(ordered: DataFrame, config: RepairConfig) -> DataFrame:
    """A row for each conversation that lies within a segment, its audit and its repaired rows with it; and a row for each
    segment of the others, with the cheapest edits from each state to each."""
    schema = _segment_schema(ordered)
    arrow = _arrow(schema)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        now: _Segment | None = None
        new = False
        for batch in batches:
            for conv_id, turn, role, text, kind in zip(*(column.to_pylist() for column in batch.columns)):
                if kind == -1:
                    if now:
                        yield now.row(part, now.begins)
                    now = _Segment(conv_id, True, now.seq + 1 if now else 0, Run((EMPTY,)))
                    continue
                if now is None:  # goes on from the partition before
                    now = _Segment(conv_id, False, 0, Run((0, 1, 2, 3)))
                if kind == 0:
                    new = True
                    continue
                if now.facts["rows"] >= config.rows or now.chars >= config.chars:
                    yield now.row(part, False)
                    now = _Segment(conv_id, False, now.seq + 1, Run((0, 1, 2, 3)))
                now.add(turn, role, text, new)
                new = False
        if now:  # it may go on in the next partition
            yield now.row(part, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(segments(batches), arrow, lambda row: sum(len(r) + len(t) for r, t in row["lines"]) + sum(len(w[4]) for w in row["ways"] or ()))

    return stored(ordered.mapInArrow(run, schema), "conv-segments")


def _by_conversation(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")


_PICKED = "part long, seq long, start int, state int, more int, final boolean, cost long, gaps long, `blank` long, duplicate long, truncated long, illegal long"


def _gaps(low, high, turns: int) -> int:
    return 0 if low is None else int(high) - int(low) + 1 - turns


def _picked(segments: DataFrame) -> DataFrame:
    """For each open segment the states that the cheapest edits of its conversation lead from and to, and with the last one
    the conversation's figures. Summaries go by in order; of each segment only four bytes and its number are held."""
    ways = F.transform("ways", lambda w: F.struct(w["start"], w["state"], w["cost"], w["place"]))
    few = _by_conversation(segments.select("conv_id", "part", "seq", "low", "high", "first", "last", *_FACTS, ways.alias("ways")))
    arrow = _arrow(_PICKED)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, costs = None, {}

        def close() -> Iterator[dict]:
            state, more, cost = ending(costs, order)
            out = []
            for n in range(len(places) - 1, -1, -1):
                start = back[4 * n + state]
                out.append({"part": places[n][0], "seq": places[n][1], "start": start, "state": state, "more": 0, "final": False})
                state = start
            out[0] |= {"more": more, "final": True, "cost": cost, "gaps": _gaps(low, high, facts["turns"]), **{k: facts[k] for k in ("blank", "duplicate", "truncated", "illegal")}}
            return reversed(out)

        for batch in batches:
            for row in batch.to_pylist():
                if not costs or row["conv_id"] != at:
                    if costs:
                        yield from close()
                    at, costs, order, back, places = row["conv_id"], {EMPTY: 0}, {EMPTY: 0}, bytearray(), []
                    facts, low, high, last = dict.fromkeys(_FACTS, 0), None, None, None
                found: dict[int, tuple] = {}
                for way in row["ways"]:
                    start, state, cost, place = way.values()
                    if start in costs:
                        one = (cost + costs[start], order[start], place, start)
                        found[state] = min(found.get(state, one), one)
                costs = {state: x[0] for state, x in found.items()}
                ranks = sorted(x[1:3] for x in found.values())
                order = {state: ranks.index(x[1:3]) for state, x in found.items()}
                back += bytes(found[s][3] if s in found else 0 for s in range(4))
                places.append((row["part"], row["seq"]))
                for k in _FACTS:
                    facts[k] += row[k]
                if row["rows"]:
                    facts["illegal"] += last is not None and last + row["first"] not in _FOLLOWS
                    last = row["last"]
                if row["low"] is not None:
                    facts["turns"] -= row["low"] == high
                    low, high = row["low"] if low is None else low, row["high"]
        if costs:
            yield from close()

    return stored(few.mapInArrow(lambda batches: _batches(fold(batches), arrow, lambda row: 100), _PICKED), "conv-picked")


def repair(rows: DataFrame, every: DataFrame | None = None, config: RepairConfig = RepairConfig()) -> DataFrame:
    """Blocks of repaired conversations: ``(conv_id, part, seq, whole, final, audit, lines, cost, gaps, blank, duplicate, truncated, illegal)``,
    in the order of ``part`` and ``seq``; the figures are in a conversation's last block (``final``), and ``whole`` says that it is the only one.

    ``rows (conv_id, turn, role, text)`` in any order; a conversation's are taken by turn, nulls first, rows of one turn by
    role, the text's first 64 characters and its digest. A null role or text is one space; a null id is an id like others. A row's first fault counts: blank, duplicate (role
    and text seen before in the conversation), truncated (does not end in ``.!?``). Edits keep a row, change its role to user or assistant (1),
    delete it (2; blank and duplicate rows must go) or insert an empty one (5); a truncated row that stays costs 5. ``audit`` has the
    cheapest edits' letters K, R, D, I, ASCII-least of equals, after which the roles' initials read ``(s?(ua)+)?``. An empty
    role has no initial and cannot be kept. Conversations of ``every`` (default: of ``rows``) without rows have an empty audit.
    Empty tables give no rows; other columns are ignored.

    Rows are sorted over partitions, so that a long conversation lies in many segments. Each runs the program from all four states;
    as no segment's edits end in an inserted row, none is a prefix of another of the same rows, and the cheapest
    and least edits of a conversation follow from costs and orders of its segments alone.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    found = _segments(_in_order(rows, rows if every is None else every), config)
    gaps = F.coalesce(F.col("high").cast("long") - F.col("low").cast("long") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    figures = ["blank", "duplicate", "truncated", "illegal"]
    whole = found.filter("whole").select("conv_id", "part", "seq", "whole", F.lit(True).alias("final"), "audit", "lines", "cost", gaps, *figures)
    open_ones = found.filter("not whole")
    picked = _picked(open_ones)
    met = open_ones.select("conv_id", "part", "seq", "lines", "ways").join(picked, ["part", "seq"])
    way = F.filter("ways", lambda w: (w["start"] == F.col("start")) & (w["state"] == F.col("state")))[0]["audit"]
    met = met.select("conv_id", "part", "seq", "final", F.concat(way, F.repeat(F.lit(INSERT), F.col("more"))).alias("audit"), "lines", "start", "cost", "gaps", *figures)
    schema = f"conv_id {found.schema['conv_id'].dataType.simpleString()}, part long, seq long, final boolean, audit string, {_LINES}, cost long, gaps long, `blank` long, duplicate long, truncated long, illegal long"
    arrow = _arrow(schema)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                yield row | {"lines": repaired(row["audit"], [(x["role"], x["text"]) for x in row["lines"]], row.pop("start"))}

    apart = met.mapInArrow(lambda batches: _batches(edit(batches), arrow, lambda row: sum(len(r) + len(t) for r, t in row["lines"])), schema)
    return whole.unionByName(apart.withColumn("whole", F.lit(False)))


def _text(line: Column) -> Column:
    return F.concat(line["role"], F.lit(":"), line["text"])


def audit_report(blocks: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of ``repair``'s blocks.

    A digest follows a conversation's lines one by one, so the blocks of a long conversation go through one task, as a stream of which no
    more than a batch is held; conversations of one block, nearly all, are digested where they are.
    """
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    joined = F.array_join(F.transform("lines", _text), "\n")
    single = blocks.filter("whole").withColumn("repaired_sha256", F.sha2(joined, 256)).select(*names)
    rest = blocks.filter("not whole").select(*names[:-1], "part", "seq", "final", F.size("lines").alias("many"), joined.alias("joined"))
    schema = ", ".join(f"`{c}` {single.schema[c].dataType.simpleString()}" for c in names)
    arrow = _arrow(schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        audits, sha, empty = [], hashlib.sha256(), True
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                audits.append(row["audit"])
                if row["many"]:
                    sha.update(b"" if empty else b"\n")
                    sha.update(row["joined"].encode())
                    empty = False
                if row["final"]:
                    yield {c: row[c] for c in names[:-2]} | {"audit": "".join(audits), "repaired_sha256": sha.hexdigest()}
                    audits, sha, empty = [], hashlib.sha256(), True

    return single.unionByName(_by_conversation(rest).mapInArrow(lambda batches: _batches(digest(batches), arrow, lambda row: len(row["audit"])), schema))
