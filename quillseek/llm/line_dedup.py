"""Line dedup: drops lines within one edit of an earlier line, by equality of hashed deletion variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillseek.functions.text import let
from quillseek.llm.common import LIMITS, stored
from quillseek.operators.joins import broadcast_if_small, split_join, unnest

_FINE = 16  # blocks of a line in the second of the two passes that come before single characters
_OWN, _LONG = 0, 1  # a line as it is; a line as the longer of a pair that differs by one character


def lines_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, line, id)`` of every line that is not blank; the id is the line's 128-bit digest."""
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    lines = unnest(docs, ["doc_id"], parts, "line", pos=True).withColumnRenamed("pos", "line_no")
    return lines.filter(F.trim("line") != "").withColumn("id", F.unhex(F.md5("line")))


def _block(line: Column, length: Column, j: Column, blocks: int, shift: int = 0, more: int = 0) -> Column:
    """Block ``j`` of a line cut for ``length`` characters, moved by ``shift`` and longer by ``more``."""
    start, end = F.floor(length * j / blocks), F.floor(length * (j + 1) / blocks)
    return line.substr((start + (shift + 1)).cast("int"), (end - start + more).cast("int"))


def half_keys(line: Column) -> Column:
    """``block_keys`` of two blocks, written out: half a line's hash with its length and place."""
    length = F.length(line)

    def keys(role: int, base: Column, shift: int) -> list[Column]:
        middle = F.floor(base / 2).cast("int")
        left, right = line.substr(F.lit(1), middle), line.substr(middle + (1 + shift), (base - middle).cast("int"))
        made = (F.xxhash64(base, F.lit(0), right), F.xxhash64(base, F.lit(1), left))
        return [F.struct(F.lit(role).alias("role"), key.alias("key")) for key in made]

    return F.array(*keys(_OWN, length, 0), *keys(_LONG, length - 1, 1))


def block_keys(line: Column, blocks: int) -> Column:
    """Deletion variants of whole blocks: ``(role, key, piece)`` for each block that is left out.

    If two lines are one edit apart, all blocks but one agree, where the longer line's blocks after the
    edit are read one character later. Both lines then have an equal key, one of them perhaps as the
    longer. ``piece`` is the text that was left out, in which the edit must be.
    """
    at = F.sequence(F.lit(0), F.lit(blocks - 1))

    def keys(role: int, base: Column, shift: int) -> Column:
        def hashes(shift: int) -> Column:
            return F.transform(at, lambda j: F.xxhash64(_block(line, base, j, blocks, shift)))

        def made(before: Column, after: Column) -> Column:
            return F.transform(
                at,
                lambda j: F.struct(
                    F.lit(role).alias("role"),
                    F.xxhash64(base, j, F.concat(F.slice(before, 1, j), F.slice(after, j + 2, blocks))).alias("key"),
                    _block(line, base, j, blocks, 0, shift).alias("piece"),
                ),
            )

        if not shift:
            return let(hashes(0), lambda h: made(h, h))
        both = F.struct(hashes(0).alias("before"), hashes(shift).alias("after"))
        return let(both, lambda h: made(h["before"], h["after"]))

    return F.concat(keys(_OWN, F.length(line), 0), keys(_LONG, F.length(line) - 1, 1))


def _met(keyed: DataFrame, label: str) -> DataFrame:
    """The rows whose key two different lines have, one of them in its own length."""
    keyed = stored(keyed, label)
    shared = (
        keyed.groupBy("key")
        .agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min("role").alias("role"))
        .filter((F.col("a") != F.col("b")) & (F.col("role") == _OWN))
        .select("key")
    )
    return split_join(keyed, stored(shared, label), ["key"], "left_semi", LIMITS)


def _variants(met: DataFrame) -> DataFrame:
    """Deletion variants of single characters within the block in which the edit must be.

    Lines of one length share ``(variant, place)`` exactly if they differ at that place alone, so such a
    group needs no pairs: all its lines are one edit from its earliest. A longer line's variant meets the
    shorter line itself.
    """
    piece, key = F.col("piece"), F.col("key")
    cut = lambda i: F.concat(piece.substr(F.lit(1), i), piece.substr(i + 2, F.length(piece)))
    places = F.when(F.length(piece) > 0, F.sequence(F.lit(0), F.length(piece) - 1)).otherwise(F.array().cast("array<int>"))
    changed = F.transform(places, lambda i: F.struct(F.lit(2).alias("kind"), F.xxhash64(key, F.lit("change"), i, cut(i)).alias("variant")))
    whole = F.array(F.struct(F.lit(_OWN).alias("kind"), F.xxhash64(key, F.lit("whole"), piece).alias("variant")))
    longer = F.array_distinct(
        F.transform(places, lambda i: F.struct(F.lit(_LONG).alias("kind"), F.xxhash64(key, F.lit("whole"), cut(i)).alias("variant")))
    )
    made = F.when(F.col("role") == _OWN, F.concat(whole, changed)).otherwise(longer)
    return unnest(met, ["id", "at"], made, "made").select("id", "at", "made.*")


def near_lines(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """``(id, at, kept)`` for every distinct line with an earlier line one edit away; ``kept`` is the earliest.

    ``firsts (id, at, halves)``: distinct lines with their first place and coarse keys.
    """
    coarse = unnest(firsts, ["id"], F.col("halves"), "half").select("id", "half.*")
    live = stored(_met(coarse, "line-halves").select("id").distinct(), "line-live")
    live = stored(split_join(firsts.select("id", "at"), live, ["id"], "left_semi", LIMITS), "line-live")
    texts = lines.join(broadcast_if_small(live, LIMITS), "id").filter(
        F.col("doc_id").eqNullSafe(F.col("at.doc_id")) & (F.col("line_no") == F.col("at.line_no"))
    )
    texts = stored(texts.select("id", "at", "line").distinct(), "line-texts")
    fine = unnest(texts, ["id", "at"], block_keys(F.col("line"), _FINE), "cut").select("id", "at", "cut.*")
    variants = stored(_variants(_met(fine, "line-blocks")), "line-variants")
    place = F.struct("at", "id")
    best = variants.groupBy("variant").agg(
        F.min(F.when(F.col("kind") != _LONG, place)).alias("own"),
        F.min(F.when(F.col("kind") == _LONG, place)).alias("long"),
        F.count(F.lit(1)).alias("rows"),
    )
    best = stored(best.filter("rows > 1 and own is not null").drop("rows"), "line-best")
    linked = split_join(variants, best, ["variant"], "inner", LIMITS)
    partner = F.when(F.col("kind") == _OWN, F.col("long")).otherwise(F.col("own"))
    linked = linked.select("id", "at", partner.alias("kept")).filter("kept is not null and kept.at < at")
    linked = stored(linked.groupBy("id").agg(F.min("at").alias("at"), F.min("kept").alias("kept")), "line-links")
    ends = linked.select("id").union(linked.select("kept.id")).distinct()
    sides = stored(split_join(texts.select("id", "line"), ends, ["id"], "left_semi", LIMITS), "line-sides")
    both = linked.join(sides, "id").withColumn("other_id", F.col("kept.id"))
    both = both.join(sides.select(F.col("id").alias("other_id"), F.col("line").alias("other")), "other_id")
    return both.filter(F.levenshtein("line", "other", 1) >= 0).select("id", "at", F.col("kept.at").alias("kept"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, kept_doc_id, kept_line_no, distance)`` for every line to drop.

    Order is by document id and line number. A line is dropped if an equal line comes earlier (distance 0,
    kept: its first place), else if an earlier line is one inserted, deleted or changed character away
    (distance 1, kept: the earliest such line, whether or not that one stays). Blank lines always stay.
    Null texts have no lines; a null id counts as the smallest; rows of one id count as one document,
    so a repeated row drops nothing. Lines may be of any length.

    Exact copies are folded first, so that a line in a third of all documents is one row afterwards. Two
    passes over hashes of blocks leave only lines that agree with another in all but one block; only
    these have their characters' variants made, and only within that block.
    """
    lines = lines_of(docs)
    keyed = lines.select("id", F.struct("doc_id", "line_no").alias("at"), half_keys(F.col("line")).alias("halves"))
    firsts = keyed.groupBy("id").agg(F.min("at").alias("at"), F.min("halves").alias("halves"), F.count(F.lit(1)).alias("copies"))
    firsts = stored(firsts, "line-firsts")
    near = near_lines(lines, firsts.select("id", "at", "halves"))
    repeated = stored(firsts.filter("copies > 1").select("id", F.col("at").alias("kept")), "line-repeated")
    again = split_join(lines.select("id", "doc_id", "line_no"), repeated, ["id"], "inner", LIMITS).filter(
        ~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("line_no") == F.col("kept.line_no")))
    )
    exact = again.select("doc_id", "line_no", "kept", F.lit(0).alias("distance")).distinct()
    changed = near.select("at.*", "kept", F.lit(1).alias("distance"))
    return exact.unionByName(changed).select(
        "doc_id", "line_no", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no"), "distance"
    )
