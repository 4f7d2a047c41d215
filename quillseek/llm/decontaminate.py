"""Benchmark decontamination: template windows of documents and benchmark items meet by hash."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillseek.llm.common import LIMITS, stored
from quillseek.llm.tokens import coded_words, parts
from quillseek.operators.joins import split_join

_PART_BYTES = 4 << 20  # of text whose windows are held at once
_FILTER_BITS = 23  # of the map of window hashes that occur in the benchmark: 1 MB whatever its size

# Words that are units after a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg oz lb lbs pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days "
    "week weeks month months year years hz khz mhz ghz v volt volts w kw watt watts j kj cal kcal k c f degree "
    "degrees percent % $ usd eur euro euros dollar dollars cent cents kb mb gb tb mph kmh".split()
)
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(?:st|nd|rd|th)?%?")
_EDGES = "!\"#&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„‘’…–—"
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_WORD, _NUM, _UNIT = 0, 1, 2
_PLACE = {_NUM: 0x1D8E4E27C47D124F, _UNIT: 0x2545F4914F6CDD1D, "name": 0x369DEA0F31A53F85}


@dataclass(frozen=True)
class LeakConfig:
    """``words`` of a window, and the share of an item's windows (and of its slots) that makes a leak."""

    words: int = 5
    share: float = 0.8


WINDOWS = "row long, place int, window long, forms int, slots array<string>, total int"
PLAIN, NARROW, WIDE = 1, 2, 4  # forms that a window stands for; wide templates take a sentence's first word too


def _facts(word: str) -> tuple[str, int, bool, bool]:
    """Normal form, kind, whether it is capitalised, whether a sentence ends after it."""
    core = word.strip(_EDGES)
    if not core:
        return ("", _WORD, False, word[-1:] in ".!?")
    low = core.lower()
    kind = _NUM if _NUMBER.fullmatch(core) else _UNIT if low in UNITS else _WORD
    return (low, kind, core[0].isupper() and not core.isupper(), word[-1:] in ".!?:")


def window_batches(words: int, keep: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches ``(row, text)``: every window of a text and, where it has slots, its templates. In the
    narrow template a capitalised first word of a sentence stays, in the wide one it is a placeholder.

    A text of fewer words is one window. ``keep`` are the low bits of hashes that can match (None: all).
    """
    mask = np.uint64((1 << _FILTER_BITS) - 1)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in parts(batch, 1, _PART_BYTES)):
            distinct, codes, offsets = coded_words(batch.column(1), lower=False)
            facts = [_facts(word) for word in distinct]
            forms = [form for form, *_ in facts]
            real = np.array([bool(form) for form in forms], dtype=bool)
            keys = np.array([xxhash.xxh64_intdigest(form) for form in forms], dtype=np.uint64)
            kinds = np.array([kind for _, kind, _, _ in facts], dtype=np.int8)
            capital = np.array([cap for _, _, cap, _ in facts], dtype=bool)
            ends = np.array([end for *_, end in facts], dtype=bool)
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            if len(codes) == 0:
                continue
            # Whether a capital marks a name is not known where a sentence begins.
            after_end = np.ones(len(codes), dtype=bool)
            after_end[1:] = ends[codes[:-1]] | (owner[1:] != owner[:-1])
            kept = real[codes]
            after_end, owner, codes = after_end[kept], owner[kept], codes[kept]
            n = len(codes)
            if n == 0:
                continue
            first = np.searchsorted(owner, np.arange(len(offsets)))
            kind = kinds[codes]
            follows = np.zeros(n, dtype=bool)
            follows[1:] = (kind[:-1] == _NUM) & (owner[1:] == owner[:-1])
            number, unit = kind == _NUM, (kind == _UNIT) & follows
            capitals = capital[codes] & ~number & ~unit
            name = capitals & ~after_end
            plain = keys[codes]
            narrow = plain.copy()
            narrow[number], narrow[unit], narrow[name] = _PLACE[_NUM], _PLACE[_UNIT], _PLACE["name"]
            wide = np.where(capitals, np.uint64(_PLACE["name"]), narrow)
            slots_of = {NARROW: number | unit | name, WIDE: number | unit | capitals}
            length = first[owner + 1] - np.arange(n)  # words left in the text
            whole = first[owner + 1] - first[owner]
            starts = np.flatnonzero((length >= words) | ((whole < words) & (length == whole)))
            hashed = []
            with np.errstate(over="ignore"):
                for form in (plain, narrow, wide):
                    total = np.zeros(len(starts), dtype=np.uint64)
                    for k in range(words):
                        at = np.minimum(starts + k, n - 1)
                        term = (form[at] ^ np.uint64(k)) * np.uint64(_ODD[k % len(_ODD)])
                        term ^= term >> np.uint64(31)
                        total = total * np.uint64(0x100000001B3) + np.where(k < length[starts], term, np.uint64(0))
                    total ^= total >> np.uint64(29)
                    hashed.append(total * np.uint64(_ODD[0]))
            last = np.minimum(starts + words, first[owner[starts] + 1])
            sums = {form: np.concatenate(([0], np.cumsum(slot))) for form, slot in slots_of.items()}
            held = {form: total[last] - total[starts] for form, total in sums.items()}
            begins = held[WIDE] > held[NARROW]
            # A template that equals a form before it is no row of its own.
            forms_of = {
                PLAIN: PLAIN + NARROW * (held[NARROW] == 0) + WIDE * (held[WIDE] == 0),
                NARROW: NARROW + WIDE * ~begins,
                WIDE: np.full(len(starts), WIDE),
            }
            chosen_of = {PLAIN: np.ones(len(starts), dtype=bool), NARROW: held[NARROW] > 0, WIDE: begins}
            rows = batch.column(0)
            count = np.maximum(1, np.diff(first) - words + 1)
            out = []
            for form, hashes in zip((PLAIN, NARROW, WIDE), hashed):
                chosen = chosen_of[form]
                if keep is not None:
                    low = (hashes & mask).astype(np.int64)
                    chosen = chosen & ((keep[low >> 3] >> (low & 7)) & 1).astype(bool)
                hit = np.flatnonzero(chosen)
                if len(hit) == 0:
                    continue
                at = starts[hit]
                slots: list[list[str] | None] = [None] * len(hit)
                if form != PLAIN:
                    slot = slots_of[form]
                    slots = [[forms[codes[j]] for j in range(i, min(i + words, first[owner[i] + 1])) if slot[j]] for i in at]
                out.append(
                    pa.RecordBatch.from_arrays(
                        [
                            rows.take(pa.array(owner[at])).cast(pa.int64()),
                            pa.array((at - first[owner[at]]).astype(np.int32)),
                            pa.array(hashes[hit].view(np.int64)),
                            pa.array(forms_of[form][hit].astype(np.int32)),
                            pa.array(slots, type=pa.list_(pa.string())),
                            pa.array(count[owner[at]].astype(np.int32)),
                        ],
                        names=["row", "place", "window", "forms", "slots", "total"],
                    )
                )
            yield from out

    return windows


def _filter_map(items: DataFrame) -> np.ndarray:
    """One bit for each hash's low bits that occurs: at most 256 rows of 4 KB reach the driver."""
    place = F.col("window").bitwiseAND(F.lit((1 << _FILTER_BITS) - 1)) + 1
    rows = (
        items.select(place.alias("n"))
        .groupBy(F.bitmap_bucket_number("n").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))
        .collect()
    )
    whole = np.zeros(1 << (_FILTER_BITS - 3), dtype=np.uint8)
    for row in rows:
        start = (row["bucket"] - 1) * 4096
        whole[start : start + 4096] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return whole


def _entry(kind: str, key: Column, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"))


def _known(*ids: str) -> Column:
    """Ids as a key in which null equals null."""
    return F.struct(*(part for n in ids for part in (F.coalesce(n, F.lit(0)).alias(n), F.col(n).isNull().alias(f"no_{n}"))))


def _judged(met: DataFrame, keys: list[str], share: float) -> DataFrame:
    """For each of ``keys``, how many windows and slots of the item were ``met``, and how many slots always
    stand for one value. Of the two templates the narrow one counts, unless only the wide one has ``share``."""
    place = F.col("place").cast("string")
    pairs = F.coalesce(F.arrays_zip(F.col("slots").alias("own"), F.col("values").alias("other")), F.array())
    stands = lambda form: F.col("forms").bitwiseAND(F.lit(form)) != 0
    parts = [F.when(stands(PLAIN), F.array(_entry("plain", place, F.lit(""))))]
    for form, name in ((NARROW, "narrow"), (WIDE, "wide")):
        kind = f"{name} slot"
        slots = F.transform(pairs, lambda p: _entry(kind, p["own"], p["other"]))  # noqa: B023
        parts.append(F.when(stands(form), F.concat(F.array(_entry(name, place, F.lit(""))), slots)))
    entries = F.flatten(F.array_compact(F.array(*parts)))
    told = met.select(*keys, "total", F.explode(entries).alias("entry")).select(*keys, "total", "entry.*")
    each = told.groupBy(*keys, "kind", "key").agg(
        F.max("total").alias("total"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    one = lambda kind, also=F.lit(True): F.sum(F.when((F.col("kind") == kind) & also, 1).otherwise(0)).cast("int")
    forms = [
        F.struct(
            one(name).alias("template"),
            one(f"{name} slot").alias("slots"),
            one(f"{name} slot", F.col("low") == F.col("high")).alias("consistent"),
        ).alias(name)
        for name in ("narrow", "wide")
    ]
    counted = each.groupBy(*keys).agg(F.max("total").alias("windows"), one("plain").alias("verbatim"), *forms)
    enough = lambda n, of: F.col(n) >= F.col(of) * share
    wider = enough("wide.template", "windows") & (
        ~enough("narrow.template", "windows") | (~enough("narrow.consistent", "narrow.slots") & enough("wide.consistent", "wide.slots"))
    )
    best = F.when(wider, F.col("wide")).otherwise(F.col("narrow")).alias("best")
    return counted.select(*keys, "windows", "verbatim", best).select(*keys, "windows", "verbatim", "best.*")


def leaks(docs: DataFrame, benchmark: DataFrame, config: LeakConfig = LeakConfig()) -> DataFrame:
    """``(doc_id, item_id, windows, verbatim, template, slots, consistent, kind)``: items that documents hold.

    Words are lower-cased without punctuation at their ends. In templates, numbers, units after numbers
    and capitalised words within a sentence are placeholders; in a second, wider form a sentence's first word
    is one too if it is capitalised, and either form will do. An item leaks as ``verbatim`` if 0.8 of its
    windows of five words occur in the document, or as ``template`` if 0.8 do as templates and 0.8 of its
    slot values always stand for one value, in the whole document or in one alignment of it: the places at
    which one copy of the item would lie, so that other copies and chance matches do not count. Items of fewer words are one window; items
    and documents without words match nothing. Rows of one id count as one document or item; null ids
    too. Empty tables give an empty result.

    Documents are read once; only windows whose hash can be in the benchmark leave that pass, and meet
    its windows by an equality join of any size.
    """
    asked = benchmark.select(F.col("item_id").cast("long"), "text")
    items = stored(asked.mapInArrow(window_batches(config.words, None), WINDOWS), "leak-items")
    found = docs.select(F.col("doc_id").cast("long"), "text")
    hits = found.mapInArrow(window_batches(config.words, _filter_map(items)), WINDOWS)
    hits = stored(hits.select(F.col("row").alias("doc_id"), F.col("place").alias("at"), "window", F.col("slots").alias("values")), "leak-hits")
    windows = items.select(F.col("row").alias("item_id"), "place", "window", "forms", "slots", "total")
    windows = stored(windows.distinct(), "leak-windows")
    verbatim = F.col("verbatim") >= F.col("windows") * config.share
    template = F.col("template") >= F.col("windows") * config.share
    consistent = F.col("consistent") >= F.col("slots") * config.share
    met = split_join(hits.select("doc_id", "window", "values").distinct(), windows, ["window"], "inner", LIMITS)
    judged = stored(_judged(met, ["doc_id", "item_id"], config.share), "leak-judged")
    sure = judged.withColumn("kind", F.when(verbatim, "verbatim").when(template & consistent, "template")).filter("kind is not null")
    # Where only the slots disagree, more copies than one may be the reason.
    unsure = judged.filter(~verbatim & template & ~consistent)
    unsure = stored(unsure.select(_known("doc_id").alias("doc"), _known("doc_id", "item_id").alias("pair"), F.col("verbatim").alias("whole")), "leak-unsure")
    some = stored(unsure.select("doc").distinct(), "leak-unsure-docs")
    again = split_join(hits.withColumn("doc", _known("doc_id")), some, ["doc"], "left_semi", LIMITS).drop("doc")
    again = split_join(again, windows, ["window"], "inner", LIMITS).withColumn("pair", _known("doc_id", "item_id"))
    again = split_join(again, unsure.select("pair", "whole"), ["pair"], "inner", LIMITS).drop("pair")
    shift, width = F.col("at") - F.col("place"), F.greatest(F.lit(1), F.floor((F.col("total") + config.words - 1) / 2)).cast("int")
    grid = lambda n, move: F.struct(F.lit(n).alias("grid"), F.floor((shift + move) / width).cast("int").alias("cell"))
    exact = F.struct(F.lit(0).alias("grid"), shift.alias("cell"))
    alignments = F.array(exact, grid(1, F.lit(0)), grid(2, F.floor(width / 2)))
    again = again.withColumn("alignment", F.explode(alignments))
    aligned = _judged(again, ["doc_id", "item_id", "whole", "alignment"], config.share).filter(template & consistent)
    best = aligned.groupBy("doc_id", "item_id", "whole").agg(
        F.max_by(F.struct("windows", "template", "slots", "consistent"), F.struct("template", "consistent", "alignment")).alias("best")
    )
    found = best.select("doc_id", "item_id", "best.windows", F.col("whole").alias("verbatim"), "best.template", "best.slots", "best.consistent", F.lit("template").alias("kind"))
    return sure.unionByName(found)
