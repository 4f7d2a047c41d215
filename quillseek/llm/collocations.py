"""Phrase collocations: n-grams counted in quotient filters, scored exactly, the best of each language listed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillseek.llm.common import NARROW, stored
from quillseek.llm.quotient import Entries, Layout, counted, decode, encode, merged, sliced
from quillseek.llm.tokens import parts
from quillseek.operators.joins import broadcast_if_small, split_join


@dataclass(frozen=True)
class CollocationConfig:
    """Phrases of two and three words with ``least`` occurrences; a phrase goes if a longer one holds it in
    ``inside`` of a hundred of its occurrences or more; the ``first`` of each language stay. ``task_entries``: what a
    task counts before it sends its filters; ``bucket_entries``: occurrences that meet in one bucket, about."""

    least: int = 10
    inside: int = 50
    first: int = 2000
    text_bytes: int = 8 << 20
    task_entries: int = 3 << 20
    bucket_entries: int = 4 << 20


# A-Z in lower case, a tab counts as a space, and what ends a piece becomes a line feed.
_SAME = bytes(range(256))
_TABLE = _SAME.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n"))
_SPACE, _BREAK = 0x20, 0x0A

_PARTS = "place long, lang string, tokens long, codes binary, code int, word binary, count long"
_PARTS_SCHEMA = pa.schema(
    [("place", pa.int64()), ("lang", pa.string()), ("tokens", pa.int64()), ("codes", pa.binary()), ("code", pa.int32()), ("word", pa.binary()), ("count", pa.int64())]
)


def words_of(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """All words of translated text, and the number of the piece that each lies in."""
    data = np.frombuffer(text, dtype=np.uint8)
    inner = (data != _SPACE) & (data != _BREAK)
    starts = np.flatnonzero(inner & ~np.concatenate(([False], inner[:-1])))
    pieces = np.cumsum(data == _BREAK)[starts]
    ends = np.flatnonzero(inner & ~np.concatenate((inner[1:], [False]))) + 1
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[inner].tobytes())]), pieces


def _cut(text: bytes, size: int) -> Iterator[bytes]:
    """The text in stretches of about ``size`` bytes, parted where pieces end."""
    begin = 0
    while begin < len(text):
        end = text.find(b"\n", begin + size)
        end = len(text) if end < 0 else end + 1
        yield text[begin:end]
        begin = end


def _coded(config: CollocationConfig):
    """Batches ``(lang, text)`` as stretches of one language: a row with its words as numbers (0: a piece ends), and
    a row for each distinct word."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        place = TaskContext.get().partitionId() << 32
        for batch in (part for batch in batches for part in parts(batch, 1, config.text_bytes)):
            langs = batch.column(0).to_pylist()
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(langs, batch.column(1).cast(pa.binary()).to_pylist()):
                texts.setdefault(lang, []).append((text or b"").translate(_TABLE))
            for lang, some in texts.items():
                for stretch in _cut(b"\n".join(some), config.text_bytes):
                    words, pieces = words_of(stretch)
                    coded = words.dictionary_encode()
                    many = len(coded.dictionary)
                    codes = coded.indices.to_numpy().astype(np.int64)
                    counts = np.bincount(codes, minlength=many)
                    at = np.arange(len(codes)) + (np.cumsum(np.diff(pieces, prepend=pieces[:1]) > 0) if len(pieces) else 0)
                    line = np.zeros(int(at[-1]) + 1 if len(at) else 0, dtype="<u4")
                    line[at] = codes + 1
                    planes = np.ascontiguousarray(line.view(np.uint8).reshape(-1, 4).T).tobytes()
                    rows = many + 1
                    first = lambda value, kind: pa.concat_arrays([pa.array([value], kind), pa.nulls(many, kind)])
                    after = lambda values, kind: pa.concat_arrays([pa.nulls(1, kind), values.cast(kind)])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(rows, place)), pa.array([lang] * rows, pa.string()), first(len(codes), pa.int64()), first(press.compress(planes), pa.binary()),
                            after(pa.array(np.arange(1, rows)), pa.int32()), after(coded.dictionary, pa.binary()), after(pa.array(counts), pa.int64()),
                        ],
                        schema=_PARTS_SCHEMA,
                    )
                    place += 1

    return code


_AT_ONCE = 1 << 18  # words whose phrases are held at once


def _grams(line: np.ndarray, ids: np.ndarray, start: int = 0, many: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the words of all phrases of two words (the third is 0) and of three that begin at ``many`` places from ``start``."""
    many = len(line) if many is None else many
    word = ids[line[start : start + many + 2]]
    x, y = word[:-1], word[1:]
    two = (x > 0) & (y > 0)
    three = two[:-1] & (word[2:] > 0)
    two[many:] = False  # begins behind these places
    third = word[2:][three]
    return np.concatenate([x[two], x[:-1][three]]), np.concatenate([y[two], y[:-1][three]]), np.concatenate([np.zeros(two.sum(), dtype=word.dtype), third])


def _line(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).reshape(-1).view("<u4")


def phrase_counts(coded: DataFrame, id_bits: int, occurrences: int, config: CollocationConfig) -> DataFrame:
    """``(w1, w2, w3, a)`` of all phrases with ``least`` occurrences or more, of rows ``(codes, pairs)`` in which
    ``pairs`` give the ids of the words' numbers (none: the word is in no such phrase).

    Each task keeps sorted filters and sends them cut by the first bits of the permuted keys: as keys are spread evenly and a key
    is sent once by a filter, no bucket is hot. A bucket merges its filters.
    """
    layout = Layout(id_bits)
    half, least, most = layout.half, config.least, config.task_entries
    prefix = min(half, max(0, -(-occurrences // config.bucket_entries) - 1).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Entries] = []

        def send() -> pa.RecordBatch:
            cut = sliced(merged(held, half), half, prefix)
            return pa.RecordBatch.from_arrays([pa.array([at for at, _ in cut], pa.int64()), pa.array([encode(e, half, prefix) for _, e in cut], pa.binary())], names=["bucket", "filter"])

        for batch in batches:
            for n in range(batch.num_rows):
                line = _line(batch.column(0)[n].as_py())
                pairs = batch.column(1)[n].values
                ids = np.zeros(int(line.max(initial=0)) + 1, dtype=np.int64)
                ids[pairs.field(0).to_numpy(zero_copy_only=False)] = pairs.field(1).to_numpy(zero_copy_only=False)
                for start in range(0, len(line), _AT_ONCE):
                    held.append(counted(*layout.pack(*_grams(line, ids, start, _AT_ONCE)), None, half))
                    if sum(map(len, held)) > most:
                        held.append(merged(held, half))
                    if len(held[-1]) > most // 2:
                        yield send()
        if held:
            yield send()

    def merge(table: pa.Table) -> pa.Table:
        at = table["bucket"][0].as_py()
        whole = merged([decode(x.as_py(), half, prefix, at) for x in table["filter"]], half)
        keep = whole.counts >= least
        w1, w2, w3 = layout.unpack(whole.high[keep], whole.low[keep])
        return pa.table({"w1": w1, "w2": w2, "w3": w3, "a": whole.counts[keep]})

    filters = coded.mapInArrow(count, "bucket long, filter binary")
    return filters.groupBy("bucket").applyInArrow(merge, "w1 long, w2 long, w3 long, a long")


def _numbered(words: DataFrame) -> DataFrame:
    """With dense ids from 1: a file's rows are numbered on from those of the files before."""
    placed = stored(words.withColumn("mid", F.monotonically_increasing_id()), "phrase-words")
    part, row = F.shiftrightunsigned("mid", 33), F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("file")).agg((F.max(row) + 1).alias("rows"))
    before = counts.withColumn("before", F.sum("rows").over(Window.orderBy("file")) - F.col("rows"))  # a row for each file
    joined = placed.withColumn("file", part).join(broadcast_if_small(before.select("file", "before"), NARROW), "file")
    return stored(joined.select((F.col("before") + row + 1).alias("id"), "lang", "word", "f"), "phrase-ids")


def _with(rows: DataFrame, counts: DataFrame, keys: dict[str, str], value: str, how: str = "inner") -> DataFrame:
    """Joined by equality with renamed columns of ``counts``; hot keys of ``rows`` are met apart."""
    right = counts.select(*(F.col(k).alias(v) for k, v in keys.items()), F.col("a" if "a" in counts.columns else "f").alias(value))
    return split_join(rows, right, list(keys.values()), how, NARROW)


def _score(l: str, r: str) -> Column:
    """floor(1000000 * a * a / (l * r)) in whole numbers of 38 digits."""
    return F.expr(f"(1000000 * cast(a as decimal(19, 0)) * cast(a as decimal(19, 0))) div (cast({l} as decimal(19, 0)) * cast({r} as decimal(19, 0)))")


def scored(cands: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates ``(w1, w2, w3, a)`` with ``l``, ``r`` and ``score`` of the cut that scores lowest, the earlier of equals."""
    freq = words.select("id", "f")
    two, three = cands.filter("w3 = 0"), cands.filter("w3 > 0")
    pairs = _with(_with(two, freq, {"id": "w1"}, "l"), freq, {"id": "w2"}, "r").withColumn("score", _score("l", "r"))
    rows = _with(_with(three, freq, {"id": "w1"}, "l1"), freq, {"id": "w3"}, "r2")
    rows = _with(_with(rows, two, {"w1": "w1", "w2": "w2"}, "l2"), two, {"w1": "w2", "w2": "w3"}, "r1")
    rows = rows.withColumn("one", _score("l1", "r1")).withColumn("two", _score("l2", "r2"))
    late = F.col("two") < F.col("one")
    pick = lambda a, b: F.when(late, F.col(b)).otherwise(F.col(a))
    triples = rows.select("w1", "w2", "w3", "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("one", "two").alias("score"))
    return pairs.select(triples.columns).unionByName(triples)


def _high_scores(rows: DataFrame, first: int) -> DataFrame:
    """Without the rows whose score is below that of ``first`` others of their language, by a count of a thousand ranges of
    scores: so few rows meet where they are ranked."""
    band = F.expr("score div 1000").alias("band")
    counts = rows.groupBy("lang", band).agg(F.count(F.lit(1)).alias("rows"))
    bands = F.reverse(F.array_sort(F.collect_list(F.struct("band", "rows"))))
    cut = F.aggregate(
        bands, F.struct(F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("band")),
        lambda done, one: F.when(done["rows"] >= first, done).otherwise(F.struct((done["rows"] + one["rows"]).alias("rows"), one["band"].alias("band"))),
    )
    cuts = stored(counts.groupBy("lang").agg(cut["band"].alias("cut")), "phrase-cuts")
    return rows.join(broadcast_if_small(cuts, NARROW), "lang").filter(F.col("score") >= 1000 * F.col("cut")).drop("cut")


def collocations(docs: DataFrame, config: CollocationConfig = CollocationConfig()) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``first`` phrases of two or three words by score, then
    occurrences, then phrase in byte order.

    A-Z is lower-cased; ``[.,;:!?]``, line feeds, vertical tabs, form feeds and carriage returns part pieces, spaces and tabs words. A null text is
    empty, a null language is ``und``. ``n`` counts a language's words, ``a`` a phrase, ``l`` and ``r`` what lies left and right of
    the cut that scores lowest, ``floor(1000000 a a / (l r))``. Repeated rows count each. Languages without phrases give no rows, as does
    an empty table; other columns are ignored.

    Texts become numbers of their stretch's distinct words; only distinct words meet the vocabulary. Words below
    ``least`` are in no candidate and count as gaps. Phrases are counted by ``phrase_counts``.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    coded = stored(rows.mapInArrow(_coded(config), _PARTS), "phrase-parts")
    found = coded.filter("word is not null").groupBy("lang", "word").agg(F.sum("count").alias("f")).filter(F.col("f") >= config.least)
    words = _numbered(found)
    totals = coded.filter("codes is not null").groupBy("lang").agg(F.sum("tokens").alias("n"))
    size = words.agg(F.max("id")).first()[0] or 0
    every = totals.agg(F.sum("n")).first()[0] or 0
    ids = coded.filter("word is not null").select("place", "code", "lang", "word").join(words.select("lang", "word", "id"), ["lang", "word"])
    pairs = ids.groupBy("place").agg(F.collect_list(F.struct("code", "id")).alias("pairs"))  # the distinct words of a stretch
    met = coded.filter("codes is not null").select("place", "codes").join(pairs, "place").select("codes", "pairs")
    cands = stored(phrase_counts(met, max(2, int(size).bit_length()), 2 * every, config), "phrase-cands")

    longer = cands.filter("w3 > 0")
    holds = longer.select("w1", "w2", "a").unionByName(longer.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    held = holds.groupBy("w1", "w2").agg(F.max("a").alias("longest")).withColumn("w3", F.lit(0).cast("long"))
    rows = stored(scored(cands, words), "phrase-scored").join(held, ["w1", "w2", "w3"], "left")
    rows = rows.filter(F.col("longest").isNull() | (100 * F.col("longest") < config.inside * F.col("a"))).drop("longest")
    # Ranked first without the phrases: all ties of the last place stay, and only what can be listed is spelled out.
    named = split_join(rows, words.select(F.col("id").alias("w1"), "lang"), ["w1"], "inner", NARROW)
    named = _high_scores(stored(named, "phrase-langs"), config.first)
    tied = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    named = stored(named.withColumn("place", F.rank().over(tied)).filter(F.col("place") <= config.first).drop("place"), "phrase-best")
    for w in ("w1", "w2", "w3"):
        spelled = words.select(F.col("id").alias(w), F.col("word").cast("string").alias(f"{w}_word"))
        named = split_join(named, spelled, [w], "left", NARROW)
    phrase = F.concat_ws(" ", "w1_word", "w2_word", "w3_word").alias("phrase")
    named = named.select("lang", phrase, "a", "l", "r", "score").join(broadcast_if_small(totals, NARROW), "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= config.first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
