"""Language-model scoring with a hierarchical Pitman-Yor model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillseek.llm.common import fold, stored
from quillseek.llm.tokens import coded_words, parts

_END = xxhash.xxh64_intdigest(b"\n")  # no word holds white space


@dataclass(frozen=True)
class LanguageConfig:
    """A token's context is the word before, or with ``context_bytes`` that word's last bytes only. Customers are seated one
    after another, then come ``sweeps`` of Gibbs sampling, of which the first ``burn_in`` are not averaged. Strengths of the
    context restaurants and of their shared parent; discounts are estimated from counts of counts."""

    sweeps: int = 3
    burn_in: int = 1
    strength: float = 5.0
    root_strength: float = 10.0
    modulus: int = 7
    held_out: int = 2
    seed: int = 42
    context_bytes: int | None = 2


def _bundle(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays of whole numbers as compressed planes of their bytes, no more of them than the largest needs."""
    head, planes = [len(arrays)], []
    for a in arrays:
        low, high = (int(a.min()), int(a.max())) if len(a) else (0, 0)
        kind = "<i8" if low < 0 else next(k for k in ("<u1", "<u2", "<u4", "<i8") if high <= np.iinfo(k).max)
        a = np.ascontiguousarray(a.astype(kind))
        head += [a.itemsize, len(a)]
        planes.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())
    return np.array(head, dtype="<i8").tobytes() + zstandard.compress(b"".join(planes), level)


def _unbundle(data: bytes) -> list[np.ndarray]:
    many = int(np.frombuffer(data, "<i8", 1)[0])
    sizes = np.frombuffer(data, "<i8", 2 * many, 8).reshape(-1, 2)
    planes, at, out = zstandard.decompress(data[8 + 16 * many :]), 0, []
    for width, length in sizes.tolist():
        bytes_ = np.frombuffer(planes, np.uint8, width * length, at).reshape(width, length)
        out.append(np.ascontiguousarray(bytes_.T).view("<i8" if width == 8 else f"<u{width}").ravel().astype(np.int64))
        at += width * length
    return out


def _steps(values: np.ndarray) -> np.ndarray:
    """Sorted numbers as differences, which are small."""
    return np.diff(values, prepend=0)


def _sequence(codes: np.ndarray, offsets: np.ndarray, end: int, heads: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes with an end after each text, the context of each, and where texts begin."""
    starts = offsets + np.arange(len(offsets))
    out = np.full(starts[-1], end, dtype=np.int64)
    place = np.ones(len(out), dtype=bool)
    place[starts[1:] - 1] = False
    out[place] = codes
    context = np.empty(len(out), dtype=np.int64)
    context[1:] = heads[out[:-1]]
    context[starts[:-1][starts[:-1] < len(out)]] = start
    return out, context, starts


_PART_BYTES = 12 << 20  # of text whose words are held at once
PARTS = "batch long, tokens long, entries long, hashes binary, counts binary, text binary"
_PARTS = pa.schema([(n, pa.int64()) for n in ("batch", "tokens", "entries")] + [(n, pa.binary()) for n in ("hashes", "counts", "text")])


def encoded(context_bytes: int | None) -> Callable:
    """Batches ``(doc_id, held_out, text)`` as a row each: its entries (distinct words, the end, contexts) by hash, with
    their counts in training texts, and the texts as numbers of entries. Hashes of contexts that are no words are odd."""

    def row(number: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        words, codes, offsets = coded_words(batch.column(2), lower=True)
        raw, end = [word.encode() for word in words], len(words)
        hashes = [xxhash.xxh64_intdigest(w) & ~1 for w in raw] + [_END & ~1, xxhash.xxh64_intdigest(b"", 1) | 1]
        heads = np.arange(end + 1)
        if context_bytes is not None:
            tails, heads = np.unique(np.array([xxhash.xxh64_intdigest(w[-context_bytes:], 1) | 1 for w in raw], dtype=np.uint64), return_inverse=True)
            hashes += tails.tolist()
            heads = np.append(heads, 0) + end + 2
        hashes = np.array(hashes, dtype="<u8")
        del words, raw
        held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        tokens, context, starts = _sequence(codes.astype(np.int64), offsets, end, heads, end + 1)
        learned = np.repeat(~held, np.diff(starts))
        counts = np.bincount(tokens[learned], minlength=len(hashes))
        if context_bytes is not None:
            counts += np.bincount(context[learned], minlength=len(hashes))
        counts[end + 1] = int((~held).sum())
        ids = batch.column(0)
        valid = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), dtype=np.int64)
        docs = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        text = _bundle(docs, valid, held, np.diff(offsets), codes, heads - np.arange(end + 1), level=3)
        values = (number, len(tokens), len(hashes), hashes.tobytes(), _bundle(counts), text)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _PARTS)], schema=_PARTS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(part for batch in batches for part in parts(batch, 2, _PART_BYTES)):
            yield row((TaskContext.get().partitionId() << 16) + n, batch)

    return encode


# What passes between batches, groups of entries and blocks of pairs: ``data`` bundles, of a kind, from ``src`` to ``dest``.
ROW = "kind int, dest long, src long, data binary, customers double, tables double"
_ROW = pa.schema([("kind", pa.int32()), ("dest", pa.int64()), ("src", pa.int64()), ("data", pa.binary()), ("customers", pa.float64()), ("tables", pa.float64())])
_ENTRIES, _STATE, _TEXT, _NUMBERS, _PAIRS, _COUNTS, _DISHES, _SUMS, _TOTALS, _KNOWN, _SEATS = range(11)


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[(*r, None, None)[:6] for r in rows]), _ROW)] if rows else [pa.array([], f.type) for f in _ROW], schema=_ROW)


def _met(frames: list[DataFrame], many: int, step: Callable) -> DataFrame:
    """Calls ``step`` with the rows of each destination, by kind, as ``(src, arrays)`` in the order of ``src``."""

    def call(table: pa.Table) -> pa.Table:
        by_kind: dict[int, list] = {}
        dest = table.column("dest")[0].as_py()
        for kind, src, data in sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "src", "data"))), key=lambda r: r[:2]):
            by_kind.setdefault(kind, []).append((src, data))
        return _rows(step(dest, by_kind))

    rows = frames[0].select("kind", "dest", "src", "data")
    for frame in frames[1:]:
        rows = rows.unionByName(frame.select("kind", "dest", "src", "data"))
    return rows.repartition(many, "dest").groupBy("dest").applyInArrow(call, ROW)


def split(groups: int) -> Callable:
    """The entries of each batch as a row for each group of hashes."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for row in batch.to_pylist()):
            hashes, (counts,) = np.frombuffer(row["hashes"], "<u8"), _unbundle(row["counts"])
            group = ((hashes >> np.uint64(1)) % np.uint64(groups)).astype(np.int64)
            order = np.lexsort((hashes, group))
            ends = np.searchsorted(group[order], np.arange(groups + 1))
            out = []
            for g in np.flatnonzero(np.diff(ends)).tolist():
                own = order[ends[g] : ends[g + 1]]
                mine = hashes[own].view(np.int64)
                out.append((_ENTRIES, g, row["batch"], _bundle(np.diff(mine.view(np.uint64), prepend=np.uint64(0)).view(np.int64), own, counts[own])))
            yield from _rows(out).to_batches()

    return entries


def numbered(groups: int) -> Callable:
    """Numbers the entries of a group, the most frequent first: number times groups plus group is an entry's id."""

    def number(group: int, rows: dict) -> list[tuple]:
        found = [(batch, *_unbundle(data)) for batch, data in rows[_ENTRIES]]
        hashes, at = np.unique(np.concatenate([np.cumsum(f[1].view(np.uint64)) for f in found]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([f[3] for f in found]), minlength=len(hashes)).astype(np.int64)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        ends = np.cumsum([0] + [len(f[1]) for f in found])
        out = [(_NUMBERS, f[0], group, _bundle(f[2], rank[at[a:b]])) for f, a, b in zip(found, ends, ends[1:])]
        word = (hashes & np.uint64(1)) == 0
        none = np.zeros(len(hashes), dtype=np.int64)
        state = _bundle(counts[order], none, none, none, none, none)
        return [*out, (_STATE, group, group, state, float(counts[word].sum()), float((counts[word] > 0).sum()))]

    return number


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    """64 random bits that depend on nothing but the arguments, so that a repeated task draws alike."""
    with np.errstate(over="ignore"):
        x = np.uint64(0x9E3779B97F4A7C15)
        for part in parts:
            part = np.uint64(part) if isinstance(part, int) else part.astype(np.uint64)
            x = (x ^ part) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(29))
    return x


def _uniform(*parts: np.ndarray | int) -> np.ndarray:
    return (_mix(*parts) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _local_pairs(text: list[np.ndarray], ids: np.ndarray, blocks: int):
    """Of a batch's texts: tokens, where texts begin, the pairs ``(context id, word id)`` in the order of blocks, the blocks'
    ends, each token's pair in that order, and the pairs' context and word as entries."""
    docs, valid, held, lengths, codes, heads = text
    end = len(heads) - 1
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    tokens, context, starts = _sequence(codes, offsets, end, heads + np.arange(end + 1), end + 1)
    by_id = np.argsort(ids)
    rank = np.empty_like(by_id)
    rank[by_id] = np.arange(len(ids))
    keys, place = np.unique(rank[context] * len(ids) + rank[tokens], return_inverse=True)
    del context
    of, word = by_id[keys // len(ids)], by_id[keys % len(ids)]
    block = (_mix(ids[of], ids[word]) % np.uint64(blocks)).astype(np.uint16 if blocks <= 1 << 16 else np.int64)
    order = np.argsort(block, kind="stable")
    ends = np.searchsorted(block[order], np.arange(blocks + 1))
    position = np.empty_like(order)
    position[order] = np.arange(len(order))
    return tokens, starts, of[order], word[order], ends, position[place]


def paired(groups: int, blocks: int) -> Callable:
    """A batch's pairs of a context and a word, with their counts in training texts, as a row for each block."""

    def pair(batch: int, rows: dict) -> list[tuple]:
        text = _unbundle(rows[_TEXT][0][1])
        ids = _ids(rows[_NUMBERS], groups)
        tokens, starts, of, word, ends, place = _local_pairs(text, ids, blocks)
        learned = np.repeat(text[2] == 0, np.diff(starts))
        counts = np.bincount(place[learned], minlength=len(of))
        out = []
        for k in np.flatnonzero(np.diff(ends)).tolist():
            a, b = ends[k], ends[k + 1]
            out.append((_PAIRS, k, batch, _bundle(_steps(ids[of[a:b]]), ids[word[a:b]], counts[a:b])))
        return out

    return pair


def _ids(rows: list[tuple], groups: int) -> np.ndarray:
    found = [(group, *_unbundle(data)) for group, data in rows]
    ids = np.empty(sum(len(f[1]) for f in found), dtype=np.int64)
    for group, codes, ranks in found:
        ids[codes] = ranks * groups + group
    return ids


def _sums(block: int, groups: int, entries: np.ndarray, *values: np.ndarray) -> list[tuple]:
    """Rows to the groups of sorted entries, with a block's sums for each."""
    group, out = entries % groups, []
    for g in np.unique(group).tolist():
        at = np.flatnonzero(group == g)
        out.append((_SUMS, g, block, _bundle(_steps(entries[at] // groups), *[v[at] for v in values])))
    return out


def _by_entry(u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    entries, at = np.unique(np.concatenate([u, w]), return_inverse=True)
    return entries, at[: len(u)], at[len(u) :]


def merged(groups: int) -> Callable:
    """Counts a block's pairs. Rows: the counts of all and who asks for which; the pairs with several customers, which alone
    have tables to draw; to the groups, tables by context and by word, those of pairs with one customer apart."""

    def merge(block: int, rows: dict) -> list[tuple]:
        found = [(batch, *_unbundle(data)) for batch, data in rows[_PAIRS]]
        entries, u, w = _by_entry(np.concatenate([np.cumsum(f[1]) for f in found]), np.concatenate([f[2] for f in found]))
        keys, at = np.unique(u * len(entries) + w, return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([f[3] for f in found]), minlength=len(keys)).astype(np.int64)
        lengths = np.array([len(f[1]) for f in found])
        ends = np.concatenate(([0], np.cumsum(lengths)))
        asked = np.concatenate([_steps(at[a:b]) for a, b in zip(ends, ends[1:])])
        u, w = keys // len(entries), keys % len(entries)
        several, many = counts > 1, len(entries)
        out = [
            (_COUNTS, block, block, _bundle(counts, np.array([f[0] for f in found]), lengths, asked)),
            (_DISHES, block, block, _bundle(_steps(entries[u[several]]), entries[w[several]], counts[several], np.ones(several.sum(), dtype=np.int64)), float((counts == 1).sum()), float((counts == 2).sum())),
        ]
        values = [np.bincount(x[c], minlength=many) for c in (counts == 1, several) for x in (u, w)]
        known = np.flatnonzero(sum(values))
        return out + _sums(block, groups, entries[known], *[v[known] for v in values])

    return merge


def _seat(customers: np.ndarray, opening: np.ndarray, discount: float, draw: np.ndarray, sweep: int) -> np.ndarray:
    """Tables after a restaurant's customers of one dish are seated one after another, from which sampling starts.

    The first opens a table; another opens one in proportion to ``opening``, against the customers already
    there less the discounts of their tables. From the 64th on they come in groups of a sixteenth of
    those seated, so that a dish of n customers takes about 16 ln n steps.
    """
    order = np.argsort(-customers, kind="stable")
    c, a, u = customers[order].astype(np.float64), opening[order], draw[order]
    tables = np.ones(len(c))
    seated, step = 1, 0
    active = int(np.searchsorted(-c, -seated, side="left"))
    while active:
        group = np.minimum(max(1, seated // 16) if seated >= 64 else 1, c[:active] - seated)
        p = a[:active] / (a[:active] + np.maximum(seated - discount * tables[:active], 1e-9))
        tables[:active] += np.floor(group * p + _uniform(u[:active], sweep, step))
        seated += max(1, seated // 16) if seated >= 64 else 1
        step += 1
        active = int(np.searchsorted(-c, -seated, side="left"))
    out = np.empty(len(c))
    out[order] = np.minimum(tables, c)
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by Stirling's series from seven on."""
    shift = np.ones_like(x)
    for k in range(7):
        shift = np.where(x < 7, shift * (x + k), shift)
    x = np.where(x < 7, x + 7, x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - np.log(shift)


_EXACT = 128  # customers up to which all numbers of tables are weighed


def _seatings(most: int, discount: float) -> np.ndarray:
    """Logarithms of generalized Stirling numbers: how the seatings of c customers at t tables weigh in all."""
    s = np.zeros((most + 1, most + 2))
    s[0, 0] = 1
    tables = np.arange(most + 2)
    for c in range(most):
        s[c + 1] = np.maximum(c - discount * tables, 0) * s[c]
        s[c + 1, 1:] += s[c, :-1]
    with np.errstate(divide="ignore"):
        return np.log(s)


def _log_seatings(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """The same numbers for large c, less the logarithm of c!: the c-th coefficient of ((1 - (1-x)^d) / d)^t / t!, integrated
    with w = 1-x along a parabola around the cut that crosses the saddle point, or 3/c where that is nearer to zero."""
    with np.errstate(all="ignore"):
        v = np.maximum(np.log(c / t) / (1 - discount), 1e-9)
        for _ in range(8):
            y, z = np.exp(-v), np.exp(-discount * v)
            slope = y / (1 - y) + 1 - discount - discount * z / (1 - z)
            v = np.maximum(v - (np.log(t * discount / c) + np.log1p(-y) + (1 - discount) * v - np.log1p(-z)) / slope, 1e-9)
        y, z = np.exp(-v), np.exp(-discount * v)
        slope = y / (1 - y) + 1 - discount - discount * z / (1 - z)
        width = np.sqrt(y * (1 - y) / (c * slope)) / (2 * y)
        cross = np.maximum(y, 3 / c)
        scale = np.where(y < 3 / c, 0.5, np.minimum(0.5, width))
        steps = 0.1 * np.arange(48)  # finer at the crossing than far from it
        turn = 1 + 1j * scale[:, None] * np.sinh(steps)
        w = cross[:, None] * turn**2
        power = lambda w, c, t: t * np.log(1 - np.exp(discount * np.log(w))) - (c + 1) * np.log(1 - w)
        top = power(cross, c, t)
        values = (np.exp(power(w, c[:, None], t[:, None]) - top[:, None]) * turn).real * np.cosh(steps)
        out = top + np.log(2 * cross * 0.1 * scale / np.pi * (values.sum(axis=1) - values[:, 0] / 2)) - _log_gamma(t + 1) - t * np.log(discount)
        whole = _log_gamma(c + 1)
        out = np.where(t == c - 1, np.log((1 - discount) * c * (c - 1) / 2) - whole, out)
    return np.where(t == c, -whole, out)


def _resample(c: np.ndarray, t: np.ndarray, other: np.ndarray, strength: float, discount: float, dish: np.ndarray, all_: float, draw: np.ndarray, sweep: int) -> np.ndarray:
    """A Gibbs step: new numbers of tables for c customers of one dish, given all else.

    ``other``: tables of the restaurant without these; ``dish`` and ``all_``: what the parent has for the dish and in all,
    without the customers that these tables sent. The j-th further table weighs ``strength + discount * (other + j)``
    times ``(dish + j) / (all_ + j)``, as earlier tables are customers of the parent; with ``all_`` infinite, ``dish`` alone.
    Up to 128 customers all numbers are weighed and one is drawn; beyond, Metropolis steps of several lengths.
    """
    out = t.astype(np.int64).copy()
    fixed = np.isinf(all_) if np.isscalar(all_) else False
    every = np.broadcast_to(np.asarray(all_, dtype=np.float64), c.shape)
    exact = _seatings(min(_EXACT, int(c.max(initial=1))), discount)
    order = np.argsort(c, kind="stable")
    ends = np.searchsorted(c[order], np.arange(_EXACT + 2))
    for size in range(2, _EXACT + 1):
        for a in range(ends[size], ends[size + 1], max(1, (1 << 20) // size)):
            at = order[a : min(a + max(1, (1 << 20) // size), ends[size + 1])]
            j = np.arange(1, size)
            weight = strength + discount * (other[at, None] + j)
            weight *= dish[at, None] if fixed else (dish[at, None] + j) / (every[at, None] + j)
            logs = np.concatenate([np.zeros((len(at), 1)), np.cumsum(np.log(weight), axis=1)], axis=1) + exact[size, 1 : size + 1]
            cum = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
            out[at] = 1 + (cum < _uniform(draw[at], sweep)[:, None] * cum[:, -1:]).sum(axis=1).clip(0, size - 1)
    for first in range(ends[_EXACT + 1], len(order), 1 << 13):
        at = order[first : first + (1 << 13)]
        n, now = c[at].astype(np.float64), out[at].astype(np.float64)
        o, own, all_at = strength / discount + other[at], dish[at], every[at]

        def weigh(t, n=n, o=o, own=own, all_at=all_at):
            up = np.log(own) * t if fixed else _log_gamma(own + t) - _log_gamma(all_at + t)
            return _log_seatings(n, t, discount) + t * np.log(discount) + _log_gamma(o + t) + up

        weight = weigh(now)
        for step in range(12):
            u = _uniform(draw[at], sweep, 2 * step + 1)
            length = 1 + np.floor(-np.log1p(-np.abs(2 * u - 1)) * (4 ** (step % 4) - 1))
            new = now + np.where(u < 0.5, -length, length)
            fits = (new >= 1) & (new <= n)
            then = weigh(np.where(fits, new, now))
            taken = fits & (np.log(_uniform(draw[at], sweep, 2 * step + 2) + 1e-300) < then - weight)
            now, weight = np.where(taken, new, now), np.where(taken, then, weight)
        out[at] = now.astype(np.int64)
    return out


@dataclass
class Totals:
    """Of the parent restaurant, after a round."""

    customers: float
    tables: float


@dataclass
class Model:
    """What the driver knows of the whole corpus: a few numbers."""

    groups: int
    words: int
    tokens: int
    discount: float
    root_discount: float
    config: LanguageConfig

    def root(self, customers: np.ndarray, tables: np.ndarray, total: Totals) -> np.ndarray:
        """The parent's probability of words, of which it has so many customers and tables."""
        return (customers - self.root_discount * tables + self.new(total)) / (self.config.root_strength + total.customers)

    def new(self, total: Totals) -> float:
        return (self.config.root_strength + self.root_discount * total.tables) / (self.words + 1)


def totalled(model: Model, turn: int, before: Totals | None) -> Callable:
    """A group's totals: tables of each context, customers and tables of the parent for each word, the latter drawn anew; to
    each block those of the entries it named."""
    config = model.config

    def total(group: int, rows: dict) -> list[tuple]:
        counts, base, base_customers, tables, customers, root = _unbundle(rows[_STATE][0][1])
        came = [(block, *_unbundle(data)) for block, data in rows.get(_SUMS, ())]
        if turn == 0:
            for _, ranks, singles, single_customers, *_ in came:
                np.add.at(base, np.cumsum(ranks), singles)
                np.add.at(base_customers, np.cumsum(ranks), single_customers)
        tables, customers = base.copy(), base_customers.copy()
        for _, ranks, *_, more, more_customers in came:
            tables[np.cumsum(ranks)] += more
            customers[np.cumsum(ranks)] += more_customers
        root = np.minimum(np.maximum(root, 1), customers)
        busy = np.flatnonzero(customers > 1)
        if turn and len(busy):
            eating, sat, draw = customers[busy], root[busy], _mix(busy * model.groups + group, config.seed)
            if turn == 1:
                new = _seat(eating, np.full(len(busy), model.new(before)), model.root_discount, draw, turn)
            else:
                new = _resample(eating, sat, np.maximum(before.tables - sat, 0.0), config.root_strength, model.root_discount, np.full(len(busy), 1 / (model.words + 1)), np.inf, draw, turn)
            root[busy] = new
        out = [(_STATE, group, group, _bundle(counts, base, base_customers, tables, customers, root), float(customers.sum()), float(root.sum()))]
        for block, ranks, *_, more, more_customers in came:
            at = np.cumsum(ranks)[(more > 0) | (more_customers > 0)]
            out.append((_TOTALS, block, group, _bundle(tables[at], customers[at], root[at])))
        return out

    return total


def sampled(model: Model, turn: int, total: Totals) -> Callable:
    """A block's tables drawn anew: without the tables of a pair, totals are those after the round before."""
    config = model.config

    def sample(block: int, rows: dict) -> list[tuple]:
        u, w, counts, now = _unbundle(rows[_DISHES][0][1])
        if len(u) == 0:
            return [(_DISHES, block, block, rows[_DISHES][0][1])]
        u = np.cumsum(u)
        entries, of, word = _by_entry(u, w)
        known = np.zeros((3, len(entries)), dtype=np.int64)
        for group, data in rows[_TOTALS]:
            known[:, entries % model.groups == group] = np.stack(_unbundle(data))
        tables, customers, root = known[0][of], known[1][word], known[2][word]
        draw = _mix(u, w, config.seed)
        if turn == 0:
            opening = (config.strength + model.discount * tables) * model.root(customers, root, total)
            new = _seat(counts, opening, model.discount, draw, turn).astype(np.int64)
        else:
            rest = customers - now
            dish = rest - model.root_discount * np.maximum(np.minimum(root, rest), 1) + model.new(total)
            new = _resample(counts, now, (tables - now).astype(np.float64), config.strength, model.discount, dish, config.root_strength + total.customers - now, draw, turn)
        sums = [np.bincount(x, weights=new, minlength=len(entries)).astype(np.int64) for x in (of, word)]
        return [(_DISHES, block, block, _bundle(_steps(u), w, counts, new)), *_sums(block, model.groups, entries, *sums)]

    return sample


def known(sweeps: int) -> Callable:
    """To each batch, what a group's totals after some sweeps say of its entries."""

    def answer(group: int, rows: dict) -> list[tuple]:
        states = [_unbundle(data) for _, data in rows[_STATE]]
        values = [states[0][0], *[v for s in states for v in s[3:]]]
        out = []
        for batch, data in rows[_NUMBERS]:
            codes, ranks = _unbundle(data)
            out.append((_KNOWN, batch, group, _bundle(codes, ranks, *[v[ranks] for v in values])))
        return out

    return answer


def answered(block: int, rows: dict) -> list[tuple]:
    """To each batch, the customers and after some sweeps the tables of the pairs it asks for."""
    counts, batches, lengths, asked = _unbundle(rows[_COUNTS][0][1])
    tables = []
    for _, data in rows[_DISHES]:
        t = np.minimum(counts, 1)
        t[counts > 1] = _unbundle(data)[3]
        tables.append(t)
    ends, out = np.concatenate(([0], np.cumsum(lengths))), []
    for batch, a, b in zip(batches.tolist(), ends, ends[1:]):
        at = np.cumsum(asked[a:b])
        out.append((_SEATS, batch, block, _bundle(counts[at], *[t[at] for t in tables])))
    return out


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scores(model: Model, blocks: int, totals: list[Totals]) -> Callable:
    def score(table: pa.Table) -> pa.Table:
        rows: dict[int, list] = {}
        for kind, src, data in sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "src", "data"))), key=lambda r: r[:2]):
            rows.setdefault(kind, []).append((src, _unbundle(data)))
        text = rows[_TEXT][0][1]
        many = sum(len(v[0]) for _, v in rows[_KNOWN])
        ids, values = np.empty(many, dtype=np.int64), np.empty((1 + 3 * len(totals), many))
        for group, (codes, ranks, *found) in rows[_KNOWN]:
            ids[codes] = ranks * model.groups + group
            values[:, codes] = np.stack(found)
        tokens, starts, of, word, ends, place = _local_pairs(text, ids, blocks)
        met = np.empty((1 + len(totals), len(of)))
        for block, found in rows[_SEATS]:
            met[:, ends[block] : ends[block + 1]] = np.stack(found)
        counts, strength = values[0], model.config.strength
        p = np.zeros(len(of))
        for k, total in enumerate(totals):
            tables, customers, root = values[1 + 3 * k : 4 + 3 * k]
            parent = model.root(customers, root, total)
            p += (strength + model.discount * tables[of]) * parent[word] + met[0] - model.discount * met[1 + k]
        logs = np.log10(p / (len(totals) * (strength + counts[of])))
        sums = lambda x: np.add.reduceat(x, starts[:-1])
        base = np.log10((counts + 1.0) / (model.tokens + model.words + 1.0))
        return pa.table(
            {
                "doc_id": pa.array(text[0], mask=text[1] == 0),
                "held_out": pa.array(text[2] == 1),
                "n_tokens": pa.array(np.diff(starts)),
                "n_known": pa.array(sums((counts > 0).astype(np.int64)[tokens])),
                "base_score": pa.array(sums(base[tokens])),
                "score": pa.array(sums(logs[place])),
            }
        )

    return score


def _shares(total: int, most: int, least: int) -> int:
    """How many shares of at most ``most`` a total has; small totals are shared too, but not below ``least``."""
    return max(1, -(-total // most), min(32, total // least))


def scored(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity)`` of every document.

    The model is a Pitman-Yor restaurant for each context, all sharing one parent whose base is uniform
    over the training words and one unknown word. Tokens are lower-cased words and an end; null and
    empty texts are an end alone. Documents with a null id are learned from; repeated rows are learned and
    scored as often as they occur; an empty table gives an empty result.

    Texts are read once and turned into numbers of their batch's entries, which groups by hash number for all. Pairs of a
    context and a word lie in blocks by a hash of both, so that no frequent word or context lies in one task. In a sweep every
    block draws the tables of its pairs given all others' after the sweep before, and sends sums of them to the groups
    of the words and contexts, which send back totals: only sums by block are shuffled.
    """
    held = F.coalesce(fold(F.col("doc_id"), config.modulus) == config.held_out, F.lit(False))
    read = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text")
    encodings = stored(read.mapInArrow(encoded(config.context_bytes), PARTS), "lm-parts")
    tokens, entries = encodings.agg(F.sum("tokens"), F.sum("entries")).first()
    groups, blocks = _shares(entries or 0, 1 << 20, 1 << 14), _shares(tokens or 0, 1 << 21, 1 << 15)
    of = lambda frame, *kinds: frame.filter(F.col("kind").isin(*kinds))
    numbers = stored(_met([encodings.select("batch", "hashes", "counts").mapInArrow(split(groups), ROW)], groups, numbered(groups)), "lm-numbers")
    state = of(numbers, _STATE)
    learned, words = state.agg(F.sum("customers"), F.sum("tables")).first()
    texts = encodings.select(F.lit(_TEXT).alias("kind"), F.col("batch").alias("dest"), F.lit(0).cast("long").alias("src"), F.col("text").alias("data"))
    asks = _met([texts, of(numbers, _NUMBERS)], 2 * blocks, paired(groups, blocks))
    pairs = stored(_met([asks], blocks, merged(groups)), "lm-pairs")
    once, twice = of(pairs, _DISHES).agg(F.sum("customers"), F.sum("tables")).first()
    discount = lambda n1, n2: min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
    model = Model(groups, int(words or 0), int(learned or 0), discount(once or 0, twice or 0), 0.5, config)
    dishes, total, samples = pairs, None, []
    for turn in range(config.sweeps + 2):
        found = stored(_met([state, of(dishes, _SUMS)], groups, totalled(model, turn, total)), "lm-totals")
        state = of(found, _STATE)
        total = Totals(*(x or 0.0 for x in state.agg(F.sum("customers"), F.sum("tables")).first()))
        if turn == 0:
            model.root_discount = discount(*_rare(state))
        if turn > min(config.burn_in, config.sweeps - 1) + 1:
            samples.append((state, of(dishes, _DISHES), total))
        if turn <= config.sweeps:
            dishes = stored(_met([of(dishes, _DISHES), of(found, _TOTALS)], blocks, sampled(model, turn, total)), "lm-tables")
    at = lambda frame, n: frame.withColumn("src", F.lit(n).cast("long"))
    back = of(numbers, _NUMBERS).select("kind", F.col("src").alias("dest"), F.col("dest").alias("src"), "data")
    told = _met([back, *[at(s, n) for n, (s, _, _) in enumerate(samples)]], groups, known(len(samples)))
    seats = _met([of(pairs, _COUNTS), *[at(d, n) for n, (_, d, _) in enumerate(samples)]], blocks, answered)
    met = texts.unionByName(told.select(*texts.columns)).unionByName(seats.select(*texts.columns))
    result = met.repartition(2 * blocks, "dest").groupBy("dest").applyInArrow(scores(model, blocks, [t for _, _, t in samples]), SCORED)
    return result.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def _rare(state: DataFrame) -> tuple[float, float]:
    """How many words occur in one context, and how many in two."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in (data for batch in batches for data in batch.column(0).to_pylist()):
            customers = _unbundle(data)[4]
            yield pa.RecordBatch.from_arrays([pa.array([float((customers == k).sum())]) for k in (1, 2)], names=["once", "twice"])

    found = state.select("data").mapInArrow(count, "once double, twice double").agg(F.sum("once"), F.sum("twice")).first()
    return found[0] or 0.0, found[1] or 0.0
