"""Counting quotient filters: exact counters of packed word-id n-grams, kept small by an invertible permutation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Odd multipliers of the rounds of the permutation.
_ROUNDS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


def _mix(values: np.ndarray, multiplier: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = (values + np.uint64(multiplier >> 7)) * np.uint64(multiplier)
        out ^= out >> np.uint64(29)
        out *= np.uint64(multiplier)
    return out >> np.uint64(1) ^ out >> np.uint64(33)


@dataclass(frozen=True)
class Layout:
    """Three word ids of ``id_bits`` each (0: none) in a key of two halves."""

    id_bits: int

    @property
    def half(self) -> int:
        return (3 * self.id_bits + 1) // 2

    def pack(self, first: np.ndarray, second: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """High and low halves of ``first, second, third``, permuted: a network of four rounds, each undone by itself."""
        b, h = self.id_bits, self.half
        x, y, z = (v.astype(np.uint64) for v in (first, second, third))
        high = x << np.uint64(2 * b - h) | y >> np.uint64(h - b)
        low = (y & np.uint64((1 << (h - b)) - 1)) << np.uint64(b) | z
        return self._turn(high, low, (0, 1, 2, 3))

    def unpack(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b, h = self.id_bits, self.half
        high, low = self._turn(high, low, (3, 2, 1, 0))
        ids = high >> np.uint64(2 * b - h), (high << np.uint64(h - b) | low >> np.uint64(b)) & np.uint64((1 << b) - 1), low & np.uint64((1 << b) - 1)
        return tuple(v.astype(np.int64) for v in ids)

    def _turn(self, high: np.ndarray, low: np.ndarray, rounds: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << self.half) - 1)
        for n in rounds:
            if n % 2:
                low = low ^ (_mix(high, _ROUNDS[n]) & mask)
            else:
                high = high ^ (_mix(low, _ROUNDS[n]) & mask)
        return high, low


@dataclass(frozen=True)
class Entries:
    """Distinct keys in order, and how often each occurs."""

    high: np.ndarray
    low: np.ndarray
    counts: np.ndarray

    def __len__(self) -> int:
        return len(self.counts)


def counted(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None, half: int) -> Entries:
    """Keys in any order with their counts (none: one each), equal keys added up."""
    if len(high) == 0:
        return Entries(high.astype(np.uint64), low.astype(np.uint64), np.zeros(0, dtype=np.int64))
    if half <= 32:
        keys = high << np.uint64(half) | low
        if counts is None:
            keys.sort()
        else:
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        high, low = keys[new] >> np.uint64(half), keys[new] & np.uint64((1 << half) - 1)
    else:
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        counts = counts[order] if counts is not None else None
        new = np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
        high, low = high[new], low[new]
    starts = np.flatnonzero(new)
    many = np.add.reduceat(counts, starts) if counts is not None else np.diff(np.append(starts, len(new)))
    return Entries(high, low, many.astype(np.int64))


def merged(filters: list[Entries], half: int) -> Entries:
    """All entries together, equal keys added up. The list is emptied, so that its entries are not held beside their copies."""
    high, low, counts = (np.concatenate([getattr(f, k) for f in filters]) for k in ("high", "low", "counts"))
    filters.clear()
    return counted(high, low, counts, half)


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of whole numbers, a plane for each byte."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: bytes, many: int, width: int) -> np.ndarray:
    out = np.zeros((many, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(width, many).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def encode(entries: Entries, half: int, prefix: int) -> bytes:
    """A filter of entries whose keys agree in their first ``prefix`` bits: a quotient of the next bits and all the
    rest as the remainder, so that no key is lost.

    The table holds, for every quotient, a one for each of its entries and then a zero (some two bits an entry); the
    remainders in whole bytes; counts as bytes, and large ones apart. The quotient's length is the one that makes the
    table smallest.
    """
    n, rest = len(entries), half - prefix
    over = min((o for o in range(0, rest + 1, 8) if rest - o <= 30), key=lambda o: n * o + (1 << (rest - o)))
    high = entries.high & np.uint64((1 << rest) - 1)
    marks = np.zeros((1 << (rest - over)) + n, dtype=np.uint8)
    marks[(high >> np.uint64(over)).astype(np.int64) + np.arange(n)] = 1
    large = np.flatnonzero(entries.counts > 254)
    small = np.minimum(entries.counts, 255).astype(np.uint8).tobytes()
    head = np.array([n, over, len(large)], dtype="<i8").tobytes()
    table = np.packbits(marks).tobytes() + _planes(high, over // 8) + _planes(entries.low, (half + 7) // 8)
    return head + table + small + entries.counts[large].astype("<i8").tobytes()


def decode(data: bytes, half: int, prefix: int, at: int) -> Entries:
    """The entries of a filter whose keys begin with the ``prefix`` bits ``at``."""
    n, over, many = np.frombuffer(data, "<i8", 3).tolist()
    rest = half - prefix
    bits, place = (1 << (rest - over)) + n, 24
    marks = np.unpackbits(np.frombuffer(data, np.uint8, (bits + 7) // 8, place), count=bits)
    place += (bits + 7) // 8
    quotient = (np.flatnonzero(marks) - np.arange(n)).astype(np.uint64)
    parts = []
    for width in (over // 8, (half + 7) // 8):
        parts.append(_from_planes(data[place : place + n * width], n, width))
        place += n * width
    counts = np.frombuffer(data, np.uint8, n, place).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", many, place + n)
    high = np.uint64(at << rest) | quotient << np.uint64(over) | parts[0]
    return Entries(high, parts[1], counts)


def sliced(entries: Entries, half: int, prefix: int) -> list[tuple[int, Entries]]:
    """The entries by the first ``prefix`` bits of their keys."""
    tops = (entries.high >> np.uint64(half - prefix)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], tops[1:] != tops[:-1]))) if len(tops) else np.zeros(0, dtype=np.int64)
    ends = np.append(starts[1:], len(tops))
    return [(int(tops[a]), Entries(entries.high[a:b], entries.low[a:b], entries.counts[a:b])) for a, b in zip(starts, ends)]
