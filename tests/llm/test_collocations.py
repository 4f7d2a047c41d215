"""Quotient filters against plain counters, and phrases against a brute-force count in Python's whole numbers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillseek.llm import collocations, quotient

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("bits", [2, 5, 16, 21, 22, 30, 42])
def test_filters_keep_every_key(bits):
    rng = np.random.default_rng(bits)
    layout = quotient.Layout(bits)
    ids = [rng.integers(1, 1 << bits, 4000) for _ in range(3)]
    ids[2][::3] = 0
    high, low = layout.pack(*ids)
    assert int(high.max()) < 1 << layout.half and int(low.max()) < 1 << layout.half
    assert all((a == b).all() for a, b in zip(layout.unpack(high, low), ids))
    plain = Counter(zip(high.tolist(), low.tolist()))
    whole = quotient.counted(high, low, None, layout.half)
    assert plain == dict(zip(zip(whole.high.tolist(), whole.low.tolist()), whole.counts.tolist()))
    many = quotient.Entries(whole.high, whole.low, whole.counts * rng.choice([1, 100, 254, 255, 256, 10**12], len(whole)))
    for prefix in (0, 1, 3):
        cut = [quotient.decode(quotient.encode(e, layout.half, prefix), layout.half, prefix, at) for at, e in quotient.sliced(many, layout.half, prefix)]
        again = quotient.merged(cut[::-1], layout.half)
        assert all((getattr(again, k) == getattr(many, k)).all() for k in ("high", "low", "counts"))
        double = quotient.merged(cut + cut, layout.half)
        assert (double.counts == 2 * many.counts).all()


def brute(rows, config):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < config.least:
                continue
            if len(phrase) == 2 and any(len(p) == 3 and b >= config.least and phrase in (p[:2], p[1:]) and 100 * b >= config.inside * a for p, b in f.items()):
                continue
            cuts = [(10**6 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        out += [(lang, n, p.decode(), -a, l, r, totals[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(found)[: config.first], 1)]
    return sorted(out)


def found(spark, rows, config, schema=DOCS):
    frame = collocations.collocations(spark.createDataFrame(rows, schema), config)
    assert frame.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, frame.collect()))


# Small limits, so that texts are cut, tasks send several filters and buckets are many.
SMALL = collocations.CollocationConfig(least=3, first=15, text_bytes=400, task_entries=300, bucket_entries=200)


def test_phrases_against_brute_force(spark):
    rng = np.random.default_rng(8)
    words = [*"abcdefgh", "Über", "été", "ÉTÉ", "日本", "x y", "\x00"]
    ends = [" ", "  ", "\t", ". ", ", ", "\n", "\r\n", "!", " ? ", ";:"]
    rows = []
    for i in range(120):
        size = int(rng.integers(0, 60))
        text = "".join(words[min(int(rng.exponential(3)), len(words) - 1)] + ends[min(int(rng.exponential(1.2)), len(ends) - 1)] for _ in range(size))
        rows.append((i, text, ["en", "de", None, "und", ""][i % 5], "s", 0))
    assert found(spark, rows, SMALL) == brute(rows, SMALL)


def test_phrases_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, " \t ", "en", "s", 0), (2, ".,;", None, "s", 0)]
    rows += [(3, "New York City", "en", "s", 0)] * 40  # repeated rows count each
    rows += [(4, "new york, city hall " * 30, "en", "s", 0), (5, "A b" * 3000, "xx", "s", 0), (6, "w" * 100_000 + " a b " * 9, "xx", "s", 0)]
    assert found(spark, rows, SMALL) == brute(rows, SMALL)
    clash = [(*row, 1, "p", 2, 3, "c", 4) for row in rows]
    assert found(spark, clash, SMALL, DOCS + ", place int, phrase string, w1 int, id int, codes string, rank int") == brute(rows, SMALL)


def test_phrases_of_nothing(spark):
    assert found(spark, [], SMALL) == []
    assert found(spark, [(1, "one two", "en", "s", 0)], SMALL) == []


def test_score_past_64_bits(spark):
    frame = spark.createDataFrame([(10**13, 2 * 10**13, 3 * 10**13)], "a long, l long, r long")
    assert frame.select(collocations._score("l", "r")).first()[0] == 10**6 * 10**26 // (6 * 10**26)


def test_phrases_counted_in_stretches():
    """A long line is counted a stretch at a time; a phrase that lies across two is counted once."""
    rng = np.random.default_rng(5)
    line, ids = rng.integers(0, 9, 1003), np.array([0, 1, 2, 3, 0, 5, 6, 7, 8])
    whole = Counter(zip(*(part.tolist() for part in collocations._grams(line, ids))))
    for many in (1, 2, 100, 1001, 1002, 5000):
        parts = [collocations._grams(line, ids, start, many) for start in range(0, len(line), many)]
        assert sum((Counter(zip(*(x.tolist() for x in part))) for part in parts), Counter()) == whole
    layout = quotient.Layout(4)
    held = [quotient.counted(*layout.pack(*part), None, layout.half) for part in parts]
    assert quotient.merged(held, layout.half).counts.sum() == sum(whole.values()) and not held
