"""Each corpus operator against a brute-force version, held-out accuracy or a law that its result must obey."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillseek.llm import ann, decontaminate, graph, line_dedup, mixing, pii, pitman_yor, sharding, simhash, toxicity, url_filter
from quillseek.llm.graph import connected_components
from quillseek.llm.queries import QUERIES, RULES
from quillseek.operators import joins

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *texts, start=0):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts, start)], DOCS)


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [tuple(map(int, pair)) for pair in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    links += [(5000, i) for i in range(5001, 5200)]
    found = dict(connected_components(spark.createDataFrame(links, "src long, dst long")).collect())
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert found == union_find(nodes, [x for x in links if x[0] != x[1]])


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([(None, 1), (2, 2)], "src long, dst long")).collect() == []


def test_small_components_are_not_measured(spark, monkeypatch):
    """How many rows a round can broadcast follows from the pairs: no job asks for it."""
    monkeypatch.setattr(joins, "is_small", lambda *_: pytest.fail("measured"))
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)]
    found = dict(connected_components(spark.createDataFrame(links, "src long, dst long")).collect())
    assert set(found.values()) == {0, 100} and len(found) == 111
    assert graph._small(400_000) and graph._small(2_000_000) is None


def test_similar_documents_close_links_once(spark, monkeypatch):
    """Links by bits and by similarity are closed together: fingerprints get no classes of their own first."""
    closed = []
    monkeypatch.setattr(simhash, "connected_components", lambda edges: closed.append(edges) or connected_components(edges))
    base = [f"w{i}" for i in range(400)]
    swapped = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in (100, 200, 300)]  # near by bits or by shingles
    texts = [" ".join(base), *swapped, " ".join(base), "another text of its own", None, ""]
    found = dict(simhash.similar_documents(docs(spark, *texts)).collect())
    assert [found[i] for i in range(8)] == [0, 0, 0, 0, 0, 5, 6, 6]
    assert len(closed) == 2  # groups within cells, and everything


def edits(a, b):
    """Whether two strings are at most one edit apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def dropped(texts):
    """Brute force over all pairs of lines."""
    lines = [(d, n, line) for d, t in enumerate(texts) for n, line in enumerate((t or "").split("\n")) if line.strip(" ")]
    first = {}
    for d, n, line in lines:
        first.setdefault(line, (d, n))
    out = set()
    for d, n, line in lines:
        if first[line] != (d, n):
            out.add((d, n, *first[line], 0))
            continue
        near = [at for other, at in first.items() if at < (d, n) and other != line and edits(line, other)]
        if near:
            out.add((d, n, *min(near), 1))
    return out


def test_lines_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abé "), size=n)) for n in (1, 2, 3, 5, 9, 15, 16, 17, 33, 90)]
    lines = list(base)
    for line in base * 6:
        i = int(rng.integers(0, len(line)))
        lines += [line[:i] + line[i + 1 :], line[:i] + "b" + line[i:], line[:i] + "x" + line[i + 1 :]]
    order = rng.permutation(len(lines))
    texts = ["\n".join(lines[i] for i in order[k::7]) for k in range(7)] + [None, "", "  \n\n"]
    found = {tuple(r) for r in line_dedup.dropped_lines(docs(spark, *texts)).collect()}
    assert found == dropped(texts)


def test_a_long_line_and_one_edit_of_it(spark):
    line = "abcdefghij " * 3000
    found = line_dedup.dropped_lines(docs(spark, line, line[:17000] + line[17001:], line[:9] + "?" + line[10:])).collect()
    assert sorted(map(tuple, found)) == [(1, 0, 0, 0, 1), (2, 0, 0, 0, 1)]


def test_lines_of_given_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    found = {tuple(r) for r in QUERIES["op1_line_edits"](spark, SF).collect()}
    exact = {r for r in dropped([r["text"] for r in rows]) if r[4] == 0}
    assert {r for r in found if r[4] == 0} == exact
    at = {(r["doc_id"], n): line for r in rows for n, line in enumerate(r["text"].split("\n"))}
    assert all(edits(at[r[:2]], at[r[2:4]]) and r[2:4] < r[:2] for r in found)


def test_shards_obey_their_law(spark):
    rows = QUERIES["op2_histogram_shards"](spark, "/root/testdata/sf0.01").collect()
    texts = dict(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    sizes, slots = [0] * 16, [[] for _ in range(16)]
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes"
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)


def test_shards_of_one_large_group(spark):
    same = docs(spark, *["copy of a text"] * 3000)
    sizes = [r["count"] for r in sharding.shard(same).groupBy("shard").count().collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) < 10


def test_shards_of_repeated_rows(spark):
    """A third of all rows are one row, and most of the bytes."""
    same = [(None, "x" * 1000, None, None, None)] * 2000
    rows = spark.createDataFrame(same + [(i, f"text {i}", "en", "s", 0) for i in range(4000)], DOCS)
    rows = rows.withColumns({name: F.lit("mine") for name in ("__key", "__piece", "key", "piece", "rank", "first", "number", "row")})
    got = sharding.shard(rows)
    assert got.columns == [*rows.columns, "size", "shard", "slot"]
    got = got.select("shard", "size", "slot").collect()
    sizes, slots = [0] * 16, [[] for _ in range(16)]
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 6000 and max(sizes) - min(sizes) <= 2 * 1001 + 0.004 * sum(sizes) / 16
    assert all(sorted(s) == list(range(len(s))) for s in slots)


def test_shards_of_odd_rows(spark):
    odd = docs(spark, None, "", "a" * 100_000).withColumn("size", F.lit("mine")).union(docs(spark, None).withColumn("size", F.lit("x")))
    rows = sharding.shard(odd).collect()
    assert len(rows) == 4 and {r["size"] for r in rows} == {1, 100_001}
    assert sharding.shard(docs(spark, "a").limit(0)).count() == 0


def test_neighbours_recall(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], dtype=float)
    norms = np.sqrt((x * x).sum(axis=1))
    found = {}
    for r in QUERIES["op3_one_bit_neighbours"](spark, folder).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hit = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        score = (x @ x[i]) / norms / norms[i]
        best = sorted((-s, v) for s, v in zip(score, ids) if v != ids[i])[:5]
        got = found[ids[i]]
        assert all(abs(s - score[np.flatnonzero(ids == v)[0]]) < 1e-12 for v, s in got)
        hit += len({v for v, _ in got} & {v for _, v in best})
        total += len(best)
    assert hit / total >= 0.98


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [0.0, 2.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [None, 1.0])]
    rows += [(7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, []), (10, [1.0, 1.0, 1.0]), (100, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    rows += [(v, [3.0, 3.0]) for v in range(200, 230)]
    found = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[0] == [3, 200, 201, 202, 203] and got[100] == [10] and got[200] == [201, 202, 203, 204, 205]
    assert got[50] == [200, 201, 202, 203, 204] and set(got) == {0, 50, 100, 200}
    assert ann.neighbours(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


def test_neighbours_are_not_copied_by_the_driver(spark, monkeypatch):
    """Queries are copied for groups of blocks, by a shuffle: no broadcast holds the copies. Groups of any number give the same rows."""
    rng = np.random.default_rng(5)
    x = {dim: rng.standard_normal((n, dim)) for dim, n in ((3, 90), (8, 300))}
    rows = [(1000 * dim + 10 * n, [float(c) for c in v]) for dim, vectors in x.items() for n, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plans, stored = [], ann.stored
    monkeypatch.setattr(ann, "stored", lambda frame, label: (label == "ann-found" and plans.append(frame), stored(frame, label))[1])
    for groups, size in ((1, 1 << 20), (3, 1 << 20), (32, 1 << 20), (1, 4000)):
        config = ann.NeighbourConfig(rows=16, queries=4, groups=groups, group_bytes=size)
        found = {}
        for r in ann.neighbours(frame, config).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append(r["vec_id"])
        wanted = {}
        for dim, vectors in x.items():
            units = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
            for n in range(0, len(vectors), 5):
                order = np.argsort(-(units @ units[n]), kind="stable")
                wanted[1000 * dim + 10 * n] = [1000 * dim + 10 * int(i) for i in order if i != n][:5]
        hits = sum(len(set(found[q]) & set(wanted[q])) for q in wanted)
        assert found.keys() == wanted.keys() and hits >= 0.98 * 5 * len(wanted)
    for plan in plans:
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "Broadcast" not in text
    assert [ann._groups(b, 64, ann.NeighbourConfig()) for b in (1, 20, 40, 586, 6000)] == [1, 20, 32, 32, 188]


def counted(texts):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for t in texts]
    return tokens


def test_language_scores(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    held = {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2}
    tokens = dict(zip([r["doc_id"] for r in rows], counted([r["text"] for r in rows])))
    counts = {}
    for d, words in tokens.items():
        for w in words if d not in held else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    found = {r["doc_id"]: r for r in QUERIES["op4_pitman_yor_scores"](spark, folder).collect()}
    assert found.keys() == tokens.keys()
    for d, words in tokens.items():
        r = found[d]
        base = sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (d in held, len(words), sum(w in counts for w in words), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    mean = lambda key: sum(found[d][key] for d in held) / sum(found[d]["n_tokens"] for d in held)
    assert mean("score") > mean("base_score")


def test_language_model_sums_to_one(spark):
    """All words end alike, so that each leads to the same context; one more word is unknown."""
    words = ["aazz", "bbzz", "cczz", "ddzz"]
    texts = [" ".join(words[(i * j) % 4] for j in range(1, 4 + i % 5)) for i in range(60)]
    asked = ["", *words, "qqzz", *(f"aazz {w}" for w in [*words, "qqzz"])]
    held = [i for i in range(100, 1000) if zlib.crc32(str(i).encode()) % 7 == 2][: len(asked)]
    more = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(held, asked)], DOCS)
    scores = {r["doc_id"]: 10 ** r["score"] for r in pitman_yor.scored(docs(spark, *texts).union(more)).collect()}
    p = {t: scores[i] for i, t in zip(held, asked)}
    end = 1 - sum(p[f"aazz {w}"] / p["aazz"] for w in [*words, "qqzz"])  # after a word
    assert 0 < end < 1
    assert p[""] + sum(p[w] / end for w in [*words, "qqzz"]) == pytest.approx(1, abs=1e-9)


def test_seating_follows_its_counts():
    draw = pitman_yor._mix(np.arange(4000), 1)
    tables = pitman_yor._seat(np.full(4000, 50), np.full(4000, 1.0), 0.5, draw, 0)
    rng = np.random.default_rng(0)
    slow = []
    for _ in range(2000):
        t = 1
        for seated in range(1, 50):
            t += rng.random() < 1.0 / (1.0 + seated - 0.5 * t)
        slow.append(t)
    assert abs(tables.mean() - np.mean(slow)) < 0.25
    assert (tables >= 1).all() and (tables <= 50).all()


def test_language_scores_of_odd_rows(spark):
    odd = docs(spark, None, "", " \t\n", "a b", "A B", "x" * 200_000).union(docs(spark, "a b"))
    rows = pitman_yor.scored(odd.union(spark.createDataFrame([(None, "a", None, None, None)], DOCS))).collect()
    assert len(rows) == 8 and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert pitman_yor.scored(docs(spark, "a").limit(0)).count() == 0


def held_out_ids(many, start=1000):
    return [i for i in range(start, start + 20 * many + 200) if zlib.crc32(str(i).encode()) % 7 == 2][:many]


def test_language_contexts_are_whole_words(spark, tmp_path):
    """Words that end alike are different contexts."""
    learned = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [(i, "left cc" if n % 2 else "soft dd", "en", "s", 0) for n, i in enumerate(learned)]
    asked = ["left cc", "left dd", "soft cc", "soft dd"]
    rows += [(i, t, "en", "s", 0) for i, t in zip(held_out_ids(4), asked)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["score"] for r in QUERIES["op4_pitman_yor_scores"](spark, str(tmp_path)).collect()}
    score = dict(zip(asked, (found[i] for i in held_out_ids(4))))
    assert score["left cc"] > score["left dd"] + 1 and score["soft dd"] > score["soft cc"] + 1


def test_language_model_of_words_sums_to_one(spark):
    """With e(w) the chance of an end after w, 1/e(u) = 1 + sum over w of p(u w) / p(u) / e(w): solved for e, which must
    then make the first words and the empty text add to one. One more word is unknown."""
    words = ["a", "bb", "ccc", "dd"]
    texts = [" ".join(words[(i * j) % 4] for j in range(1, 4 + i % 5)) for i in range(300)]
    every = [*words, "unknown"]
    asked = ["", *every, *(f"{u} {w}" for u in every for w in every)]
    more = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(held_out_ids(len(asked)), asked)], DOCS)
    config = pitman_yor.LanguageConfig(context_bytes=None)
    found = {r["doc_id"]: 10 ** r["score"] for r in pitman_yor.scored(docs(spark, *texts).union(more), config).collect()}
    p = dict(zip(asked, (found[i] for i in held_out_ids(len(asked)))))
    step = np.array([[p[f"{u} {w}"] / p[u] for w in every] for u in every])
    ends = 1 / np.linalg.solve(np.eye(5) - step, np.ones(5))
    assert (ends > 0).all() and (ends < 1).all()
    assert p[""] + sum(p[w] / e for w, e in zip(every, ends)) == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("customers", [2, 40, 128, 200])
@pytest.mark.parametrize("root", [False, True])
def test_gibbs_step_draws_from_its_conditional(customers, root):
    discount, j = 0.7, np.arange(1, customers)
    grow = 5 + discount * (300 + j)
    weights = np.log(grow * 0.01) if root else np.log(grow * (3 + j) / (2000 + j))
    logs = np.concatenate([[0], np.cumsum(weights)])
    ways = [0.0] * (customers + 1)
    ways[0] = 1.0
    for c in range(customers):  # generalized Stirling numbers over c!
        ways = [0.0] + [(ways[t - 1] + max(c - discount * t, 0) * ways[t]) / (c + 1) for t in range(1, customers + 1)]
    with np.errstate(divide="ignore"):
        logs = logs + np.log(ways[1:])
    p = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
    many, tables = 8000, np.minimum(np.full(8000, 12), customers)
    whole = lambda x: np.full(many, x)
    for sweep in range(8):
        dish, every = (whole(0.01), np.inf) if root else (whole(3.0), whole(2000.0))
        tables = pitman_yor._resample(whole(customers), tables, whole(300.0), 5.0, discount, dish, every, pitman_yor._mix(np.arange(many), 3), sweep)
    got = np.bincount(tables, minlength=customers + 1)[1:] / many
    assert np.abs(got.cumsum() - p.cumsum()).max() < 0.025


def test_seatings_of_many_customers():
    for discount in (0.1, 0.6, 0.85, 0.95):
        slow = pitman_yor._seatings(160, discount)[160, 1:161]
        fast = pitman_yor._log_seatings(np.full(160, 160.0), np.arange(1.0, 161.0), discount) + math.lgamma(161)
        assert np.abs(fast - slow).max() < 1e-5


def plain_sampler(tokens, held, strength, root_strength, sweeps, burn_in, seed):
    """Scores of texts by a sampler that takes every customer out and seats it again."""
    rng = np.random.default_rng(seed)
    pairs = {}
    for d, words in tokens.items():
        for u, w in zip([0, *words], words) if d not in held else ():
            pairs[u, w] = pairs.get((u, w), 0) + 1
    rare = lambda values: values.count(1) / (values.count(1) + 2 * values.count(2))
    spread = {}
    for _, w in pairs:
        spread[w] = spread.get(w, 0) + 1
    d, d0 = (min(0.95, max(0.1, rare([*x.values()]))) for x in (pairs, spread))
    many = len(spread)
    seats, root, of, eating = {k: [] for k in pairs}, {w: [] for w in spread}, {}, {}
    all_tables, all_customers = 0, 0

    def parent(w):
        at = root.get(w, [])
        return (sum(at) - d0 * len(at) + (root_strength + d0 * all_tables) / (many + 1)) / (root_strength + all_customers)

    def add(u, w):
        nonlocal all_tables, all_customers
        at, base = seats[u, w], parent(w)
        open_ = (strength + d * of.get(u, 0)) * base
        x = rng.random() * (open_ + sum(at) - d * len(at))
        for k, n in enumerate(at):
            x -= n - d
            if x < 0:
                at[k] += 1
                return
        at.append(1)
        of[u] = of.get(u, 0) + 1
        at, open_ = root[w], (root_strength + d0 * all_tables) / (many + 1)
        all_customers += 1
        x = rng.random() * (open_ + sum(at) - d0 * len(at))
        for k, n in enumerate(at):
            x -= n - d0
            if x < 0:
                at[k] += 1
                return
        at.append(1)
        all_tables += 1

    def leave(at):
        x = rng.random() * sum(at)
        for k, n in enumerate(at):
            x -= n
            if x < 0:
                break
        at[k] -= 1
        if at[k] == 0:
            del at[k]
            return True
        return False

    customers = [pair for pair, n in pairs.items() for _ in range(n)]
    for u, _ in customers:
        eating[u] = eating.get(u, 0) + 1
    for u, w in customers:
        add(u, w)
    total = {}
    for sweep in range(sweeps):
        for u, w in customers:
            if leave(seats[u, w]):
                of[u] -= 1
                all_customers -= 1
                all_tables -= leave(root[w])
            add(u, w)
        if sweep >= burn_in:
            for doc, words in tokens.items():
                for u, w in zip([0, *words], words) if doc in held else ():
                    at = seats.get((u, w), [])
                    p = (sum(at) - d * len(at) + (strength + d * of.get(u, 0)) * parent(w)) / (strength + eating.get(u, 0))
                    total.setdefault((u, w), []).append(p)
    log = {k: math.log10(sum(v) / len(v)) for k, v in total.items()}
    return {doc: sum(log[u, w] for u, w in zip([0, *words], words)) for doc, words in tokens.items() if doc in held}


def test_language_scores_are_those_of_a_plain_sampler(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60)
    tokens = {r["doc_id"]: counted([r["text"]])[0] for r in rows.collect()}
    held = {d for d in tokens if zlib.crc32(str(d).encode()) % 7 == 2}
    slow = plain_sampler(tokens, held, 5.0, 10.0, 6, 3, 0)
    config = pitman_yor.LanguageConfig(context_bytes=None)
    found = {r["doc_id"]: (r["score"], r["n_tokens"]) for r in pitman_yor.scored(rows, config).collect()}
    assert held and sum(n for _, n in (found[d] for d in held)) > 1000
    for d in held:
        assert found[d][0] / found[d][1] == pytest.approx(slow[d] / found[d][1], abs=0.02)
    size = sum(found[d][1] for d in held)
    assert sum(found[d][0] for d in held) / size == pytest.approx(sum(slow.values()) / size, abs=0.01)


def test_language_blocks_change_nothing(spark, monkeypatch):
    rows = docs(spark, *(" ".join(f"w{(i * j * j) % (7 + i % 5)}" for j in range(1, 40)) for i in range(150))).repartition(3)
    scores = []
    for many in (1, 9):
        monkeypatch.setattr(pitman_yor, "_shares", lambda total, most, least, many=many: 3 if most == 1 << 20 else many)
        scores.append({r["doc_id"]: r["score"] for r in pitman_yor.scored(rows, pitman_yor.LanguageConfig(context_bytes=None)).collect()})
    assert scores[0] == pytest.approx(scores[1], rel=1e-9)


def test_mixture_meets_its_weights(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 40))), "en", f"s{min(int(i**0.5) // 8, 4)}", 0) for i in range(4000)]
    frame = spark.createDataFrame(rows, DOCS)
    config = mixing.MixingConfig(most_repeats=2.0, target_entropy=0.99)
    mixed = mixing.mix(frame, config).collect()
    assert {r["doc_id"] for r in mixed} == set(range(4000))
    tokens, times, weight, have = {}, {}, {}, {}
    for r in mixed:
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["tokens"]
        times[(r["doc_id"], r["epoch"])] = times.get((r["doc_id"], r["epoch"]), 0) + 1
        weight[r["source"]] = r["weight"]
    for _, text, _, source, _ in rows:
        have[source] = have.get(source, 0) + len(text.split())
    assert set(times.values()) == {1} and sum(weight.values()) == pytest.approx(1)
    budget = max(have[s] / weight[s] for s in have)
    for s in have:
        assert abs(tokens[s] - budget * weight[s]) <= 40 + 1e-6 * budget
        assert tokens[s] / have[s] <= 2.01
    # The exponent is the one of the definition.
    share = {s: have[s] / sum(have.values()) for s in have}
    ratio = max(share.values()) / min(share.values())
    power = 1 - math.log(2.0) / math.log(ratio)
    z = sum(p**power for p in share.values())
    assert all(weight[s] == pytest.approx(share[s] ** power / z, rel=1e-3) for s in have)


def test_a_budget_cuts_every_source(spark):
    rows = [(i, "a b c d e", "en", "big" if i % 3 else "small", 0) for i in range(3000)]
    config = mixing.MixingConfig(target_entropy=0.0, budget=6000)
    mixed = mixing.mix(spark.createDataFrame(rows, DOCS), config)
    sums = dict(mixed.groupBy("source").agg(F.sum("tokens")).collect())
    assert abs(sums["big"] - 4000) <= 5 and abs(sums["small"] - 2000) <= 5
    assert mixed.filter("epoch > 1").count() == 0


def test_mixture_of_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "a b", None, "s", 3), (2, "", "en", "empty", 0), (3, "c", "en", "s", 1)], DOCS)
    rows = mixing.mix(odd.withColumn("tokens", F.lit("mine")).withColumn("key", F.lit(1))).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in rows if r["epoch"] == 1) == [(False, 1), (False, 2), (False, 3), (True, None)]
    assert mixing.mix(odd.limit(0)).count() == 0


def judged(spark, pages, rules=RULES):
    rules = spark.createDataFrame(list(rules), "action string, rule string")
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r["page_id"]: r for r in url_filter.judged_pages(frame, rules).collect()}


def test_url_rules_and_aliases(spark):
    canonical = '<head><link href="https://c.net/x" rel="canonical"></head>'
    refresh = '<meta http-equiv="refresh" content="0; url=https://a.org/fr/1">'
    found = judged(
        spark,
        [
            (1, "https://WWW.Site.net/A", None), (2, "https://b.com/1", canonical), (3, "https://b.com/1#top", ""),
            (4, "http://www.b.com/1?utm_source=x", ""), (5, "https://d.com/2", refresh), (6, "https://sub.example.net/en/x", ""),
            (7, "https://example.net/de/", ""), (8, "https://site.net", ""), (9, None, ""), (10, "no address", canonical),
            (11, "https://e.com/3", canonical + refresh), (11, "https://e.com/3", None), (12, "https://ample.net.com/", ""),
        ],
    )
    verdicts = {n: (r["rule"], r["verdict"]) for n, r in found.items()}
    assert verdicts == {
        1: ("net/", "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "block"), 5: (None, "block"),
        6: ("example.net/en/", "allow"), 7: ("net/", "block"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"),
        11: (None, "block"), 12: (None, "allow"),
    }
    assert (found[1]["host"], found[1]["path"], found[9]["host"], found[10]["path"]) == ("www.site.net", "/A", "", "")


def test_blocks_pass_through_aliases_and_stop_at_rules(spark):
    """Page 11 above ties 5 to a blocked address. Without it, 5 has an allowed alias only, and an own rule beats any alias."""
    to = lambda url: f'<link rel="canonical" href="{url}">'
    pages = [(1, "https://b.com/1", to("https://c.net/x")), (2, "https://d.com/2", to("https://a.org/fr/1")), (3, "https://a.org/fr/2", to("https://c.net/x"))]
    found = {n: (r["verdict"], r["reason"]) for n, r in judged(spark, pages).items()}
    assert found == {1: ("block", "alias"), 2: ("allow", "default"), 3: ("allow", "rule")}
    found = judged(spark, [(1, "https://x.net/", None)], [("block", "net/"), ("allow", "net/")])
    assert (found[1]["rule"], found[1]["verdict"]) == ("net/", "allow")


def test_relative_targets(spark):
    """Canonical links and refreshes that are relative to the page carry verdicts as absolute ones do."""
    cases = [
        ("new.html", "https://H.org/a/b/new.html"), ("../a", "https://h.org/a/a"), ("?id=3", "https://h.org/a/b/c?id=3"), ("./", "https://h.org/a/b/"),
        ("../../../x?y=http://z.org", "https://h.org/x?y=http://z.org"), ("/r/./s", "https://h.org/r/s"), ("#top", "https://h.org/a/b/c?q=1#top"),
        ("//k.org/1", "https://k.org/1"), ("http://k.org/1", "http://k.org/1"), ("..", "https://h.org/a/"), ("mailto:a@b.cd", None),
    ]
    frame = spark.createDataFrame([(t, "https://h.org/a/b/c?q=1#f") for t, _ in cases], "target string, url string")
    told = [r[0] for r in frame.select(url_filter.absolute(F.col("target"), F.col("url"))).collect()]
    assert told == [w.replace("H.org", "h.org") if w else None for _, w in cases]
    page = lambda to: f'<link rel="canonical" href="{to}">'
    rules = [("block", "h.org/a/new"), ("block", "g.org/x/")]
    found = judged(spark, [(1, "https://h.org/a/old", page("new.html")), (2, "https://g.org/y/1", page("../x/2")), (3, "https://g.org/y/3", None)], rules)
    assert {n: r["verdict"] for n, r in found.items()} == {1: "block", 2: "block", 3: "allow"}


def test_url_query_on_linked_pages(spark, tmp_path):
    """The SQL of the query resolves relative targets and carries blocks as the operator does."""
    from quillseek.llm.queries import ORACLE
    from tests.oracle import compare

    to = lambda *urls: "".join(f'<link rel="canonical" href="{u}">' for u in urls[:1]) + "".join(f'<meta http-equiv="refresh" content="0; url={u}">' for u in urls[1:])
    targets = ["x", "../y", "?q=2", "#f", "/z/./a", "//bad.net/q", "https://www.bad.net/1?utm_x=2", "http://good.org/fr/3", "mailto:a@b.c", "..", "./", "", "a/../../b.html"]
    pages = [(i, f"https://{'www.' * (i % 2)}h{i % 5}.{['com', 'net', 'org'][i % 3]}/{'fr/' * (i % 4 == 0)}p{i % 6}/{i % 7}", to(targets[i % 13], targets[(i * 5 + 3) % 13])) for i in range(120)]
    pages += [(200, None, to("x")), (201, "no address", to("x")), (202, "https://example.com/de", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    import os
    import shutil

    part = next(p for p in os.listdir(tmp_path / "pages.parquet") if p.endswith(".parquet"))
    (tmp_path / "one").mkdir()
    shutil.copy(tmp_path / "pages.parquet" / part, tmp_path / "one" / "pages.parquet")
    assert compare(spark, QUERIES["op6_url_aliases"], ORACLE["op6_url_aliases"], str(tmp_path / "one")) == (123, "")


def test_urls_of_nothing(spark):
    assert judged(spark, []) == {}


def slow_print(text, words=3):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: slow_print(r["text"]) for r in rows}
    ids = sorted(prints)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3]
    wanted = {d: (f"{prints[d]:016x}", root) for d, root in union_find(ids, links).items()}
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op7_simhash_popcounts"](spark, folder).collect()}
    assert found == wanted


def test_simhash_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(8)
    prints = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)]
    for x in list(prints):
        for _ in range(20):
            for bit in rng.choice(64, int(rng.integers(1, 7)), replace=False):
                x ^= (1 << int(bit)) - (1 << 64 if bit == 63 else 0)
            prints.append(x)
    prints = sorted(set(prints))
    links = [(a, b) for n, a in enumerate(prints) for b in prints[n + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    wanted = union_find(prints, links)
    frame = spark.createDataFrame([(x,) for x in prints], "fp long")
    parts = dict(connected_components(simhash.near_links(frame)).collect())
    found = {x: parts.get(x, x) for x in prints}
    assert found == wanted


def test_simhash_of_odd_rows(spark):
    odd = docs(spark, None, "", " ", "one", "One", "a b").union(spark.createDataFrame([(None, "one", None, None, None), (3, "one", "", "", 3)], DOCS))
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 8 and {r["component_id"] for r in rows if r["doc_id"] in (0, 1, 2)} == {0}
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [3]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_similar_documents(spark):
    """Copies with changed words are found, texts that share only a passage are not."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), size=6))
    passage = [word() for _ in range(60)]
    texts, family = [], []
    for f in range(12):
        base = [word() for _ in range(int(rng.integers(80, 600)))]
        base[20:20] = passage
        for k in range(1 + f):
            copy = list(base)
            for i in rng.choice(len(copy), int(len(copy) * 0.015 * (k > 0)), replace=False):
                copy[i] = word()
            texts.append(" ".join(copy))
            family.append(f)
    order = rng.permutation(len(texts))
    found = dict(simhash.similar_documents(docs(spark, *[texts[i] for i in order], None, "", "one")).collect())
    first = {}
    for d, i in enumerate(order):
        first.setdefault(family[i], d)
    wanted = {d: first[family[i]] for d, i in enumerate(order)}
    missed = sum(found[d] != w for d, w in wanted.items())
    assert missed <= 3 and all(found[d] >= wanted[d] for d in wanted)
    n = len(texts)
    assert (found[n], found[n + 1], found[n + 2]) == (n, n, n + 2)


def test_similar_documents_of_large_groups(spark, monkeypatch):
    """Groups of more texts than a block give the classes of one block."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), size=6))
    base = [word() for _ in range(300)]
    texts = [" ".join(base[:i] + [word()] + base[i + 1 :]) for i in range(0, 300, 4)]
    monkeypatch.setattr(simhash, "_BLOCK", 10)
    found = dict(simhash.similar_documents(docs(spark, *texts)).collect())
    assert set(found.values()) == {0}
    assert simhash.similar_documents(docs(spark, "a").limit(0)).count() == 0


def near_pair(rng, size):
    """A text of ``size`` words and one without its last words, of similarity 0.80 to 0.85 or the next above."""
    text = [f"w{n}" for n in rng.integers(0, 1 << 40, size)]
    kept = next(k for k in range(5, size) if (k - 4) / (size - 4) >= 0.8)
    return " ".join(text), " ".join(text[:kept])


def test_samples_of_short_texts_meet():
    """Texts of similarity 0.8, of 10 to 100 words, share a sample as often as long ones."""
    rng = np.random.default_rng(8)
    for size in (10, 14, 24, 44, 64, 100):
        shared = 0
        for _ in range(300):
            a, b = (simhash._signature(simhash._hashes(text, 5))[2] for text in near_pair(rng, size))
            shared += any(x == y for x, y in zip(a, b))
        assert shared >= 297, (size, shared)


def test_similar_documents_are_verified(spark):
    """Short texts are linked if 0.8 of their shingles are in common, and not at 0.65 to 0.79."""
    rng = np.random.default_rng(9)
    texts, wanted = [], []
    for size in (14, 24, 44, 64, 100) * 12:
        a, b = near_pair(rng, size)
        below = b.split()
        while (len(below) - 4) / (size - 4) >= 0.8 - 0.06 * (len(wanted) % 3):
            below.pop()
        for other, alike in ((b, True), (" ".join(below), False)):
            own = [f"{len(texts)}{word}" for word in a.split()]
            texts += [" ".join(own), " ".join(own[: len(other.split())])]
            wanted.append(alike)
    found = dict(simhash.similar_documents(docs(spark, *texts)).collect())
    linked = [found[2 * n + 1] == 2 * n for n in range(len(wanted))]
    assert not any(got for got, alike in zip(linked, wanted) if not alike)
    assert sum(got for got, alike in zip(linked, wanted) if alike) >= 59


def test_fingerprints_link_by_themselves(spark):
    """Within three bits texts are linked even if their sets of shingles differ: a passage that is repeated outweighs the rest."""
    repeated = " ".join(f"w{n}" for n in range(11)) + " "
    texts = [repeated * 200 + " ".join(f"{name}{n}" for n in range(40)) for name in "ab"]
    prints = [simhash._fingerprint(simhash._hashes(text, 5)) for text in texts]
    assert ((prints[0] ^ prints[1]) & (2**64 - 1)).bit_count() <= 3
    found = dict(simhash.similar_documents(docs(spark, *texts, "another text with words of its own")).collect())
    assert found == {0: 0, 1: 0, 2: 2}


def test_dense_fingerprints_are_folded_by_cells(spark, monkeypatch):
    """All settings of eleven bits: folding makes two rows of each fingerprint, and classes are whole."""
    bits = [0, 1, 5, 9, 20, 31, 32, 40, 41, 50, 62]
    prints = [sum(((n >> i) & 1) << bit for i, bit in enumerate(bits)) for n in range(1 << len(bits))]
    made, unnest = [], simhash.unnest
    monkeypatch.setattr(simhash, "unnest", lambda *args, **kwargs: made.append(unnest(*args, **kwargs)) or made[-1])
    frame = spark.createDataFrame([(x,) for x in [*prints, 7 << 54]], "fp long")
    parts = dict(connected_components(simhash.near_links(frame)).collect())
    assert {parts[x] for x in prints} == {0} and parts.get(7 << 54, 7 << 54) == 0
    assert made[0].count() == 2 * (len(prints) + 1)


ITEM = "If Anna buys 12 red apples for 3 dollars each and gives away 5 apples to Peter how many apples does Anna have"


def leaked(spark, texts, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.leaks(docs(spark, *texts), bench).collect()}


def test_leaks(spark):
    filler = " and some other words that stand around it in the text of a document"
    other = ITEM.replace("12", "40").replace("Anna", "Clara").replace("Peter", "Tom").replace("5", "7")
    mixed_up = other.replace("does Clara", "does Zoe").replace("3 dollars", "9 euros")
    texts = [filler + " " + ITEM + filler, ITEM.lower(), filler + other, filler * 9, ITEM[:40], None, "", "short item", filler + " " + mixed_up]
    found = leaked(spark, texts, [(1, ITEM), (2, "short item"), (3, None), (4, "")])
    assert {k: v for k, v in found.items() if k[0] != 8} == {(0, 1): "verbatim", (1, 1): "verbatim", (2, 1): "template", (7, 2): "verbatim"}


def test_inconsistent_slots_do_not_leak(spark):
    item = " ".join(f"then add {n} to the pile" for n in (4, 4, 4, 4, 4, 4))
    same = item.replace("4", "9")
    other = " ".join(f"then add {n} to the pile" for n in (1, 2, 3, 5, 6, 7))
    assert leaked(spark, [same, other], [(1, item)]) == {(0, 1): "template"}


def test_one_of_several_copies_leaks(spark):
    """Two copies of one question with other values each, also where a few words were put in."""
    copy = lambda a, b, n, m: ITEM.replace("12", n).replace("Anna", a).replace("Peter", b).replace("5", m)
    first, second = copy("Clara", "Tom", "40", "7"), copy("Zoe", "Max", "31", "8")
    longer = second.replace("gives away", "then later gives away")
    texts = [f"so {first} . and {second} .", f"so {first} . {longer} {ITEM[:30]}"]
    found = leaked(spark, texts, [(1, ITEM)])
    assert found.get((0, 1)) == found.get((1, 1)) == "template"
    rows = spark.createDataFrame([(None, texts[0])], "doc_id long, text string")
    items = spark.createDataFrame([(None, ITEM)], "item_id long, text string")
    assert [r["kind"] for r in decontaminate.leaks(rows, items).collect()] == ["template"]


def test_names_at_the_start_of_sentences(spark):
    """A question whose sentences begin with names leaks with other names; with names mixed up it does not."""
    item = (
        "{a} has 14 green marbles in a bag . {b} takes 6 of them away on Monday . {a} then buys 9 more at the shop . "
        "{b} wants to know how many marbles are in it now ?"
    )
    mixed_up = item.replace("14 green", "{c} green").format(a="Olga", b="Ivan", c=20).replace("Olga then", "Nils then").replace("Ivan wants", "Maja wants")
    found = leaked(spark, ["so . " + item.format(a="Olga", b="Ivan") + " end", "so . " + mixed_up + " end"], [(1, item.format(a="Anna", b="Peter"))])
    assert found == {(0, 1): "template"}


def test_leaks_of_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    planted = {(r["doc_id"], i["item_id"]) for r in rows for i in items if i["text"] in r["text"]}
    found = QUERIES["op8_template_leaks"](spark, folder).collect()
    assert planted <= {(r["doc_id"], r["item_id"]) for r in found}
    assert len(found) <= len(planted) * 1.2 + 3


def slow_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m.group())
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"\D", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_against_their_patterns():
    rng = np.random.default_rng(2)
    for _ in range(3000):
        text = "".join(rng.choice(list("ab1279+@@.. -()é"), size=40))
        assert pii.base_spans(text) == slow_spans(text)
    text = "a@b.c@d.e.f x@y..z @q.r 4111 1111-1111 1111 +1 (988) 555-2485 300.1.1.1 1.2.3.4.5"
    assert pii.base_spans(text) == slow_spans(text)


def test_personal_data_of_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    for r in QUERIES["op9_boosted_pii"](spark, folder).collect():
        base = slow_spans(texts[r["doc_id"]])
        told = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == n for x in base) for n in range(4)]
        assert set(told.split(",")) - {""} <= set(r["spans"].split(","))


def test_personal_data_in_other_formats(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    models = pii.fit(frame)
    for text in ("please call 988-555-2485 today", "write to anna.berg (at) mail7.example.com soon", "the card 4111.1111.1111.1111 was"):
        base, spans = pii.found_in(text, models, 0.9)
        assert base == [] and len(spans) == 1, text
    for text in ("version 2.0.1 of 1999", "The license 4.0. and 12 items", "on 2024-01-05 at 10:30"):
        assert pii.found_in(text, models, 0.9)[1] == [], text


def test_personal_data_mostly_in_other_formats(spark):
    """Data in formats that no base pattern accepts are found where they are the most common ones."""
    rng = np.random.default_rng(5)
    number = lambda *sizes: ["".join(map(str, rng.integers(2, 10, size))) for size in sizes]
    texts = []
    for n in range(400):
        a, b, c = number(3, 3, 4)
        texts.append(f"call {a}-{b}-{c} or write to ann{n} (at) mail{n % 7}.example.com on 2024-0{n % 9 + 1}-05 , version 2.0.{n}")
        if n % 8 == 0:
            texts.append(f"call +1 {b} {a} {c} or write to bob{n}@mail{n % 7}.example.com soon")
    models = pii.fit(docs(spark, *texts))
    for text in ("call 988-555-2485 or so", "write to anna (at) mail3.example.com soon"):
        base, spans = pii.found_in(text, models, 0.9)
        assert base == [] and len(spans) == 1, text
    for text in ("on 2024-01-05 , version 2.0.17", "version 2.0.1 of 1999"):
        assert pii.found_in(text, models, 0.9)[1] == [], text


def test_personal_data_and_what_looks_like_it(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    models = pii.fit(frame)
    assert all(m.precision >= 0.99 and m.recall >= 0.95 for m in models), [(m.sure, m.precision, m.recall) for m in models]
    for text in ("mail bob (at) site.org", "anna at mail dot example dot com", "call (212) 555-1234", "host 10-20-30-40", "pay by 4111/1111/1111/1111"):
        assert len(pii.found_in(text, models)[1]) == 1, text
    for text in (
        "see part 555-123-4567", "release 10-20-30-40", "order 555.123.4567", "host 300-2-3-4", "pay by 4111/1111/1111/1112",
        "born 1984-12-05", "we met at noon. Then", "from at and. Of", "isbn 555-123-4567",
    ):
        assert pii.found_in(text, models)[1] == [], text


def test_personal_data_of_clean_texts(spark):
    """No batch holds a candidate; one id is repeated."""
    clean = docs(spark, *["plain words only"] * 10).repartition(4)
    assert [r["spans"] for r in pii.redacted(clean).collect()] == [""] * 10
    mixed = clean.union(spark.createDataFrame([(5, f"mail a{i}@b.cd", "en", "s", 0) for i in range(50)], DOCS))
    assert sum(r["spans"] != "" for r in pii.redacted(mixed).collect()) == 50


def test_personal_data_of_odd_rows(spark):
    odd = docs(spark, None, "", "a@b.cd", "1" * 50_000).withColumn("spans", F.lit("mine"))
    rows = {r["doc_id"]: r for r in pii.redacted(odd).collect()}
    assert rows[2]["redacted"] == "<email>" and rows[2]["spans"] == "email:0:6" and rows[0]["spans"] == "" and rows[0]["redacted"] is None
    assert pii.redacted(odd.limit(0)).count() == 0


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    found = QUERIES["op10_crf_toxicity"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = found.join(labels, "doc_id").filter("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    toxic = [r for r in rows if r["toxic"] == 1]
    clean = [r for r in rows if r["toxic"] == 0]
    print("recall", sum(r["predicted"] for r in toxic) / len(toxic), "false", sum(r["predicted"] for r in clean) / len(clean))
    assert sum(r["predicted"] for r in toxic) / len(toxic) >= 0.8
    assert sum(r["predicted"] for r in clean) / len(clean) <= 0.02


def test_field_marginals_against_all_taggings():
    model = toxicity.Field()
    model.move = np.array([[0.3, -0.7], [0.2, 0.9]])
    scores = np.array([0.5, -1.0, 2.0, 0.1, -0.4, 1.0])
    found = model.marginals(scores, np.array([0, 4, 4, 6]))
    for start, end in ((0, 4), (4, 6)):
        total, marked = 0.0, np.zeros(end - start)
        for tags in np.ndindex(*[2] * (end - start)):
            s = sum(scores[start + i] for i, t in enumerate(tags) if t) + sum(model.move[a, b] for a, b in zip(tags, tags[1:]))
            total += math.exp(s)
            marked += np.array(tags) * math.exp(s)
        assert np.allclose(found[start:end], marked / total)


def test_field_gradient_against_all_taggings():
    """The gradient by every word's score and every move is the one of the likelihood, summed over all taggings."""
    rng = np.random.default_rng(4)
    model = toxicity.Field()
    model.move = rng.normal(size=(2, 2))
    scores, ends, labels = rng.normal(size=9), np.array([0, 4, 5, 5, 9]), rng.integers(0, 2, 9)

    def loss(scores, move):
        total = 0.0
        for a, b in zip(ends[:-1], ends[1:]):
            value = lambda tags: sum(scores[a + i] for i, t in enumerate(tags) if t) + sum(move[x, y] for x, y in zip(tags, tags[1:]))  # noqa: B023, E731
            total += math.log(sum(math.exp(value(tags)) for tags in np.ndindex(*[2] * (b - a)))) - value(labels[a:b])
        return total

    by_score, by_move = toxicity.gradient(model, scores, ends, labels)
    step = 1e-6
    for i in range(9):
        moved = scores + step * (np.arange(9) == i)
        assert by_score[i] == pytest.approx((loss(moved, model.move) - loss(scores, model.move)) / step, abs=1e-4)
    for i in (0, 1):
        for j in (0, 1):
            moved = model.move.copy()
            moved[i, j] += step
            assert by_move[i, j] == pytest.approx((loss(scores, moved) - loss(scores, model.move)) / step, abs=1e-4)


def test_toxicity_from_a_few_documents(spark):
    texts = [f"word{i % 7} plain text number{i} {'vilest insult here' if i % 5 == 1 else 'all is well'} end" for i in range(60)]
    frame = docs(spark, *texts)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 1)) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = toxicity.scored_documents(frame, labels).collect()
    assert all(r["predicted"] == (r["doc_id"] % 5 == 1) for r in rows)


def test_toxicity_of_one_repeated_id(spark):
    """A third of all rows share a labelled id: the sample still holds one row for each id."""
    same = spark.createDataFrame([(1, f"copy {i} vilest insult", "en", "s", 0) for i in range(300)], DOCS)
    frame = docs(spark, *[f"plain words {i}" if i % 4 else f"vilest insult {i}" for i in range(2, 600)], start=2).union(same)
    labels = spark.createDataFrame([(i, 1, int(i == 1 or (i - 2) % 4 == 0)) for i in range(1, 600)], "doc_id long, quality int, toxic int")
    rows = toxicity.scored_documents(frame, labels).collect()
    assert len(rows) == 898 and sum(r["predicted"] for r in rows if r["doc_id"] == 1) == 300


def test_toxicity_of_odd_rows(spark):
    odd = docs(spark, None, "", "x " * 50_000, "a").withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.scored_documents(odd, labels).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.scored_documents(odd.limit(0), labels).count() == 0
    assert toxicity.scored_documents(odd, labels.limit(0)).count() == 4


def test_words_of_slices():
    import pyarrow as pa

    from quillseek.llm.tokens import coded_words

    texts = [" A bé\tC ", None, "", "d  D\n", "e" * 100, "F g"]
    for start in range(6):
        words, codes, offsets = coded_words(pa.array(texts).slice(start), lower=True)
        found = [[words[c] for c in codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:])]
        assert found == [[w.decode() for w in (t or "").encode().lower().split()] for t in texts[start:]]
