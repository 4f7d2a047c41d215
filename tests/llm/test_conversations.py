"""Audits against all edits of short conversations, and against a plain program over whole strings."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from quillseek.llm import audits, conversations

ROWS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """``rows (role, text)`` in order: the first fault of each."""
    seen, out = set(), []
    for role, text in rows:
        kept = re.findall("[^\x20\x09-\x0d]", text)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least cost, audit and lines among all edits with at most two inserted rows at a place."""
    found = faults(rows)
    choices = []
    for (role, text), fault in zip(rows, found):
        inserted = [("", [], 0)] + [("I" * n, [(r, "") for r in roles], 5 * n) for n in (1, 2) for roles in itertools.product(("user", "assistant"), repeat=n)]
        more = 5 * (fault == "truncated")
        done = [("D", [], 2)]
        if fault not in ("blank", "duplicate"):
            done += [("K", [(role, text)], more)] + [("R", [(r, text)], more + 1) for r in ("user", "assistant")]
        choices.append([(a + b, x + y, c + d) for a, x, c in inserted for b, y, d in done])
    choices.append([("", [], 0), ("I", [("user", "")], 5), ("I", [("assistant", "")], 5)] + [("II", [(r, ""), (s, "")], 10) for r in ("user", "assistant") for s in ("user", "assistant")])
    best = None
    for parts in itertools.product(*choices):
        lines = [line for _, some, _ in parts for line in some]
        if any(not role for role, _ in lines) or not LEGAL.fullmatch("".join(role[:1] for role, _ in lines)):
            continue
        one = (sum(p[2] for p in parts), "".join(p[0] for p in parts), lines)
        best = min(best or one, one)
    return best


def plain(rows):
    """The same by a program over whole strings, for conversations of any length."""
    now = {0: (0, "", [])}
    for (role, text), fault in zip(rows, faults(rows)):
        nxt = {}
        for state, (cost, audit, lines) in now.items():
            for middle, more in ((s, m) for s, m in audits._INSERTS[state]):
                added, at = [], state
                for _ in range(more):
                    at = 3 if at == 2 else 2
                    added.append(("assistant" if at == 3 else "user", ""))
                for after, letter, price in audits.steps(middle, role[:1], fault in ("blank", "duplicate"), fault == "truncated"):
                    line = [] if letter == "D" else [(role, text)] if letter == "K" else [("assistant" if after == 3 else "user", text)]
                    one = (cost + 5 * more + price, audit + "I" * more + letter, lines + added + line)
                    if after not in nxt or one[:2] < nxt[after][:2]:
                        nxt[after] = one
        now = nxt
    last = {0: [], 1: [("user", ""), ("assistant", "")], 2: [("assistant", "")], 3: []}
    return min((c + 5 * len(last[s]), a + "I" * len(last[s]), x + last[s]) for s, (c, a, x) in now.items())


def report(rows):
    """``rows (conv_id, turn, role, text)``: what is expected of each conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0], r[1].encode(), r[2][:64].encode(), hashlib.sha256(r[2].encode()).digest()))
        lines = [r[1:] for r in mine]
        turns = [r[0] for r in mine if r[0] is not None]
        found = faults(lines)
        cost, audit, fixed = plain(lines)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in fixed).encode()).hexdigest()
        out[conv] = (gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def repaired(spark, rows, config=conversations.RepairConfig(), schema=ROWS):
    blocks = conversations.repair(spark.createDataFrame(rows, schema), None, config)
    got = conversations.audit_report(blocks).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def some_rows(seed, conversations_, longest, roles=("user", "assistant", "system", "tool")):
    rng = np.random.default_rng(seed)
    texts = ["Yes.", "No!", "why", "", "  \n", "Long answer?", "so. ", "end.\x0b"]
    return [
        (conv, turn, str(rng.choice(roles, p=[0.4, 0.35, 0.15, 0.1])), str(rng.choice(texts)) + ("" if rng.random() < 0.5 else f" {rng.integers(30)}."))
        for conv in range(conversations_)
        for turn in sorted(rng.choice(3 * longest, int(rng.integers(1, longest + 1)), replace=False).tolist())
    ]


@pytest.mark.parametrize("seed", range(4))
def test_program_against_all_edits(seed):
    for conv, rows in itertools.groupby(some_rows(seed, 12, 3), key=lambda r: r[0]):
        lines = [r[2:] for r in rows]
        assert plain(lines) == cheapest(lines)


def test_order_of_edits():
    """Every comparison of sequences is that of their letters, also where nearly all hashes collide."""
    rng = np.random.default_rng(2)
    for prime in (audits._PRIME, 7, 1):
        edits = audits.Edits(prime=prime)
        nodes = [0]
        for _ in range(300):
            nodes.append(edits.extend(nodes[int(rng.integers(max(0, len(nodes) - 40), len(nodes)))], "".join(rng.choice(list("DIKR"), int(rng.integers(1, 4))))))
        for a, b in rng.choice(nodes, (3000, 2)).tolist():
            assert edits.less(a, b) == (edits.spelled(a) < edits.spelled(b))
        some = rng.choice(nodes, 50).tolist()
        assert edits.spelled(edits.least(some)) == min(map(edits.spelled, some))


@pytest.mark.parametrize("rows", [2, 5, 2048])
def test_repair_against_plain_program(spark, rows):
    """Long conversations too, in segments of two rows up to one."""
    data = some_rows(9, 40, 6) + [(100 + c, t, r, x) for c, t, r, x in some_rows(10, 3, 200)]
    assert repaired(spark, data, conversations.RepairConfig(rows=rows)) == report(data)


def test_repair_of_one_hot_conversation(spark):
    data = [(c, t, r, x) for c, t, r, x in some_rows(11, 30, 5)] + [(1000, t, r, f"{x} {t}.") for _, t, r, x in some_rows(12, 1, 3000)]
    data += [(1000, 9000 + i, "user", "the same again.") for i in range(500)]
    assert repaired(spark, data, conversations.RepairConfig(rows=100)) == report(data)


def test_repair_of_odd_rows(spark):
    data = [
        (None, None, None, None), (None, 1, "user", "a."), (1, None, "user", "Hi."), (1, None, "user", "Hi."), (1, None, "assistant", None), (2, 5, "", "x."), (2, 6, "s", "sys."),
        (2, 7, "User", "case."), (3, 1, "user", "w " * 300_000 + "."), (3, 2, "assistant", "w " * 300_000), (4, -3, "assistant", " "), (4, 4, "user", " é!"), (5, 1, "system", "only."),
    ]
    data += [(6, 1, "user", "same."), (6, 1, "user", "same.")] * 3 + [(6, 1, "assistant", "b."), (6, 2, "user", "c.")]
    expected = report(data)
    assert repaired(spark, data, conversations.RepairConfig(rows=3, chars=1000)) == expected
    wide = [(*row, 1, "k", 2, 3, True) for row in data]
    assert repaired(spark, wide, schema=ROWS + ", part int, kind string, seq int, mid int, whole boolean") == expected


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], ROWS)
    assert conversations.audit_report(conversations.repair(none)).collect() == []
    every = spark.createDataFrame([(7,), (7,), (None,)], "conv_id long")
    got = {tuple(r) for r in conversations.audit_report(conversations.repair(none, every)).collect()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {(7, *empty), (None, *empty)}


def test_damage(spark):
    data = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in (0, 1, 5, None)] + [(None, 3, None, None)]
    expected = []
    for c, t, role, text in data:
        name = f"{' ' if c is None else c}:{' ' if t is None else t}"
        fate = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (c, t, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
        expected += [row] * (0 if fate == 0 else 2 if fate == 3 else 1)
    got = map(tuple, conversations.damaged(spark.createDataFrame(data, ROWS)).collect())
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_repaired_lines(spark):
    data = some_rows(13, 20, 8)
    blocks = conversations.repair(spark.createDataFrame(data, ROWS), None, conversations.RepairConfig(rows=4)).orderBy("part", "seq").collect()
    for conv in {r[0] for r in data}:
        lines = [tuple(x) for b in blocks if b["conv_id"] == conv for x in b["lines"]]
        assert LEGAL.fullmatch("".join(role[:1] for role, _ in lines))
        assert lines == plain([r[2:] for r in sorted((d for d in data if d[0] == conv), key=lambda r: r[1])])[2]
