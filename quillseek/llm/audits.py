"""Cheapest edits of a run of rows: a dynamic program whose edit sequences are linked nodes that share prefixes."""

from __future__ import annotations

from dataclasses import dataclass, field

# States: nothing kept yet, after a system row, after a user's, after an assistant's.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = "KRDI"
_COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
_TRUNCATED = 5
# From each state: the state after so many inserted rows. More would only cost more.
_INSERTS = {EMPTY: ((EMPTY, 0), (USER, 1), (ASSISTANT, 2)), SYSTEM: ((SYSTEM, 0), (USER, 1), (ASSISTANT, 2)), USER: ((USER, 0), (ASSISTANT, 1)), ASSISTANT: ((ASSISTANT, 0), (USER, 1))}
_PRIME = (1 << 61) - 1
_BASE = 1_000_003


class Edits:
    """Edit sequences as nodes: the letter before each node, ancestors at distances 1, 2, 4, ..., length and a rolling hash.

    Node 0 is the empty sequence. ``base`` and ``prime`` of the hash can be set, so that tests can force collisions.
    """

    def __init__(self, base: int = _BASE, prime: int = _PRIME):
        self.base, self.prime = base, prime
        self.letters, self.above, self.lengths, self.hashes = [""], [[]], [0], [0]
        self.proved: set[tuple[int, int]] = set()

    def add(self, node: int, letter: str) -> int:
        above, at = [node], 0
        while len(self.above[above[at]]) > at:
            above.append(self.above[above[at]][at])
            at += 1
        self.letters.append(letter)
        self.above.append(above)
        self.lengths.append(self.lengths[node] + 1)
        self.hashes.append((self.hashes[node] * self.base + ord(letter)) % self.prime)
        return len(self.letters) - 1

    def extend(self, node: int, letters: str) -> int:
        for letter in letters:
            node = self.add(node, letter)
        return node

    def spelled(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letters[node])
            node = self.above[node][0]
        return "".join(reversed(out))

    def _cut(self, node: int, length: int) -> int:
        """The ancestor of this length."""
        while (over := self.lengths[node] - length) > 0:
            node = self.above[node][over.bit_length() - 1]
        return node

    def _alike(self, a: int, b: int) -> bool:
        """Whether two nodes of equal length and hash spell the same, letter by letter as far as they are not
        one node or proved already."""
        seen = []
        while a != b and (a, b) not in self.proved:
            if self.letters[a] != self.letters[b]:
                return False
            seen.append((a, b))
            a, b = self.above[a][0], self.above[b][0]
        self.proved.update(seen)
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether ``a`` is before ``b`` in ASCII order. The longest common prefix is searched by hashes of ancestors; what
        they say is verified, and a collision leads to a comparison of the letters."""
        length = min(self.lengths[a], self.lengths[b])
        x, y = self._cut(a, length), self._cut(b, length)
        if self.hashes[x] == self.hashes[y]:
            if self._alike(x, y):
                return self.lengths[a] < self.lengths[b]
            return self.spelled(a) < self.spelled(b)
        for k in range(len(self.above[x]) - 1, -1, -1):
            if k < len(self.above[x]):
                p, q = self.above[x][k], self.above[y][k]
                if self.hashes[p] != self.hashes[q]:
                    x, y = p, q
        if self.letters[x] != self.letters[y] and self._alike(self.above[x][0], self.above[y][0]):
            return self.letters[x] < self.letters[y]
        return self.spelled(a) < self.spelled(b)

    def least(self, nodes: list[int]) -> int:
        best = nodes[0]
        for node in nodes[1:]:
            if self.less(node, best):
                best = node
        return best


def steps(state: int, initial: str, doomed: bool, truncated: bool) -> list[tuple[int, str, int]]:
    """``(state after, letter, cost)`` of what can be done with a row: blank and repeated rows can only go."""
    out = [(state, DELETE, _COSTS[DELETE])]
    if not doomed:
        more = _TRUNCATED if truncated else 0
        after = ASSISTANT if state == USER else USER
        if initial == "s" and state == EMPTY:
            out.append((SYSTEM, KEEP, more))
        if initial == "ua"[after == ASSISTANT]:
            out.append((after, KEEP, more))
        out.append((after, REROLE, more + _COSTS[REROLE]))
    return out


_MOVES: dict[tuple[str, bool, bool], list[tuple[int, int, str, int]]] = {}


def moves(initial: str, doomed: bool, truncated: bool) -> list[tuple[int, int, str, int]]:
    """``(state, state after, letters, cost)``: inserted rows, then what is done with a row."""
    key = (initial if initial in ("s", "u", "a") else "", doomed, truncated)
    if key not in _MOVES:
        _MOVES[key] = [
            (state, after, INSERT * many + letter, many * _COSTS[INSERT] + cost)
            for state, inserts in _INSERTS.items()
            for middle, many in inserts
            for after, letter, cost in steps(middle, *key)
        ]
    return _MOVES[key]


@dataclass
class Run:
    """The program over rows added one after another, from each of the ``starts``: ``best[start][state]`` is the least
    cost and the node of the ASCII-least of the cheapest edits. Inserted rows stand before a row, never last: so edits
    of equally many rows are never a prefix of each other, and runs can be put together."""

    starts: tuple[int, ...]
    edits: Edits = field(default_factory=Edits)

    def __post_init__(self):
        self.best = {start: {start: (0, 0)} for start in self.starts}

    def add(self, initial: str, doomed: bool, truncated: bool) -> None:
        ways = moves(initial, doomed, truncated)
        edits = self.edits
        for start, now in self.best.items():
            found: dict[int, tuple[int, list[tuple[int, str]]]] = {}
            for state, after, letters, cost in ways:
                if state in now:
                    cost += now[state][0]
                    known = found.get(after)
                    if known is None or cost < known[0]:
                        found[after] = (cost, [(now[state][1], letters)])
                    elif cost == known[0]:
                        known[1].append((now[state][1], letters))
            self.best[start] = {
                after: (cost, edits.extend(*ways[0]) if len(ways) == 1 else edits.least([edits.extend(*way) for way in ways]))
                for after, (cost, ways) in found.items()
            }

    def order(self, start: int) -> dict[int, int]:
        """The place of each state's edits in ASCII order; they all differ, as edits decide the state."""
        nodes = {state: node for state, (_, node) in self.best[start].items()}
        return {state: sum(self.edits.less(other, node) for other in nodes.values() if other != node) for state, node in nodes.items()}


def ending(costs: dict[int, int], order: dict[int, int]) -> tuple[int, int, int]:
    """``(state, inserted rows after it, cost)`` of the cheapest whole audit, ASCII-least of equals."""
    last = {EMPTY: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
    state = min(costs, key=lambda s: (costs[s] + last[s] * _COSTS[INSERT], order[s]))
    return state, last[state], costs[state] + last[state] * _COSTS[INSERT]


def repaired(audit: str, rows: list[tuple[str, str]], state: int) -> list[tuple[str, str]]:
    """Rows ``(role, text)`` after the edits, from a state on."""
    out, at = [], 0
    for letter in audit:
        role, text = rows[at] if letter != INSERT else ("", "")
        at += letter != INSERT
        if letter == DELETE:
            continue
        if letter == KEEP and role[:1] == "s":
            state = SYSTEM
        else:
            state = ASSISTANT if state == USER else USER
            if letter != KEEP:
                role = "assistant" if state == ASSISTANT else "user"
        out.append((role, text))
    return out
