"""Personal data: fixed formats, and further spans that boosted trees accept among many candidates."""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillseek.llm.common import others

KINDS = ("email", "ip", "card", "phone")

# The base formats. A match that fails its test is dropped and not tried again.
_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Candidates for further spans, on purpose too many: they overlap each other and the base formats.
_NUMBERS = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9][0-9 ().:/_-]{4,40}[0-9](?![0-9A-Za-z])")
_ADDRESS = re.compile(
    r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}"
    r"(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{1,63}){1,5}"
)
_CUES = {
    "email": ("mail", "contact", "write", "reach", "address"),
    "ip": ("ip", "host", "server", "addr", "login"),
    "card": ("card", "visa", "credit", "account", "paid", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "contact", "cell"),
}


def luhn(digits: str) -> bool:
    total = 0
    for n, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + n % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, number of kind, end)`` of the base formats, sorted."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _EMAIL_LOCAL:
            start -= 1
        match = _EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, 0, match.end()))
            free = match.end()
        at = text.find("@", max(at + 1, free))
    for match in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in match.group().split(".")):
            found.append((match.start(), 1, match.end()))
    for match in _CARD.finditer(text):
        digits = _digits(match.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((match.start(), 2, match.end()))
    for match in _PHONE.finditer(text):
        if 9 <= len(_digits(match.group())) <= 15:
            found.append((match.start(), 3, match.end()))
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that may be personal data. A number's spans are the whole and its parts between wide gaps."""
    found = set()
    for match in _NUMBERS.finditer(text):
        found.add(match.span())
        for part in re.finditer(r"[+(]?[0-9](?:[0-9().:/_-]|[ ](?=[0-9(])){4,40}[0-9]", match.group()):
            found.add((match.start() + part.start(), match.start() + part.end()))
    if "@" in text or "at" in text:
        for sign in re.finditer(r"@|[(\[{]at[)\]}]|(?<= )at(?= \S{1,63} ?(?:\.|[(\[{]dot|dot ))", text):
            match = None
            low = max(0, sign.start() - 66)
            for start in range(low, sign.start()):
                if (start == low or text[start - 1].isspace()) and (match := _ADDRESS.match(text, start)) and match.end() > sign.end():
                    found.add(match.span())
                    break
    return sorted(found)


# Words before a number that is a reference, not a datum of a person.
_REFERENCES = re.compile(
    r"\b(?:part|order|invoice|version|release|section|chapter|item|ref|isbn|issn|serial|sku|model|build|page|figure|table|line|no|nr|id)\b[ .:#]*$"
)
_SIGNS = re.compile(r"@|[(\[{]at[)\]}]")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}")


def features(text: str, start: int, end: int) -> list[float]:
    """Of a span's format and of the words before it. Sizes of numbers say nothing of a span with letters, and are
    0 there; of such a span the sign, the dots and the last label count."""
    span, digits = text[start:end], _digits(text[start:end])
    letters = bool(re.search(r"[A-Za-z]", span))
    groups = [] if letters else re.findall(r"[0-9]+", span)
    sizes = [len(g) for g in groups] or [0]
    before = text[max(0, start - 40) : start].lower()
    low = span.lower()
    octets = [int(g) for g in groups if len(g) <= 9]
    label = re.search(r"[a-z0-9-]*$", low)[0]
    return [
        0 if letters else len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1],
        span.count("-") if not letters else 0, span.count(" ") if not letters else 0, span.count(".") if not letters else 0,
        float(span[:1] == "+"), float("(" in span and ")" in span and not letters), float(letters),
        float(bool(_SIGNS.search(low))), float(letters and bool(re.search(r"(?:[(\[{]dot[)\]}]| dot )", low))),
        float(letters and bool(re.search(r"\. ", span))), float(letters and label.isalpha() and 2 <= len(label) <= 12),
        float(12 <= len(digits) <= 19 and luhn(digits)), float(len(groups) == 4 and len(octets) == 4 and max(octets) <= 255),
        *(float(any(re.search(rf"\b{cue}", before) for cue in _CUES[kind])) for kind in KINDS),
        float(bool(_REFERENCES.search(before))), float(bool(_DATE.search(span))), float(text[end : end + 1].isalnum()),
    ]


class Trees:
    """Gradient-boosted regression trees for the log-odds of one class, with a calibration of their sum."""

    def __init__(self, rounds: int = 30, depth: int = 3, rate: float = 0.3) -> None:
        self.rounds, self.depth, self.rate = rounds, depth, rate
        self.start, self.trees, self.scale = -10.0, [], (1.0, 0.0)
        self.sure, self.precision, self.recall = 0.9, None, None

    def _grow(self, x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int):
        leaf = -gradient.sum() / (weight.sum() + 1.0)
        if depth == 0 or len(x) < 8:
            return leaf
        best, at = gradient.sum() ** 2 / (weight.sum() + 1.0) + 1e-6, None
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, g, w = x[order, f], np.cumsum(gradient[order]), np.cumsum(weight[order])
            edges = np.flatnonzero(v[1:] > v[:-1])
            if not len(edges):
                continue
            gain = g[edges] ** 2 / (w[edges] + 1.0) + (g[-1] - g[edges]) ** 2 / (w[-1] - w[edges] + 1.0)
            top = int(np.argmax(gain))
            if gain[top] > best:
                best, at = gain[top], (f, (v[edges[top]] + v[edges[top] + 1]) / 2)
        if at is None:
            return leaf
        left = x[:, at[0]] <= at[1]
        return (*at, self._grow(x[left], gradient[left], weight[left], depth - 1), self._grow(x[~left], gradient[~left], weight[~left], depth - 1))

    def _value(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        left = x[:, tree[0]] <= tree[1]
        out = np.empty(len(x))
        out[left], out[~left] = self._value(tree[2], x[left]), self._value(tree[3], x[~left])
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((self._value(t, x) for t in self.trees), np.zeros(len(x)))

    def fit(self, x: np.ndarray, y: np.ndarray, wanted: float = 0.99) -> Trees:
        """Boosts on four fifths of the rows; the rest scales the sum to a probability, and sets the lowest one,
        0.5 or more, from which ``wanted`` of the accepted rows are right. ``precision`` and ``recall`` are of these rows."""
        if y.sum() < 5 or y.sum() > len(y) - 5:
            return self
        learn = np.arange(len(y)) % 5 != 4
        share = y[learn].mean()
        self.start = float(np.log(share / (1 - share)))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-self.raw(x[learn])))
            self.trees.append(self._grow(x[learn], p - y[learn], np.maximum(p * (1 - p), 1e-6), self.depth))
        raw, held = self.raw(x[~learn]), y[~learn]
        a, b = 1.0, 0.0
        for _ in range(200):
            error = 1 / (1 + np.exp(-(a * raw + b))) - held
            a, b = a - 0.02 * (error * raw).mean() - 0.002 * (a - 1), b - 0.02 * error.mean()
        self.scale = (a, b)
        p = self.probability(x[~learn])
        for sure in np.unique(np.append(p[p >= 0.5], 0.9)):
            taken = p >= sure
            self.sure, self.precision, self.recall = float(sure), held[taken].mean() if taken.any() else 1.0, held[taken].sum() / max(1.0, held.sum())
            if self.precision >= wanted:
                break
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.raw(x) + self.scale[1], -30, 30)))


@dataclass(frozen=True)
class PiiConfig:
    """``sample``: documents, the first by a hash of their ids, whose candidates the trees are fitted on.
    ``sure``: calibrated probability from which a candidate is redacted; None: for each kind the one that reaches
    ``precision`` on candidates held out."""

    sample: int = 20_000
    sure: float | None = None
    precision: float = 0.99
    seed: int = 42


def _rewritten(kind: int, span: str) -> list[str]:
    """The same datum in formats that the base patterns miss."""
    digits = _digits(span)
    if kind == 0:
        name, _, domain = span.partition("@")
        return [f"{name} (at) {domain}", f"{name}[at]{domain.replace('.', '[dot]')}", f"{name} at {domain.replace('.', ' dot ')}"]
    if kind == 1:
        return [span.replace(".", ":"), span.replace(".", "-")]
    if kind == 2:
        return [".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), "/".join(digits[i : i + 4] for i in range(0, len(digits), 4))]
    local = digits[-10:]
    return [f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}", f"{local[:3]}.{local[3:6]}.{local[6:]}"]


def _near_misses(kind: int, span: str) -> list[tuple[str, str]]:
    """Words before and a number that looks much like the datum but is none: digits that fail their test, octets
    past 255, dates, reference numbers."""
    digits = _digits(span)
    if kind == 1:
        wrong = re.sub(r"^[0-9]+", str(256 + int(digits[:2])), span)
        return [("", wrong), ("", wrong.replace(".", "-")), ("version ", span.replace(".", "-")), ("release ", span.replace(".", "-"))]
    if kind == 2:
        wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        return [("", wrong), *(("", other) for other in _rewritten(2, wrong)), ("serial ", wrong)]
    if kind == 3:
        year, month, day = 1950 + int(digits[-2:]) % 100, int(digits[-4:-2]) % 12 + 1, int(digits[-6:-4]) % 28 + 1
        words = ("part ", "order ", "isbn ", "invoice no. ")
        return [(word, other) for word, other in zip(words, _rewritten(3, span))] + [("on ", f"{year}-{month:02}-{day:02}"), ("", f"{day:02}.{month:02}.{year}"), ("at ", f"{year}-{month:02}-{day:02} {digits[-2:]}:{digits[:2]}")]
    return []


_OTHER_FORMATS = (
    re.compile(r"\S+ ?(?:\(at\)|\[at\]|\{at\}) ?\S.*|\S+ (?:at|@) \S.*(?: dot |[(\[{]dot).*|\S+@\S.*(?: dot |[(\[{]dot).*"),
    re.compile(r"[0-9]{1,3}([:-])[0-9]{1,3}\1[0-9]{1,3}\1[0-9]{1,3}"),
    re.compile(r"[0-9]{4}([./:_-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?"),
    re.compile(r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"),
)


def in_other_format(span: str) -> bool:
    """Whether a span looks like a datum in a format that the base patterns miss."""
    email, ip, card, phone = (pattern.fullmatch(span) for pattern in _OTHER_FORMATS)
    if ip and max(int(part) for part in re.findall(r"[0-9]+", span)) > 255:
        ip = None
    return bool(email or ip or (card and luhn(_digits(span))) or phone)


def examples(text: str) -> list[tuple[list[float], int]]:
    """Features and kind (-1: none) of a text's candidates, of its base spans in other formats, and of near misses made of
    these. Candidates that look like a datum in another format are neither: nothing tells whether they are one."""
    base = base_spans(text)
    found = []
    for start, end in candidates(text):
        over = [(s, k, e) for s, k, e in base if s < end and start < e]
        exact = [k for s, k, e in over if (s, e) == (start, end)]
        if exact or (not over and not in_other_format(text[start:end])):
            found.append((features(text, start, end), exact[0] if exact else -1))
    for start, kind, end in base:
        made = [("", other, kind) for other in _rewritten(kind, text[start:end])]
        made += [(words, other, -1) for words, other in _near_misses(kind, text[start:end])]
        for words, other, label in made:
            before = text[max(0, start - 60) : start] + words
            found.append((features(before + other + text[end : end + 2], len(before), len(before) + len(other)), label))
    return found


def fit(docs: DataFrame, config: PiiConfig = PiiConfig()) -> list[Trees]:
    """A model for each kind. Base spans, also rewritten in other formats, are the positive examples; near misses made of
    them, and candidates that no base format accepts and that do not look like one in another format, are the negative
    ones. Of an id with several texts the least is read, so that the sample has one row for each id. Only the models
    reach the driver."""
    ids = docs.filter("doc_id is not null").select("doc_id").distinct()
    chosen = ids.orderBy(F.xxhash64(F.lit(config.seed), "doc_id"), "doc_id").limit(config.sample)
    sample = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).select("text")
    wanted = config.precision

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for text in batch.text.dropna() for row in examples(text)]
            yield pd.DataFrame({"x": pd.Series([x for x, _ in rows], dtype=object), "kind": pd.Series([k for _, k in rows], dtype="int32")})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [batch for batch in batches if len(batch)]
        models = [Trees() for _ in KINDS]
        if parts:
            rows = pd.concat(parts)
            x, kind = np.array(rows.x.tolist(), dtype=float), rows.kind.to_numpy()
            order = np.lexsort((*x.T, kind))  # whatever order tasks end in
            order = np.random.default_rng(7).permutation(order)
            x, kind = x[order], kind[order]
            models = [Trees().fit(x, (kind == n).astype(float), wanted) for n in range(len(KINDS))]
        yield pd.DataFrame({"models": [pickle.dumps([vars(model) for model in models])]})

    rows = sample.mapInPandas(read, "x array<double>, kind int").repartition(1).mapInPandas(learn, "models binary").collect()
    models = [Trees() for _ in KINDS]
    if rows:
        for model, state in zip(models, pickle.loads(rows[0]["models"])):
            vars(model).update(state)
    return models


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def found_in(text: str, models: list[Trees], sure: float | None = None) -> tuple[list, list]:
    """The base spans, and with them the further ones that are sure (None: by each model's own measure) and overlap none
    already taken."""
    base = base_spans(text)
    spans = [(s, e) for s, e in candidates(text) if not any(a < e and s < b for a, _, b in base)]
    if not spans:
        return base, base
    x = np.array([features(text, s, e) for s, e in spans])
    p = np.column_stack([m.probability(x) for m in models])
    taken = list(base)
    for n in np.lexsort((np.arange(len(spans)), -p.max(axis=1))):
        (s, e), kind = spans[n], int(np.argmax(p[n]))
        if p[n, kind] >= (models[kind].sure if sure is None else sure) and not any(a < e and s < b for a, _, b in taken):
            taken.append((s, kind, e))
    return base, sorted(taken)


def personal_data(text: Column, models: list[Trees], sure: float | None) -> Column:
    """Counts and digests of the base spans, and all spans, of whole texts."""

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                text = text or ""
                base, spans = found_in(text, models, sure)
                kinds = [k for _, k, _ in base]
                clean, at = [], 0
                for start, kind, end in spans:
                    if end > at:
                        clean += [text[at:start] if start > at else "", f"<{KINDS[kind]}>" if start >= at else ""]
                        at = end
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((*(kinds.count(n) for n in range(4)), digest, _joined(spans), "".join(clean) + text[at:] if spans else None))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"])

    return found(text)


def redacted(docs: DataFrame, config: PiiConfig = PiiConfig()) -> DataFrame:
    """All columns of the documents, with counts of base spans, ``base_sha256``, ``spans`` and ``redacted``.

    ``spans`` lists ``kind:start:end`` in code points, end exclusive. The base formats always stay; trees
    add spans that overlap none of them. ``redacted`` is the text with every span replaced by its kind,
    overlapping spans as one. A null or empty text has no spans; repeated rows are alike; an empty table
    gives an empty result. Columns called like a new one are replaced. Texts are read whole, whatever their length.
    """
    models = fit(docs, config)
    found = docs.withColumn("__found", personal_data(F.col("text"), models, config.sure))
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    return found.select(
        *others(docs, *names, "redacted"),
        *(F.col(f"__found.{name}").alias(name) for name in names),
        F.coalesce("__found.redacted", "text").alias("redacted"),
    )
