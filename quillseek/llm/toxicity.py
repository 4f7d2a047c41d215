"""Toxicity: a linear-chain conditional random field over words, learned from labelled documents."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillseek.llm.common import fold, others
from quillseek.llm.tokens import coded_words, runs

_TABLE = 1 << 18  # hashed feature weights
_PREFIXES = (4, 5, 6)
_PART_CHARS = 8 << 20  # of text that is scored at once
_ROLES = 1 + len(_PREFIXES)  # the word and its prefixes
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class ToxicityConfig:
    """``sample``: labelled documents of each class that the model is fitted on, the first by a hash of their
    ids. The last quarter of them fits the calibration. Their texts are learned from whole, in chains of ``chain`` words.
    ``held_out``: remainder modulo ``modulus`` that is not learned from."""

    sample: int = 4000
    chain: int = 64
    modulus: int = 5
    held_out: int = 0
    seed: int = 42


def _features(word: str) -> list[int]:
    """Slots of the word and of its prefixes; a word shorter than a prefix has the empty slot 0."""
    core = word.strip(_EDGES)
    names = [f"w{core}" if core else ""] + [f"p{core[:n]}" if len(core) > n else "" for n in _PREFIXES]
    return [1 + xxhash.xxh32_intdigest(name) % (_TABLE - 1) if name else 0 for name in names]


class Field:
    """Two states, clean and toxic. Weights of a word's features in its own place and for its neighbours."""

    def __init__(self) -> None:
        self.own = np.zeros(_TABLE)
        self.before = np.zeros(_TABLE)
        self.after = np.zeros(_TABLE)
        self.bias = -4.0
        self.move = np.array([[0.0, 0.0], [0.0, 0.0]])  # from state to state
        self.calibration = np.array([-3.0, 0.0, 0.0, 0.0])

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slots = np.array([_features(word) for word in words], dtype=np.int64).reshape(-1, _ROLES)
        return self.own[slots].sum(axis=1) + self.bias, self.before[slots].sum(axis=1), self.after[slots].sum(axis=1)

    def marginals(self, scores: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(toxic) of every word."""
        forward, backward = self.messages(scores, offsets)
        return 1 / (1 + np.exp(-np.clip(forward + backward, -50, 50)))

    def messages(self, scores: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of every word from the words up to it, and from those after it, by forward-backward over all chains
        at once; longer chains go first, so that the work is in proportion to the words."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = offsets[:-1][order], lengths[order]
        alive = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
        t = np.exp(self.move)
        with np.errstate(over="ignore"):
            up = lambda a: np.log((t[0, 1] + t[1, 1] * np.exp(a)) / (t[0, 0] + t[1, 0] * np.exp(a)))
            down = lambda b: np.log((t[1, 0] + t[1, 1] * np.exp(b)) / (t[0, 0] + t[0, 1] * np.exp(b)))
            forward = np.array(scores, dtype=float)
            for i in range(1, len(alive)):
                at = starts[: alive[i]] + i
                forward[at] += up(np.clip(forward[at - 1], -50, 50))
            backward = np.zeros(len(scores))
            for i in range(len(alive) - 1, 0, -1):
                at = starts[: alive[i]] + i
                backward[at - 1] = down(np.clip(backward[at] + scores[at], -50, 50))
        return forward, backward

    def pairs(self, scores: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the second words of all neighbours in a chain, and P of each pair of their states."""
        forward, backward = self.messages(scores, offsets)
        right = np.ones(len(scores), dtype=bool)
        right[offsets[:-1][np.diff(offsets) > 0]] = False
        at = np.flatnonzero(right)
        late = scores[at] + backward[at]
        log = np.stack([np.stack([self.move[i, j] + i * forward[at - 1] + j * late for j in (0, 1)], axis=-1) for i in (0, 1)], axis=-2)
        weight = np.exp(log - log.max(axis=(1, 2), keepdims=True))
        return at, weight / weight.sum(axis=(1, 2), keepdims=True)


def _emissions(model: Field, words: list[str], codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    own, before, after = model.word_scores(words)
    scores = own[codes]
    if len(codes) > 1:
        joined = np.ones(len(codes) - 1, dtype=bool)
        inner = offsets[1:-1]
        joined[inner[(inner > 0) & (inner < len(codes))] - 1] = False
        scores[1:] += np.where(joined, before[codes[:-1]], 0)
        scores[:-1] += np.where(joined, after[codes[1:]], 0)
    return scores


def _summary(marginals: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What a document's score is made of: highest log-odds of a word, expected toxic words, length."""
    lengths = np.diff(offsets)
    some = lengths > 0
    top, expected = np.zeros(len(lengths)), np.zeros(len(lengths))
    if some.any():
        top[some] = np.maximum.reduceat(marginals, offsets[:-1][some])
        expected[some] = np.add.reduceat(marginals, offsets[:-1][some])
    odds = np.log((top + 1e-6) / (1 - top + 1e-6))
    return np.column_stack([np.ones(len(lengths)), odds, np.log(expected + 1e-4), np.log(lengths + 1.0)])


def _token_labels(words: list[str], codes: np.ndarray, offsets: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Labels of the words of labelled documents: a word is toxic, in a toxic document, if it or a prefix of
    it is in several toxic documents (six, or half of fewer than twelve) and hardly any other."""
    slots = np.array([_features(word) for word in words], dtype=np.int64).reshape(-1, _ROLES)
    owner = np.repeat(np.arange(len(toxic)), np.diff(offsets))
    pairs = np.unique(owner.astype(np.int64) * len(words) + codes)
    doc, word = pairs // len(words), pairs % len(words)
    spread = np.unique(np.repeat(doc, _ROLES) * _TABLE + slots[word].ravel())
    doc, slot = spread // _TABLE, spread % _TABLE
    bad = np.bincount(slot[toxic[doc] == 1], minlength=_TABLE)
    good = np.bincount(slot[toxic[doc] == 0], minlength=_TABLE)
    ratio = (bad + 0.05) / (good + 0.05) * (np.sum(toxic == 0) + 1) / (np.sum(toxic == 1) + 1)
    telling = (bad >= np.clip(toxic.sum() // 2, 2, 6)) & (ratio >= 60)
    telling[0] = False
    return (telling[slots].any(axis=1)[codes] & (toxic[owner] == 1)).astype(np.int8)


def gradient(model: Field, scores: np.ndarray, ends: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the negative log-likelihood of chains' labels: by the score of each word, and by each move. Expected states and
    pairs of states less those seen."""
    error = model.marginals(scores, ends) - labels
    right, expected = model.pairs(scores, ends)
    y = labels.astype(int)
    seen = np.bincount(2 * y[right - 1] + y[right], minlength=4).reshape(2, 2)
    return error, expected.sum(axis=0) - seen


def _train(texts: list[str], toxic: np.ndarray, config: ToxicityConfig) -> Field:
    """Fits the field on three quarters of the documents by adaptive gradients, the calibration on the rest."""
    model = Field()
    if len(set(toxic.tolist())) < 2:
        model.calibration[0] = 3.0 if toxic.any() else -3.0
        return model
    rest = np.arange(len(texts)) % 4 == 3
    learn = np.flatnonzero(~rest)
    words, codes, offsets = coded_words(pa.array([texts[i] for i in learn], pa.string()), lower=True)
    labels = _token_labels(words, codes, offsets, toxic[learn])
    slots = np.array([_features(word) for word in words], dtype=np.int64).reshape(-1, _ROLES)
    width = config.chain
    chains = [(a, min(a + width, e)) for s, e in zip(offsets[:-1], offsets[1:]) for a in range(s, e, width)]
    rng = np.random.default_rng(config.seed)
    grads = {"own": np.zeros(_TABLE), "before": np.zeros(_TABLE), "after": np.zeros(_TABLE)}
    seen_move, seen_bias, rate = np.ones((2, 2)), 1.0, 0.3
    for _ in range(3):
        order = rng.permutation(len(chains))
        for begin in range(0, len(order), 128):
            part = [chains[i] for i in order[begin : begin + 128]]
            ends = np.concatenate(([0], np.cumsum([b - a for a, b in part])))
            at = np.concatenate([np.arange(a, b) for a, b in part])
            c, y = codes[at], labels[at].astype(float)
            scores = _batch_scores(model, slots, c, ends)
            error, pair = (g / len(part) for g in gradient(model, scores, ends, y))
            joined = np.ones(len(at), dtype=bool)
            joined[ends[:-1]] = False
            for name, role, e in (
                ("own", c, error),
                ("before", c[:-1], np.where(joined[1:], error[1:], 0)),
                ("after", c[1:], np.where(joined[1:], error[:-1], 0)),
            ):
                weights = getattr(model, name)
                flat = slots[role].ravel()
                grad = np.bincount(flat, weights=np.repeat(e, _ROLES), minlength=_TABLE)
                touched = np.unique(flat)
                g = grad[touched] + 1e-6 * weights[touched]
                grads[name][touched] += g * g
                weights[touched] -= rate * g / np.sqrt(grads[name][touched] + 1e-10)
                weights[0] = 0.0
            seen_bias += error.sum() ** 2
            model.bias -= rate * error.sum() / np.sqrt(seen_bias)
            seen_move += pair**2
            model.move -= 0.1 * pair / np.sqrt(seen_move)
    held = np.flatnonzero(rest)
    words, codes, offsets = coded_words(pa.array([texts[i] for i in held], pa.string()), lower=True)
    x = _summary(model.marginals(_emissions(model, words, codes, offsets), offsets), offsets)
    model.calibration = _logistic(x, toxic[held].astype(float))
    return model


def _batch_scores(model: Field, slots: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    own, before, after = (w[slots[codes]].sum(axis=1) for w in (model.own, model.before, model.after))
    scores = own + model.bias
    joined = np.ones(len(codes), dtype=bool)
    joined[ends[:-1]] = False
    scores[1:] += np.where(joined[1:], before[:-1], 0)
    scores[:-1] += np.where(joined[1:], after[1:], 0)
    return scores


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (p - y) + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> Field:
    """Learns from a bounded sample of labelled documents, in one task; only the model reaches the driver.

    Labels of one id count as toxic if any is, and of its texts the least is read. Rows with a null id or label are not learned from.
    """
    known = labels.filter("doc_id is not null and toxic is not null").filter(fold(F.col("doc_id"), config.modulus) != config.held_out)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64(F.lit(config.seed), "doc_id")
    chosen = [known.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(config.sample) for c in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    sample = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # 2 * sample rows

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            yield pd.DataFrame({"model": [pickle.dumps(vars(Field()))]})
            return
        rows = pd.concat(parts).sort_values(["doc_id", "text"], kind="stable")
        rows = rows.sample(frac=1.0, random_state=config.seed)
        yield pd.DataFrame({"model": [pickle.dumps(vars(_train(rows.text.fillna("").tolist(), rows.toxic.to_numpy(), config)))]})

    found = sample.repartition(1).mapInPandas(train, "model binary").collect()
    model = Field()
    if found:
        vars(model).update(pickle.loads(found[0]["model"]))
    return model


def toxicity(text: Column, model: Field) -> Column:
    """``(score, spans)`` of whole texts; spans are ``start:end`` in characters of words that are rather toxic."""

    def one(texts: list[str]) -> pd.DataFrame:
        words, codes, offsets = coded_words(pa.array(texts, pa.string()), lower=True)
        marginals = model.marginals(_emissions(model, words, codes, offsets), offsets)
        scores = 1 / (1 + np.exp(-np.clip(_summary(marginals, offsets) @ model.calibration, -30, 30)))
        spans = [""] * len(texts)
        for i in set((np.searchsorted(offsets, np.flatnonzero(marginals >= 0.5), side="right") - 1).tolist()):
            found = list(_TOKEN.finditer(texts[i]))
            flagged = np.flatnonzero(marginals[offsets[i] : offsets[i + 1]] >= 0.5)
            spans[i] = ",".join(f"{found[j].start()}:{found[j].end()}" for j in flagged)
        return pd.DataFrame({"score": scores, "spans": spans})

    @F.pandas_udf("score double, spans string")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = batch.fillna("").tolist()
            sizes = np.array([len(text) for text in whole], dtype=np.int64)
            judged = [one(whole[a:b]) for a, b in runs(sizes, _PART_CHARS)]
            yield pd.concat(judged) if judged else pd.DataFrame({"score": np.zeros(0), "spans": pd.Series([], dtype="str")})

    return scored(text)


def scored_documents(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """All columns of the documents with ``held_out``, ``score``, ``predicted`` and ``spans``.

    The score is calibrated on the field's marginals: the highest of any word, the expected number of
    toxic words, and the length. Null and empty texts have no words and get a score as well; without
    labels of both classes every score is the same. Repeated rows score alike; an empty table gives an
    empty result. A null id is not held out. Columns called like a new one are replaced.
    """
    model = fit(docs, labels, config)
    found = docs.withColumn("__toxicity", toxicity(F.col("text"), model))
    return found.select(
        *others(docs, "held_out", "score", "predicted", "spans"),
        F.coalesce(fold(F.col("doc_id"), config.modulus) == config.held_out, F.lit(False)).alias("held_out"),
        F.col("__toxicity.score").alias("score"),
        F.when(F.col("__toxicity.score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.col("__toxicity.spans").alias("spans"),
    )
