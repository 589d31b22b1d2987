"""Toxicity by a linear-chain conditional random field over words.

Labels say only which documents are toxic, so spans are labelled first, and labelled anew by the chain that they give.  A word
or word beginning is offending where, in a bounded sample of labelled documents, it stands after many different words in toxic
ones and after hardly any in others (counting neighbours, not documents, leaves copies of one text without weight).  Those of
toxic documents make the first spans.  A chain of two states, clean
and offending, over features of words and of their neighbours, is fitted to windows of the sample by gradient steps on its
likelihood; its own marginals label the windows of toxic documents once more, and it is fitted again.

Scoring is exact forward-backward over all words of the whole text.  Words without a feature all have the same potentials, so
a stretch of them is a power of one 2x2 matrix, and the work follows the few words that have one.  The marginals of offending
words give the spans, and a logistic regression over them (most certain, sum, share of words) the document's score.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.llm.common import extended, pick

#: Sampled documents with each label, and their longest text; features kept.
SAMPLE_DOCS, SAMPLE_CHARS, FEATURES = 2000, 20_000, 4096
#: Words of a training window, and windows trained on at most (drawn by a hash).
SEQUENCE, WINDOWS = 48, 6000
#: Features of a word beside an offending one: the word before it is, the word after it is.
BESIDE = ("<", ">")
#: Least different neighbours in toxic documents, and least logarithm of the odds, that make a feature offending.
NEIGHBOURS, LOG_ODDS = 8, 2.0
_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """The word itself and its beginnings of three to five letters."""
    return [f"={word}", *(f"^{word[:k]}" for k in (3, 4, 5) if len(word) > k)]


@dataclass
class Model:
    """weights: of features for the offending state; bias: of a word; move: log potentials from state to state; scale: of the document's regression."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    move: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    scale: tuple[float, ...] = (-2.0, 3.0, 1.0, 1.0)

    def __post_init__(self) -> None:
        self.known: dict[str, float | None] = {}
        self.powers: dict[int, np.ndarray] = {}

    def potential(self, word: str) -> float | None:
        """What the word's features add to the offending state; None without any."""
        if (w := self.known.get(word, 0)) == 0:
            if len(self.known) > 20_000:
                self.known.clear()
            found = [self.weights[f] for f in features_of(word) if f in self.weights]
            self.known[word] = w = sum(found) if found else None
        return w

    def between(self, gap: int) -> np.ndarray:
        """Product of the potentials from one word to the one ``gap`` words later, without the latter's own; scaled to a sum of 1."""
        if (m := self.powers.get(gap)) is None:
            step = np.exp(np.array(self.move)).reshape(2, 2)
            plain = step * np.array([1.0, math.exp(self.bias)])
            m, base, k = np.eye(2), plain / plain.sum(), gap - 1
            while k > 0:
                if k & 1:
                    m = m @ base
                    m /= m.sum()
                base = base @ base
                base /= base.sum()
                k >>= 1
            m = m @ step
            m /= m.sum()
            if len(self.powers) < 4096:
                self.powers[gap] = m
        return m

    def marginals(self, places: list[int], added: list[float], words: int) -> list[float]:
        """Probability of the offending state of the words at ``places``, of a text of ``words`` words."""
        if not places:
            return []
        own = [np.array([1.0, math.exp(min(30.0, self.bias + a))]) for a in added]
        gaps = [self.between(b - a) for a, b in zip(places, places[1:])]
        start = np.array([1.0, math.exp(self.bias)])
        forward = [own[0] if places[0] == 0 else (start / start.sum()) @ self.between(places[0]) * own[0]]
        for m, o in zip(gaps, own[1:]):
            f = (forward[-1] / forward[-1].sum()) @ m * o
            forward.append(f)
        tail = words - 1 - places[-1]
        end = np.ones(2) if tail == 0 else self.between(tail) @ start
        backward = [end]
        for m, o in zip(reversed(gaps), reversed(own[1:])):
            b = m @ (o * backward[-1])
            backward.append(b / b.sum())
        return [float(f[1] * b[1] / (f @ b)) for f, b in zip(forward, reversed(backward))]

    def tag(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """(start, end, marginal) of the words that have features, and how many words there are."""
        own: dict[int, float] = {}
        at, n = [], 0
        lowered = text.lower()
        kept = lowered if len(lowered) == len(text) else text  # a few letters change length in lower case
        for n, m in enumerate(_WORD.finditer(kept), 1):
            at.append(m.span())
            p = self.potential(m[0] if kept is lowered else m[0].lower())
            if p is not None:
                own[n - 1] = p
        places, added = self.added(own, n)
        return [(*at[i], p) for i, p in zip(places, self.marginals(places, added, n))], n

    def added(self, own: dict[int, float], words: int) -> tuple[list[int], list[float]]:
        """Places with features of their own or of neighbours, in order, and what these add to the offending state."""
        after, before = self.weights.get(BESIDE[0], 0.0), self.weights.get(BESIDE[1], 0.0)
        total = dict(own)
        for i in own:
            if i + 1 < words:
                total[i + 1] = total.get(i + 1, 0.0) + after
            if i:
                total[i - 1] = total.get(i - 1, 0.0) + before
        places = sorted(total)
        return places, [total[i] for i in places]

    @staticmethod
    def summary(marginals: list[float], words: int) -> tuple[float, float, float]:
        total = sum(marginals)
        return max(marginals, default=0.0), math.log1p(total), math.sqrt(total / max(1, words))

    def score(self, marginals: list[float], words: int) -> float:
        z = self.scale[0] + sum(a * b for a, b in zip(self.scale[1:], self.summary(marginals, words)))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def offending_features(texts: list[str], toxic: list[int]) -> dict[str, float]:
    """Log odds of the features that are offending by their neighbours in the sample."""
    seen: tuple[dict[str, set[str]], dict[str, set[str]]] = ({}, {})
    words_in = [0, 0]
    for side in (1, 0):  # toxic texts first: what clean ones are asked for is then known, in whatever order the sample comes
        for text in (t for t, label in zip(texts, toxic) if label == side):
            before = ""
            for word in _WORD.findall(text.lower()):
                words_in[side] += 1
                for f in features_of(word):
                    if side or f in seen[1]:
                        seen[side].setdefault(f, set()).add(before)
                before = word
    rate = (words_in[1] + 1) / (words_in[0] + 1)
    odds = {f: math.log((len(b) + 0.5) / (len(seen[0].get(f, ())) + 0.5) / rate) for f, b in seen[1].items() if len(b) >= NEIGHBOURS}
    best = sorted((f for f, o in odds.items() if o >= LOG_ODDS), key=lambda f: (-odds[f], f))
    return {f: odds[f] for f in best[:FEATURES]}


def fit_chain(sequences: list[list[list[int]]], labels: list[list[int]], features: int, rounds: int = 50, rate: float = 0.2, ridge: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """Feature weights, bias and log moves of the chain that make the labels likely; each word is a list of feature numbers."""
    n, length = len(sequences), max(map(len, sequences))
    active = np.zeros((n, length), bool)
    gold = np.zeros((n, length), np.int64)
    flat_row, flat_feature = [], []
    for i, (words, marks) in enumerate(zip(sequences, labels)):
        active[i, : len(words)] = True
        gold[i, : len(words)] = marks
        for j, fs in enumerate(words):
            flat_row += [i * length + j] * len(fs)
            flat_feature += fs
    flat_row, flat_feature = np.array(flat_row, np.int64), np.array(flat_feature, np.int64)
    params = np.concatenate([np.full(features, 1.0), [-4.0], np.zeros(4)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    pairs = active[:, 1:]
    for step in range(1, rounds + 1):
        w, bias, move = params[:features], params[features], params[features + 1 :].reshape(2, 2)
        gain = (np.bincount(flat_row, w[flat_feature], minlength=n * length).reshape(n, length) if len(flat_row) else np.zeros((n, length))) + bias
        emit = np.stack([np.zeros_like(gain), gain], axis=2)
        forward, backward = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        forward[:, 0] = emit[:, 0]
        for t in range(1, length):
            new = np.logaddexp(forward[:, t - 1, :1] + move[0], forward[:, t - 1, 1:] + move[1]) + emit[:, t]
            forward[:, t] = np.where(active[:, t, None], new, forward[:, t - 1])
        for t in range(length - 2, -1, -1):
            after = emit[:, t + 1] + backward[:, t + 1]
            new = np.logaddexp(move[:, 0] + after[:, :1], move[:, 1] + after[:, 1:])
            backward[:, t] = np.where(active[:, t + 1, None], new, 0)
        norm = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        last = active.sum(axis=1) - 1
        offending = np.where(active, np.exp(np.clip(forward[:, :, 1] + backward[:, :, 1] - norm[:, None], -50, 0)), 0)
        residual = np.where(active, gold - offending, 0)
        grad = np.zeros_like(params)
        if len(flat_row):
            grad[:features] = np.bincount(flat_feature, residual.ravel()[flat_row], minlength=features)
        grad[features] = residual.sum()
        for a in range(2):
            for b in range(2):
                both = np.exp(np.clip(forward[:, :-1, a] + move[a, b] + emit[:, 1:, b] + backward[:, 1:, b] - norm[:, None], -50, 0))
                grad[features + 1 + 2 * a + b] = (((gold[:, :-1] == a) & (gold[:, 1:] == b)) * pairs).sum() - (both * pairs).sum()
        grad = grad / n - ridge * params
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    assert (last >= 0).all()
    return params[:features], float(params[features]), params[features + 1 :]


def _regress(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
    return tuple(float(a) for a in w)


def fit(texts: list[str], toxic: list[int]) -> Model:
    """The model of a bounded sample.  Without both labels, or without any offending feature, it finds nothing and scores low."""
    model = Model()
    if not 0 < sum(toxic) < len(toxic):
        return model
    odds = offending_features(texts, toxic)
    if not odds:
        return model
    number = {f: i for i, f in enumerate([*odds, *BESIDE])}
    windows = []
    for text, label in zip(texts, toxic):
        words = [[number[f] for f in features_of(w) if f in number] for w in _WORD.findall(text.lower())]
        hits = [i for i, fs in enumerate(words) if fs]
        for i in hits:
            if i + 1 < len(words):
                words[i + 1] = [*words[i + 1], number[BESIDE[0]]]
            if i:
                words[i - 1] = [*words[i - 1], number[BESIDE[1]]]
        marks = [0] * len(words)
        for i in hits if label else ():
            marks[i] = 1
        upto = 0
        for i in hits or [zlib.crc32(text.encode("utf-8", "replace")) % max(1, len(words) - SEQUENCE + 1)]:
            if i >= upto and words:  # windows cover all offending words of the text
                lo = max(0, i - SEQUENCE // 4) if hits else i
                upto = lo + SEQUENCE
                windows.append((zlib.crc32(f"{lo} {text}".encode("utf-8", "replace")), words[lo:upto], marks[lo:upto], label))
    windows = sorted(windows, key=lambda w: w[0])[:WINDOWS]
    sequences, labels = [w[1] for w in windows], [w[2] for w in windows]
    for again in (True, False):
        weights, bias, move = fit_chain(sequences, labels, len(number))
        model = Model(dict(zip(number, map(float, weights))), bias, tuple(map(float, move)))
        if again:
            for k, (_, words, _, label) in enumerate(windows):
                places = [i for i, fs in enumerate(words) if fs]
                if label and places:
                    found = model.marginals(places, [float(sum(weights[f] for f in words[i])) for i in places], len(words))
                    labels[k] = [0] * len(words)
                    for i, p in zip(places, found):
                        labels[k][i] = int(p >= 0.5)
    rows = []
    for text in texts:
        marks, words = model.tag(text)
        rows.append(model.summary([p for _, _, p in marks], words))
    model.scale = _regress(np.array(rows), np.array(toxic, float))
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out_fold: int | None = 0, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from at most ``sample_docs`` documents of each label, dealt out by a hash of the id, with texts up to ``SAMPLE_CHARS``.

    Of repeated rows each counts in the draw; an empty table gives a model that finds nothing.  Rows whose crc32(id as text) mod ``folds`` is ``held_out_fold`` are left aside; null ids, labels and texts teach nothing.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    if held_out_fold is not None:
        rows = rows.filter(F.crc32(F.col("doc_id").cast("string")) % folds != held_out_fold)
    picked = [rows.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs) for k in (0, 1)]
    sample = picked[0].unionByName(picked[1])  # 2 * sample_docs rows, so that they can be sent to every executor
    found = pick(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").filter(F.length("text").between(1, SAMPLE_CHARS))
    drawn = sorted(map(tuple, found.select("text", "label").limit(4 * sample_docs).collect()))  # by text, so that sums are added up in one order under any ids
    return fit([r[0] for r in drawn], [r[1] for r in drawn])


@lru_cache(1)
def _model(frozen: tuple) -> Model:
    weights, *rest = frozen
    return Model(dict(weights), *rest)


SPANS = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("marginal", "double"))


def score_toxicity(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with toxicity double (0 to 1) and toxic_spans array<struct<start, end, marginal>>, code points of words more likely offending than not.

    Null and empty texts have no spans and the score of a text without offending words; repeated rows score alike; very long texts
    are tagged whole; an empty table gives an empty one; columns so named are replaced.
    """
    frozen = (tuple(model.weights.items()), model.bias, model.move, model.scale)
    shared = docs.sparkSession.sparkContext.broadcast(frozen)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def work(batch):
        own = _model(shared.value)
        scores, spans = [], []
        for text in batch.column("t").to_pylist():
            marks, words = own.tag(text or "")
            scores.append(own.score([p for _, _, p in marks], words))
            spans.append([{"start": a, "end": b, "marginal": p} for a, b, p in marks if p >= 0.5])
        return [pa.array(scores, pa.float64()), pa.array(spans, kind)]

    return extended(docs, {"t": F.col(text_col).cast("string")}, T.StructType().add("toxicity", "double").add("toxic_spans", SPANS), work)
