"""Toxicity: a logistic classifier of n-gram indicators with counterfactual regularisation.

Weights are sparse (lasso; its strength is chosen by cross-fitting).  Identity terms
in labelled texts are swapped for other ones, and the squared change
of the margin is added to the loss, so that what is learned does not hang on which
group a text mentions.  Since a term that never occurs in a labelled text would keep
whatever its parts happen to weigh, each term is also held against the empty
sentence.  Texts score by presence of n-grams, words' first bytes included, so that
one hostile word in a long text counts as in a short one.

The bias is not learned on the class shares of the sample alone: margins become
probabilities by a logistic curve fitted on cross-fitted margins.

Defined cases: null or empty text scores by the bias; texts of any length are read
whole; repeated rows are scored each, and equal texts alike; of rows that repeat a labelled
id one is learned from; ties of features go by their hash; with no labelled row, or one
class alone, every score is that class's share (0.5 for none); an empty table gives an
empty result; other columns are handed on only where `carry` names them.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.linear_text import Recipe, Rows, features, score_rows, training_rows
from tidemark.llm.quality_classifier import _platt
from tidemark.llm.quality_rules import labelled_sample, labelled_texts

MAX_ROWS = 8_000
THRESHOLD = 0.3
RECIPE = Recipe(lower=True, words=1, first=(3, 4, 5, 6, 7, 8))
#: Words for groups of people, in the languages of the corpus.
IDENTITY_TERMS = (
    "women", "woman", "men", "man", "girls", "boys", "gay", "lesbian", "bisexual", "transgender", "straight",
    "black", "white", "asian", "latino", "african", "european", "american", "muslim", "muslims", "christian",
    "christians", "jewish", "jews", "hindu", "buddhist", "atheist", "immigrant", "immigrants", "refugees",
    "disabled", "blind", "deaf", "old", "young", "femmes", "hommes", "musulmans", "juifs", "frauen", "männer",
    "juden", "muslime", "mujeres", "hombres", "musulmanes", "judíos",
)
PENALTY = 50.0
#: Strengths of the lasso term, of which cross-fitting picks one.
L1 = (0.02, 0.008, 0.003, 0.001)
FEATURES = 20_000


def swap_terms(terms: tuple[str, ...] = IDENTITY_TERMS):
    """A function that gives a chunk with every identity term exchanged for the one half the list away, and which documents changed."""
    other = {t: terms[(k + len(terms) // 2) % len(terms)] for k, t in enumerate(terms)}
    pattern = re.compile(rb"(?i)(?<![^\x20\x09-\x0D])(" + b"|".join(sorted((re.escape(t.encode()) for t in terms), key=len, reverse=True)) + rb")(?=[.,;:!?]*(?:[\x20\x09-\x0D]|$))")

    def change(m: re.Match) -> bytes:
        return other.get(m[1].decode().lower(), m[1].decode()).encode()

    def swap(c: K.Chunk) -> tuple[K.Chunk, np.ndarray]:
        raw, changed = c.data.tobytes(), np.zeros(c.hi - c.lo, bool)
        out = []
        for d, (a, b) in enumerate(zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist(), strict=True)):
            text, n = pattern.subn(change, raw[a:b])
            changed[d] = n > 0
            out.append(text if n else b"")
        edges = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int64)
        return K.Chunk(c.lo, c.hi, np.frombuffer(b"".join(out), np.uint8), edges), changed

    return swap


def _term_features(terms: tuple[str, ...]) -> list[np.ndarray]:
    data = [t.encode() for t in terms]
    edges = np.concatenate(([0], np.cumsum([len(x) for x in data]))).astype(np.int64)
    c = K.Chunk(0, len(terms), np.frombuffer(b"".join(data), np.uint8), edges)
    pairs = list(features(c, RECIPE))
    doc, feat = np.concatenate([d for d, _ in pairs]), np.concatenate([f for _, f in pairs])
    return [np.unique(feat[doc == k]) for k in range(len(terms))]


class _Sparse:
    """Rows of +1 and -1 entries."""

    def __init__(self, plus: list[np.ndarray], minus: list[np.ndarray] | None = None):
        minus = minus or [np.zeros(0, np.int64)] * len(plus)
        self.n = len(plus)
        self.row = np.repeat(np.arange(self.n), [len(p) + len(q) for p, q in zip(plus, minus, strict=True)])
        self.col = np.concatenate([np.concatenate((p, q)) for p, q in zip(plus, minus, strict=True)]).astype(np.int64) if self.n else np.zeros(0, np.int64)
        self.val = np.concatenate([np.concatenate((np.ones(len(p)), -np.ones(len(q)))) for p, q in zip(plus, minus, strict=True)]) if self.n else np.zeros(0)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col] * self.val, self.n)

    def back(self, r: np.ndarray, m: int) -> np.ndarray:
        return np.bincount(self.col, r[self.row] * self.val, m)


def fit(index: list[np.ndarray], y: np.ndarray, m: int, swapped: _Sparse, *, l1: float, penalty: float = PENALTY, steps: int = 120) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic loss (classes weighing alike) + l1 |w| + penalty * mean squared margin change under swaps.

    Accelerated proximal steps; each weight has its own step size from a separable bound of the curvature.
    """
    x = _Sparse(index)
    share = y.mean()
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(y)
    size = np.bincount(x.row, minlength=x.n) + 1.0
    pull = penalty / max(len(y), swapped.n)
    hess = 0.25 * x.back(weight * size, m) + pull * np.bincount(swapped.col, np.bincount(swapped.row, minlength=swapped.n)[swapped.row], m) + 1e-12
    rate, bias_rate = 1 / hess, 1 / (0.25 * (weight * size).sum())
    w, bias = np.zeros(m), 0.0
    vw, vb, t = w.copy(), bias, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.dot(vw) + vb, -30, 30)))
        r = weight * (p - y)
        g = x.back(r, m) + pull * swapped.back(swapped.dot(vw), m)
        nw = vw - rate * g
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * l1, 0)
        nb = vb - bias_rate * r.sum()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / s * (nw - w), nb + (t - 1) / s * (nb - bias)
        w, bias, t = nw, nb, s
    return w, bias


def _swap_rows(rows: Rows, of: np.ndarray, terms: list[np.ndarray]) -> _Sparse:
    both = [(rows.index[i], rows.swapped[i]) for i in of if rows.swapped and rows.swapped[i] is not None]
    plus, minus = [np.setdiff1d(a, b) for a, b in both], [np.setdiff1d(b, a) for a, b in both]
    for t in terms:  # a mention alone should not move the score
        at = np.searchsorted(rows.known, t)
        at = at[(at < len(rows.known))]
        at = at[np.isin(rows.known[at], t)]
        plus.append(at)
        minus.append(np.zeros(0, np.int64))
    return _Sparse(plus, minus)


def train(docs: DataFrame, labels: DataFrame, *, column: str = "toxic", max_rows: int = MAX_ROWS, terms: tuple[str, ...] = IDENTITY_TERMS, penalty: float = PENALTY, id_col: str = "doc_id", text_col: str = "text"):
    """(known features, weights, function from margins to scores); None for the features if there is nothing to learn from."""
    hits = labelled_sample(labels.where(F.col(column) == 1), column, max_rows // 2)
    rest = labelled_sample(labels.where(F.col(column) == 0), column, max_rows // 2)
    sample = labelled_texts(docs, hits.union(rest), id_col, text_col)
    mentions = _term_features(terms)
    rows = training_rows(sample, RECIPE, max_features=FEATURES, swap=swap_terms(terms), always=np.unique(np.concatenate(mentions)))
    y = rows.y
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return None, None, share
    m, fold = len(rows.known), np.arange(len(y)) % 2
    best = None
    for l1 in L1:
        out = np.zeros(len(y))
        for k in range(2):
            of = np.flatnonzero(fold != k)
            if y[of].min() == y[of].max():
                of = np.arange(len(y))
            w, b = fit([rows.index[i] for i in of], y[of], m, _swap_rows(rows, of, mentions), l1=l1, penalty=penalty)
            for i in np.flatnonzero(fold == k):
                out[i] = w[rows.index[i]].sum() + b
        curve = _platt(out, y)
        p = 1 / (1 + np.exp(-np.clip(curve[0] * out + curve[1], -30, 30)))
        loss = -np.mean(np.log(np.where(y > 0, p, 1 - p)))
        if best is None or loss < best[0]:
            best = (loss, l1, curve)
    _, l1, (slope, offset) = best
    w, b = fit(rows.index, y, m, _swap_rows(rows, np.arange(len(y)), mentions), l1=l1, penalty=penalty)

    def to_score(margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(slope * (margin + b) + offset, -40, 40)))

    return rows.known, w, to_score


def score(docs: DataFrame, model, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and the carried columns of every row of docs."""
    known, weights, to_score = model
    if known is None:
        return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.lit(to_score).alias("score"), *carry)
    return score_rows(docs, RECIPE, known, weights, to_score, id_col=id_col, text_col=text_col, carry=carry)
