"""Quality classifier: naive Bayes support vectors.

Each indicator is scaled by its log-count ratio between the classes, each row is
brought to unit length, and a linear hinge-loss model is fitted by dual coordinate
descent; its weights are then mixed with their mean size (interpolation with naive
Bayes).  Margins become probabilities by a logistic curve fitted on margins from
two-fold cross-fitting, so that it is not fitted on rows the model has seen.

Defined cases: null or empty text scores by the bias alone; texts of any length are
read whole; repeated rows are scored each, and equal texts alike; of rows that repeat a
labelled id one is learned from; ties of features go by their hash; with no labelled row,
or one class alone, every score is that class's share (0.5 for none); an empty table gives
an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.linear_text import Recipe, score_rows, training_rows
from tidemark.llm.quality_rules import labelled_sample, labelled_texts

MAX_ROWS = 6_000
THRESHOLD = 0.7
RECIPE = Recipe(words=2, first=(2, 3), last=(1, 2, 3), repeats=True, case=True)


def log_count_ratio(index: list[np.ndarray], y: np.ndarray, m: int, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(m, alpha), np.full(m, alpha)
    for at, label in zip(index, y, strict=True):
        (p if label > 0 else q)[at] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(index: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, float]:
    """w and bias of min |w|^2/2 + sum cost * hinge, rows being scale[at] / sqrt(count)."""
    sign = np.where(y > 0, 1.0, -1.0)
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(y))
    norm = [1 / np.sqrt(max(len(a), 1)) for a in index]
    square = np.array([float((scale[a] ** 2).sum()) * k * k + 1 for a, k in zip(index, norm, strict=True)])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            a, s = index[i], scale[index[i]] * norm[i]
            grad = sign[i] * (w[a] @ s + bias) - 1
            new = min(max(alpha[i] - grad / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[a] += step * s
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step) / cost[i])
        if moved < 1e-3:
            break
    return w, bias


def _fit(index, y, m, beta: float = 0.25):
    ratio = log_count_ratio(index, y, m)
    share = y.mean()
    cost = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    w, bias = dual_coordinate_descent(index, ratio, y, cost)
    w = (1 - beta) * w + beta * np.abs(w).mean()
    return ratio * w, bias


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x = np.column_stack((margin, np.ones(len(margin))))
    v = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t) + 1e-6 * v)
        v = v - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(v[0], 1e-3)), float(v[1])


def _margins(index, weights, bias):
    return np.array([weights[a].sum() / np.sqrt(max(len(a), 1)) + bias for a in index])


def classify(docs: DataFrame, labels: DataFrame, *, column: str = "quality", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row of docs; fitted on labelled rows that are not held out."""
    picked = labelled_sample(labels, column, max_rows)
    sample = labelled_texts(docs, picked, id_col, text_col)
    rows = training_rows(sample, RECIPE)
    y = rows.y
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.lit(share).alias("score"))
    m = len(rows.known)
    fold = np.arange(len(y)) % 2
    out = np.zeros(len(y))
    for k in range(2):
        of = np.flatnonzero(fold != k)
        if y[of].min() == y[of].max():
            of = np.arange(len(y))
        weights, bias = _fit([rows.index[i] for i in of], y[of], m)
        at = np.flatnonzero(fold == k)
        out[at] = _margins([rows.index[i] for i in at], weights, bias)
    slope, offset = _platt(out, y)
    weights, bias = _fit(rows.index, y, m)
    # the count of known features must be the same in training and scoring: no weight is exactly 0
    weights = np.where(weights == 0, 1e-12, weights)

    def to_score(margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(slope * (margin + bias) + offset, -40, 40)))

    return score_rows(docs, RECIPE, rows.known, weights, to_score, normalise=True, id_col=id_col, text_col=text_col)
