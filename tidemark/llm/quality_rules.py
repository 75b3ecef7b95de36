"""Quality rules: gradient-boosted trees over document statistics, on top of two fixed rules.

Statistics of whole texts are computed in numpy over many documents at once.  The
trees are grown here, by histograms and second-order gain with logistic loss, and
flattened into node arrays; scoring walks all documents down a tree in as many
vector steps as it is deep.  On the features in FALLING the score never rises as
the feature grows: splits against the direction are refused, and each child's
values are bounded by the midpoint of its parent's split.

The trees are fitted on at most MAX_ROWS labelled rows, those with the smallest
hash of the id; everything else covers all rows.

Defined cases: null text has no words (all statistics 0, base_failed true); with no
labelled row, or one class alone, the score is that class's share (0.5 for none)
and the base rules decide alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.store import Passed, crc_mod

MAX_ROWS = 20_000
THRESHOLD = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "exclaim_share", "comma_share", "other_share", "distinct_share", "words_per_line", "longest_word", "symbol_word_share")
#: Features on which the score may only fall.
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "exclaim_share", "symbol_word_share")

_KINDS = {"symbol": SYMBOLS, "upper": bytes(range(65, 91)), "digit": b"0123456789", "exclaim": b"!", "comma": b",.;:?", "letter": bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))}
_TABLES = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in _KINDS.items()}


def _per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _mark_repeats(key: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _tag(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes made different for different documents."""
    return K.mix64(h ^ K.mix64(doc.astype(np.uint64) + np.uint64(0x51ED2701)))


def statistics(c: K.Chunk) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts by name, and the feature matrix."""
    w = K.split_words(c)
    data, docs = c.data, len(c.offsets) - 1
    n = w.counts.astype(np.int64)
    doc = w.doc
    solid = ~K.white_space(data)
    points = (data & 0xC0) != 0x80
    word_chars = _per_doc(solid & points, c.offsets)
    counts = {k: _per_doc(t[data], c.offsets) for k, t in _TABLES.items()}
    h = K.hash_spans(data, w.starts, w.ends)
    # lines with a word
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate((c.offsets[:-1], breaks + 1)))
    starts = starts[starts < len(data)]
    line_of_break = np.searchsorted(starts, breaks, "right") - 1
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    ends = ends.copy()
    ends[line_of_break] = breaks
    words_in = np.searchsorted(w.starts, ends) - np.searchsorted(w.starts, starts)
    starts, ends = starts[words_in > 0], ends[words_in > 0]
    line_doc = np.searchsorted(c.offsets, starts, "right") - 1
    line_key = _tag(K.hash_spans(data, starts, ends), line_doc)
    lines = np.bincount(line_doc, minlength=docs)
    _, first = np.unique(line_key, return_index=True)
    dup = lines - np.bincount(line_doc[first], minlength=docs)
    # words in repeated windows of three
    at = K.window_starts(w, 3)
    again = at[_mark_repeats(_tag(K.ngrams(h, 3)[at], doc[at]))] if len(at) else at
    covered = np.zeros(len(h) + 3, bool)
    for j in range(3):
        covered[again + j] = True
    repeat = _per_doc(covered[: len(h)], w.offsets)
    _, first = np.unique(_tag(h, doc), return_index=True)
    distinct = np.bincount(doc[first], minlength=docs)
    size = w.ends - w.starts
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, doc, size)
    sym = np.concatenate(([0], np.cumsum(_TABLES["symbol"][data])))
    sym_words = _per_doc(sym[w.ends] > sym[w.starts], w.offsets)
    base = {"n_words": n, "word_chars": word_chars, "n_symbols": counts["symbol"], "n_dup_lines": dup, "n_repeat_words": repeat}
    some = np.maximum(n, 1).astype(float)
    chars = np.maximum(word_chars, 1).astype(float)
    other = word_chars - _per_doc(points & (_TABLES["letter"] | _TABLES["digit"] | _TABLES["symbol"] | _TABLES["exclaim"] | _TABLES["comma"])[data], c.offsets)
    x = [np.log1p(n), word_chars / some, counts["symbol"] / chars, dup / np.maximum(lines, 1), repeat / some, counts["upper"] / chars, counts["digit"] / chars, counts["exclaim"] / chars, counts["comma"] / some, other / chars, distinct / some, n / np.maximum(lines, 1), longest.astype(float), sym_words / some]
    return base, np.column_stack(x) if docs else np.zeros((0, len(FEATURES)))


@dataclass
class Trees:
    """All trees' nodes one after another; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        row = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, *, falling: tuple[int, ...] = (), trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Trees for labels 0/1; falling: numbers of the features on which the score may only fall."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Trees(*(np.zeros(0, t) for t in (np.int64, float, np.int64, np.int64, float)), np.zeros(0, np.int64), 0, float(np.log(share / (1 - share))))
    m = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    binned = np.column_stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(m)])
    down = np.zeros(m, bool)
    down[list(falling)] = True
    nodes: list[list[float]] = []
    roots = []
    prior = float(np.log(share / (1 - share)))
    margin = np.full(len(y), prior)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)

        def grow(rows: np.ndarray, level: int, lo: float, hi: float) -> int:
            here = len(nodes)
            sg, sh = g[rows].sum(), h[rows].sum()
            value = float(np.clip(sg / (sh + l2), lo, hi))
            nodes.append([0, 0.0, here, here, rate * value])
            if level == depth or len(rows) < 2 * least:
                margin[rows] += rate * value
                return here
            best = (1e-6, None)
            for f in range(m):
                width = len(edges[f]) + 1
                if width < 2:
                    continue
                b = binned[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(b, v, width))[:-1] for v in (g[rows], h[rows], None))
                gr, hr, nr = sg - gl, sh - hl, len(rows) - nl
                wl, wr = np.clip(gl / (hl + l2), lo, hi), np.clip(gr / (hr + l2), lo, hi)
                gain = gl * wl - 0.5 * (hl + l2) * wl**2 + gr * wr - 0.5 * (hr + l2) * wr**2 - (sg * value - 0.5 * (sh + l2) * value**2)
                gain[(nl < least) | (nr < least)] = -1
                if down[f]:
                    gain[wr > wl] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, wl[k], wr[k]))
            if best[1] is None:
                margin[rows] += rate * value
                return here
            f, k, wl, wr = best[1]
            go = binned[rows, f] <= k
            mid = (wl + wr) / 2
            # on a falling feature the left child stays above the midpoint, the right one below
            left = grow(rows[go], level + 1, *((mid, hi) if down[f] else (lo, hi)))
            right = grow(rows[~go], level + 1, *((lo, mid) if down[f] else (lo, hi)))
            nodes[here][:4] = [f, float(edges[f][k]), left, right]
            return here

        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    a = np.array(nodes, float)
    return Trees(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.array(roots, np.int64), depth, prior)


def labelled_sample(labels: DataFrame, column: str, rows: int, held_out: bool = False) -> DataFrame:
    """At most `rows` labelled ids (_id, _y), smallest hash first; without those that crc32 holds out unless asked for."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).select(F.col("doc_id").cast("bigint").alias("_id"), F.col(column).cast("double").alias("_y"))
    if not held_out:
        known = known.where(crc_mod(F.col("_id"), 4) != 2)
    return known.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(rows)


def labelled_texts(docs: DataFrame, picked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _y, _text of the picked labels, so many rows at most: of rows that repeat an id the one with the least text."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id")
    return rows.groupBy("_id").agg(F.min(F.struct("_text", "_y")).alias("r")).select("_id", "r._y", "r._text")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in K.chunks(b.column(1)):
            _, x = statistics(c)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(c.lo, c.hi - c.lo), lists], ["_y", "_x"])


def train(docs: DataFrame, labels: DataFrame, *, column: str = "quality", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    picked = labelled_sample(labels, column, max_rows)
    rows = labelled_texts(docs, picked, id_col, text_col)
    got = rows.select("_y", "_text").mapInArrow(_features, "_y double, _x array<double>").toPandas()
    x = np.array(got["_x"].tolist(), float).reshape(len(got), len(FEATURES))
    # rows arrive in any order; sums of floats should not depend on it
    order = np.lexsort((*x.T, got["_y"].to_numpy()))
    return fit(x[order], got["_y"].to_numpy()[order], falling=tuple(FEATURES.index(f) for f in FALLING))


def apply_rules(docs: DataFrame, model: Trees, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base counts, base_failed, score, kept and the carried columns of docs; one row per row of docs."""
    passed = Passed(docs, carry, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in K.chunks(b.column(1)):
                base, x = statistics(c)
                failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
                score = model.score(x)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.lo, c.hi - c.lo), *(pa.array(base[k].astype(np.int64)) for k in BASE), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold)), *passed.of(b, c.lo, c.hi - c.lo)], ["doc_id", *BASE, "base_failed", "score", "kept", *passed.names])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, score double, kept boolean" + passed.schema
    return docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"), *passed.extra).mapInArrow(run, schema)
