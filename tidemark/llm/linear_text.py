"""What the two linear text classifiers share: n-gram indicators, their selection, and scoring of all rows.

Features are indicators of distinct hashed n-grams: words, word pairs, the first
bytes of longer words, the last bytes, and how often the text repeats itself.  A
feature is its own 64-bit hash; nothing is folded into fewer buckets, so no two
features share a weight.

Training rows are a bounded sample of the labelled ones (quality_rules.labelled_sample).
Of their features those with the largest difference between the classes are kept,
at most MAX_FEATURES; class counts are made by Spark, so that only the kept
features and the rows' indices into them come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.store import Passed, Scratch

MAX_FEATURES = 40_000


@dataclass(frozen=True)
class Recipe:
    """Which n-grams are features; lengths of first and last parts in bytes."""

    lower: bool = False
    words: int = 2
    first: tuple[int, ...] = ()
    last: tuple[int, ...] = ()
    repeats: bool = False
    case: bool = False


def _seed(h: np.ndarray, kind: int) -> np.ndarray:
    return K.mix64(h + np.uint64((kind * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF))


def features(c: K.Chunk, recipe: Recipe) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, feature) arrays, one pair for each kind; a feature may recur in a document."""
    if recipe.lower:
        c = K.lower_ascii(c)
    w = K.split_words(c)
    doc = w.doc
    h = K.hash_spans(c.data, w.starts, w.ends)
    yield doc, _seed(h, 1)
    for k in range(2, recipe.words + 1):
        at = K.window_starts(w, k)
        yield doc[at], _seed(K.ngrams(h, k)[at], k)
    size = w.ends - w.starts
    for n in recipe.first:
        some = np.flatnonzero(size > n)
        yield doc[some], _seed(K.hash_spans(c.data, w.starts[some], w.starts[some] + n), 100 + n)
    for n in recipe.last:
        some = np.flatnonzero(size > n)
        yield doc[some], _seed(K.hash_spans(c.data, w.ends[some] - n, w.ends[some]), 200 + n)
    if recipe.repeats:
        # sixteenths of the words that lie in a three-word window found before
        at = K.window_starts(w, 3)
        key = K.mix64(K.ngrams(h, 3)[at] ^ K.mix64(doc[at].astype(np.uint64)))
        _, first = np.unique(key, return_index=True)
        docs = len(w.offsets) - 1
        total, fresh = np.bincount(doc[at], minlength=docs), np.bincount(doc[at][first], minlength=docs)
        share = 16 * (total - fresh) // np.maximum(total, 1)
        some = np.flatnonzero(total > 0)
        yield some, _seed(share[some].astype(np.uint64), 300)
    if recipe.case:
        caps = np.concatenate(([0], np.cumsum((c.data >= 65) & (c.data <= 90))))
        many = caps[w.ends] - caps[w.starts]
        docs = len(w.offsets) - 1
        share = 16 * np.bincount(doc, (2 * many >= size) & (size > 1), docs) // np.maximum(np.bincount(doc, minlength=docs), 1)
        some = np.flatnonzero(w.counts > 0)
        yield some, _seed(share[some].astype(np.int64).astype(np.uint64), 301)


def distinct(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, doc))
    doc, feature = doc[order], feature[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
    return doc[keep], feature[keep]


class Lookup:
    """Numbers of known features: a bit table answers most of the misses, a sorted array the rest."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(known & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def find(self, doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The (document, number) pairs of known features, each once."""
        some = self.bits[(feature & np.uint64((1 << 22) - 1)).astype(np.int64)]
        doc, feature = doc[some], feature[some]
        if not len(self.known) or not len(doc):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, feature), len(self.known) - 1)
        hit = self.known[at] == feature
        key = np.unique(doc[hit] * len(self.known) + at[hit])
        return key // len(self.known), key % len(self.known)


@dataclass
class Rows:
    """Training rows as lists of feature numbers, in an order that does not depend on the cluster."""

    known: np.ndarray
    y: np.ndarray
    index: list[np.ndarray]
    swapped: list[np.ndarray | None] = field(default_factory=list)


def training_rows(sample: DataFrame, recipe: Recipe, *, max_features: int = MAX_FEATURES, least: int = 3, swap=None, always: np.ndarray | None = None) -> Rows:
    """sample: _id, _y, _text. swap: gives a chunk's counterfactual (chunk, documents changed). always: features kept in any case."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in K.chunks(b.column(2)):
                # a swapped text is made only of documents with a term to swap
                for kind, (part, changed) in enumerate(((c, np.ones(c.hi - c.lo, bool)), *((swap(c),) if swap else ()))):
                    pairs = list(features(part, recipe))
                    doc, feat = distinct(np.concatenate([d for d, _ in pairs]), np.concatenate([f for _, f in pairs]))
                    some = np.flatnonzero(changed)
                    bounds = np.searchsorted(doc, np.arange(c.hi - c.lo + 1))
                    size = np.diff(bounds)[some]
                    values = feat[K.ragged(bounds[some], size)]
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(K.signed(values)))
                    at = pa.array(c.lo + some)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.full(len(some), kind, np.int32)), lists], ["_id", "_y", "_kind", "_f"])

    scratch = Scratch(sample.sparkSession)
    rows = scratch.save(sample.select("_id", "_y", "_text").mapInArrow(extract, "_id long, _y double, _kind int, _f array<long>"), "text-features")
    real = rows.where("_kind = 0")
    total = real.agg(F.sum("_y").alias("p"), F.count("*").alias("n")).first()
    pos, neg = float(total["p"] or 0), float(total["n"] - (total["p"] or 0))
    counts = real.select("_y", F.explode("_f").alias("f")).groupBy("f").agg(F.sum("_y").alias("p"), F.count("*").alias("n")).where(F.col("n") >= least)
    rate_p, rate_n = (F.col("p") + 0.5) / (pos + 1), (F.col("n") - F.col("p") + 0.5) / (neg + 1)
    # difference of log rates in units of its standard error
    z = F.abs(F.log(rate_p / rate_n)) / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") - F.col("p") + 0.5))
    best = counts.select("f", F.round(z, 9).alias("z")).orderBy(F.desc("z"), "f").limit(max_features)
    known = np.array([r["f"] for r in best.collect()], np.int64).view(np.uint64)
    known = np.unique(known if always is None else np.concatenate((known, always)))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(known)
        for b in batches:
            size = np.asarray(b.column(3).value_lengths().fill_null(0)).astype(np.int64)
            doc, at = look.find(np.repeat(np.arange(len(size)), size), np.asarray(b.column(3).flatten()).view(np.uint64))
            edges = np.searchsorted(doc, np.arange(len(size) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(pa.array(edges), pa.array(at.astype(np.int32)))], ["_id", "_y", "_kind", "_f"])

    got = rows.mapInArrow(number, "_id long, _y double, _kind int, _f array<int>").toPandas()
    scratch.drop()
    got["_len"] = got["_f"].map(len)
    got = got.sort_values(["_kind", "_id", "_y", "_len"], kind="stable")
    first, second = got[got["_kind"] == 0], got[got["_kind"] == 1]
    other = {i: np.array(f, np.int64) for i, f in zip(second["_id"], second["_f"], strict=True)}
    return Rows(known, first["_y"].to_numpy(), [np.array(f, np.int64) for f in first["_f"]], [other.get(i) for i in first["_id"]])


def score_rows(docs: DataFrame, recipe: Recipe, known: np.ndarray, weights: np.ndarray, to_score, *, normalise: bool = False, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and the carried columns; to_score turns margins (sums of weights, over the root of the count if normalised) into 0 to 1."""
    used = weights != 0
    names, values = known[used], weights[used]
    passed = Passed(docs, carry, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(names)
        for b in batches:
            for c in K.chunks(b.column(1)):
                docs_here = c.hi - c.lo
                margin, count = np.zeros(docs_here), np.zeros(docs_here)
                for doc, feat in features(c, recipe):
                    at_doc, at = look.find(doc, feat)
                    margin += np.bincount(at_doc, values[at], docs_here) if len(at) else 0
                    count += np.bincount(at_doc, minlength=docs_here) if len(at) else 0
                if normalise:
                    margin = margin / np.sqrt(np.maximum(count, 1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.lo, docs_here), pa.array(to_score(margin)), *passed.of(b, c.lo, docs_here)], ["doc_id", "score", *passed.names])

    return docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"), *passed.extra).mapInArrow(run, "doc_id long, score double" + passed.schema)
