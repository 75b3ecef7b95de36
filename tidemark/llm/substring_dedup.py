"""Removal of passages that an earlier document already holds, by level-wise doubling.

A window of `window` words is looked for through shorter ones.  The levels are
lengths that double up to `window` (7 and 13 for 13).  At the shortest level only
one anchor for each window position is emitted - the sub-window with the smallest
hash - so about a quarter of the positions are shuffled; equal windows have equal
anchors, so none is lost.  Anchors that occur in one document alone end there.
Around those that repeat, windows of twice the length are formed, of which again
only the repeated ones go on, until `window` is reached or no candidate is left.
At the last level, 96 bits of hash identify a window.

Exact copies of an earlier text cannot be a window's first holder, and all their
windows are repeats; they skip the search and are marked whole.  So a group of
copies of any size adds one document to the search.

Defined cases: null text has no words; a document of fewer than `window` words
loses nothing; rows with one doc_id do not remove each other's words and each row
is judged by its own text; rows with a null doc_id are returned unchanged; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.store import materialise

WINDOW = 13
#: No level is shorter than this.
SHORTEST = 6


def levels(window: int) -> list[int]:
    """Lengths that double, rounded up so that the last is the window."""
    out = [window]
    while -(-out[0] // 2) >= SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out


def anchor_positions(g: np.ndarray, w: K.Words, k: int, window: int) -> np.ndarray:
    """Word numbers of the leftmost smallest k-gram of each window of `window` words, once each."""
    at = K.window_starts(w, window)
    if not len(at):
        return at
    span = window - k + 1
    low = g[at]
    for j in range(1, span):
        low = np.minimum(low, g[at + j])
    pos = np.zeros(len(at), np.int64)
    for j in range(span - 1, -1, -1):
        hit = g[at + j] == low
        pos[hit] = at[hit] + j
    return pos[np.concatenate(([True], pos[1:] != pos[:-1]))]


def _tags(g: np.ndarray, w: K.Words) -> np.ndarray:
    """Window hashes made different for different documents; those that leave their document are of no use."""
    return K.mix64(g ^ K.mix64(w.doc[: len(g)].astype(np.uint64) + np.uint64(0x5DE)))


def _once(tags: np.ndarray) -> np.ndarray:
    """Places of the first of equal tags."""
    return np.sort(np.unique(tags, return_index=True)[1])


def _all_of(at: np.ndarray, g: np.ndarray, w: K.Words) -> np.ndarray:
    """True at every place of a document whose window equals one at the given places."""
    out = np.zeros(len(w.starts) + 1, bool)
    if len(at):
        tags = _tags(g, w)
        out[: len(g)] = np.isin(tags, tags[at])
    return out


def _anchors(k: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for c in K.chunks(b.column(2)):
                w = K.split_words(c)
                h = K.hash_spans(c.data, w.starts, w.ends)
                g = K.ngrams(h, k)
                pos = anchor_positions(g, w, k, window)
                if len(pos):
                    # of a window that recurs in its document the first is enough
                    pos = pos[_once(_tags(g, w)[pos])]
                doc = np.searchsorted(w.offsets, pos, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(g[pos])), pa.array(ids[c.lo + doc]), pa.array(keys[c.lo + doc]), pa.array((pos - w.offsets[doc]).astype(np.int32))], ["_h", "_id", "_key", "_pos"])

    return run


def _list_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    return np.asarray(column.flatten()).astype(np.int64), lengths


def _windows(k: int, length: int, window: int, first: bool):
    """Windows of `length` words near the surviving positions of level k.  first: the survivors are anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            values, lengths = _list_column(b.column(3))
            bounds = np.concatenate(([0], np.cumsum(lengths)))
            for c in K.chunks(b.column(2)):
                w = K.split_words(c)
                n = len(w.starts)
                h = K.hash_spans(c.data, w.starts, w.ends)
                g = K.ngrams(h, k)
                live = _all_of(values[bounds[c.lo] : bounds[c.hi]] + np.repeat(w.offsets[:-1], lengths[c.lo : c.hi]), g, w)
                at = K.window_starts(w, length)
                if first:
                    # within a window of full length whose anchor survived
                    full = K.window_starts(w, window)
                    span = window - k + 1
                    low = g[full] if len(full) else np.zeros(0, np.uint64)
                    for j in range(1, span):
                        low = np.minimum(low, g[full + j])
                    ok = np.zeros(len(full), bool)
                    for j in range(span):
                        ok |= live[full + j] & (g[full + j] == low)
                    edge = np.zeros(n + 2, np.int64)
                    np.add.at(edge, full[ok], 1)
                    np.add.at(edge, full[ok] + window - length + 1, -1)
                    at = at[np.cumsum(edge)[at] > 0]
                else:
                    at = at[live[at] & live[at + length - k]]
                if not len(at):
                    continue
                h2 = K.hash_spans(c.data, w.starts, w.ends, 1)
                grams = K.ngrams(h, length)
                at = at[_once(_tags(grams, w)[at])]
                one, two = grams[at], K.ngrams(h2, length)[at]
                doc = np.searchsorted(w.offsets, at, "right") - 1
                pos = (at - w.offsets[doc]).astype(np.uint64)
                packed = (two & np.uint64(0xFFFFFFFF00000000)) | pos
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(one)), pa.array(ids[c.lo + doc]), pa.array(keys[c.lo + doc]), pa.array(K.signed(packed))], ["_h", "_id", "_key", "_packed"])

    return run


def _remove(window: int, verbatim: bool, carried: list[str]):
    names = ["doc_id", "n_words", "n_removed", "kept_text", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = np.asarray(b.column(2).fill_null(False))
            values, lengths = _list_column(b.column(3))
            bounds = np.concatenate(([0], np.cumsum(lengths)))
            for c in K.chunks(b.column(1)):
                w = K.split_words(c)
                n = len(w.starts)
                at = values[bounds[c.lo] : bounds[c.hi]] + np.repeat(w.offsets[:-1], lengths[c.lo : c.hi])
                gone = np.zeros(n, bool)
                if len(at):
                    hit = np.flatnonzero(_all_of(at, K.ngrams(K.hash_spans(c.data, w.starts, w.ends), window), w))
                    hit = hit[hit + window <= w.doc_end[hit]]
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, hit, 1)
                    np.add.at(edge, hit + window, -1)
                    gone = np.cumsum(edge)[:n] > 0
                counts = w.counts
                gone |= np.repeat(whole[c.lo : c.hi] & (counts >= window), counts)
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), w.offsets[:-1]) * (counts > 0)
                keep = ~gone
                kept = K.join_words(c, w.starts[keep], w.ends[keep], np.concatenate(([0], np.cumsum(counts - removed))))
                if verbatim:
                    kept = pc.if_else(pa.array(removed == 0), b.column(1).slice(c.lo, c.hi - c.lo), kept)
                rest = [b.column(4 + k).slice(c.lo, c.hi - c.lo) for k in range(len(carried))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.lo, c.hi - c.lo), pa.array(counts.astype(np.int64)), pa.array(removed.astype(np.int64)), kept, *rest], names)

    return run


def _repeated(df: DataFrame, *key: str) -> DataFrame:
    """Rows whose key occurs in two or more documents, with the smallest of these."""
    over = Window.partitionBy(*key)
    return df.withColumn("_first", F.min("_id").over(over)).withColumn("_last", F.max("_id").over(over)).where("_first < _last")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, verbatim: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the kept words joined by one space), one row per row of docs.

    verbatim: a text that loses nothing stays as it is. carry: other columns of docs to pass through.
    """
    if window < 2:
        raise ValueError("window must be two words or more")
    # One exchange of the texts, by row key, serves every pass.
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col)).alias("_key"), F.col(text_col).alias("_text"), F.md5(F.col(text_col)).alias("_md5"), *(F.col(c).alias(f"_carry{k}") for k, c in enumerate(carry))).repartition("_key")
    firsts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.md5(F.col(text_col)).alias("_m")).agg(F.min(F.struct(F.col(id_col).cast("bigint").alias("i"), F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col)).alias("k"))).alias("s")).select(F.col("s.k").alias("_key"), F.lit(True).alias("_is_first"))
    marked = rows.join(firsts.hint("shuffle_hash"), "_key", "left")
    steps = levels(window)
    k = steps[0]
    if len(steps) == 1:
        steps = [k, k]
    found = marked.where("_is_first").select("_id", "_key", "_text").mapInArrow(_anchors(k, window), "_h long, _id long, _key long, _pos int")
    live = _repeated(found.repartition("_h"), "_h").select("_key", "_pos")
    for n, length in enumerate(steps[1:], 1):
        last = n == len(steps) - 1
        at = live.groupBy("_key").agg(F.collect_list("_pos").alias("_at"))
        near = rows.select("_id", "_key", "_text").join(at.hint("shuffle_hash"), "_key").select("_id", "_key", "_text", "_at")
        cand = near.mapInArrow(_windows(steps[n - 1], length, window, n == 1), "_h long, _id long, _key long, _packed long")
        again = _repeated(cand.withColumn("_high", F.shiftright("_packed", 32)).repartition("_h"), "_h", "_high")
        live = (again.where("_id > _first") if last else again).select("_key", F.col("_packed").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("_pos"))
        if not last:
            live = materialise(live, "substring-level")
            if live.isEmpty():
                break
    at = live.groupBy("_key").agg(F.collect_list("_pos").alias("_at"))
    # A later copy of a text; a text that recurs under its own first doc_id is no copy.
    out = marked.join(at.hint("shuffle_hash"), "_key", "left")
    kinds = dict(docs.dtypes)
    schema = "doc_id long, n_words long, n_removed long, kept_text string" + "".join(f", `{c}` {kinds[c]}" for c in carry)
    return out.select("_id", "_text", (F.col("_is_first").isNull() & F.col("_id").isNotNull()).alias("_whole"), "_at", *(f"_carry{k}" for k in range(len(carry)))).mapInArrow(_remove(window, verbatim, list(carry)), schema)
