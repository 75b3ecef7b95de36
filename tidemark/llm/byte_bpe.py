"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token's bytes form a doubly linked list.  Every adjacent pair that the
vocabulary can merge waits in the bucket of its merge rank.  The ranks with
waiting positions are bits of a bitmap, whose words are summarised by bits of a
second and a third level, so the next rank is found by three find-first-set steps,
whatever the length of the pre-token; all of a rank's positions are merged from
left to right, and entries that an earlier merge has made stale are skipped.  The
work is O(n) merges of constant cost, which is what very long pre-tokens need.

Distinct units (a word with the white space before it) are split by the pattern and
encoded once per worker; texts are put together from their units' ids.  The
pattern's pieces depend on a unit alone unless the text holds white space other
than ASCII's, or one of U+001C-U+001F; such texts are split as a whole.

Defined cases: null text is the empty text and has no ids; special tokens' strings
are ordinary text; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.word_tokens import REMEMBERED, SpanCache, vocabulary_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


class RankQueue:
    """A priority queue of positions by rank; three levels of 64-bit words hold which ranks have any."""

    def __init__(self, ranks: int):
        n0 = (ranks >> 6) + 1
        n1 = (n0 >> 6) + 1
        self.low, self.mid, self.top = [0] * n0, [0] * n1, 0
        self.bucket: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        waiting = self.bucket.get(rank)
        if waiting is not None:
            waiting.append(position)
            return
        self.bucket[rank] = [position]
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions, in order of arrival."""
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = (b << 6) + (word & -word).bit_length() - 1
        bits = self.low[a]
        rank = (a << 6) + (bits & -bits).bit_length() - 1
        bits &= bits - 1
        self.low[a] = bits
        if not bits:
            word &= word - 1
            self.mid[b] = word
            if not word:
                self.top &= self.top - 1
        return rank, self.bucket.pop(rank)


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.pattern = regex.compile(pattern)
        self.unusual = regex.compile(r"[\x1c-\x1f\x85\u2028\u2029\p{Zs}--[ ]]", regex.V1)
        self.queue = RankQueue(len(self.bytes))
        self.single = [self.ranks.get(bytes([i]), -1) for i in range(256)]
        self.pair: dict[tuple[int, int], int] = {}
        self.cache = SpanCache(np.uint16 if len(self.bytes) <= 1 << 16 else np.uint32)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.decimal = [str(i) for i in range(len(self.bytes))]

    def _rank(self, left: int, right: int) -> int:
        """The rank of the pair's merge, or -1."""
        key = (left, right)
        rank = self.pair.get(key)
        if rank is None:
            if len(self.pair) > 2_000_000:
                self.pair.clear()
            rank = self.pair[key] = self.ranks.get(self.bytes[left] + self.bytes[right], -1)
        return rank

    def merge(self, token: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(token)
        if whole is not None:
            return [whole]
        n, rank_of, queue = len(token), self._rank, self.queue
        ids = [self.single[b] for b in token]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        for i in range(n - 1):
            r = rank_of(ids[i], ids[i + 1])
            if r >= 0:
                queue.push(r, i)
        while (got := queue.pop()) is not None:
            rank, positions = got
            if len(positions) > 1:
                positions.sort()
            for i in positions:
                j = after[i]
                # stale: the position was swallowed, or its pair is another by now
                if ids[i] < 0 or j >= n or rank_of(ids[i], ids[j]) != rank:
                    continue
                ids[i], ids[j] = rank, -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    r = rank_of(rank, ids[k])
                    if r >= 0:
                        queue.push(r, i)
                h = before[i]
                if h >= 0:
                    r = rank_of(ids[h], rank)
                    if r >= 0:
                        queue.push(r, h)
        return [x for x in ids if x >= 0]

    def encode_text(self, text: str) -> list[int]:
        return [i for piece in self.pattern.findall(text) for i in self.merge(piece.encode())]

    def encode(self, c: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """ids of all documents of the chunk, and where each document's begin."""
        starts, ends, offsets = _units(c)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(c.offsets), np.int64)
        keys, first, inverse = np.unique(K.hash_spans(c.data, starts, ends), return_index=True, return_inverse=True)
        if len(self.cache.starts) > REMEMBERED:
            self.cache.clear()
        slots = self.cache.find(keys)
        new = np.flatnonzero(slots < 0)
        if len(new):
            raw = c.data.tobytes()
            got = [self.encode_text(raw[a:b].decode()) for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            slots[new] = self.cache.add(keys[new], np.fromiter((i for g in got for i in g), self.cache.dtype, int(sizes.sum())), sizes)
        ids, sizes = self.cache.gather(slots[inverse])
        edges = np.concatenate(([0], np.cumsum(sizes)))[offsets]
        odd = self._odd(c)
        if len(odd):
            parts = np.split(ids, edges[1:-1])
            for d in odd.tolist():
                parts[d] = np.array(self.encode_text(c.bytes(c.offsets[d], c.offsets[d + 1]).decode()), ids.dtype)
            ids, edges = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, edges

    def _odd(self, c: K.Chunk) -> np.ndarray:
        """Documents whose white space is not ASCII's alone."""
        # lead bytes of U+0085, U+00A0, U+1680, U+2000-202F, U+205F and U+3000, or U+001C-U+001F themselves
        hint = np.isin(c.data, np.array([0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3], np.uint8))
        some = np.unique(np.searchsorted(c.offsets, np.flatnonzero(hint), "right") - 1)
        return np.array([d for d in some.tolist() if self.unusual.search(c.bytes(c.offsets[d], c.offsets[d + 1]).decode())], np.int64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids."""
        ids = ids.astype(np.int64)
        return self.flat[K.ragged(self.begins[ids], self.lengths[ids])]


def _units(c: K.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word with the white space before it; a document's last white space is a unit of its own."""
    w = K.split_words(c)
    counts = w.counts
    begin = c.offsets[:-1]
    prev = np.empty(len(w.starts), np.int64)
    if len(prev):
        prev[0] = 0
        prev[1:] = w.ends[:-1]
        some = counts > 0
        prev[w.offsets[:-1][some]] = begin[some]
    last = begin.copy()
    last[counts > 0] = w.ends[w.offsets[1:][counts > 0] - 1]
    tail = np.flatnonzero(last < c.offsets[1:])
    starts, ends = np.concatenate((prev, last[tail])), np.concatenate((w.ends, c.offsets[1:][tail]))
    order = np.argsort(starts, kind="stable")
    per = counts + np.bincount(tail, minlength=len(counts))
    return starts[order], ends[order], np.concatenate(([0], np.cumsum(per)))


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode(docs: DataFrame, *, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array of int), one row per row of docs."""
    path, pattern = _defaults(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for b in batches:
            for c in K.chunks(b.column(1)):
                ids, edges = bpe.encode(c)
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.lo, c.hi - c.lo), pa.array(np.diff(edges)), lists], ["doc_id", "n_tokens", "ids"])

    return _columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id, decoded (bytes) of rows with doc_id and ids."""
    path, pattern = _defaults(path, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for b in batches:
            out = [bpe.decode(np.array(x.as_py() or [], np.int64)).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, *, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_csv (decimal ids joined by commas), decoded (bytes of those ids): both directions in one pass."""
    path, pattern = _defaults(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for b in batches:
            for c in K.chunks(b.column(1)):
                ids, edges = bpe.encode(c)
                text = [",".join(map(bpe.decimal.__getitem__, ids[s:e].tolist())) for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                raw = bpe.decode(ids)
                bounds = np.concatenate(([0], np.cumsum(bpe.lengths[ids.astype(np.int64)])))[edges].astype(np.int64)
                decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.lo, c.hi - c.lo), pa.array(np.diff(edges)), pa.array(text, pa.string()), decoded], ["doc_id", "n_tokens", "ids_csv", "decoded"])

    return _columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_csv string, decoded binary")


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("_text"))


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or vocabulary_path(VOCABULARY), pattern or public_tokenizers.PATTERN
