"""Vectorised text kernels over Arrow string buffers.

Every function works on the UTF-8 bytes of a run of documents at once, so that
no Python object is made per word.  A *word* is a maximal run of bytes other
than 0x20 and 0x09-0x0D; UTF-8 continuation bytes are never in that set, so
byte runs and code point runs agree.

Null text counts as the empty text here; callers that must tell them apart look
at the column's null mask.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one kernel call handles, unless a single document is longer.
CHUNK_BYTES = 2 << 20

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_R = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _byte_values(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_VALUES = (_byte_values(11), _byte_values(12))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow_tables(n: int) -> list[np.ndarray]:
    """r**i and r**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_R, pow(_R, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Chunk:
    """Documents lo..hi of a batch: their bytes and the offsets of each within them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def bytes(self, a: int, b: int) -> bytes:
        return self.data[a:b].tobytes()


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts a string column into runs of whole documents of about `size` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


@dataclass
class Words:
    """starts, ends: byte positions of words; offsets: the word number at which each document begins."""

    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    @property
    def doc_end(self) -> np.ndarray:
        return np.repeat(self.offsets[1:], self.counts)


def white_space(data: np.ndarray) -> np.ndarray:
    return _WS[data]


def split_words(c: Chunk) -> Words:
    n = len(c.data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(c.offsets), np.int64))
    ws = _WS[c.data]
    edge = np.zeros(n + 1, bool)
    edge[c.offsets] = True
    before = edge[:n].copy()
    before[0] = True
    before[1:] |= ws[:-1]
    after = edge[1:].copy()
    after[-1] = True
    after[:-1] |= ws[1:]
    solid = ~ws
    starts = np.flatnonzero(solid & before)
    ends = np.flatnonzero(solid & after) + 1
    return Words(starts, ends, np.searchsorted(starts, c.offsets))


def lower_ascii(c: Chunk) -> Chunk:
    return Chunk(c.lo, c.hi, _LOWER[c.data], c.offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, block: int = CHUNK_BYTES) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are in order and do not overlap. `which` picks one of two independent hashes."""
    out = np.empty(len(starts), np.uint64)
    lo, values = 0, _VALUES[which]
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + block, "right")))
        seg = data[base : int(ends[hi - 1])]
        up, down = _pow_tables(max(len(seg) + 1, block + 1))
        total = np.empty(len(seg) + 1, np.uint64)
        total[0] = 0
        np.cumsum(values[seg] * up[: len(seg)], out=total[1:])
        a, b = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mix64((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        lo = hi
    return out


_GRAM = [int(x) | 1 for x in np.random.Generator(np.random.PCG64(13)).integers(1, 1 << 63, 4096, dtype=np.uint64)]


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes; positions whose window leaves the document are the caller's to drop."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n] * np.uint64(_GRAM[0])
    for j in range(1, k):
        g += h[j : n + j] * np.uint64(_GRAM[j])
    return mix64(g)


def window_starts(w: Words, k: int) -> np.ndarray:
    """Word numbers at which a window of k words lies within one document."""
    n = len(w.starts)
    return np.flatnonzero(np.arange(n) + k <= w.doc_end) if n >= k else np.zeros(0, np.int64)


def sequence_hash(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One hash of each document's whole word sequence (0 words: the hash of nothing)."""
    n = len(h)
    up, _ = _pow_tables(max(n + 1, 2))
    at = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(h) * up[at], out=total[1:])
    return mix64(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64) * np.uint64(_GRAM[1]))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated index ranges starts[i] .. starts[i] + lengths[i]."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(first - starts, lengths)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return x.view(np.int64)


def join_words(c: Chunk, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """For each document, its given words joined by one space, as a large_string array."""
    lengths = ends - starts
    width = lengths + 1
    to = np.cumsum(width) - width
    out = np.full(int(width.sum()), 0x20, np.uint8)
    out[ragged(to, lengths)] = c.data[ragged(starts, lengths)]
    bounds = np.append(to, len(out))[offsets]
    # the space after a document's last word is dropped
    some = np.diff(offsets) > 0
    keep = np.ones(len(out), bool)
    keep[bounds[1:][some] - 1] = False
    out = out[keep]
    size = np.diff(bounds) - some
    edges = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(edges), pa.py_buffer(out)).cast(pa.string())
