"""The coder of `coder.py` over many chunks at once: a chunk is a lane of numpy arrays; payloads are the same to the byte."""

from __future__ import annotations

import numpy as np

from tidemark.functions.coder import _BOTTOM, _TOP, LIMIT

_MASK = _TOP - 1


def tables(chunks: np.ndarray, size: np.ndarray, block: np.ndarray, place: np.ndarray, interval: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of frequencies below each byte value, by state, and each chunk's state: Model's, online, of each block and interval.

    chunks: rows of bytes, of which size count; block and place: a chunk's block and its number in that.
    """
    blocks, k = int(block.max()) + 1, place // interval
    per = int(k.max()) + 1
    held = np.bincount(block * per + k, minlength=blocks * per).reshape(blocks, per)
    inside = np.arange(chunks.shape[1]) < size[:, None]
    cell = ((block * per + k) * 256)[:, None] + chunks
    added = np.bincount(cell[inside], minlength=blocks * per * 256).reshape(blocks, per, 256)
    counts, freq = np.zeros((blocks, 256), np.int64), np.empty((blocks, per, 256), np.int64)
    for i in range(per):
        freq[:, i] = 2 * counts + 1
        full = held[:, i] == interval
        counts[full] += added[full, i]
        while (big := 2 * counts.sum(1) + 256 >= LIMIT).any():
            counts[big] //= 2
    below = np.zeros((blocks * per, 257), np.int64)
    np.cumsum(freq.reshape(-1, 256), axis=1, out=below[:, 1:])
    return below, block * per + k


def _renew(low: np.ndarray, span: np.ndarray, lanes: np.ndarray, shift) -> None:
    """The coder's renormalisation of lanes; shift is told of which lanes a byte goes."""
    at = np.flatnonzero(((low ^ (low + span)) < _BOTTOM) | (span < 1 << 16))
    while len(at):
        lo, sp = low[at], span[at]
        sp = np.where((lo ^ (lo + sp)) >= _BOTTOM, -lo & 0xFFFF, sp)
        shift(at, lo)
        low[at], span[at] = lo, sp = lo << 8 & _MASK, sp << 8 & _MASK
        at = at[((lo ^ (lo + sp)) < _BOTTOM) | (sp < 1 << 16)]


def encode(chunks: np.ndarray, size: np.ndarray, below: np.ndarray, state: np.ndarray) -> list[bytes]:
    """Payloads of chunks; chunks come longest first."""
    lanes = len(size)
    low, span, ends = np.zeros(lanes, np.int64), np.full(lanes, _TOP - 1, np.int64), np.zeros(lanes, np.int64)
    out = np.zeros((lanes, 4 * chunks.shape[1] + 8), np.uint8)
    flat, row, total = below.ravel(), state * 257, below[state, 256]

    def shift(at: np.ndarray, lo: np.ndarray) -> None:
        out[at, ends[at]] = lo >> 24 & 0xFF
        ends[at] += 1

    for i in range(chunks.shape[1]):
        n = int(np.searchsorted(-size, -i))  # those longer than i
        at = row[:n] + chunks[:n, i]
        under = flat[at]
        part = span[:n] // total[:n]
        low[:n] += under * part
        span[:n] = (flat[at + 1] - under) * part
        _renew(low[:n], span[:n], ends, shift)
    every = np.arange(lanes)
    for _ in range(4):
        shift(every, low)
        low = low << 8 & _MASK
    ends += -ends % 4
    return [out[i, :e].tobytes() for i, e in enumerate(ends.tolist())]


def decode(payloads: list[bytes], size: np.ndarray, below: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Rows of bytes, of which size count; payloads come as encode's."""
    lanes, width = len(size), int(size.max())
    room = max(map(len, payloads)) + 4 * width + 8
    data = np.frombuffer(b"".join(p.ljust(room, b"\0") for p in payloads), np.uint8).reshape(lanes, room)
    code = (data[:, :4].astype(np.int64) << np.array([24, 16, 8, 0])).sum(1)
    low, span, ends = np.zeros(lanes, np.int64), np.full(lanes, _TOP - 1, np.int64), np.full(lanes, 4, np.int64)
    out = np.zeros((lanes, width), np.uint8)
    flat, row, total = below.ravel(), state * 257, below[state, 256]

    def shift(at: np.ndarray, lo: np.ndarray) -> None:
        code[at] = (code[at] << 8 | data[at, ends[at]]) & _MASK
        ends[at] += 1

    for i in range(width):
        n = int(np.searchsorted(-size, -i))
        part = span[:n] // total[:n]
        f = np.minimum((code[:n] - low[:n]) // part, total[:n] - 1)
        at = row[:n].copy()
        for step in (128, 64, 32, 16, 8, 4, 2, 1):
            at += np.where(flat[at + step] <= f, step, 0)
        out[:n, i] = at - row[:n]
        under = flat[at]
        low[:n] += under * part
        span[:n] = (flat[at + 1] - under) * part
        _renew(low[:n], span[:n], ends, shift)
    return out
