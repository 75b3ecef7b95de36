"""A lossless archive: range coder over integer counts, prequential replay, framing.

Frequencies are integers (twice the count plus one, so alpha is one half), updated
after each full interval, so encoder and decoder agree without floating point.
Payloads are padded to multiples of four bytes.
"""

from __future__ import annotations

import json
import struct
import zlib
from itertools import accumulate, pairwise

MAGIC = b"TDMK"
VERSION = 3
_TOP, _BOTTOM = 1 << 32, 1 << 24


def varint(n: int) -> bytes:
    if n < 0:
        raise ValueError("a varint is not negative")
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("the varint is cut off")
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


class Counts:
    """Frequencies 2 n + 1 of 256 byte values in a Fenwick tree."""

    def __init__(self, counts=None):
        self.tree, self.total = [0] * 257, 0
        for s in range(256):
            self.add(s, 1 + (2 * int(counts[s]) if counts is not None else 0))

    def add(self, s: int, by: int) -> None:
        self.total += by
        s += 1
        while s < 257:
            self.tree[s] += by
            s += s & -s

    def below(self, s: int) -> int:
        out = 0
        while s:
            out += self.tree[s]
            s &= s - 1
        return out

    def find(self, f: int) -> int:
        at, step = 0, 256
        while step:
            if at + step <= 256 and self.tree[at + step] <= f:
                at += step
                f -= self.tree[at]
            step >>= 1
        return at


class Encoder:
    """Carry-less range coder of 32 bits."""

    def __init__(self) -> None:
        self.low, self.range, self.out = 0, _TOP - 1, bytearray()

    def put(self, low: int, freq: int, total: int) -> None:
        r = self.range // total
        self.low += low * r
        self.range = freq * r
        while (self.low ^ (self.low + self.range)) < _BOTTOM or self.range < 1 << 16:
            if (self.low ^ (self.low + self.range)) >= _BOTTOM:
                self.range = -self.low & 0xFFFF
            self.out.append(self.low >> 24 & 0xFF)
            self.low = self.low << 8 & 0xFFFFFFFF
            self.range = self.range << 8 & 0xFFFFFFFF

    def finish(self) -> bytes:
        for _ in range(4):
            self.out.append(self.low >> 24 & 0xFF)
            self.low = self.low << 8 & 0xFFFFFFFF
        return bytes(self.out) + b"\0" * (-len(self.out) % 4)


class Decoder:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 4
        self.low, self.range, self.code = 0, _TOP - 1, int.from_bytes(data[:4].ljust(4, b"\0"), "big")

    def at_freq(self, total: int) -> int:
        self.step = self.range // total
        return min((self.code - self.low) // self.step, total - 1)

    def take(self, low: int, freq: int) -> None:
        self.low += low * self.step
        self.range = freq * self.step
        while (self.low ^ (self.low + self.range)) < _BOTTOM or self.range < 1 << 16:
            if (self.low ^ (self.low + self.range)) >= _BOTTOM:
                self.range = -self.low & 0xFFFF
            self.code = (self.code << 8 | (self.data[self.at] if self.at < len(self.data) else 0)) & 0xFFFFFFFF
            self.at += 1
            self.low = self.low << 8 & 0xFFFFFFFF
            self.range = self.range << 8 & 0xFFFFFFFF


#: Total frequency beyond which all counts are halved, so that the coder's range holds them.
LIMIT = 1 << 16


class Model:
    """Frozen within an interval, updated after it if it is full."""

    def __init__(self, online: bool):
        self.online, self.counts = online, [0] * 256
        self.state = Counts()

    def update(self, chunk: bytes) -> None:
        if not self.online:
            return
        for b in chunk:
            self.counts[b] += 1
        while 2 * sum(self.counts) + 256 >= LIMIT:
            self.counts = [c // 2 for c in self.counts]
        self.state = Counts(self.counts)

    def encode(self, chunk: bytes) -> bytes:
        e, s = Encoder(), self.state
        for b in chunk:
            low = s.below(b)
            e.put(low, s.below(b + 1) - low, s.total)
        return e.finish()

    def decode(self, payload: bytes, n: int) -> bytes:
        d, s, out = Decoder(payload), self.state, bytearray()
        for _ in range(n):
            b = s.find(d.at_freq(s.total))
            low = s.below(b)
            d.take(low, s.below(b + 1) - low)
            out.append(b)
        return bytes(out)


def compress(chunks: list[bytes], *, interval: int, online: bool, settings: dict) -> bytes:
    """The archive of a stream's chunks in coding order."""
    model, payloads = Model(online), []
    for k in range(0, len(chunks), interval):
        group = chunks[k : k + interval]
        payloads += [model.encode(c) for c in group]
        if len(group) == interval:
            model.update(b"".join(group))
    return build(settings, sum(map(len, chunks)), [len(c) for c in chunks], payloads)


def build(settings: dict, total: int, lengths: list[int], payloads: list[bytes], framing: bytes = b"") -> bytes:
    """Payloads one after another, then a compressed index of them in JSON, and last the index's size."""
    if len(lengths) != len(payloads):
        raise ValueError("as many payloads as lengths are needed")
    table = [[n, len(p)] for n, p in zip(lengths, payloads, strict=True)]
    index = zlib.compress(json.dumps({"settings": settings, "symbols": total, "framing": framing.hex(), "chunks": table}, sort_keys=True).encode(), 9)
    return MAGIC + bytes([VERSION]) + b"".join(payloads) + index + struct.pack(">I", len(index))


def parse(data: bytes) -> tuple[dict, bytes, int, list[int], list[bytes]]:
    """Settings, framing, symbols, and of each chunk its length and payload."""
    if data[:4] != MAGIC:
        raise ValueError("not an archive")
    if data[4] != VERSION:
        raise ValueError(f"archive version {data[4]} is not {VERSION}")
    wrong = "the archive's parts are not as long as stated"
    end = len(data) - 4
    start = end - struct.unpack(">I", data[end:])[0] if end >= 5 else -1
    if start < 5:
        raise ValueError(wrong)
    try:
        index = json.loads(zlib.decompress(data[start:end]))
    except (zlib.error, ValueError) as e:
        raise ValueError(wrong) from e
    sizes = [n for _, n in index["chunks"]]
    if 5 + sum(sizes) != start:
        raise ValueError(wrong)
    edges = list(accumulate(sizes, initial=5))
    payloads = [data[x:y] for x, y in pairwise(edges)]
    return index["settings"], bytes.fromhex(index["framing"]), index["symbols"], [n for n, _ in index["chunks"]], payloads


def decompress(data: bytes, *, interval: int, online: bool, settings: dict) -> bytes:
    """Replays the schedule on what has been decoded; refuses an archive made with other settings."""
    meta, _, total, lengths, payloads = parse(data)
    if meta != json.loads(json.dumps(settings)):
        raise ValueError("the archive was made with other settings")
    model, out = Model(online), []
    for k in range(0, len(payloads), interval):
        group = [model.decode(p, n) for p, n in zip(payloads[k : k + interval], lengths[k : k + interval], strict=True)]
        out += group
        if len(group) == interval:
            model.update(b"".join(group))
    whole = b"".join(out)
    if len(whole) != total:
        raise ValueError("the decoded stream is not as long as stated")
    return whole


def wav(pcm: bytes, rate: int = 8000) -> bytes:
    """8-bit mono PCM with its 44-byte header."""
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(pcm)) + pcm


def archive_meta(config, role: str, environment: dict) -> dict:
    """What an archive says of its making: role, modality, settings and environment."""
    return {"role": role, "modality": config.modality, "settings": config.settings_hash(role), "environment": environment}


def check_meta(meta: dict, config, role: str, environment: dict) -> None:
    """An error that names the first difference, in the order role, modality, settings, environment."""
    want = archive_meta(config, role, environment)
    for name in ("role", "modality", "settings", "environment"):
        if meta.get(name) != want[name]:
            raise ValueError(f"the archive's {name} differs: {meta.get(name)!r} is not {want[name]!r}")
