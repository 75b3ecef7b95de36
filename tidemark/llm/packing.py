"""Best-fit packing of token sequences, improved by swap-based local search.

Documents are tokenised, an end id is added, and only those longer than the
capacity are cut.  Full pieces are sequences as they are.  The rest are dealt by a
hash to shards of about SHARD pieces, so that a shard's waste of less than one
sequence is small against its content, and each shard is packed by itself:

* a first assignment, each piece in the order of their hash into the open bin with the
  least sufficient room (a bitmap of rooms finds it);
* then local search: a bin's documents move to, or are exchanged one for one or two
  for one with, those of other underfull bins, each step raising the sum of squared
  fills, until that bin is empty or no step is left.  Passes over the underfull bins,
  emptiest first, go on until none of them has a step left, or until the number of
  bins is the least possible, total / capacity;
* where that is not reached, the documents of all underfull bins are assigned anew,
  longest first, and searched again, as long as that saves a bin; and last a search of
  all documents assigned longest first is held against it.

`search_steps` tells how many steps a shard's search took.

Defined cases: null or empty text is the end id alone; an empty table packs to no
row; repeated rows are packed each; ids of any value, null too, are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.word_tokens import vocabulary_path, word_tokenizer

CAPACITY = 4096
END_ID = 1
#: Pieces that one task packs together.
SHARD = 32_768


def tokenise(docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit, as bytes): each document's ids and end id in pieces of at most capacity."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(path)
        for b in batches:
            for c in K.chunks(b.column(1)):
                ids, offs = tok.encode(c)
                n = np.diff(offs)
                flat = np.full(len(ids) + len(n), end_id, "<u4")
                flat[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                size = n + 1
                pieces = -(-size // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, size[doc] - start)
                edges = np.concatenate(([0], np.cumsum(length))) * 4
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(c.lo + doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), raw], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: list[int], capacity: int, *, longest_first: bool = True) -> list[list[int]]:
    """Bins of item numbers: longest first or as they come, each into the open bin with the least sufficient room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True) if longest_first else range(len(lengths)):
        size = lengths[i]
        above = mask >> size
        if above:
            r = size + (above & -above).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
            bins[k].append(i)
        else:
            r, k = capacity, len(bins)
            bins.append([i])
        if r > size:
            room[r - size].append(k)
            mask |= 1 << (r - size)
    return bins


class _Search:
    """Underfull bins: item sizes, the bin of each, the items and the fill of each bin."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.items = [i for b in bins for i in b]
        self.size = np.array([lengths[i] for i in self.items], np.int64)
        self.bin = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        edges = np.cumsum([0, *map(len, bins)]).tolist()
        self.members = [list(range(lo, hi)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        self.fill = np.bincount(self.bin, self.size, len(bins)).astype(np.int64)
        self.capacity, self.steps = capacity, 0

    def put(self, at: int, to: int) -> None:
        self.fill[self.bin[at]] -= self.size[at]
        self.members[self.bin[at]].remove(at)
        self.bin[at] = to
        self.members[to].append(at)
        self.fill[to] += self.size[at]

    def step(self, a: int) -> bool:
        """One step that takes weight from bin a into a bin that is at least as full; True if there was one."""
        mine = self.members[a]
        sizes, one, count = np.unique(self.size[mine], return_index=True, return_counts=True)
        room = self.capacity - self.fill
        better = (self.fill >= self.fill[a]) & (room > 0)
        better[a] = False
        room[~better] = 0
        k = int(np.searchsorted(sizes, room.max(), "right")) - 1
        if k >= 0:  # move
            fit = np.flatnonzero(room >= sizes[k])
            self.put(mine[one[k]], int(fit[np.argmin(room[fit])]))
            self.steps += 1
            return True
        # one for one, two for one: the most that can come for an item is the largest sum that its bin still holds in its stead
        pairs = sizes[:, None] + sizes
        pairs[np.diag_indices(len(sizes))] = np.where(count > 1, 2 * sizes, 0)
        sums = np.zeros(self.capacity + 1, np.int64)
        for x in (sizes, pairs[pairs <= self.capacity]):
            sums[x] = x
        np.maximum.accumulate(sums, out=sums)
        rest = room[self.bin]
        gain = np.where(rest > 0, sums[self.size + rest] - self.size, 0)
        other = int(np.argmax(gain))
        if gain[other] <= 0:
            return False
        total = int(gain[other] + self.size[other])
        at = int(np.searchsorted(sizes, total))
        if at < len(sizes) and sizes[at] == total:
            group = [mine[one[at]]]
        else:
            x, y = (int(v[0]) for v in np.nonzero(pairs == total))
            second = next(i for i in mine if self.size[i] == sizes[y] and i != mine[one[x]])
            group = [mine[one[x]], second]
        to = int(self.bin[other])
        self.put(other, a)
        for i in group:
            self.put(i, to)
        self.steps += 1
        return True


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[list[list[int]], int]:
    """Exchanges between underfull bins until none has a step left, and their number. Squared fill rises with each step, so it ends."""
    least = -(-sum(lengths) // capacity)
    full, open_bins, again, steps = [], bins, True, 0
    while again and len(full) + len(open_bins) > least:
        fill = [sum(lengths[i] for i in b) for b in open_bins]
        full += [b for b, f in zip(open_bins, fill, strict=True) if f == capacity]
        s = _Search([b for b, f in zip(open_bins, fill, strict=True) if f < capacity], lengths, capacity)
        left = len(s.members)
        for a in np.argsort(s.fill, kind="stable").tolist():
            while s.fill[a] and s.step(a):
                pass
            left -= s.fill[a] == 0
            if len(full) + left <= least:
                break
        again, steps = s.steps > 0, steps + s.steps
        open_bins = [[s.items[i] for i in m] for m in s.members if m]
    return full + open_bins, steps


def pack_lengths(lengths: list[int], capacity: int) -> tuple[list[list[int]], int]:
    """Bins of item numbers, and the steps that the search took."""
    bins, steps = local_search(best_fit(lengths, capacity, longest_first=False), lengths, capacity)
    least = -(-sum(lengths) // capacity)
    while len(bins) > least:
        full = [b for b in bins if sum(lengths[i] for i in b) == capacity]
        rest = [i for b in bins if sum(lengths[i] for i in b) < capacity for i in b]
        size = [lengths[i] for i in rest]
        anew, more = local_search(best_fit(size, capacity), size, capacity)
        steps += more
        if len(full) + len(anew) >= len(bins):
            break
        bins = full + [[rest[i] for i in b] for b in anew]
    if len(bins) > least:
        other, more = local_search(best_fit(lengths, capacity), lengths, capacity)
        bins, steps = min(bins, other, key=len), steps + more
    return bins, steps


def pack(pieces: DataFrame, shards: int, *, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id, offset and search_steps (of its shard) to rows with doc_id, piece, start and length, of which none is longer than capacity."""
    key = [c for c in ("doc_id", "piece", "start", "length", "ids_crc32") if c in pieces.columns]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = ["_order", *key]  # a hash: the order in which pieces come
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        whole = np.flatnonzero(lengths == capacity)
        rest = np.flatnonzero(lengths < capacity)
        packed, steps = pack_lengths(lengths[rest].tolist(), capacity)
        bins = [[i] for i in whole.tolist()] + [[int(rest[i]) for i in b] for b in packed]
        seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for k, b in enumerate(bins):
            size = lengths[b]
            seq[b] = k
            off[b] = np.cumsum(size) - size
        return pdf.assign(sequence_id=seq + (pdf["_shard"].to_numpy().astype(np.int64) << 32), offset=off, search_steps=steps).drop(columns=["_shard", "_order"])

    # by all that a piece is, so that rows of one id, or of none, are dealt apart
    mixed = F.xxhash64(*key)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long, search_steps long"
    return pieces.withColumn("_shard", F.pmod(mixed, F.lit(max(1, shards))).cast("int")).withColumn("_order", F.shiftright(mixed, 20)).groupBy("_shard").applyInPandas(run, schema)


def shard_count(docs: DataFrame) -> int:
    """A document leaves at most one piece that is not full, so rows / SHARD bounds a shard's search."""
    return -(-docs.count() // SHARD)


def pack_documents(docs: DataFrame, **tokens) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, search_steps of each piece of each document."""
    capacity = tokens.get("capacity", CAPACITY)
    pieces = tokenise(docs, **tokens).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(pieces, shard_count(docs), capacity=capacity)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, of tokenise() and pack() of the same documents."""
    both = pieces.select("doc_id", "piece", "ids").join(placed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    parts = both.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
