"""Code lengths of chunks and intervals under the adaptive count model.

The model is p(b | S) = (n_S(b) + ALPHA) / (N_S + 256 ALPHA), where n_S are counts of
earlier full intervals, weighted by the update strength, on top of optional
pre-training counts.  State is a sum of past counts, so the whole trajectory is one
prefix sum, in two levels: over spans of many intervals by windows on their sparse
counts, within a span in numpy.
Code lengths are integers, in millionths of a bit for each symbol, so that sums do
not depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scratch import materialise
from tidemark.operators.streams import byte_counts

ALPHA = 0.5
UNIT = 1_000_000
#: Chunks whose counts are held at once.
SPAN_CHUNKS = 1024


@dataclass(frozen=True)
class Schedule:
    """chunk bytes, chunks of an interval, update strength (rate times epochs), whether updates take all seen intervals."""

    chunk: int = 512
    interval: int = 4
    strength: float = 1.0
    all_seen: bool = False


def micro_bits(n: Column, total: Column) -> Column:
    """Code length of one symbol with count n of total."""
    return F.round(-F.log2((n + ALPHA) / (total + 256 * ALPHA)) * UNIT).cast("bigint")


def lengths(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """micro_bits in numpy; whole numbers as doubles."""
    return np.floor(-np.log2((n + ALPHA) / (total + 256 * ALPHA)) * UNIT + 0.5)


def span(s: Schedule) -> int:
    """Intervals that a task works out at once."""
    return max(1, SPAN_CHUNKS // s.interval)


def _placed_by_span(stream: DataFrame, s: Schedule, halo: int) -> DataFrame:
    """stream, span, start, data, before: bytes of each span of intervals and of `halo` bytes before it, and one row with the state before the span.

    before lists of each byte value in the span how often it occurred in earlier spans (n), and that times the number of its interval (nk).
    """
    width, wide = s.chunk * s.interval, span(s) * s.chunk * s.interval
    keys = Window.partitionBy("stream", "sym").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    if s.all_seen:
        per = byte_counts(stream, width, "k").groupBy("stream", F.expr(f"k div {span(s)}").alias("span"), "sym").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("k")).alias("ck"))
    else:
        per = byte_counts(stream, wide, "span").withColumn("ck", F.lit(0).cast("bigint"))
    so_far = per.select("stream", "span", "sym", F.sum("c").over(keys).alias("n"), F.sum("ck").over(keys).alias("nk")).where("n is not null")
    before = so_far.groupBy("stream", "span").agg(F.collect_list(F.struct("sym", "n", "nk")).alias("before"))
    first, last = F.expr(f"start div {wide}"), F.expr(f"(start + octet_length(data) - 1 + {halo}) div {wide}")
    cut = stream.withColumn("span", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.lit(0).cast("bigint"), F.col("span") * wide - halo - F.col("start"))
    hi = F.least(F.octet_length("data").cast("bigint"), (F.col("span") + 1) * wide - F.col("start"))
    cut = cut.select("stream", "span", (F.col("start") + lo).alias("start"), F.col("data").substr((lo + 1).cast("int"), (hi - lo).cast("int")).alias("data"))
    return cut.unionByName(before, allowMissingColumns=True).select("stream", "span", "start", "data", "before")


@dataclass
class Span:
    """Counts of a span: cells by (chunk, byte value), own by (interval, byte value), prev those of the interval before each, and the state before each interval at strength 1: state and seen."""

    stream: str
    k: np.ndarray
    cells: np.ndarray
    own: np.ndarray
    prev: np.ndarray
    state: np.ndarray
    seen: np.ndarray


def _spans(s: Schedule, halo: int, work: Callable[[Span], pa.RecordBatch]):
    """Batches of _placed_by_span, a span's rows one after another, to what work makes of each span."""
    width, many = s.chunk * s.interval, span(s)

    def measure(stream: str, number: int, starts: list[int], parts: list[memoryview], before: tuple) -> pa.RecordBatch:
        size = np.array([len(p) for p in parts], np.int64)
        sym = np.frombuffer(b"".join(parts), np.uint8)
        # one interval before the span, empty without a halo
        at = np.repeat(np.array(starts, np.int64) - (np.cumsum(size) - size), size) + np.arange(len(sym)) - (number * many - 1) * width
        cells = np.bincount(at // s.chunk * 256 + sym, minlength=(many + 1) * s.interval * 256).reshape(many + 1, s.interval, 256)
        counts, k = cells.sum(1), number * many + np.arange(many)
        own, n, nk = counts[1:], np.zeros(256, np.int64), np.zeros(256, np.int64)
        if before:
            n[before[0]], nk[before[0]] = before[1], before[2]
        state = n + np.cumsum(own, 0) - own
        if s.all_seen:
            state = k[:, None] * state - (nk + np.cumsum(own * k[:, None], 0) - own * k[:, None])
        # all intervals before one are full; the update after interval i adds all up to i, so that interval j counts k - j times
        times = k * (k + 1) / 2 if s.all_seen else k.astype(np.float64)
        return work(Span(stream, k, cells[1:].reshape(-1, 256), own, counts[:-1], state.astype(np.float64), times * width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, starts, parts, before = None, [], [], ()
        for b in batches:
            for stream, number, start, data, state in zip(*(c for c in b.columns), strict=True):
                now = stream.as_py(), number.as_py()
                if now != key:
                    if parts:
                        yield measure(*key, starts, parts, before)
                    key, starts, parts, before = now, [], [], ()
                if data.is_valid:
                    starts.append(start.as_py())
                    parts.append(bytes(data.as_buffer()))
                else:
                    before = tuple(state.values.field(i).to_numpy() for i in range(3))
        if parts:
            yield measure(*key, starts, parts, before)

    return run


def by_span(stream: DataFrame, s: Schedule, work: Callable[[Span], pa.RecordBatch], schema: str, *, halo: bool = False) -> DataFrame:
    """Rows that work makes of each span of (stream, start, data): texts are written once, and shuffled once more by span.

    No task holds more than a span at a time. Rows without a stream are left out.
    """
    before = s.chunk * s.interval if halo else 0
    placed = materialise(stream.where("stream is not null and octet_length(data) > 0").select("stream", "start", "data"), "placed")
    tasks = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _placed_by_span(placed, s, before).repartition(tasks, "stream", "span").sortWithinPartitions("stream", "span")
    return rows.mapInArrow(_spans(s, before, work), schema)


def table_of(prior: DataFrame | None) -> np.ndarray:
    """Counts of 256 byte values."""
    out = np.zeros(256)
    if prior is not None:
        for r in prior.groupBy("sym").agg(F.sum("c").alias("c")).collect():  # at most 256 rows
            out[r.sym] = r.c
    return out


def sums(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of whole numbers by row."""
    return np.bincount(row, weights=values, minlength=rows).astype(np.int64)


def interval_costs_by_strength(stream: DataFrame, s: Schedule, strengths: tuple[float, ...], prior: DataFrame | None = None) -> DataFrame:
    """interval_costs at several strengths, told by the column strength, in one pass."""
    if s.all_seen:
        raise ValueError("probes compare neighbouring states of recent-interval updates")
    pn = table_of(prior)
    pt, width, chunk, interval = pn.sum(), s.chunk * s.interval, s.chunk, s.interval

    def work(x: Span) -> pa.RecordBatch:
        size, (row, sym) = x.own.sum(1), np.nonzero(x.own)
        c, was, out = x.own[row, sym], x.prev[row, sym], []
        here, rows = np.flatnonzero(size), len(size)
        chunks = -(-size // chunk)
        base = sums(row, c * lengths(pn[sym], pt), rows)
        for w in strengths:
            n, tot = x.state[row, sym] * w + pn[sym], x.seen[row] * w + pt
            pre, post = sums(row, c * lengths(n, tot), rows), sums(row, c * lengths(n + c * w, tot + size[row] * w), rows)
            first = x.k[row] == 0
            prev = sums(row, c * lengths(n - np.where(first, 0, was * w), tot - np.where(first, 0, width * w)), rows)
            own = [pa.array([x.stream] * len(here), pa.string()), *(pa.array(v[here]) for v in (x.k, size, chunks, chunks < interval, pre, base, post)), pa.array(prev[here], mask=x.k[here] == 0)]
            out.append(pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(here), w, np.float64))], ["stream", "k", "bytes", "chunks", "is_tail", "pre", "base", "post", "prev", "strength"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if len(here) else out[0]

    return by_span(stream, s, work, "stream string, k long, bytes long, chunks long, is_tail boolean, pre long, base long, post long, prev long, strength double", halo=True)


def interval_costs(stream: DataFrame, s: Schedule, prior: DataFrame | None = None) -> DataFrame:
    """stream, k, bytes, chunks, is_tail (fewer chunks than an interval) and the interval's cost under four states, in micro-bits.

    pre: S_k (what coding it takes); base: S_0; post: S_k+1, updated on it; prev: S_k-1,
    before the update on its predecessor (null for the first). stream: (stream, start, data).
    """
    return interval_costs_by_strength(stream, s, (s.strength,), prior).drop("strength")


def chunk_costs(stream: DataFrame, s: Schedule, prior: DataFrame | None = None) -> DataFrame:
    """stream, chunk, length, static, online: each chunk's cost under S_0 and under its interval's state, in micro-bits."""
    pn = table_of(prior)
    pt, interval, strength = pn.sum(), s.interval, s.strength

    def work(x: Span) -> pa.RecordBatch:
        size, (row, sym) = x.cells.sum(1), np.nonzero(x.cells)
        c, k, here, rows = x.cells[row, sym], row // interval, np.flatnonzero(size), len(size)
        static = sums(row, c * lengths(pn[sym], pt), rows)
        online = sums(row, c * lengths(x.state[k, sym] * strength + pn[sym], x.seen[k] * strength + pt), rows)
        return pa.RecordBatch.from_arrays([pa.array([x.stream] * len(here), pa.string()), *(pa.array(v[here]) for v in (x.k[0] * interval + np.arange(rows), size, static, online))], ["stream", "chunk", "length", "static", "online"])

    return by_span(stream, s, work, "stream string, chunk long, length long, static long, online long")
