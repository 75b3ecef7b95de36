"""Context against adaptation: an order-1 model with and without a context tail, static and online."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.costs import lengths, micro_bits
from tidemark.operators.streams import segments

#: The context symbol where there is no byte before.
START = 256

#: Bytes of streams that are measured at once.
AT_ONCE = 1 << 18


def pair_counts(stream: DataFrame, chunk: int, interval: int, ctx: int) -> DataFrame:
    """stream, k, ctx, sym, c: bytes by the byte before in their chunk.

    At a chunk's start the context is START, or with a tail (ctx > 0) the last byte
    before the interval: all chunks of an interval see the same tail.
    """
    width = chunk * interval
    cut = segments(stream, width).groupBy("stream", F.col("unit").alias("k")).agg(F.array_sort(F.collect_list(F.struct("start", F.hex("data").alias("h")))).alias("p"))
    hexes = F.array_join(F.transform("p", lambda x: x["h"]), "")
    syms = F.transform(F.filter(F.split(hexes, "(?<=\\G..)"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int"))
    rows = cut.select("stream", "k", syms.alias("s"))
    last = F.lag(F.element_at("s", -1)).over(Window.partitionBy("stream").orderBy("k"))
    rows = rows.withColumn("tail", F.coalesce(last, F.lit(START)) if ctx else F.lit(START))
    before = F.transform("s", lambda x, i: F.when(i % chunk == 0, F.col("tail")).otherwise(F.get("s", i - 1)))
    pairs = rows.select("stream", "k", F.explode(F.arrays_zip(before.alias("ctx"), F.col("s").alias("sym"))).alias("x"))
    return pairs.groupBy("stream", "k", F.col("x.ctx").alias("ctx"), F.col("x.sym").alias("sym")).agg(F.count("*").alias("c"))


def cell(pairs: DataFrame, online: bool) -> DataFrame:
    """stream, bits (micro-bits) of the order-1 model: frozen and uniform, or updated after each interval."""
    if not online:
        return pairs.groupBy("stream").agg(F.sum(F.col("c") * micro_bits(F.lit(0), F.lit(0))).alias("bits"))
    before = lambda *keys: Window.partitionBy("stream", *keys).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    per = pairs.groupBy("stream", "k", "ctx").agg(F.sum("c").alias("t")).withColumn("tot", F.coalesce(F.sum("t").over(before("ctx")), F.lit(0))).drop("t")
    rows = pairs.withColumn("n", F.coalesce(F.sum("c").over(before("ctx", "sym")), F.lit(0))).join(per, ["stream", "k", "ctx"])
    return rows.groupBy("stream").agg(F.sum(F.col("c") * micro_bits(F.col("n"), F.col("tot"))).alias("bits"))


def _rank(key: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Of each place how many earlier places have its key, those of its own unit left out; units ascend by place."""
    bits = int(len(key)).bit_length()
    packed = np.sort(key << bits | np.arange(len(key)))
    by, k = packed & (1 << bits) - 1, packed >> bits
    at, u = np.arange(len(k)), unit[by]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    fresh = new | np.concatenate([[True], u[1:] != u[:-1]])
    out = np.empty(len(k), np.int64)
    out[by] = np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(new, at, 0))
    return out


def _walk(chunk: int, interval: int, ctxs: tuple[int, ...]):
    """Batches of (stream, data), a stream's rows one after another and in order, to stream, ctx, mode, bits: parts to be summed.

    Streams are taken many at once. One that is not at its end goes on with the counts of its full intervals.
    """
    width = chunk * interval

    def measure(runs: list[tuple[str, bytes]], state: dict | None, at: int, last: int, goes_on: bool):
        """Sums of runs, of which the first is at byte `at` of its stream, after the byte `last`, in a state; and the last one's state."""
        size = np.array([len(d) for _, d in runs])
        sym = np.frombuffer(b"".join(d for _, d in runs), np.uint8).astype(np.int64)
        row, first = np.repeat(np.arange(len(runs)), size), np.cumsum(size) - size
        pos = np.arange(len(sym)) - first[row]
        prev = np.concatenate([[START], sym[:-1]])
        prev[first] = START
        prev[0] = last
        unit, whole = pos // width, int(size[0])
        static = (size * lengths(np.zeros(1), np.zeros(1))[0]).astype(np.int64)
        bits, after = [], {}
        for ctx in ctxs:
            tail = prev[np.arange(len(sym)) - pos % width] if ctx else START
            c = np.where(pos % chunk == 0, tail, prev)
            two = c * 256 + sym
            n, total = _rank(row * (257 * 256) + two, unit), _rank(row * 257 + c, unit)
            if state is not None:
                n[:whole] += state[ctx][two[:whole]]
                total[:whole] += state[ctx].reshape(257, 256).sum(1)[c[:whole]]
            bits.append(np.bincount(row, weights=lengths(n, total), minlength=len(runs)).astype(np.int64))
            if goes_on:
                after[ctx] = np.bincount(two[first[-1] :], minlength=257 * 256) + (state[ctx] if state is not None and len(runs) == 1 else 0)
        names = [s for s, _ in runs]
        cols = [(ctx, mode, v) for ctx, online in zip(ctxs, bits, strict=True) for mode, v in (("static", static), ("online", online))]
        k = len(cols)
        return pa.RecordBatch.from_arrays(
            [pa.array(names * k, pa.string()), pa.array(np.repeat([c[0] for c in cols], len(runs)), pa.int32()), pa.array([c[1] for c in cols for _ in runs], pa.string()), pa.array(np.concatenate([c[2] for c in cols]))],
            ["stream", "ctx", "mode", "bits"],
        ), after, at + whole if len(runs) == 1 else int(size[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[tuple[str, bytearray]] = []
        held, state, at, last = 0, None, 0, START

        def flush(goes_on: bool):
            nonlocal runs, held, state, at, last
            rest = b""
            name = runs[-1][0]
            if goes_on:
                # of the last stream only full intervals, so that what is kept is a state between two of them
                full = len(runs[-1][1]) // width * width
                rest = bytes(runs[-1][1][full:])
                runs[-1] = (name, runs[-1][1][:full])
            alone = len(runs) == 1
            todo = [(s, bytes(d)) for s, d in runs]
            ends = todo[-1][1][-1:] or (bytes([last]) if alone and last < START else b"")
            kept = [x for x in todo if x[1]]
            starts = bool(todo[0][1])  # whether the first of what is measured is the stream that the state is of
            out = None
            if kept:
                out, after, now = measure(kept, state if starts else None, at if starts else 0, last if starts else START, goes_on)
                if goes_on and todo[-1][1]:
                    state, at = after, now
            if goes_on and not todo[-1][1] and not alone:
                state, at = None, 0
            if goes_on:
                last = ends[0] if ends else START
                runs, held = [(name, bytearray(rest))], len(rest)
            else:
                runs, held, state, at, last = [], 0, None, 0, START
            return out

        for b in batches:
            for name, data in zip(b.column(0), b.column(1), strict=True):
                name, data = name.as_py(), memoryview(data.as_buffer())
                for lo in range(0, len(data), AT_ONCE):
                    part = data[lo : lo + AT_ONCE]
                    if runs and runs[-1][0] == name:
                        runs[-1][1].extend(part)
                    else:
                        runs.append((name, bytearray(part)))
                    held += len(part)
                    if held >= AT_ONCE and (out := flush(True)) is not None:
                        yield out
        if runs and (out := flush(False)) is not None:
            yield out

    return run


def cells(rows: DataFrame, chunk: int, interval: int, ctxs: tuple[int, ...]) -> DataFrame:
    """stream, ctx, mode, bits (micro-bits) of (stream, seq, data): what cell() says of pair_counts(), in one pass.

    A stream goes through one task, which holds a part of it and counts of pairs; bytes are shuffled once, as texts.
    Rows without a stream are left out, as the joins of cell() leave them out.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.where("stream is not null and octet_length(data) > 0").select("stream", "seq", "data").repartition(tasks, "stream").sortWithinPartitions("stream", "seq", "data")
    parts = placed.select("stream", "data").mapInArrow(_walk(chunk, interval, ctxs), "stream string, ctx int, mode string, bits long")
    return parts.groupBy("stream", "ctx", "mode").agg(F.sum("bits").alias("bits"))


def gain_pct(a: Column, x: Column) -> Column:
    """100 (a - x) / a, 0 where a is 0."""
    return F.when(a == 0, 0.0).otherwise(100 * (a - x) / a)


def latest(cells: DataFrame, order: str) -> DataFrame:
    """The last written row of each (dataset, ctx, mode)."""
    w = Window.partitionBy("dataset", "ctx", "mode").orderBy(F.desc(order))
    return cells.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def squares(cells: DataFrame) -> DataFrame:
    """dataset, ctx, gains of B (adaptation), C (context), D (both) over A, and how they add up; incomplete cells give no row."""
    is_ = lambda mode: F.max(F.when(F.col("mode") == mode, F.col("bits")))
    wide = cells.where("dataset is not null").groupBy("dataset", "ctx").agg(is_("static").alias("static"), is_("online").alias("online"))
    zero = lambda c: F.max(F.when(F.col("ctx") == 0, F.col(c))).over(Window.partitionBy("dataset"))
    sq = wide.withColumns({"a": zero("static"), "b": zero("online")}).where("ctx > 0").dropna(subset=["static", "online", "a", "b"])
    g = sq.select("dataset", "ctx", gain_pct(F.col("a"), F.col("b")).alias("gain_b"), gain_pct(F.col("a"), F.col("static")).alias("gain_c"), gain_pct(F.col("a"), F.col("online")).alias("gain_d"))
    return g.withColumns({"d_vs_c": F.col("gain_d") - F.col("gain_c"), "d_vs_b": F.col("gain_d") - F.col("gain_b"), "additive": F.col("gain_b") + F.col("gain_c"), "overlap": F.col("gain_b") + F.col("gain_c") - F.col("gain_d")})
