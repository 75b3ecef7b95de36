"""Same-state branching: every candidate strength from one parent state.

Rows are (run, phase, pos, lr, curr_bits, next_bits): pos is the recorded order of
candidates, by which ties are broken; lr 0 skips the update.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.costs import Schedule, Span, by_span, lengths, sums

NEAR_TIE = 0.001


def records(stream: DataFrame, rates: tuple[float, ...], s: Schedule) -> DataFrame:
    """Candidates at every boundary of (stream, start, data); the main trajectory advances by s.strength."""
    width, strength = s.chunk * s.interval, s.strength
    names = [f"c{i}" for i in range(len(rates))] + [f"n{i}" for i in range(len(rates))]

    def work(x: Span) -> pa.RecordBatch:
        size, (row, sym) = x.own.sum(1), np.nonzero(x.own)
        c, here, rows = x.own[row, sym], np.flatnonzero(size), len(size)
        n, tot, first = x.state[row, sym] * strength, x.seen[row] * strength, x.k[row] == 0
        curr = [sums(row, c * lengths(n + c * r, tot + size[row] * r), rows) for r in rates]
        # this interval under its predecessor's state, updated by r instead of the reference strength
        was, by = np.where(first, 0, x.prev[row, sym]), np.where(first, 0, width)
        following = [sums(row, c * lengths(n + was * (r - strength), tot + by * (r - strength)), rows) for r in rates]
        return pa.RecordBatch.from_arrays([pa.array([x.stream] * len(here), pa.string()), *(pa.array(v[here]) for v in (x.k, size, *curr, *following))], ["stream", "k", "bytes", *names])

    per = by_span(stream, s, work, "stream string, k long, bytes long, " + ", ".join(f"{c} long" for c in names), halo=True)
    w = Window.partitionBy("stream").orderBy("k")
    ahead = per.select("stream", "k", "bytes", F.lead("bytes").over(w).alias("next_bytes"), *(f"c{i}" for i in range(len(rates))), *(F.lead(f"n{i}").over(w).alias(f"n{i}") for i in range(len(rates)))).where("next_bytes is not null")
    cands = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(float(r)).alias("lr"), (F.col(f"c{i}") / 1e6).alias("curr_bits"), (F.col(f"n{i}") / 1e6).alias("next_bits")) for i, r in enumerate(rates)))
    return ahead.select(F.col("stream").alias("run"), F.col("k").alias("phase"), F.col("bytes").alias("curr_bytes"), "next_bytes", F.explode(cands).alias("x")).select("run", "phase", "curr_bytes", "next_bytes", "x.*")


def best(cands: DataFrame) -> DataFrame:
    """run, phase, best_lr, best_bits, second_bits, gap, near_tie; fewest next bits, ties by recorded order."""
    w = Window.partitionBy("run", "phase").orderBy("next_bits", "pos")
    ranked = cands.withColumns({"_rank": F.row_number().over(w), "_second": F.lead("next_bits").over(w)}).where("_rank = 1")
    gap = F.col("_second") - F.col("next_bits")
    return ranked.select("run", "phase", F.col("lr").alias("best_lr"), F.col("next_bits").alias("best_bits"), F.col("_second").alias("second_bits"), gap.alias("gap"), F.coalesce(gap < NEAR_TIE * F.abs("next_bits"), F.lit(False)).alias("near_tie"))


def gains(cands: DataFrame) -> DataFrame:
    """Adds g and din of each candidate against skipping (null without a skip candidate)."""
    w = Window.partitionBy("run", "phase")
    skip = lambda c: F.max(F.when(F.col("lr") == 0, F.col(c))).over(w)
    return cands.withColumns({"g": skip("next_bits") - F.col("next_bits"), "din": skip("curr_bits") - F.col("curr_bits")})


def totals(cands: DataFrame) -> DataFrame:
    """run, pos, lr, total of next bits, mean g and din, share of wins, excess over the best of each boundary."""
    w = Window.partitionBy("run", "phase")
    first = F.row_number().over(w.orderBy("next_bits", "pos")) == 1
    rows = gains(cands).withColumns({"_win": first.cast("int"), "_least": F.min("next_bits").over(w)})
    return rows.groupBy("run", "pos", "lr").agg(F.sum("next_bits").alias("total"), F.avg("g").alias("mean_g"), F.avg("din").alias("mean_din"), F.avg("_win").alias("win_fraction"), F.sum(F.col("next_bits") - F.col("_least")).alias("excess"))


def oracle(cands: DataFrame) -> DataFrame:
    """run, best_fixed_lr, best_fixed_total, oracle_total, headroom."""
    fixed = cands.groupBy("run", "pos", "lr").agg(F.sum("next_bits").alias("total")).groupBy("run").agg(F.min_by(F.struct("lr", "total"), F.struct(F.round("total", 6), "pos")).alias("b"))
    free = cands.groupBy("run", "phase").agg(F.min("next_bits").alias("m")).groupBy("run").agg(F.sum("m").alias("oracle_total"))
    out = fixed.join(free, "run").select("run", F.col("b.lr").alias("best_fixed_lr"), F.col("b.total").alias("best_fixed_total"), "oracle_total")
    return out.withColumn("headroom", F.when(F.col("best_fixed_total") == 0, 0.0).otherwise((F.col("best_fixed_total") - F.col("oracle_total")) / F.col("best_fixed_total")))


def actions(cands: DataFrame, stable: bool = False) -> DataFrame:
    """run, phase, lr: the best candidate of each boundary. stable: on a near-tie the lr emitted before stays if it is in the band."""
    top = best(cands)
    if not stable:
        return top.select("run", "phase", F.col("best_lr").alias("lr"))
    bits = cands.groupBy("run", "phase").agg(F.array_sort(F.collect_list(F.struct("pos", "lr", "next_bits"))).alias("cands"))
    rows = top.join(bits, ["run", "phase"]).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("phase", "best_lr", "best_bits", "near_tie", "cands"))).alias("seq"))

    def step(acc: Column, x: Column) -> Column:
        held = F.element_at(acc, -1)["lr"]
        same = F.get(F.filter(x["cands"], lambda c: c["lr"] == held), F.lit(0))["next_bits"]
        keep = x["near_tie"] & (same - x["best_bits"] < NEAR_TIE * F.abs(x["best_bits"]))
        return F.concat(acc, F.array(F.struct(x["phase"].alias("phase"), F.when(F.coalesce(keep, F.lit(False)), held).otherwise(x["best_lr"]).alias("lr"))))

    # element_at of an empty array would be an error: the accumulator starts with a sentinel
    start = F.array(F.struct(F.lit(-1).cast("bigint").alias("phase"), F.lit(float("inf")).alias("lr")))
    return rows.select("run", F.explode(F.filter(F.aggregate("seq", start, step), lambda x: x["phase"] >= 0)).alias("x")).select("run", "x.phase", "x.lr")


def switches(seq: DataFrame) -> DataFrame:
    """run, n, switches, same_rate (0 with fewer than two)."""
    w = Window.partitionBy("run").orderBy("phase")
    rows = seq.withColumn("_was", F.lag("lr").over(w))
    moved = F.sum((F.col("_was") != F.col("lr")).cast("int"))
    out = rows.groupBy("run").agg(F.count("*").alias("n"), F.coalesce(moved, F.lit(0)).cast("bigint").alias("switches"))
    return out.withColumn("same_rate", F.when(F.col("n") < 2, 0.0).otherwise(1 - F.col("switches") / (F.col("n") - 1)))


def transitions(seq: DataFrame) -> DataFrame:
    """run, from_lr, to_lr, n."""
    w = Window.partitionBy("run").orderBy("phase")
    return seq.withColumn("from_lr", F.lag("lr").over(w)).where("from_lr is not null").groupBy("run", "from_lr", F.col("lr").alias("to_lr")).agg(F.count("*").alias("n"))


def with_domain(boundaries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds domain to (run, phase, next_bytes): the block that holds the next bytes so far, inclusive; beyond all blocks the last."""
    w = Window.partitionBy("run").orderBy("phase").rowsBetween(Window.unboundedPreceding, 0)
    at = boundaries.withColumn("_at", F.sum("next_bytes").over(w))
    b = F.broadcast(blocks.select("dataset", "byte_start", "byte_end"))
    last = F.broadcast(blocks.agg(F.max_by("dataset", "byte_end").alias("_last")))
    return at.join(b, (F.col("_at") >= F.col("byte_start")) & (F.col("_at") < F.col("byte_end")), "left").join(last).withColumn("domain", F.coalesce("dataset", "_last", F.lit("stream"))).drop("_at", "_last", "dataset", "byte_start", "byte_end")


def percent(mean_g: Column, n: Column, skip: Column) -> Column:
    """A mean gain over n boundaries in percent of what skipping every update costs; 0 where that is 0."""
    return F.when(skip == 0, 0.0).otherwise(mean_g * n / skip * 100)
