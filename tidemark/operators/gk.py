"""Transfer (g_k), in-sample gain and regret over boundary records.

A boundary has run, phase, curr_tokens, curr_bytes, curr_pre, curr_post, curr_base
(nullable), next_tokens, next_bytes, next_pre, next_post; code lengths in bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.streams import running_before


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def records(costs: DataFrame) -> DataFrame:
    """Boundaries of interval costs (stream, k, bytes, pre, base, post, prev in micro-bits): every full interval with a successor."""
    w = Window.partitionBy("stream").orderBy("k")
    bits = lambda c: F.col(c) / 1e6
    out = costs.select(
        F.col("stream").alias("run"), F.col("k").alias("phase"), F.col("bytes").alias("curr_tokens"), F.col("bytes").alias("curr_bytes"),
        bits("pre").alias("curr_pre"), bits("post").alias("curr_post"), bits("base").alias("curr_base"),
        F.lead("bytes").over(w).alias("next_tokens"), F.lead("bytes").over(w).alias("next_bytes"),
        (F.lead("prev").over(w) / 1e6).alias("next_pre"), (F.lead("pre").over(w) / 1e6).alias("next_post"),
    )
    return out.where("next_bytes is not null")


def with_gains(boundaries: DataFrame) -> DataFrame:
    """Adds g, din, regret in bits; regret is null without a base."""
    return boundaries.withColumns({"g": F.col("next_pre") - F.col("next_post"), "din": F.col("curr_pre") - F.col("curr_post"), "regret": F.col("curr_pre") - F.col("curr_base")})


def _per(unit: str) -> tuple[Column, Column, Column]:
    if unit == "rel":
        return F.col("next_pre"), F.col("curr_pre"), F.col("curr_base")
    if unit == "bpb":
        return F.col("next_bytes"), F.col("curr_bytes"), F.col("curr_bytes")
    if unit == "bpt":
        return F.col("next_tokens"), F.col("curr_tokens"), F.col("curr_tokens")
    raise ValueError(f"unit {unit!r} is none of rel, bpb, bpt")


def normalised(boundaries: DataFrame, unit: str) -> DataFrame:
    """run, phase, g, din, regret in the unit: by bits before, bytes or tokens."""
    g, d, r = _per(unit)
    gains = with_gains(boundaries)
    return gains.select("run", "phase", ratio(F.col("g"), g).alias("g"), ratio(F.col("din"), d).alias("din"), F.when(F.col("regret").isNotNull(), ratio(F.col("regret"), r)).alias("regret"))


def summary(boundaries: DataFrame, unit: str = "bpb") -> DataFrame:
    """One row per run: harmful share, means and stream values of g, in-sample gain, transfer efficiency and regret."""
    g, d, r = _per(unit)
    gains = with_gains(boundaries)
    known = F.col("regret").isNotNull()
    below = F.sum(F.when(known, r)) if unit == "rel" else F.sum(r)
    zero = F.lit(0.0)
    return gains.groupBy("run").agg(
        F.count("*").alias("n"),
        F.avg((F.col("g") < 0).cast("int")).alias("harmful_fraction"),
        F.avg(ratio(F.col("g"), g)).alias("mean_g"),
        F.avg(ratio(F.col("din"), d)).alias("mean_din"),
        ratio(F.sum("g"), F.sum(g)).alias("stream_g"),
        ratio(F.sum("g"), F.sum("din")).alias("transfer_efficiency"),
        F.bool_and(known).alias("has_regret"),
        F.coalesce(F.avg(F.when(known, (F.col("regret") > 0).cast("int"))), zero).alias("worse_than_base"),
        F.coalesce(ratio(F.sum("regret"), below), zero).alias("stream_regret"),
    )


def total(boundaries: DataFrame) -> DataFrame:
    """n, harmful_fraction, stream_g, transfer_efficiency over all runs: one row, of zeros without any boundary."""
    g = with_gains(boundaries)
    zero = F.lit(0.0)
    return g.agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col("g") < 0).cast("int")), zero).alias("harmful_fraction"), F.coalesce(ratio(F.sum("g"), F.sum("next_bytes")), zero).alias("stream_g"), F.coalesce(ratio(F.sum("g"), F.sum("din")), zero).alias("transfer_efficiency"))


def cumulative_regret(boundaries: DataFrame) -> DataFrame:
    """run, phase, cum_regret (null counts as 0), cum_rel (over the base bits so far); sums of whole millionths of a bit, in two levels."""
    out = with_gains(boundaries).select("run", "phase", "regret", "curr_base")
    for name, of in (("cum_regret", "regret"), ("_base", "curr_base")):
        own = F.round(F.coalesce(of, F.lit(0.0)) * 1e6).cast("bigint")
        out = running_before(out, own, keys=("run",), order="phase", out="_before").withColumn(name, (F.col("_before") + own) / 1e6).drop("_before")
    return out.select("run", "phase", "cum_regret", ratio(F.col("cum_regret"), F.col("_base")).alias("cum_rel"))


def regret_crossing(boundaries: DataFrame) -> DataFrame:
    """run, first_phase: where cumulative regret first rises above 0 (null: never)."""
    return cumulative_regret(boundaries).groupBy("run").agg(F.min(F.when(F.col("cum_regret") > 0, F.col("phase"))).alias("first_phase"))


def human_size(n: Column) -> Column:
    """Sizes by thousands, as run labels show them."""
    return F.when(n >= 1_000_000, F.concat(F.format_string("%.0f", n / 1e6), F.lit("MB"))).when(n >= 1_000, F.concat(F.format_string("%.0f", n / 1e3), F.lit("KB"))).otherwise(F.concat(n.cast("string"), F.lit("B")))
