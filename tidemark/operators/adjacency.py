"""Adjacency probe: does an update help what comes next more than matched material elsewhere?

Intervals are (k, bytes, domain, base): base is the cost under S_0 in micro-bits.
Records are (run, k, h, adj_pre, adj_post, ctrl_pre, ctrl_post) per horizon, in bits;
controls are averaged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.costs import micro_bits

MAIN_H = 4
T_PCT_MIN, T_SHARE_MIN, P_MAX = 0.5, 0.20, 0.05


def windows(intervals: DataFrame, h: int) -> DataFrame:
    """k, domain, total, decile of every window of h intervals within one domain.

    Ties share the highest rank; the window of one domain orders that domain's
    intervals, a table that is 2048 times smaller than its bytes.
    """
    ahead = Window.partitionBy(F.lit(0)).orderBy("k").rowsBetween(0, h - 1)
    w = intervals.select("k", "domain", F.sum("base").over(ahead).alias("total"), F.count("*").over(ahead).alias("_n"), F.min("domain").over(ahead).alias("_lo"), F.max("domain").over(ahead).alias("_hi"))
    w = w.where((F.col("_n") == h) & (F.col("_lo") == F.col("_hi"))).drop("_n", "_lo", "_hi")
    per = Window.partitionBy("domain")
    rank = F.count("*").over(per.orderBy("total").rangeBetween(Window.unboundedPreceding, 0)) - 1
    return w.withColumn("decile", F.least(F.lit(9), F.floor(rank * 10 / F.count("*").over(per))).cast("bigint"))


def plan(intervals: DataFrame, *, h: int, k: int, n_target: int, seed: int) -> DataFrame:
    """k, domain, control: for at most n_target boundaries, k control windows of the domain and decile of the future window.

    Boundaries are evenly strided; one whose controls are too few is left out, not moved.
    """
    w = windows(intervals, h)
    n = intervals.count()
    future = w.select((F.col("k") - 1).alias("k"), "domain", "decile").where((F.col("k") >= 0) & (F.col("k") <= n - 2))
    valid = future.count()
    step = max(h + 1, valid // n_target)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("k")) - 1
    chosen = future.withColumn("_i", place).where(F.col("_i") % step == 0).drop("_i")
    j = w.select(F.col("k").alias("j"), "domain", "decile")
    far = ((F.col("j") + h <= F.col("k")) | (F.col("j") >= F.col("k") + h + 1)) & (F.abs(F.col("j") - F.col("k")) >= 2 * h)
    cand = F.broadcast(chosen).join(j, ["domain", "decile"]).where(far)
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), "k", "j"))
    per = Window.partitionBy("k")
    cand = cand.withColumns({"_n": F.count("*").over(per), "_r": F.row_number().over(per.orderBy(draw, "j"))}).where((F.col("_n") >= k) & (F.col("_r") <= k))
    kept = cand.withColumn("_b", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("k"))).where(F.col("_b") <= n_target)
    return kept.select("k", "domain", F.col("j").alias("control"))


def state_counts(counts: DataFrame, at: DataFrame) -> DataFrame:
    """s, sym, n of interval counts (k, sym, c) before each of the few wanted states: sums between neighbours, then running."""
    marks = sorted(r[0] for r in at.select("s").distinct().collect())  # at most two for each sampled boundary
    if not marks:
        return counts.select(F.lit(0).cast("bigint").alias("s"), "sym", F.lit(0).cast("bigint").alias("n")).where("false")
    array = F.array(*(F.lit(m).cast("bigint") for m in marks))
    upto = F.get(F.filter(array, lambda m: m > F.col("k")), F.lit(0))
    part = counts.withColumn("s", upto).where("s is not null").groupBy("s", "sym").agg(F.sum("c").alias("c"))
    grid = F.broadcast(at.select("s").distinct()).crossJoin(part.select("sym").distinct())  # marks x 256
    full = grid.join(part, ["s", "sym"], "left")
    run = Window.partitionBy("sym").orderBy("s")
    return full.select("s", "sym", F.sum(F.coalesce("c", F.lit(0))).over(run).alias("n"))


def scores(counts: DataFrame, sizes: DataFrame, chosen: DataFrame, prior: DataFrame, h_max: int) -> DataFrame:
    """k, domain, h, adj_pre, adj_post, ctrl_pre, ctrl_post (bits) of a plan, over horizons 1 to h_max.

    counts: (k, sym, c); sizes: (k, bytes); prior: (sym, c), the state S_0.
    """
    step = F.explode(F.sequence(F.lit(1), F.lit(h_max))).alias("h")
    adj = chosen.select("k", "domain").distinct().select("k", "domain", F.lit(-1).cast("bigint").alias("src"), step).withColumn("i", F.col("k") + F.col("h"))
    ctl = chosen.select("k", "domain", F.col("control").alias("src"), step).withColumn("i", F.col("src") + F.col("h") - 1)
    units = F.broadcast(adj.union(ctl).withColumn("s", F.explode(F.array(F.col("k"), F.col("k") + 1))))  # bounded by the plan
    st = F.broadcast(state_counts(counts, units.select("s").distinct()))
    marks = units.select("s").distinct()
    seen = sizes.join(F.broadcast(marks), F.col("k") < F.col("s")).groupBy("s").agg(F.sum("bytes").alias("seen"))
    p = F.broadcast(prior.groupBy("sym").agg(F.sum("c").alias("p")))
    total = F.broadcast(prior.agg(F.sum("c").alias("pt")))
    rows = units.join(counts.withColumnRenamed("k", "i"), "i").join(st, ["s", "sym"], "left").join(F.broadcast(seen), "s", "left").join(p, "sym", "left").join(total)
    zero = F.lit(0)
    n = F.coalesce("n", zero) + F.coalesce("p", zero)
    tot = F.coalesce("seen", zero) + F.coalesce("pt", zero)
    per = rows.groupBy("k", "domain", "src", "h").agg(F.sum(F.when(F.col("s") == F.col("k"), F.col("c") * micro_bits(n, tot))).alias("pre"), F.sum(F.when(F.col("s") > F.col("k"), F.col("c") * micro_bits(n, tot))).alias("post"))
    run = Window.partitionBy("k", "src").orderBy("h")
    cum = per.withColumns({"pre": F.sum("pre").over(run), "post": F.sum("post").over(run)})
    mine, theirs = F.col("src") < 0, F.col("src") >= 0
    return cum.groupBy("k", "domain", "h").agg(
        (F.sum(F.when(mine, F.col("pre"))) / 1e6).alias("adj_pre"), (F.sum(F.when(mine, F.col("post"))) / 1e6).alias("adj_post"),
        (F.avg(F.when(theirs, F.col("pre"))) / 1e6).alias("ctrl_pre"), (F.avg(F.when(theirs, F.col("post"))) / 1e6).alias("ctrl_post"),
    )


def gains(records: DataFrame) -> DataFrame:
    """Adds g_adj, g_ctrl and their difference t."""
    return records.withColumns({"g_adj": F.col("adj_pre") - F.col("adj_post"), "g_ctrl": F.col("ctrl_pre") - F.col("ctrl_post")}).withColumn("t", F.col("g_adj") - F.col("g_ctrl"))


def aggregate(records: DataFrame, *by: str) -> DataFrame:
    """n, T in percent of the bits before, adjacent gain, T's share of it (null unless positive), positive share, mean, median."""
    r = gains(records)
    pre = F.sum("adj_pre")
    pct = lambda x: F.when(pre == 0, 0.0).otherwise(100 * x / pre)
    return r.groupBy(*by).agg(
        F.count("*").alias("n"), pct(F.sum("t")).alias("t_pct"), pct(F.sum("g_adj")).alias("g_adj_pct"),
        F.when(F.sum("g_adj") > 0, F.sum("t") / F.sum("g_adj")).alias("t_share"), F.avg((F.col("t") > 0).cast("int")).alias("positive_fraction"),
        F.avg("t").alias("mean_t"), F.median("t").alias("median_t"),
    )


def blocks(records: DataFrame, n_blocks: int, order: str = "k") -> DataFrame:
    """b, t, pre: sums over contiguous blocks of the boundaries in order; edges i * n / n_blocks are rounded half to even."""
    r = gains(records).withColumns({"_i": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1, "_n": F.count("*").over(Window.partitionBy(F.lit(0)))})
    nb = F.least(F.lit(n_blocks), F.col("_n"))
    edges = F.transform(F.sequence(F.lit(1), nb - 1), lambda i: F.bround(i * F.col("_n") / nb))
    block = F.when(nb < 2, F.lit(0)).otherwise(F.size(F.filter(edges, lambda e: e <= F.col("_i"))))
    return r.groupBy(block.alias("b")).agg(F.sum("t").alias("t"), F.sum("adj_pre").alias("pre"))


def _draw(seed: int, *parts: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def bootstrap(records: DataFrame, *, n_blocks: int = 20, n_boot: int = 1000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """lo, hi of T in percent over resampled blocks; picks come from hashes, so that any engine can repeat them.

    Of fewer than two boundaries both are NaN; a resample without any bits before counts as 0.
    """
    spark = records.sparkSession
    b = blocks(records, n_blocks)
    nb = F.broadcast(b.agg(F.count("*").alias("_nb")))
    draws = spark.range(n_boot).select(F.col("id").alias("i")).join(nb).withColumn("d", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nb") - 1)))
    pick = F.pmod(F.conv(F.substring(_draw(seed, "i", "d"), 1, 8), 16, 10).cast("bigint"), F.col("_nb")).cast("int")
    stat = draws.withColumn("b", pick).join(F.broadcast(b), "b").groupBy("i").agg(F.when(F.sum("pre") == 0, 0.0).otherwise(100 * F.try_divide(F.sum("t"), F.sum("pre"))).alias("x"))
    ranked = stat.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round("x", 9), "i")) - 1)
    lo, hi = int(alpha / 2 * n_boot), min(n_boot - 1, int((1 - alpha / 2) * n_boot))
    out = ranked.agg(F.max(F.when(F.col("r") == lo, F.col("x"))).alias("lo"), F.max(F.when(F.col("r") == hi, F.col("x"))).alias("hi"))
    few = F.broadcast(records.agg((F.count("*") < 2).alias("_few")))
    return out.join(few).select(*(F.when(F.col("_few"), F.lit(float("nan"))).otherwise(F.col(c)).alias(c) for c in ("lo", "hi")))


def permutation(records: DataFrame, *, n_perm: int = 1000, seed: int = 0, order: str = "k") -> DataFrame:
    """p: one-sided sign-flip test of the sum of t, with one added to count and draws."""
    spark = records.sparkSession
    r = gains(records).select(F.col(order).alias("k"), F.round(F.col("t") * 1e6).cast("bigint").alias("t"))
    obs = F.broadcast(r.agg(F.sum("t").alias("_obs")))
    odd = F.conv(F.substring(_draw(seed, "i", "k"), 1, 1), 16, 10).cast("int") % 2 == 1
    flips = spark.range(n_perm).select(F.col("id").alias("i")).crossJoin(F.broadcast(r))  # draws x sampled boundaries, both bounded
    sums = flips.groupBy("i").agg(F.sum(F.when(odd, -F.col("t")).otherwise(F.col("t"))).alias("x"))
    return sums.join(obs).agg(((1 + F.sum((F.col("x") >= F.col("_obs")).cast("int"))) / (n_perm + 1)).alias("p"))


def null_sample(records: DataFrame, *, n_perm: int = 2000, seed: int = 0, order: str = "k") -> DataFrame:
    """i, t_pct: T in percent under each sign flip of the permutation test, 0 without any bits before."""
    spark = records.sparkSession
    r = gains(records).select(F.col(order).alias("k"), F.round(F.col("t") * 1e6).cast("bigint").alias("t"), "adj_pre")
    pre = F.broadcast(r.agg(F.sum("adj_pre").alias("_pre")))
    odd = F.conv(F.substring(_draw(seed, "i", "k"), 1, 1), 16, 10).cast("int") % 2 == 1
    flips = spark.range(n_perm).select(F.col("id").alias("i")).crossJoin(F.broadcast(r.select("k", "t")))  # draws x sampled boundaries, both bounded
    sums = flips.groupBy("i").agg(F.sum(F.when(odd, -F.col("t")).otherwise(F.col("t"))).alias("x")).join(pre)
    return sums.select("i", F.when(F.col("_pre") == 0, 0.0).otherwise(F.try_divide(F.col("x") / 1e4, F.col("_pre"))).alias("t_pct"))


def leave_one_out(records: DataFrame, n_blocks: int = 20) -> DataFrame:
    """lobo_min: the smallest T in percent when one block is left out."""
    b = blocks(records, n_blocks)
    total = F.broadcast(b.agg(F.sum("t").alias("_t"), F.sum("pre").alias("_p")))
    left = b.join(total).withColumn("x", F.when(F.col("_p") == F.col("pre"), 0.0).otherwise(100 * (F.col("_t") - F.col("t")) / (F.col("_p") - F.col("pre"))))
    return left.agg(F.min("x").alias("lobo_min"))


def verdict(t_pct: Column, g_adj_pct: Column, t_share: Column, p: Column, lo: Column, lobo: Column, all_positive: Column) -> tuple[Column, Column]:
    """(verdict, reasons) of the ladder: significance, direction, robustness, then materiality. Null and NaN pass no step."""
    def yes(x: Column, *of: Column) -> Column:
        return F.coalesce(x, F.lit(False)) & ~reduce(lambda a, b: a | b, (F.coalesce(F.isnan(c.cast("double")), F.lit(False)) for c in of))

    weak = F.array_compact(F.array(F.when(~yes(p < P_MAX, p), F.lit("not significant")), F.when(~yes(lo > 0, lo), F.lit("interval includes zero")), F.when(~yes(t_pct > 0, t_pct), F.lit("not positive")), F.when(~yes(g_adj_pct > 0, g_adj_pct), F.lit("the update does not help what follows"))))
    hard = F.array_compact(F.array(F.when(~F.coalesce(all_positive, F.lit(False)), F.lit("direction differs between datasets")), F.when(~yes(lobo > 0, lobo), F.lit("rests on one block"))))
    small = ~(yes(t_pct >= T_PCT_MIN, t_pct) & yes(t_share >= T_SHARE_MIN, t_share))
    name = F.when((F.size(weak) > 0) | (F.size(hard) > 0), "FAIL").when(small, "SIGNIFICANT-BUT-SMALL").otherwise("PASS")
    why = F.when(F.size(weak) > 0, weak).when(F.size(hard) > 0, hard).when(small, F.array(F.lit("below the material size"))).otherwise(F.array().cast("array<string>"))
    return name, why


def main_horizon(records: DataFrame) -> Column:
    """MAIN_H where it was measured, else the longest horizon: an aggregate."""
    return F.when(F.max((F.col("h") == MAIN_H).cast("int")) == 1, F.lit(MAIN_H)).otherwise(F.max("h"))
