"""Coding cost, rate curves, transfer and branching over the per-source streams of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import branch, costs, gk, rate, streams
from tidemark.operators.scratch import materialise
from tidemark.plans import sqltext as S

SCHEDULE = costs.Schedule()
ALL_SEEN = costs.Schedule(all_seen=True)
RATES = (0.0, 0.25, 1.0, 4.0)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk counts of all sources, from a table of their own."""
    return materialise(streams.byte_counts(streams.as_stream(spark.read.parquet(f"{sf_dir}/documents.parquet")), SCHEDULE.chunk), "chunk-counts")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of all sources."""
    return streams.as_stream(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.lit("benchmark").alias("stream"), F.col("item_id").alias("seq"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"), F.lit(0).cast("bigint").alias("start"))
    return streams.byte_counts(text, 1 << 30).select("sym", "c")


def _long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: S.q6(F.col(c)) for c in cols})


def chunk_byte_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct byte values and bytes of each chunk."""
    return counts(spark, sf_dir).groupBy("stream", "chunk").agg(F.count("*").alias("distinct_bytes"), F.sum("c").alias("bytes"))


def static_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks under the frozen pre-trained state."""
    c = costs.chunk_costs(placed(spark, sf_dir), SCHEDULE, prior(spark, sf_dir))
    return c.select("stream", "chunk", "length", "static")


def online_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs.chunk_costs(placed(spark, sf_dir), SCHEDULE).select("stream", "chunk", "length", "online")


def online_cost_pretrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs.chunk_costs(placed(spark, sf_dir), SCHEDULE, prior(spark, sf_dir)).select("stream", "chunk", "length", "online")


def online_cost_all_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs.chunk_costs(placed(spark, sf_dir), ALL_SEEN).select("stream", "chunk", "length", "online")


def interval_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval's cost under S_k, S_0, S_k+1 and S_k-1."""
    return costs.interval_costs(placed(spark, sf_dir), SCHEDULE)


def content_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio, bits per byte and per content unit of each stream's payload (whole bytes)."""
    per = online_cost(spark, sf_dir).groupBy("stream").agg(F.sum("length").alias("orig"), F.floor((F.sum("online") / 1e6 + 7) / 8).alias("comp"))
    most = lambda c: F.greatest(F.col(c), F.lit(1))
    return per.select("stream", "orig", "comp", S.q6(F.col("orig") / most("comp")).alias("ratio"), S.q6(8 * F.col("comp") / most("orig")).alias("bpb"), S.q6(8 * F.col("comp") / most("orig")).alias("bpsp"))


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = costs.chunk_costs(placed(spark, sf_dir), SCHEDULE, prior(spark, sf_dir))
    return materialise(c.select(F.col("stream").alias("run"), "chunk", "length", (F.col("static") / 1e6).alias("static"), (F.col("online") / 1e6).alias("online")), "curve")


def rate_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _curve(spark, sf_dir).withColumn("rate", rate.rate(F.col("online"), F.col("length")))
    return _long(rate.rolling(c, "rate", 8).select("run", "chunk", "rate", "rolling"), "rate", "rolling")


def rate_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(rate.cumulative_saving(_curve(spark, sf_dir)).select("run", "chunk", "saved"), "saved")


def rate_break_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate.break_even(_curve(spark, sf_dir))


def rate_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as sizes alone lay them out, against those that were counted and coded."""
    sizes = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(F.col("source").alias("run")).agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("size"))
    width = SCHEDULE.chunk
    plan = sizes.where("size > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(size - 1) div {width}"))))
    plan = plan.select("run", F.lit("static").alias("mode"), "chunk", F.least(F.lit(width).cast("bigint"), F.col("size") - F.col("chunk") * width).alias("length"))
    coded = _curve(spark, sf_dir).select("run", F.lit("online").alias("mode"), "chunk", "length")
    return rate.check_layout(plan.union(coded))


def rate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(rate.summary(_curve(spark, sf_dir)), "static_rate", "online_rate", "saved", "delta_pct")


def _boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(gk.records(costs.interval_costs(placed(spark, sf_dir), SCHEDULE)), "boundaries")


def gk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boundaries(spark, sf_dir)
    return _long(b, "curr_pre", "curr_post", "curr_base", "next_pre", "next_post")


def gk_boundary_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boundaries(spark, sf_dir)
    out = None
    for unit in ("rel", "bpb", "bpt"):
        part = gk.normalised(b, unit).select("run", "phase", F.lit(unit).alias("unit"), "g", "din", "regret")
        out = part if out is None else out.unionByName(part)
    return _long(out, "g", "din", "regret")


def gk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("harmful_fraction", "mean_g", "mean_din", "stream_g", "transfer_efficiency", "worse_than_base", "stream_regret")
    return _long(gk.summary(_boundaries(spark, sf_dir), "bpb"), *cols)


def gk_summary_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("harmful_fraction", "mean_g", "mean_din", "stream_g", "transfer_efficiency", "worse_than_base", "stream_regret")
    return _long(gk.summary(_boundaries(spark, sf_dir), "rel"), *cols)


def gk_cumulative_regret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(gk.cumulative_regret(_boundaries(spark, sf_dir)), "cum_regret", "cum_rel")


def gk_regret_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gk.regret_crossing(_boundaries(spark, sf_dir))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(branch.records(placed(spark, sf_dir), RATES, SCHEDULE), "candidates")


def branch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_candidates(spark, sf_dir), "curr_bits", "next_bits")


def branch_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(branch.best(_candidates(spark, sf_dir)), "best_bits", "second_bits", "gap")


def branch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(branch.totals(_candidates(spark, sf_dir)), "total", "mean_g", "mean_din", "win_fraction", "excess")


def branch_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(branch.oracle(_candidates(spark, sf_dir)), "best_fixed_total", "oracle_total", "headroom")


def branch_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(branch.switches(branch.actions(_candidates(spark, sf_dir))), "same_rate")


def branch_switches_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(branch.switches(branch.actions(_candidates(spark, sf_dir), stable=True)), "same_rate")


def branch_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return branch.transitions(branch.actions(_candidates(spark, sf_dir)))


def branch_near_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return branch.best(_candidates(spark, sf_dir)).groupBy("run").agg(S.q6(F.avg(F.col("near_tie").cast("int"))).alias("near_tie_fraction"))


def branch_cumulative_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    per = Window.partitionBy("run", "phase")
    run = Window.partitionBy("run", "pos").orderBy("phase").rowsBetween(Window.unboundedPreceding, 0)
    c = _candidates(spark, sf_dir).withColumn("x", F.col("next_bits") - F.min("next_bits").over(per))
    return c.select("run", "phase", "pos", "lr", S.q6(F.sum("x").over(run)).alias("cum_excess"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_byte_counts, static_cost, online_cost, online_cost_pretrained, online_cost_all_seen, interval_measures, content_rates,
        rate_rolling, rate_cumulative, rate_break_even, rate_layout, rate_summary,
        gk_records, gk_boundary_units, gk_summary, gk_summary_rel, gk_cumulative_regret, gk_regret_crossing,
        branch_records, branch_best, branch_totals, branch_oracle, branch_switches, branch_switches_stable, branch_transitions, branch_near_ties, branch_cumulative_excess,
    )
}

_ST = S.states()
_CHUNK = "SELECT c.stream, c.chunk, sum(c.c)::BIGINT AS length, {cols} FROM cnt c JOIN st ON st.stream = c.stream AND st.k = c.chunk // 4 AND st.sym = c.sym {join} GROUP BY c.stream, c.chunk"
_PJ = "LEFT JOIN prior_sym p ON p.sym = c.sym CROSS JOIN prior_all a"
_N, _T = "coalesce(p.prior_n, 0)", "a.prior_total"
_STATIC = f"sum(c.c * {S.mb(_N, _T)})::BIGINT AS static"
_ONLINE = f"sum(c.c * {S.mb('st.n', 'st.seen')})::BIGINT AS online"
_ONLINE_P = f"sum(c.c * {S.mb('st.n + ' + _N, 'st.seen + ' + _T)})::BIGINT AS online"
_CURVE = "cc AS (" + _CHUNK.format(cols=f"{_STATIC}, {_ONLINE_P}", join=_PJ) + "),\ncurve AS (SELECT stream AS run, chunk, length, static / 1e6 AS static, online / 1e6 AS online FROM cc)"
_GKQ = (S.COUNTS, _ST, S.costs(), S.GK)


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0 ELSE {a} / {b} END"


def _summary_sql(g: str, d: str, r: str) -> str:
    return f"""SELECT run, count(*)::BIGINT AS n, round(avg((g < 0)::INT), 6) AS harmful_fraction, round(avg({_ratio("g", g)}), 6) AS mean_g,
    round(avg({_ratio("din", d)}), 6) AS mean_din, round({_ratio("sum(g)", f"sum({g})")}, 6) AS stream_g,
    round({_ratio("sum(g)", "sum(din)")}, 6) AS transfer_efficiency, bool_and(regret IS NOT NULL) AS has_regret,
    round(avg((regret > 0)::INT), 6) AS worse_than_base, round({_ratio("sum(regret)", f"sum({r})")}, 6) AS stream_regret
FROM bd GROUP BY run"""


def _branch_cte() -> str:
    curr = ", ".join(f"sum(s.c * {S.mb(f's.n + {r} * s.c', f's.seen + {r} * s.bytes')})::BIGINT AS c{i}" for i, r in enumerate(RATES))
    nxt = ", ".join(f"sum(s.c * {S.mb(f's.n - coalesce(q.c, 0) + {r} * coalesce(q.c, 0)', f's.seen - p.bytes + {r} * p.bytes')})::BIGINT AS n{i}" for i, r in enumerate(RATES))
    lead = ", ".join(f"lead(n{i}) OVER w AS n{i}" for i in range(len(RATES)))
    rows = " UNION ALL ".join(f"SELECT run, phase, curr_bytes, next_bytes, {i} AS pos, {r}::DOUBLE AS lr, c{i} / 1e6 AS curr_bits, n{i} / 1e6 AS next_bits FROM ahead" for i, r in enumerate(RATES))
    return f"""
per AS (
    SELECT s.stream, s.k, any_value(s.bytes) AS bytes, {curr}, {nxt}
    FROM st s LEFT JOIN iv p ON p.stream = s.stream AND p.k = s.k - 1 LEFT JOIN ic q ON q.stream = s.stream AND q.k = s.k - 1 AND q.sym = s.sym
    GROUP BY s.stream, s.k
),
ahead0 AS (SELECT stream AS run, k AS phase, bytes AS curr_bytes, lead(bytes) OVER w AS next_bytes, {", ".join(f"c{i}" for i in range(len(RATES)))}, {lead} FROM per WINDOW w AS (PARTITION BY stream ORDER BY k)),
ahead AS (SELECT * FROM ahead0 WHERE next_bytes IS NOT NULL),
cand AS ({rows}),
ranked AS (SELECT *, row_number() OVER w AS rn, lead(next_bits) OVER w AS second_bits FROM cand WINDOW w AS (PARTITION BY run, phase ORDER BY next_bits, pos)),
best AS (SELECT run, phase, lr AS best_lr, next_bits AS best_bits, second_bits, second_bits - next_bits AS gap, coalesce(second_bits - next_bits < 0.001 * abs(next_bits), false) AS near_tie FROM ranked WHERE rn = 1)
"""


_BR = (S.COUNTS, _ST, _branch_cte())
_SWITCH = """SELECT run, count(*)::BIGINT AS n, coalesce(sum((was <> lr)::INT), 0)::BIGINT AS switches,
    round(CASE WHEN count(*) < 2 THEN 0 ELSE 1 - coalesce(sum((was <> lr)::INT), 0) / (count(*) - 1) END, 6) AS same_rate
FROM (SELECT *, lag(lr) OVER (PARTITION BY run ORDER BY phase) AS was FROM {seq}) GROUP BY run"""

ORACLE_SQL = {
    "chunk_byte_counts": S.query(S.COUNTS, select="SELECT stream, chunk, count(*)::BIGINT AS distinct_bytes, sum(c)::BIGINT AS bytes FROM cnt GROUP BY ALL"),
    "static_cost": S.query(S.COUNTS, _ST, S.PRIOR, select=_CHUNK.format(cols=_STATIC, join=_PJ)),
    "online_cost": S.query(S.COUNTS, _ST, select=_CHUNK.format(cols=_ONLINE, join="")),
    "online_cost_pretrained": S.query(S.COUNTS, _ST, S.PRIOR, select=_CHUNK.format(cols=_ONLINE_P, join=_PJ)),
    "online_cost_all_seen": S.query(S.COUNTS, S.states(all_seen=True), select=_CHUNK.format(cols=_ONLINE, join="")),
    "interval_measures": S.query(S.COUNTS, _ST, S.costs(), select="SELECT * FROM co"),
    "content_rates": S.query(S.COUNTS, _ST, "cc AS (" + _CHUNK.format(cols=_ONLINE, join="") + ")", "t AS (SELECT stream, sum(length)::BIGINT AS orig, floor((sum(online) / 1e6 + 7) / 8)::BIGINT AS comp FROM cc GROUP BY 1)", select="SELECT stream, orig, comp, round(orig / greatest(comp, 1), 6) AS ratio, round(8 * comp / greatest(orig, 1), 6) AS bpb, round(8 * comp / greatest(orig, 1), 6) AS bpsp FROM t"),
    "rate_rolling": S.query(S.COUNTS, _ST, S.PRIOR, _CURVE, select="SELECT run, chunk, round(online / length, 6) AS rate, round(avg(online / length) OVER (PARTITION BY run ORDER BY chunk ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 6) AS rolling FROM curve"),
    "rate_cumulative": S.query(S.COUNTS, _ST, S.PRIOR, _CURVE, select="SELECT run, chunk, round(sum(static - online) OVER (PARTITION BY run ORDER BY chunk), 6) AS saved FROM curve"),
    "rate_break_even": S.query(S.COUNTS, _ST, S.PRIOR, _CURVE, select="SELECT run, min(chunk) FILTER (saved > 0) AS first FROM (SELECT run, chunk, sum(static - online) OVER (PARTITION BY run ORDER BY chunk) AS saved FROM curve) GROUP BY run"),
    "rate_layout": S.query(S.COUNTS, "co AS (SELECT stream AS run, chunk, sum(c) AS length FROM cnt GROUP BY ALL)", "si AS (SELECT stream AS run, max(start + len) AS size FROM placed GROUP BY 1)", "pl AS (SELECT run, chunk, least(512, size - chunk * 512) AS length FROM (SELECT run, size, unnest(range(((size + 511) // 512)::BIGINT)) AS chunk FROM si))", select="SELECT coalesce(pl.run, co.run) AS run, bool_and(pl.length IS NOT DISTINCT FROM co.length) AS same_layout FROM pl FULL JOIN co ON pl.run = co.run AND pl.chunk = co.chunk GROUP BY 1"),
    "rate_summary": S.query(S.COUNTS, _ST, S.PRIOR, _CURVE, select="SELECT run, sum(length)::BIGINT AS length, floor(sum(static) / 8)::BIGINT AS static_payload, floor(sum(online) / 8)::BIGINT AS online_payload, round(sum(static) / sum(length), 6) AS static_rate, round(sum(online) / sum(length), 6) AS online_rate, round(sum(static) - sum(online), 6) AS saved, round((sum(static) - sum(online)) / sum(static) * 100, 6) AS delta_pct FROM curve GROUP BY run"),
    "gk_records": S.query(*_GKQ, select="SELECT run, phase, curr_bytes AS curr_tokens, curr_bytes, round(curr_pre, 6) AS curr_pre, round(curr_post, 6) AS curr_post, round(curr_base, 6) AS curr_base, next_bytes AS next_tokens, next_bytes, round(next_pre, 6) AS next_pre, round(next_post, 6) AS next_post FROM bd"),
    "gk_boundary_units": S.query(*_GKQ, select=" UNION ALL ".join(f"SELECT run, phase, '{u}' AS unit, round({_ratio('g', g)}, 6) AS g, round({_ratio('din', d)}, 6) AS din, round({_ratio('regret', r)}, 6) AS regret FROM bd" for u, g, d, r in (("rel", "next_pre", "curr_pre", "curr_base"), ("bpb", "next_bytes", "curr_bytes", "curr_bytes"), ("bpt", "next_bytes", "curr_bytes", "curr_bytes")))),
    "gk_summary": S.query(*_GKQ, select=_summary_sql("next_bytes", "curr_bytes", "curr_bytes")),
    "gk_summary_rel": S.query(*_GKQ, select=_summary_sql("next_pre", "curr_pre", "curr_base")),
    "gk_cumulative_regret": S.query(*_GKQ, select="SELECT run, phase, round(sum(regret) OVER w, 6) AS cum_regret, round(sum(regret) OVER w / sum(curr_base) OVER w, 6) AS cum_rel FROM bd WINDOW w AS (PARTITION BY run ORDER BY phase)"),
    "gk_regret_crossing": S.query(*_GKQ, select="SELECT run, min(phase) FILTER (r > 0) AS first_phase FROM (SELECT run, phase, sum(regret) OVER (PARTITION BY run ORDER BY phase) AS r FROM bd) GROUP BY run"),
    "branch_records": S.query(*_BR, select="SELECT run, phase, curr_bytes, next_bytes, pos, lr, round(curr_bits, 6) AS curr_bits, round(next_bits, 6) AS next_bits FROM cand"),
    "branch_best": S.query(*_BR, select="SELECT run, phase, best_lr, round(best_bits, 6) AS best_bits, round(second_bits, 6) AS second_bits, round(gap, 6) AS gap, near_tie FROM best"),
    "branch_totals": S.query(*_BR, select="""SELECT c.run, c.pos, c.lr, round(sum(c.next_bits), 6) AS total, round(avg(z.next_bits - c.next_bits), 6) AS mean_g, round(avg(z.curr_bits - c.curr_bits), 6) AS mean_din,
    round(avg((c.lr = b.best_lr)::INT), 6) AS win_fraction, round(sum(c.next_bits - b.best_bits), 6) AS excess
FROM cand c JOIN best b USING (run, phase) JOIN cand z ON z.run = c.run AND z.phase = c.phase AND z.lr = 0 GROUP BY c.run, c.pos, c.lr"""),
    "branch_oracle": S.query(*_BR, "tot AS (SELECT run, pos, lr, sum(next_bits) AS total FROM cand GROUP BY ALL)", "fixed AS (SELECT DISTINCT ON (run) run, lr, total FROM tot ORDER BY run, round(total, 6), pos)", "free AS (SELECT run, sum(best_bits) AS oracle_total FROM best GROUP BY run)", select="SELECT run, lr AS best_fixed_lr, round(total, 6) AS best_fixed_total, round(oracle_total, 6) AS oracle_total, round((total - oracle_total) / total, 6) AS headroom FROM fixed JOIN free USING (run)"),
    "branch_switches": S.query(*_BR, select=_SWITCH.format(seq="(SELECT run, phase, best_lr AS lr FROM best)")),
    "branch_switches_stable": S.query(*_BR, select=_SWITCH.format(seq="""(
    WITH RECURSIVE held(run, phase, lr) AS (
        SELECT run, phase, best_lr FROM best WHERE phase = 0
        UNION ALL
        SELECT b.run, b.phase, CASE WHEN b.near_tie AND c.next_bits - b.best_bits < 0.001 * abs(b.best_bits) THEN h.lr ELSE b.best_lr END
        FROM held h JOIN best b ON b.run = h.run AND b.phase = h.phase + 1 JOIN cand c ON c.run = b.run AND c.phase = b.phase AND c.lr = h.lr
    ) SELECT * FROM held)""")),
    "branch_transitions": S.query(*_BR, select="SELECT run, was AS from_lr, lr AS to_lr, count(*)::BIGINT AS n FROM (SELECT run, best_lr AS lr, lag(best_lr) OVER (PARTITION BY run ORDER BY phase) AS was FROM best) WHERE was IS NOT NULL GROUP BY ALL"),
    "branch_near_ties": S.query(*_BR, select="SELECT run, round(avg(near_tie::INT), 6) AS near_tie_fraction FROM best GROUP BY run"),
    "branch_cumulative_excess": S.query(*_BR, select="SELECT c.run, c.phase, c.pos, c.lr, round(sum(c.next_bits - b.best_bits) OVER (PARTITION BY c.run, c.pos ORDER BY c.phase), 6) AS cum_excess FROM cand c JOIN best b USING (run, phase)"),
}
