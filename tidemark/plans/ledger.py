"""Context squares, collapse points, sweeps, evaluation totals, codecs, sinks and sources over the standard tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import RunConfig
from tidemark.operators import codecs, context, costs, gk, ledger, streams
from tidemark.operators.scratch import materialise
from tidemark.plans import coding
from tidemark.plans import sqltext as S
from tidemark.sources import readers, sinks

GRID = {"modality": "text", "fixed": {"mode": "both"}, "grid": {"lora_r": [8, 16], "lr": [0.25, 1.0, 4.0], "chunk": [512]}}
STRENGTHS = (0.25, 1.0, 4.0)


def _cells(spark, sf_dir) -> DataFrame:
    """dataset, ctx, mode, bits: both tails with chunks of 64 bytes and intervals of one chunk, static and online alike."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    cells = context.cells(streams.rows_of(c, stream="conv_id", order="turn"), 64, 1, (0, 1))
    return cells.select(F.col("stream").alias("dataset"), "ctx", "mode", "bits")


def context_cells(spark, sf_dir):
    return _cells(spark, sf_dir)


def context_square(spark, sf_dir):
    sq = context.squares(_cells(spark, sf_dir))
    return sq.select("dataset", "ctx", *(S.q6(F.col(c)).alias(c) for c in ("gain_b", "gain_c", "gain_d", "d_vs_c", "d_vs_b", "additive", "overlap")))


def _points(spark, sf_dir) -> DataFrame:
    """One point for each source and strength."""
    every = materialise(costs.interval_costs_by_strength(coding.placed(spark, sf_dir), costs.Schedule(), STRENGTHS), "interval-costs")
    out = []
    for x in STRENGTHS:
        per = every.where(F.col("strength") == x)
        summary = gk.summary(gk.records(per), "rel").select("run", (F.col("mean_din") * 100).alias("mean_din"), (F.col("transfer_efficiency") * 100).alias("efficiency"), (F.col("stream_regret") * 100).alias("regret_rel"))
        bpb = gk.summary(gk.records(per), "bpb").select("run", F.col("stream_g").alias("stream_g_bpb"))
        delta = per.groupBy(F.col("stream").alias("run")).agg(((F.sum("base") - F.sum("pre")) / F.sum("base") * 100).alias("delta_pct"))
        out.append(summary.join(bpb, "run").join(delta, "run").select(F.col("run").alias("dataset"), F.lit("lr").alias("knob"), F.lit(x).alias("knob_value"), "mean_din", "efficiency", "stream_g_bpb", "delta_pct", "regret_rel"))
    return reduce(DataFrame.unionByName, out)


def collapse_points(spark, sf_dir):
    series = ledger.collapse_series(_points(spark, sf_dir), "delta_pct", floor=48.0)
    return series.select("dataset", "knob", "knob_value", *(S.q6(F.col(c)).alias(c) for c in ("mean_din", "efficiency", "stream_g_bpb", "delta_pct", "regret_rel", "shown")), "diverged", "place")


def sweep_grid(spark, sf_dir):
    return ledger.expand(spark, GRID)


def _sweep(spark, sf_dir) -> DataFrame:
    """The grid with static and online rates of the whole corpus at each strength; runs of rank 16 and strength 4 failed."""
    every = materialise(costs.interval_costs_by_strength(coding.placed(spark, sf_dir), costs.Schedule(), STRENGTHS), "interval-costs")
    rates = []
    for x in STRENGTHS:
        per = every.where(F.col("strength") == x).agg((F.sum("base") / 1e6 / F.sum("bytes")).alias("static_rate"), (F.sum("pre") / 1e6 / F.sum("bytes")).alias("online_rate"))
        rates.append(per.withColumn("lr", F.lit(x)))
    grid = ledger.expand(spark, GRID)
    ok = (F.col("lora_r") == 8) | (F.col("lr") < 4)
    status = grid.select("run_id", ledger.outcome(F.lit(0), ok).alias("status"))
    results = grid.where(ok).join(F.broadcast(reduce(DataFrame.unionByName, rates)), "lr").select("run_id", "static_rate", "online_rate")
    return ledger.collect(grid, status, results)


def sweep_summary(spark, sf_dir):
    s = _sweep(spark, sf_dir)
    return s.select("run_id", "status", "chunk", "lora_alpha", "lora_r", "lr", *(S.q6(F.col(c)).alias(c) for c in ("static_rate", "online_rate", "delta_pct")))


def sweep_best(spark, sf_dir):
    return ledger.best_config(_sweep(spark, sf_dir), ["chunk", "lora_alpha", "lora_r", "lr"])


def sweep_ls(spark, sf_dir):
    out = ledger.listing(_sweep(spark, sf_dir), "rates")
    return out.select("group_name", "runs", "done", S.q6(F.col("min_rate")).alias("min_rate"))


def sweep_varied(spark, sf_dir):
    return ledger.varied(ledger.expand(spark, GRID))


def _samples(spark, sf_dir) -> DataFrame:
    """Documents in pieces of 4096 bytes, each coded under the pre-trained state; every tenth is coded and decoded, the others are not checked."""
    d = streams.as_stream(spark.read.parquet(f"{sf_dir}/documents.parquet"), stream="doc_id")
    p = coding.prior(spark, sf_dir)
    prior, total = F.broadcast(p.groupBy("sym").agg(F.sum("c").alias("p"))), F.broadcast(p.agg(F.sum("c").alias("pt")))
    counts = streams.byte_counts(d, 4096, "piece").join(prior, "sym", "left").join(total)
    bits = F.sum(F.col("c") * costs.micro_bits(F.coalesce("p", F.lit(0)), F.col("pt")))
    per = counts.groupBy(F.col("stream").cast("bigint").alias("doc_id"), "piece").agg(F.sum("c").alias("original_bytes"), F.ceil(bits / 8e6).alias("compressed_bytes"))
    done = codecs.round_trip(d.where(F.col("stream").cast("bigint") % 10 == 0), RunConfig(), block=4096)
    done = done.select(F.col("stream").cast("bigint").alias("doc_id"), F.col("block").alias("piece"), F.col("equal").cast("int").alias("_equal"))
    return per.join(done, ["doc_id", "piece"], "left").withColumn("roundtrip_ok", F.coalesce("_equal", F.lit(-1))).drop("_equal")


def eval_per_doc(spark, sf_dir):
    d = ledger.per_document(_samples(spark, sf_dir), "doc_id")
    return d.select("doc_id", "original_bytes", "compressed_bytes", S.q6(F.col("bpb")).alias("bpb"), S.q6(F.col("ratio")).alias("ratio"), "roundtrip_ok")


def eval_totals(spark, sf_dir):
    t = ledger.totals(ledger.per_document(_samples(spark, sf_dir), "doc_id"))
    return t.select("n", "original_bytes", "compressed_bytes", S.q6(F.col("bpb")).alias("bpb"), S.q6(F.col("ratio")).alias("ratio"), "checked", "passed")


def roundtrip_check(spark, sf_dir):
    """Every source's stream coded, decoded anew and compared."""
    return codecs.round_trip(streams.as_stream(spark.read.parquet(f"{sf_dir}/documents.parquet")), RunConfig())


def codec_baselines(spark, sf_dir):
    """Codecs over each document in pieces of 2048 bytes, by source and in all."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"))
    return codecs.with_total(codecs.baselines(d, "source", piece=2048), "source")


def codec_baselines_whole(spark, sf_dir):
    """Codecs over each document as a whole, by source and in all."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"))
    return codecs.with_total(codecs.baselines(d, "source"), "source")


def signal_mixture(spark, sf_dir):
    return readers.signal(spark, 2000, 8000).select("i", S.q6(F.col("x")).alias("x"))


def status_upsert(spark, sf_dir):
    """Latest order status of each customer."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("status"))
    return ledger.upsert(o.where("at % 2 = 0"), o.where("at % 2 = 1"), "k", "at")


def shard_fold(spark, sf_dir):
    """Documents appended to shards that roll once they hold 20000 bytes."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", (F.octet_length("text") + 1).cast("bigint").alias("n"))
    return sinks.roll(d, 20_000, key="source", order="doc_id", size="n")


def byte_slices(spark, sf_dir):
    """Sizes of exact byte slices of each source's stream."""
    sizes = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("source").agg(F.sum(F.octet_length("text")).alias("size"))
    return sinks.slices(sizes, 50_000)


def loader_choice(spark, sf_dir):
    """Which registered loader a path's last part names."""
    paths = ["/data/Pile-of-Law/train", "text/raw/enwik9", "x/ljspeech/", "a/unknown", "/d/pile_of_law-small"]
    names = ["pile_of_law", "enwik9", "ljspeech"]
    return readers.matching_loader(spark.createDataFrame([(p,) for p in paths], "path string"), names)


def fallback_ladder(spark, sf_dir):
    """Attempts in order: for each endpoint the fast transport first, the plain one last."""
    return readers.ladder(spark.createDataFrame([(0, "mirror"), (1, "origin")], "place int, endpoint string"), prefer_fast=True)


QUERIES = {
    f.__name__: f
    for f in (
        context_cells, context_square, collapse_points, sweep_grid, sweep_summary, sweep_best, sweep_ls, sweep_varied, eval_per_doc, eval_totals,
        roundtrip_check, codec_baselines, codec_baselines_whole, signal_mixture, status_upsert, shard_fold, byte_slices, loader_choice, fallback_ladder,
    )
}


def _context_sql(ctx: int) -> str:
    tail = "coalesce(last_value(sym) OVER (PARTITION BY stream ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), 256)" if ctx else "256"
    return f"""
pr{ctx} AS (SELECT stream, k, ctx, sym, count(*) AS c FROM (SELECT stream, pos // 64 AS k, sym, CASE WHEN pos % 64 = 0 THEN {tail} ELSE lag(sym) OVER (PARTITION BY stream ORDER BY pos) END AS ctx FROM cb) GROUP BY ALL),
nx{ctx} AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY stream, ctx, sym ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM pr{ctx}),
tx{ctx} AS (SELECT stream, k, ctx, coalesce(sum(sum(c)) OVER (PARTITION BY stream, ctx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tot FROM pr{ctx} GROUP BY stream, k, ctx),
on{ctx} AS (SELECT stream, sum(c * {S.mb("n", "tot")})::BIGINT AS online, sum(c * {S.mb("0", "0")})::BIGINT AS static FROM nx{ctx} JOIN tx{ctx} USING (stream, k, ctx) GROUP BY stream)"""


_CB = """
cd AS (SELECT conv_id::VARCHAR AS stream, turn, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS len FROM conversations),
cp AS (SELECT *, sum(len) OVER (PARTITION BY stream ORDER BY turn) - len AS start FROM cd),
cb AS (SELECT stream, (start + i)::BIGINT AS pos, ('0x' || substr(hx, (2 * i + 1)::BIGINT, 2))::INTEGER AS sym FROM (SELECT stream, hx, start, unnest(range(len)) AS i FROM cp))
"""
_CELLS = "cells AS (SELECT stream AS dataset, 0 AS ctx, 'static' AS mode, static AS bits FROM on0 UNION ALL SELECT stream, 0, 'online', online FROM on0 UNION ALL SELECT stream, 1, 'static', static FROM on1 UNION ALL SELECT stream, 1, 'online', online FROM on1)"


def _suffixed(sql: str, i: int, names: tuple[str, ...]) -> str:
    import re

    for n in names:
        sql = re.sub(rf"\b{n}\b", f"{n}{i}", sql)
    return sql


_STRENGTH_CTES = []
for _i, _x in enumerate(STRENGTHS):
    for _part in (S.states(_x), S.costs(_x), S.GK):
        _STRENGTH_CTES.append(_suffixed(_part, _i, ("ic", "iv", "nn", "st", "co", "gk", "bd")))
_R = lambda a, b: f"CASE WHEN {b} = 0 THEN 0 ELSE {a} / {b} END"
_POINTS = "pts AS (" + " UNION ALL ".join(
    f"SELECT run AS dataset, 'lr' AS knob, {x}::DOUBLE AS knob_value, 100 * avg({_R('din', 'curr_pre')}) AS mean_din, 100 * ({_R('sum(g)', 'sum(din)')}) AS efficiency, {_R('sum(g)', 'sum(next_bytes)')} AS stream_g_bpb, any_value(d.delta) AS delta_pct, 100 * ({_R('sum(regret)', 'sum(curr_base)')}) AS regret_rel FROM bd{i} JOIN (SELECT stream, (sum(base) - sum(pre)) / sum(base) * 100 AS delta FROM co{i} GROUP BY 1) d ON d.stream = run GROUP BY run"
    for i, x in enumerate(STRENGTHS)
) + ")"
_GRIDV = "grid AS (SELECT lpad((row_number() OVER (ORDER BY r, l) - 1)::VARCHAR, 4, '0') AS run_id, 512::BIGINT AS chunk, (2 * r)::BIGINT AS lora_alpha, r::BIGINT AS lora_r, l::DOUBLE AS lr, 'both' AS mode FROM (VALUES (8), (16)) a(r), (VALUES (0.25), (1.0), (4.0)) b(l))"
_RATES = "rt AS (" + " UNION ALL ".join(f"SELECT {x}::DOUBLE AS lr, sum(base) / 1e6 / sum(bytes) AS static_rate, sum(pre) / 1e6 / sum(bytes) AS online_rate FROM co{i}" for i, x in enumerate(STRENGTHS)) + ")"
_SW = (S.COUNTS, *_STRENGTH_CTES, _GRIDV, _RATES, "sw AS (SELECT g.*, CASE WHEN lora_r = 8 OR g.lr < 4 THEN 'done' ELSE 'failed' END AS status, CASE WHEN lora_r = 8 OR g.lr < 4 THEN static_rate END AS static_rate, CASE WHEN lora_r = 8 OR g.lr < 4 THEN online_rate END AS online_rate FROM grid g JOIN rt ON rt.lr = g.lr)")
_SAMPLES = f"""
dd AS (SELECT doc_id, hex(encode(text)) AS hx, octet_length(encode(text)) AS len FROM documents),
db AS (SELECT doc_id, i // 4096 AS piece, ('0x' || substr(hx, (2 * i + 1)::BIGINT, 2))::INTEGER AS sym FROM (SELECT *, unnest(range(len)) AS i FROM dd)),
dc AS (SELECT doc_id, piece, sym, count(*) AS c FROM db GROUP BY ALL),
sa AS (SELECT doc_id, piece, sum(c)::BIGINT AS o, ceil(sum(c * {S.mb("coalesce(prior_n, 0)", "prior_total")}) / 8e6)::BIGINT AS z FROM dc LEFT JOIN prior_sym USING (sym) CROSS JOIN prior_all GROUP BY ALL),
ev AS (SELECT doc_id, sum(o)::BIGINT AS original_bytes, sum(z)::BIGINT AS compressed_bytes, CASE WHEN doc_id % 10 = 0 THEN 1 ELSE -1 END AS roundtrip_ok FROM sa GROUP BY doc_id)
"""

ORACLE_SQL = {
    "context_cells": S.query(_CB, _context_sql(0), _context_sql(1), _CELLS, select="SELECT dataset, ctx::INTEGER AS ctx, mode, bits FROM cells"),
    "context_square": S.query(_CB, _context_sql(0), _context_sql(1), "sq AS (SELECT a.stream AS dataset, 100 * (a.static - a.online) / a.static AS b, 100 * (a.static - c.static) / a.static AS c, 100 * (a.static - c.online) / a.static AS d FROM on0 a JOIN on1 c USING (stream))", select="SELECT dataset, 1::INTEGER AS ctx, round(b, 6) AS gain_b, round(c, 6) AS gain_c, round(d, 6) AS gain_d, round(d - c, 6) AS d_vs_c, round(d - b, 6) AS d_vs_b, round(b + c, 6) AS additive, round(b + c - d, 6) AS overlap FROM sq"),
    "collapse_points": S.query(S.COUNTS, *_STRENGTH_CTES, _POINTS, "dv AS (SELECT *, coalesce(delta_pct < 48, false) AS diverged FROM pts)", select="SELECT dataset, knob, knob_value, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean_din", "efficiency", "stream_g_bpb", "delta_pct", "regret_rel")) + ", round(CASE WHEN diverged THEN greatest(delta_pct, 48) ELSE delta_pct END, 6) AS shown, diverged, CASE WHEN NOT diverged THEN (sum((NOT diverged)::INT) OVER (PARTITION BY dataset, knob ORDER BY mean_din, knob_value))::BIGINT END AS place FROM dv"),
    "sweep_grid": S.query(_GRIDV, select="SELECT * FROM grid"),
    "sweep_summary": S.query(*_SW, select="SELECT run_id, status, chunk, lora_alpha, lora_r, lr, round(static_rate, 6) AS static_rate, round(online_rate, 6) AS online_rate, round((static_rate - online_rate) / static_rate * 100, 6) AS delta_pct FROM sw"),
    "sweep_best": S.query(*_SW, select="SELECT chunk, lora_alpha, lora_r, lr, 'both' AS mode, false AS no_decompress FROM sw WHERE status = 'done' ORDER BY online_rate, run_id LIMIT 1"),
    "sweep_ls": S.query(*_SW, select="SELECT 'rates' AS group_name, count(*)::BIGINT AS runs, count(*) FILTER (status = 'done')::BIGINT AS done, round(min(online_rate) FILTER (status = 'done'), 6) AS min_rate FROM sw"),
    "sweep_varied": "SELECT setting, n::BIGINT AS n FROM (VALUES ('lora_alpha', 2), ('lora_r', 2), ('lr', 3)) t(setting, n)",
    "eval_per_doc": S.query(S.PRIOR, _SAMPLES, select="SELECT doc_id, original_bytes, compressed_bytes, round(8 * compressed_bytes / greatest(original_bytes, 1), 6) AS bpb, round(original_bytes / greatest(compressed_bytes, 1), 6) AS ratio, roundtrip_ok FROM ev"),
    "eval_totals": S.query(S.PRIOR, _SAMPLES, select="SELECT count(*)::BIGINT AS n, sum(original_bytes)::BIGINT AS original_bytes, sum(compressed_bytes)::BIGINT AS compressed_bytes, round(8 * sum(compressed_bytes) / greatest(sum(original_bytes), 1), 6) AS bpb, round(sum(original_bytes) / greatest(sum(compressed_bytes), 1), 6) AS ratio, count(*) FILTER (roundtrip_ok >= 0)::BIGINT AS checked, count(*) FILTER (roundtrip_ok = 1)::BIGINT AS passed FROM ev"),
    "signal_mixture": S.query(select="SELECT i, round((0.5 * sin(2 * pi() * 220 * i / 8000) + 0.3 * sin(2 * pi() * 440 * i / 8000) + 0.2 * sin(2 * pi() * 110 * i / 8000)), 6) AS x FROM range(2000) t(i)"),
    "status_upsert": "SELECT o_custkey AS k, max(o_orderkey) AS at, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1",
    "shard_fold": """WITH RECURSIVE d AS (SELECT source, doc_id, octet_length(encode(text))::BIGINT + 1 AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
f(source, doc_id, n, i, shard, held) AS (SELECT source, doc_id, n, i, 0::BIGINT, n FROM d WHERE i = 1
    UNION ALL SELECT d.source, d.doc_id, d.n, d.i, CASE WHEN f.held >= 20000 THEN f.shard + 1 ELSE f.shard END, CASE WHEN f.held >= 20000 THEN d.n ELSE f.held + d.n END FROM f JOIN d ON d.source = f.source AND d.i = f.i + 1)
SELECT source, doc_id, n, shard FROM f""",
    "byte_slices": "SELECT source, s AS shard, least(50000, size - s * 50000)::BIGINT AS bytes FROM (SELECT source, size, unnest(range(greatest((size + 49999) // 50000, 1))) AS s FROM (SELECT source, sum(octet_length(encode(text)))::BIGINT AS size FROM documents GROUP BY 1))",
    "loader_choice": "SELECT path, loader FROM (VALUES ('/data/Pile-of-Law/train', NULL), ('text/raw/enwik9', 'enwik9'), ('x/ljspeech/', 'ljspeech'), ('a/unknown', NULL), ('/d/pile_of_law-small', 'pile_of_law')) t(path, loader)",
    "fallback_ladder": "SELECT attempt::BIGINT AS attempt, endpoint, fast FROM (VALUES (0, 'mirror', true), (1, 'mirror', false), (2, 'origin', true), (3, 'origin', false)) t(attempt, endpoint, fast)",
}
