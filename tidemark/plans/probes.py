"""Mixed-language stream, its domains, and the adjacency probe over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import adjacency as A
from tidemark.operators import branch, costs, mixing, streams
from tidemark.operators.scratch import materialise
from tidemark.plans import coding
from tidemark.plans import sqltext as S

LANGS = ("en", "fr", "de", "es")
WIDTH = 2048
TOTAL = 200_000
PLAN = {"h": 4, "k": 2, "n_target": 24, "seed": 5}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the four languages of the mix, which alone make the stream; others, and those without a language, are not part of it."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("lang").isin(*LANGS))
    place = F.coalesce(*(F.when(F.col("lang") == x, F.lit(i)) for i, x in enumerate(LANGS)))
    return d.withColumn("place", place)


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream: languages one after another, each in order of doc_id."""
    d = _docs(spark, sf_dir).withColumn("one", F.lit("mixed")).withColumn("at", F.col("place") * (1 << 40) + F.col("doc_id"))
    return streams.as_stream(d, stream="one", order="at")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).groupBy(F.col("place").alias("order"), F.col("lang").alias("dataset")).agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"))
    return mixing.ranges(d)


def mixed_stream_blocks(spark, sf_dir):
    """A stream of TOTAL bytes in equal parts of the four languages, cut safely."""
    plan = mixing.targets(spark.createDataFrame([(i, x, 1.0) for i, x in enumerate(LANGS)], "order int, dataset string, weight double"), TOTAL)
    each = streams.as_stream(_docs(spark, sf_dir), stream="lang")
    cut = mixing.ranges(mixing.safe_cuts(each, plan))
    return cut.select("order", "dataset", "target", "bytes", "byte_start", "byte_end", S.q6(F.col("share_pct")).alias("share_pct"))


def _counts(spark, sf_dir):
    return materialise(streams.byte_counts(_mixed(spark, sf_dir), WIDTH, "k").select("k", "sym", "c"), "mixed-counts")


def _intervals(spark, sf_dir, counts: DataFrame) -> DataFrame:
    """k, bytes, domain, base (cost under the pre-trained S_0)."""
    prior = coding.prior(spark, sf_dir)
    p, total = F.broadcast(prior.groupBy("sym").agg(F.sum("c").alias("p"))), F.broadcast(prior.agg(F.sum("c").alias("pt")))
    cost = F.col("c") * costs.micro_bits(F.coalesce("p", F.lit(0)), F.coalesce("pt", F.lit(0)))
    per = counts.join(p, "sym", "left").join(total).groupBy("k").agg(F.sum("c").alias("bytes"), F.sum(cost).alias("base"))
    return materialise(mixing.domain_at(per.withColumn("at", F.col("k") * WIDTH), _blocks(spark, sf_dir), "at").select("k", "bytes", "domain", "base"), "intervals")


def domain_of_interval(spark, sf_dir):
    return _intervals(spark, sf_dir, _counts(spark, sf_dir))


def branch_domains(spark, sf_dir):
    """Domains of boundaries by the bytes of next intervals so far, inclusive."""
    per = _intervals(spark, sf_dir, _counts(spark, sf_dir))
    from pyspark.sql import Window

    b = per.select(F.lit("mixed").alias("run"), F.col("k").alias("phase"), F.lead("bytes").over(Window.orderBy("k")).alias("next_bytes")).where("next_bytes is not null")
    return branch.with_domain(b, _blocks(spark, sf_dir)).groupBy("run", "domain").agg(F.count("*").alias("n"), F.min("phase").alias("first"), F.max("phase").alias("last"))


def adjacency_plan(spark, sf_dir):
    return A.plan(_intervals(spark, sf_dir, _counts(spark, sf_dir)), **PLAN)


def _records(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    iv = _intervals(spark, sf_dir, counts)
    return A.scores(counts, iv.select("k", "bytes"), A.plan(iv, **PLAN), coding.prior(spark, sf_dir), PLAN["h"])


def adjacency_scores(spark, sf_dir):
    r = A.gains(_records(spark, sf_dir))
    return r.select("k", "domain", "h", *(S.q6(F.col(c)).alias(c) for c in ("adj_pre", "adj_post", "ctrl_pre", "ctrl_post", "g_adj", "g_ctrl", "t")))


def _main(spark, sf_dir):
    return materialise(_records(spark, sf_dir).where(F.col("h") == A.MAIN_H), "records")


def adjacency_agg(spark, sf_dir):
    """By domain and pooled, at the main horizon."""
    r = _main(spark, sf_dir)
    both = A.aggregate(r, "domain").unionByName(A.aggregate(r.withColumn("domain", F.lit("pooled")), "domain"))
    return both.select("domain", "n", *(S.q6(F.col(c)).alias(c) for c in ("t_pct", "g_adj_pct", "t_share", "positive_fraction", "mean_t", "median_t")))


def adjacency_bootstrap(spark, sf_dir):
    return A.bootstrap(_main(spark, sf_dir), n_blocks=10, n_boot=1000, seed=3).select(S.q6(F.col("lo")).alias("lo"), S.q6(F.col("hi")).alias("hi"))


def adjacency_permutation(spark, sf_dir):
    return A.permutation(_main(spark, sf_dir), n_perm=1000, seed=3).select(S.q6(F.col("p")).alias("p"))


def adjacency_null(spark, sf_dir):
    """T of 2,000 sign flips."""
    return A.null_sample(_main(spark, sf_dir), n_perm=2000, seed=3).select("i", S.q6(F.col("t_pct")).alias("t_pct"))


def adjacency_lobo(spark, sf_dir):
    return A.leave_one_out(_main(spark, sf_dir), 10).select(S.q6(F.col("lobo_min")).alias("lobo_min"))


def adjacency_verdict(spark, sf_dir):
    r = _main(spark, sf_dir)
    pooled = A.aggregate(r.withColumn("all", F.lit(1)), "all")
    sides = A.aggregate(r, "domain").agg(F.bool_and(F.col("t_pct") > 0).alias("same"))
    x = pooled.join(sides).join(A.bootstrap(r, n_blocks=10, n_boot=1000, seed=3)).join(A.permutation(r, n_perm=1000, seed=3)).join(A.leave_one_out(r, 10))
    name, why = A.verdict(*(F.col(c) for c in ("t_pct", "g_adj_pct", "t_share", "p", "lo", "lobo_min", "same")))
    return x.select(name.alias("verdict"), F.array_join(why, "; ").alias("reasons"))


QUERIES = {f.__name__: f for f in (mixed_stream_blocks, domain_of_interval, branch_domains, adjacency_plan, adjacency_scores, adjacency_agg, adjacency_bootstrap, adjacency_permutation, adjacency_null, adjacency_lobo, adjacency_verdict)}

_O = "CASE lang " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(LANGS)) + " END"
_MIX = f"""
md AS (SELECT {_O} AS o, lang, doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS len FROM documents WHERE {_O} IS NOT NULL),
mp AS (SELECT *, sum(len) OVER (ORDER BY o, doc_id) - len AS start FROM md),
mb AS (SELECT ((start + i) // {WIDTH})::BIGINT AS k, ('0x' || substr(hx, (2 * i + 1)::BIGINT, 2))::INTEGER AS sym FROM (SELECT hx, start, unnest(range(len)) AS i FROM mp)),
mc AS (SELECT k, sym, count(*)::BIGINT AS c FROM mb GROUP BY ALL),
bl AS (SELECT o AS "order", lang AS dataset, sum(len)::BIGINT AS bytes, min(start)::BIGINT AS byte_start, (min(start) + sum(len))::BIGINT AS byte_end FROM mp GROUP BY ALL),
miv0 AS (SELECT k, sum(c)::BIGINT AS bytes, sum(c * {S.mb("coalesce(prior_n, 0)", "prior_total")})::BIGINT AS base FROM mc LEFT JOIN prior_sym USING (sym) CROSS JOIN prior_all GROUP BY k),
miv AS (SELECT k, m.bytes, dataset AS domain, base FROM miv0 m JOIN bl ON k * {WIDTH} >= byte_start AND k * {WIDTH} < byte_end)
"""
_H, _K, _NT, _SEED = PLAN["h"], PLAN["k"], PLAN["n_target"], PLAN["seed"]
_PLAN = f"""
w0 AS (SELECT k, domain, sum(base) OVER f AS total, count(*) OVER f AS n, min(domain) OVER f AS lo, max(domain) OVER f AS hi FROM miv WINDOW f AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND {_H - 1} FOLLOWING)),
w AS (SELECT k, domain, least(9, ((count(*) OVER (PARTITION BY domain ORDER BY total RANGE UNBOUNDED PRECEDING) - 1) * 10) // count(*) OVER (PARTITION BY domain)) AS decile FROM w0 WHERE n = {_H} AND lo = hi),
fu AS (SELECT k - 1 AS k, domain, decile FROM w WHERE k >= 1 AND k - 1 <= (SELECT count(*) FROM miv) - 2),
ch AS (SELECT k, domain, decile FROM (SELECT *, row_number() OVER (ORDER BY k) - 1 AS i FROM fu) WHERE i % greatest({_H + 1}, (SELECT count(*) FROM fu) // {_NT}) = 0),
ca AS (SELECT c.k, c.domain, w.k AS j, count(*) OVER (PARTITION BY c.k) AS n, row_number() OVER (PARTITION BY c.k ORDER BY md5('{_SEED}:' || c.k || ':' || w.k), w.k) AS r
    FROM ch c JOIN w ON w.domain = c.domain AND w.decile = c.decile AND (w.k + {_H} <= c.k OR w.k >= c.k + {_H} + 1) AND abs(w.k - c.k) >= {2 * _H}),
pl AS (SELECT k, domain, j AS control FROM (SELECT *, dense_rank() OVER (ORDER BY k) AS b FROM ca WHERE n >= {_K} AND r <= {_K}) WHERE b <= {_NT})
"""
_SCORES = f"""
un AS (SELECT *, unnest([k, k + 1]) AS s FROM (
    SELECT DISTINCT k, domain, -1 AS src, h, k + h AS i FROM pl, range(1, {_H + 1}) t(h)
    UNION ALL SELECT k, domain, control, h, control + h - 1 FROM pl, range(1, {_H + 1}) t(h))),
sn AS (SELECT s, sym, sum(c) AS n FROM (SELECT DISTINCT s FROM un) JOIN mc ON mc.k < s GROUP BY ALL),
ss AS (SELECT s, sum(bytes) AS seen FROM (SELECT DISTINCT s FROM un) JOIN miv ON miv.k < s GROUP BY ALL),
pc AS (SELECT u.k, domain, src, h, s, sum(c * {S.mb("coalesce(n, 0) + coalesce(prior_n, 0)", "coalesce(seen, 0) + prior_total")})::BIGINT AS cost
    FROM un u JOIN mc ON mc.k = u.i LEFT JOIN sn USING (s, sym) LEFT JOIN ss USING (s) LEFT JOIN prior_sym USING (sym) CROSS JOIN prior_all GROUP BY ALL),
cu AS (SELECT k, domain, src, h, sum(sum(cost) FILTER (s = k)) OVER x AS pre, sum(sum(cost) FILTER (s > k)) OVER x AS post FROM pc GROUP BY k, domain, src, h WINDOW x AS (PARTITION BY k, src ORDER BY h)),
rec AS (SELECT k, domain, h, sum(pre) FILTER (src < 0) / 1e6 AS adj_pre, sum(post) FILTER (src < 0) / 1e6 AS adj_post, avg(pre) FILTER (src >= 0) / 1e6 AS ctrl_pre, avg(post) FILTER (src >= 0) / 1e6 AS ctrl_post FROM cu GROUP BY k, domain, h),
ga AS (SELECT *, adj_pre - adj_post AS g_adj, ctrl_pre - ctrl_post AS g_ctrl, (adj_pre - adj_post) - (ctrl_pre - ctrl_post) AS t FROM rec),
mn AS (SELECT * FROM ga WHERE h = {A.MAIN_H}),
ed AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n, least(10, count(*) OVER ()) AS nb FROM mn),
bk AS (SELECT len(list_filter(range(1, nb), lambda e: round_even(e * n / nb, 0) <= i)) AS b, sum(t) AS t, sum(adj_pre) AS pre FROM ed GROUP BY 1)
"""
_AGG = "count(*)::BIGINT AS n, round(CASE WHEN sum(adj_pre) = 0 THEN 0 ELSE 100 * sum(t) / sum(adj_pre) END, 6) AS t_pct, round(CASE WHEN sum(adj_pre) = 0 THEN 0 ELSE 100 * sum(g_adj) / sum(adj_pre) END, 6) AS g_adj_pct, round(CASE WHEN sum(g_adj) > 0 THEN sum(t) / sum(g_adj) END, 6) AS t_share, round(avg((t > 0)::INT), 6) AS positive_fraction, round(avg(t), 6) AS mean_t, round(median(t), 6) AS median_t FROM mn"
_ALL = (S.PRIOR, _MIX, _PLAN, _SCORES)
_BOOT = "nbk AS (SELECT count(*) AS nb FROM bk), dr AS (SELECT i, (('0x' || substr(md5('3:' || i || ':' || d), 1, 8))::BIGINT % nb) AS b FROM range(1000) r(i), nbk, range(10) q(d) WHERE d < nb), bs AS (SELECT i, 100 * sum(t) / sum(pre) AS x FROM dr JOIN bk USING (b) GROUP BY i), br AS (SELECT x, row_number() OVER (ORDER BY ROUND(x, 9), i) - 1 AS r FROM bs)"
_PERM = "pm AS (SELECT i, sum(CASE WHEN ('0x' || substr(md5('3:' || i || ':' || k), 1, 1))::INT % 2 = 1 THEN -q ELSE q END) AS x FROM range(1000) r(i), (SELECT k, ROUND(t * 1000000)::BIGINT AS q FROM mn) GROUP BY i), pv AS (SELECT (1 + sum((x >= (SELECT sum(ROUND(t * 1000000)::BIGINT) FROM mn))::INT)) / 1001 AS p FROM pm)"
_LOBO = "lb AS (SELECT min(100 * (a.t - b.t) / (a.pre - b.pre)) AS lobo FROM bk b, (SELECT sum(t) AS t, sum(pre) AS pre FROM bk) a)"
_CUT = f"""
tg AS (SELECT *, round_even({float(TOTAL)} * 1.0 / 4, 0)::BIGINT AS target FROM (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(LANGS))}) v("order", dataset)),
wh AS (SELECT lang AS dataset, hex(encode(string_agg(coalesce(text, ''), '' ORDER BY doc_id))) AS hx, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS size FROM documents GROUP BY 1),
by2 AS (SELECT dataset, target, pos, substr(hx, 2 * pos + 1, 2) AS h FROM (SELECT dataset, hx, target, unnest(range(greatest(0, target - 8210), target + 1)) AS pos FROM tg JOIN wh USING (dataset) WHERE target < size)),
c1 AS (SELECT dataset, max(pos) AS cut FROM by2 WHERE substr(h, 1, 1) NOT IN ('8', '9', 'A', 'B') GROUP BY 1),
c2 AS (SELECT c1.dataset, cut, max(pos + 1) FILTER (h = '0A' AND pos + 1 <= cut AND pos + 1 > cut - 8192) AS line FROM c1 JOIN by2 USING (dataset) GROUP BY ALL),
fin AS (SELECT "order", dataset, target, CASE WHEN target >= coalesce(size, 0) THEN coalesce(size, 0) ELSE coalesce(line, cut) END::BIGINT AS bytes FROM tg LEFT JOIN wh USING (dataset) LEFT JOIN c2 USING (dataset))
"""

ORACLE_SQL = {
    "mixed_stream_blocks": S.query(_CUT, select='SELECT "order"::INTEGER AS "order", dataset, target, bytes, (sum(bytes) OVER w - bytes)::BIGINT AS byte_start, (sum(bytes) OVER w)::BIGINT AS byte_end, round(bytes * 100.0::DOUBLE / sum(bytes) OVER (), 6) AS share_pct FROM fin WINDOW w AS (ORDER BY "order")'),
    "domain_of_interval": S.query(S.PRIOR, _MIX, select="SELECT * FROM miv"),
    "branch_domains": S.query(S.PRIOR, _MIX, 'nx AS (SELECT k, lead(bytes) OVER (ORDER BY k) AS nb FROM miv)', "cm AS (SELECT k, sum(nb) OVER (ORDER BY k) AS pos_at FROM nx WHERE nb IS NOT NULL)", select="SELECT 'mixed' AS run, coalesce(dataset, (SELECT max_by(dataset, byte_end) FROM bl)) AS domain, count(*)::BIGINT AS n, min(k) AS first, max(k) AS last FROM cm LEFT JOIN bl ON pos_at >= byte_start AND pos_at < byte_end GROUP BY 2"),
    "adjacency_plan": S.query(S.PRIOR, _MIX, _PLAN, select="SELECT * FROM pl"),
    "adjacency_scores": S.query(*_ALL, select="SELECT k, domain, h::INTEGER AS h, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("adj_pre", "adj_post", "ctrl_pre", "ctrl_post", "g_adj", "g_ctrl", "t")) + " FROM ga"),
    "adjacency_agg": S.query(*_ALL, select=f"SELECT domain, {_AGG} GROUP BY domain UNION ALL SELECT 'pooled', {_AGG}"),
    "adjacency_bootstrap": S.query(*_ALL, _BOOT, select="SELECT round(max(x) FILTER (r = 25), 6) AS lo, round(max(x) FILTER (r = 975), 6) AS hi FROM br"),
    "adjacency_permutation": S.query(*_ALL, _PERM, select="SELECT round(p, 6) AS p FROM pv"),
    "adjacency_null": S.query(*_ALL, _PERM.replace("range(1000)", "range(2000)"), select="SELECT i, round(x / 10000.0::DOUBLE / (SELECT sum(adj_pre) FROM mn), 6) AS t_pct FROM pm"),
    "adjacency_lobo": S.query(*_ALL, _LOBO, select="SELECT round(lobo, 6) AS lobo_min FROM lb"),
    "adjacency_verdict": S.query(*_ALL, _BOOT, _PERM, _LOBO, """x AS (SELECT (SELECT 100 * sum(t) / sum(adj_pre) FROM mn) AS tp, (SELECT 100 * sum(g_adj) / sum(adj_pre) FROM mn) AS gp, (SELECT CASE WHEN sum(g_adj) > 0 THEN sum(t) / sum(g_adj) END FROM mn) AS ts,
    (SELECT p FROM pv) AS p, (SELECT max(x) FILTER (r = 25) FROM br) AS lo, (SELECT lobo FROM lb) AS lobo, (SELECT bool_and(d > 0) FROM (SELECT sum(t) AS d FROM mn GROUP BY domain)) AS same),
y AS (SELECT *, concat_ws('; ', CASE WHEN NOT p < 0.05 THEN 'not significant' END, CASE WHEN NOT lo > 0 THEN 'interval includes zero' END, CASE WHEN NOT tp > 0 THEN 'not positive' END, CASE WHEN NOT gp > 0 THEN 'the update does not help what follows' END) AS weak,
    concat_ws('; ', CASE WHEN NOT same THEN 'direction differs between datasets' END, CASE WHEN NOT lobo > 0 THEN 'rests on one block' END) AS hard, NOT (tp >= 0.5 AND coalesce(ts >= 0.2, false)) AS small FROM x)""", select="SELECT CASE WHEN weak <> '' OR hard <> '' THEN 'FAIL' WHEN small THEN 'SIGNIFICANT-BUT-SMALL' ELSE 'PASS' END AS verdict, CASE WHEN weak <> '' THEN weak WHEN hard <> '' THEN hard WHEN small THEN 'below the material size' ELSE '' END AS reasons FROM y"),
}
