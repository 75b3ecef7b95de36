"""Runs, labels, normalisation, ingest and what else surrounds the measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import run
from tidemark.config import RunConfig
from tidemark.functions import texts as T
from tidemark.operators import branch, ledger, mixing, streams
from tidemark.plans import coding, probes
from tidemark.plans import ledger as L
from tidemark.plans import sqltext as S
from tidemark.sources import ingest

BLOCKS = (("head", 0, 20_000), ("middle", 20_000, 60_000), ("tail", 60_000, 1 << 40))
WHOLE = 1 << 40
RUNS = (
    ("runs/a/result.json", '{"model": "m1", "lora_r": 8, "lr": 0.0}', '{"model": "old", "data": "d1", "chunk_size": 512}'),
    ("runs/b.json", '{"lora_r": 16}', '{"model": "m2", "data": "d2", "lr": 0.0003, "chunk_size": 2048}'),
    ("c.json", "{}", "{}"),
)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def run_text(spark, sf_dir):
    """Every source's stream, static and online: chunks with their payload in bits."""
    config = RunConfig(max_bytes=WHOLE)
    return run.chunk_table(streams.as_stream(_docs(spark, sf_dir)), config, coding.prior(spark, sf_dir))


def run_totals(spark, sf_dir):
    """Chunks, boundaries (where online coding ran) and rate of each run and mode."""
    config = RunConfig(max_bytes=WHOLE)
    t = run.totals(run.chunk_table(streams.as_stream(_docs(spark, sf_dir)), config, coding.prior(spark, sf_dir)))
    bounds = F.when(F.col("mode") == "online", F.greatest(F.expr(f"(n_chunks - 1) div {config.train_interval}"), F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    return t.select("run", "mode", "n_chunks", bounds.alias("n_boundaries"), "symbols", "payload_bytes", S.q6(F.col("rate")).alias("rate"), F.lit(run.symbol_name(config.modality)).alias("symbol"))


def _signatures(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(RUNS), "path string, config string, args string")
    return ledger.signature(rows)


def run_signature(spark, sf_dir):
    return _signatures(spark).select("run", "model", "data", "lora_r", "lr", "chunk_size")


def run_labels(spark, sf_dir):
    return _signatures(spark).select("run", ledger.rate_label(F.col("lr")).alias("rate"), ledger.run_label("model", "data", "lora_r", "chunk_size", "lr").alias("label"))


def pdf_normalised(spark, sf_dir):
    """How a source's documents spread over languages, as a distribution without zeros."""
    d = _docs(spark, sf_dir)
    grid = d.select("source").distinct().join(F.broadcast(d.select("lang").where("lang is not null").distinct()))  # sources x languages
    counts = grid.join(d.groupBy("source", "lang").agg(F.count("*").alias("n")), ["source", "lang"], "left")
    p = T.pdf_normalised(counts.withColumn("n", F.coalesce("n", F.lit(0))), "n", "source")
    return p.select("source", "lang", S.q6(F.col("p")).alias("p"))


def bitstrings(spark, sf_dir):
    """Lengths of documents as bits, padded to whole bytes, and back."""
    d = _docs(spark, sf_dir).where("n_chars is not null").select("doc_id", T.padded_bits(F.bin("n_chars")).alias("bits"))
    d = d.withColumn("hex", F.hex(T.bits_to_bytes(F.col("bits"))))
    return d.select("doc_id", "bits", "hex", T.bytes_to_bits(F.unhex("hex")).alias("again"))


def branch_domain_actions(spark, sf_dir):
    """By part of the stream: how often each rate was the best candidate."""
    cands = coding._candidates(spark, sf_dir)
    sizes = cands.where("pos = 0").select("run", "phase", "next_bytes")
    blocks = spark.createDataFrame(list(BLOCKS), "dataset string, byte_start long, byte_end long")
    placed = branch.with_domain(sizes, blocks).select("run", "phase", "domain")
    n = branch.actions(cands).join(placed, ["run", "phase"]).groupBy("domain", "lr").agg(F.count("*").alias("n"))
    return n.select("domain", "lr", "n", S.q6(F.col("n") / F.sum("n").over(Window.partitionBy("domain"))).alias("share"))  # a row for each part and rate


def branch_percent(spark, sf_dir):
    """Mean gain of each rate in percent of what skipping the update costs."""
    cands = coding._candidates(spark, sf_dir)
    t = branch.totals(cands)
    n = cands.groupBy("run", "pos").agg(F.count("*").alias("n"))
    skip = t.where("lr = 0").select("run", F.col("total").alias("_skip"))
    out = t.join(n, ["run", "pos"]).join(skip, "run")
    return out.select("run", "lr", S.q6(branch.percent(F.col("mean_g"), F.col("n"), F.col("_skip"))).alias("gain_pct"))


def context_table(spark, sf_dir):
    """Cells of a context square side by side, '-' where one was not run (every fifth dataset lacks one)."""
    cells = L._cells(spark, sf_dir).where("not (cast(dataset as bigint) % 5 = 0 and ctx = 1 and mode = 'online')")
    name = F.concat(F.lit("ctx"), F.col("ctx").cast("string"), F.lit("_"), F.col("mode"))
    wide = cells.withColumn("cell", name).groupBy("dataset").pivot("cell", ["ctx0_static", "ctx0_online", "ctx1_static", "ctx1_online"]).agg(F.round(F.first("bits")).cast("bigint").cast("string"))
    return wide.select("dataset", *(F.coalesce(c, F.lit("-")).alias(c) for c in wide.columns[1:]))


def normalised_text(spark, sf_dir):
    """A normaliser that is not idempotent, applied once more where that changes the text, but no more."""
    shorten = lambda c: F.replace(c, F.lit("ee"), F.lit("e"))
    d = T.normalised(_docs(spark, sf_dir), "text", shorten)
    return d.select("doc_id", F.md5("normalised").alias("md5"), "passes")


def normalise_pending(spark, sf_dir):
    """Sources without a summary of an earlier pass; with force all of them."""
    d = _docs(spark, sf_dir).select(F.col("source").alias("dataset")).where("source is not null").distinct()
    done = d.where("dataset < 'src2'")
    return T.pending(d, done).select("dataset", F.lit(False).alias("forced")).unionByName(T.pending(d, done, force=True).select("dataset", F.lit(True).alias("forced")))


def normalise_changes(spark, sf_dir):
    """By language the eight commonest replacements of upper-case letters."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return T.top_substitutions(_docs(spark, sf_dir).select("lang", "text", low.alias("low")), "text", "low", by="lang", top=8)


def mixed_stream_built(spark, sf_dir):
    """The mixed stream's pieces: exact prefixes of their sources, valid text, and the switches between domains."""
    plan = mixing.targets(spark.createDataFrame([(i, x, 1.0) for i, x in enumerate(probes.LANGS)], "order int, dataset string, weight double"), probes.TOTAL)
    each = streams.as_stream(probes._docs(spark, sf_dir), stream="lang")
    return mixing.verified(mixing.built(each, mixing.ranges(mixing.safe_cuts(each, plan))))


def sweep_run(spark, sf_dir):
    """The grid run row by row: one is done, some fail, some end without a result, which is a failure too."""

    def one(row: dict) -> dict:
        if row["lora_r"] == 16 and row["lr"] == 4.0:
            raise RuntimeError("diverged")
        return {} if row["lora_r"] == 16 and row["lr"] == 0.25 else {"value": row["lora_r"] * row["lr"]}

    grid = ledger.expand(spark, L.GRID)
    done = grid.where("lora_r = 8 and lr = 1").select("run_id")
    return ledger.run_manifest(grid, one, done=done)


def ingest_status(spark, sf_dir):
    catalogue = {n: ingest.DataSet(f"{sf_dir}/{n}.parquet", "parquet") for n in ("documents", "pages", "labels")} | {"gone": ingest.DataSet(f"{sf_dir}/gone.parquet", "parquet"), "odd": ingest.DataSet(f"{sf_dir}/pages.parquet", "tape")}
    return ingest.ingest(spark, catalogue, ["documents", "nosuch", "labels", "gone", "odd", "pages"], done={"labels"}).select("name", "kind", "status", "rows")


def ingest_overview(spark, sf_dir):
    text = ingest_status(spark, sf_dir)
    pages = ingest.ingest(spark, {"pages": ingest.DataSet(f"{sf_dir}/pages.parquet", "parquet")}, ["pages"])
    return ingest.overview({"text": text, "web": pages})


QUERIES = {
    f.__name__: f
    for f in (
        run_text, run_totals, run_signature, run_labels, pdf_normalised, bitstrings, branch_domain_actions, branch_percent, context_table,
        normalised_text, normalise_pending, normalise_changes, mixed_stream_built, sweep_run, ingest_status, ingest_overview,
    )
}

_RUN = (S.COUNTS, coding._ST, S.PRIOR, "cc AS (" + coding._CHUNK.format(cols=f"{coding._STATIC}, {coding._ONLINE_P}", join=coding._PJ) + ")", "rt AS (SELECT stream AS run, 'static' AS mode, chunk, length, (8 * ceil(static / 8000000.0))::BIGINT AS chunk_bits FROM cc UNION ALL SELECT stream, 'online', chunk, length, (8 * ceil(online / 8000000.0))::BIGINT FROM cc)")
_DOM = "dm AS (SELECT run, phase, CASE WHEN pos_at < 20000 THEN 'head' WHEN pos_at < 60000 THEN 'middle' ELSE 'tail' END AS domain FROM (SELECT run, phase, sum(next_bytes) OVER (PARTITION BY run ORDER BY phase) AS pos_at FROM ahead))"
_ING = "(VALUES ('documents', 'parquet', 'ok', (SELECT count(*) FROM documents)), ('nosuch', NULL, 'failed', NULL), ('labels', 'parquet', 'skipped', NULL), ('gone', 'parquet', 'failed', NULL), ('odd', 'tape', 'failed', NULL), ('pages', 'parquet', 'ok', (SELECT count(*) FROM pages))) t(name, kind, status, rows)"

ORACLE_SQL = {
    "run_text": S.query(*_RUN, select="SELECT * FROM rt"),
    "run_totals": S.query(*_RUN, select="SELECT run, mode, count(*)::BIGINT AS n_chunks, CASE WHEN mode = 'online' THEN greatest((count(*) - 1) // 4, 0) ELSE 0 END::BIGINT AS n_boundaries, sum(length)::BIGINT AS symbols, (sum(chunk_bits) // 8)::BIGINT AS payload_bytes, round(sum(chunk_bits) / greatest(sum(length), 1)::DOUBLE, 6) AS rate, 'byte' AS symbol FROM rt GROUP BY run, mode"),
    "run_signature": "SELECT run, model, data, r::INTEGER AS lora_r, lr::DOUBLE AS lr, c::INTEGER AS chunk_size FROM (VALUES ('a', 'm1', 'd1', 8, 0.0, 512), ('b', 'm2', 'd2', 16, 0.0003, 2048), ('c', NULL, NULL, NULL, NULL, NULL)) t(run, model, data, r, lr, c)",
    "run_labels": "SELECT * FROM (VALUES ('a', 'skip', 'm1 d1 r8 c512 lr skip'), ('b', '0.0003', 'm2 d2 r16 c2048 lr 0.0003'), ('c', NULL, '')) t(run, rate, label)",
    "pdf_normalised": S.query("g AS (SELECT s.source, l.lang FROM (SELECT DISTINCT source FROM documents) s, (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) l)", "c AS (SELECT g.source, g.lang, count(d.doc_id)::DOUBLE AS n FROM g LEFT JOIN documents d ON d.source = g.source AND d.lang = g.lang GROUP BY ALL)", "q AS (SELECT *, greatest(n / sum(n) OVER (PARTITION BY source), 1e-30) AS w FROM c)", select="SELECT source, lang, round(w / sum(w) OVER (PARTITION BY source), 6) AS p FROM q"),
    "bitstrings": "SELECT doc_id, b AS bits, upper(lpad(to_hex(n_chars), (length(b) // 4)::INTEGER, '0')) AS hex, b AS again FROM (SELECT doc_id, n_chars, lpad(bin(n_chars), (8 * ((length(bin(n_chars)) + 7) // 8))::INTEGER, '0') AS b FROM documents WHERE n_chars IS NOT NULL)",
    "branch_domain_actions": S.query(*coding._BR, _DOM, select="SELECT domain, best_lr AS lr, count(*)::BIGINT AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY domain), 6) AS share FROM best JOIN dm USING (run, phase) GROUP BY domain, best_lr"),
    "branch_percent": S.query(*coding._BR, select="SELECT c.run, c.lr, round(avg(z.next_bits - c.next_bits) * count(*) / sum(z.next_bits) * 100, 6) AS gain_pct FROM cand c JOIN cand z ON z.run = c.run AND z.phase = c.phase AND z.lr = 0 GROUP BY c.run, c.lr"),
    "context_table": "WITH x AS (SELECT dataset, 'ctx' || ctx || '_' || mode AS cell, ROUND(bits)::BIGINT::VARCHAR AS b FROM (" + L.ORACLE_SQL["context_cells"] + ") WHERE NOT (dataset::BIGINT % 5 = 0 AND ctx = 1 AND mode = 'online')) SELECT dataset, " + ", ".join(f"coalesce(max(b) FILTER (cell = '{c}'), '-') AS {c}" for c in ("ctx0_static", "ctx0_online", "ctx1_static", "ctx1_online")) + " FROM x GROUP BY dataset",
    "normalised_text": "WITH a AS (SELECT doc_id, text, replace(text, 'ee', 'e') AS y FROM documents), b AS (SELECT *, replace(y, 'ee', 'e') AS z FROM a) SELECT doc_id, md5(z) AS md5, CASE WHEN y = z THEN 1 ELSE 2 END::INTEGER AS passes FROM b",
    "normalise_pending": "SELECT DISTINCT source AS dataset, false AS forced FROM documents WHERE source >= 'src2' UNION ALL SELECT DISTINCT source, true FROM documents WHERE source IS NOT NULL",
    "normalise_changes": "WITH p AS (SELECT lang, unnest(string_split(text, '')) AS old, unnest(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')) AS new FROM documents), c AS (SELECT lang, old, new, count(*)::BIGINT AS n FROM p WHERE old <> new GROUP BY ALL) SELECT lang, old, new, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, old, new) AS r FROM c) WHERE r <= 8",
    "mixed_stream_built": S.query(probes._CUT, "pl AS (SELECT lang AS dataset, octet_length(encode(coalesce(text, ''))) AS len, sum(octet_length(encode(coalesce(text, '')))) OVER (PARTITION BY lang ORDER BY doc_id) - octet_length(encode(coalesce(text, ''))) AS start, hex(encode(coalesce(text, ''))) AS hx FROM documents)", "ps AS (SELECT f.\"order\", f.dataset, f.bytes, start, md5(substr(hx, 1, (2 * least(len, f.bytes - start))::BIGINT)) AS h FROM fin f JOIN pl USING (dataset) WHERE start < f.bytes AND len > 0)", select="SELECT \"order\"::INTEGER AS \"order\", dataset, bytes, count(*)::BIGINT AS pieces, md5(string_agg(h, '' ORDER BY start)) AS md5, true AS exact, true AS valid, (SELECT count(*) - 1 FROM fin WHERE bytes > 0)::BIGINT AS switches FROM ps GROUP BY \"order\", dataset, bytes"),
    "sweep_run": "SELECT run_id, CASE WHEN lora_r = 16 AND lr <> 1 THEN 'failed' ELSE 'finished' END AS status, CASE WHEN NOT (lora_r = 16 AND lr <> 1) THEN (lora_r * lr)::DOUBLE END AS value FROM (" + L.ORACLE_SQL["sweep_grid"] + ") WHERE NOT (lora_r = 8 AND lr = 1)",
    "ingest_status": f"SELECT name, kind, status, rows::BIGINT AS rows FROM {_ING}",
    "ingest_overview": f"SELECT 'text' AS modality, status, count(*)::BIGINT AS n FROM {_ING} GROUP BY status UNION ALL SELECT 'web', 'ok', 1",
}
