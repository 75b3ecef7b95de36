"""Experiment ledger: grids, runs, summaries; evaluation totals; collapse points."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FLOOR = -40.0


def validate(spec: dict) -> None:
    """All problems of a grid specification at once."""
    problems = []
    if not spec.get("modality"):
        problems.append("modality is missing")
    grid, fixed = spec.get("grid") or {}, spec.get("fixed") or {}
    if not grid:
        problems.append("the grid is empty")
    problems += [f"{k}: a grid value must be a list with entries" for k, v in grid.items() if not isinstance(v, list) or not v]
    problems += [f"{k}: both fixed and in the grid" for k in sorted(grid.keys() & fixed.keys())]
    if problems:
        raise ValueError("; ".join(problems))


def expand(spark: SparkSession, spec: dict) -> DataFrame:
    """run_id (four digits) and one column for each setting: the product over sorted grid keys, the last varying fastest."""
    validate(spec)
    keys = sorted(spec["grid"])
    parts = [spark.createDataFrame([(i, v) for i, v in enumerate(spec["grid"][k])], f"_{k} int, {k} {_kind(spec['grid'][k])}") for k in keys]
    out = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # grids are small
    out = out.withColumn("run_id", F.lpad((F.row_number().over(Window.orderBy(*(f"_{k}" for k in keys))) - 1).cast("string"), 4, "0")).drop(*(f"_{k}" for k in keys))
    for k, v in (spec.get("fixed") or {}).items():
        out = out.withColumn(k, F.lit(v))
    if "lora_r" in out.columns and "lora_alpha" not in out.columns:
        out = out.withColumn("lora_alpha", F.col("lora_r") * 2)
    return out.select("run_id", *sorted(c for c in out.columns if c != "run_id"))


def _kind(values: list) -> str:
    if all(isinstance(v, bool) for v in values):
        return "boolean"
    if all(isinstance(v, int) for v in values):
        return "bigint"
    return "double" if all(isinstance(v, (int, float)) for v in values) else "string"


def collect(configs: DataFrame, status: DataFrame, results: DataFrame) -> DataFrame:
    """Configuration with status ('missing' without one) and rates; delta in percent of the static rate."""
    rows = configs.join(status, "run_id", "left").join(results, "run_id", "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    return rows.withColumn("delta_pct", F.when(F.col("static_rate") != 0, (F.col("static_rate") - F.col("online_rate")) / F.col("static_rate") * 100))


def outcome(return_code: Column, has_metrics: Column) -> Column:
    """done, or failed: also when a run ended well but left no metrics."""
    return F.when((return_code == 0) & has_metrics, "done").otherwise("failed")


def pending(configs: DataFrame, status: DataFrame) -> DataFrame:
    return configs.join(status.where("status = 'done'"), "run_id", "left_anti")


def best(summary: DataFrame) -> DataFrame:
    """The finished run with the lowest online rate, ties by run_id."""
    return summary.where("status = 'done' and online_rate is not null").orderBy("online_rate", "run_id").limit(1)


def best_config(summary: DataFrame, settings: list[str]) -> DataFrame:
    return best(summary).select(*settings, F.lit("both").alias("mode"), F.lit(False).alias("no_decompress"))


def varied(configs: DataFrame) -> DataFrame:
    """setting, n: settings with more than one distinct value, as text."""
    names = [c for c in configs.columns if c != "run_id"]
    one = configs.agg(*(F.countDistinct(F.col(c).cast("string")).alias(c) for c in names))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("setting"), F.col(c).alias("n")) for c in names))).alias("x")).select("x.*").where("n > 1")


def listing(summary: DataFrame, group: str) -> DataFrame:
    return summary.agg(F.count("*").alias("runs"), F.sum((F.col("status") == "done").cast("bigint")).alias("done"), F.min(F.when(F.col("status") == "done", F.col("online_rate"))).alias("min_rate")).withColumn("group_name", F.lit(group))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Latest row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return old.unionByName(new, allowMissingColumns=True).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def per_document(chunks: DataFrame, key: str) -> DataFrame:
    """key, original_bytes, compressed_bytes, bpb, ratio, roundtrip_ok (1 if all are 1, -1 if all are -1, else 0)."""
    ok = F.when(F.min("roundtrip_ok") == F.max("roundtrip_ok"), F.when(F.min("roundtrip_ok").isin(1, -1), F.min("roundtrip_ok")).otherwise(0)).otherwise(0)
    o, c = F.sum("original_bytes"), F.sum("compressed_bytes")
    return chunks.groupBy(key).agg(o.alias("original_bytes"), c.alias("compressed_bytes"), (8 * c / F.greatest(o, F.lit(1))).alias("bpb"), (o / F.greatest(c, F.lit(1))).alias("ratio"), ok.alias("roundtrip_ok"))


def totals(samples: DataFrame) -> DataFrame:
    """n, sums, ratio of sums, and round trips among those that were checked."""
    o, c = F.sum("original_bytes"), F.sum("compressed_bytes")
    return samples.agg(F.count("*").alias("n"), o.alias("original_bytes"), c.alias("compressed_bytes"), (8 * c / F.greatest(o, F.lit(1))).alias("bpb"), (o / F.greatest(c, F.lit(1))).alias("ratio"), F.sum(F.when(F.col("roundtrip_ok") >= 0, 1).otherwise(0)).cast("bigint").alias("checked"), F.sum(F.when(F.col("roundtrip_ok") == 1, 1).otherwise(0)).cast("bigint").alias("passed"))


def collapse_series(points: DataFrame, metric: str, floor: float = FLOOR) -> DataFrame:
    """Adds place (by mean_din within dataset and knob), diverged (delta below the floor: not in the curve) and shown (clamped)."""
    w = Window.partitionBy("dataset", "knob").orderBy("mean_din", "knob_value")
    out = points.withColumn("diverged", F.coalesce(F.col("delta_pct") < floor, F.lit(False)))
    place = F.when(~F.col("diverged"), F.sum((~F.col("diverged")).cast("int")).over(w))
    return out.withColumns({"place": place, "shown": F.when(F.col("diverged"), F.greatest(F.col(metric), F.lit(floor))).otherwise(F.col(metric))})


def signature(runs: DataFrame) -> DataFrame:
    """Adds run (the file's stem, or its folder where it is result.json), model, data, lora_r, lr, chunk_size: of the configuration, else of the arguments."""
    stem, folder = F.regexp_extract("path", r"([^/]+)\.json$", 1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    of = lambda k, t: F.coalesce(F.get_json_object("config", f"$.{k}"), F.get_json_object("args", f"$.{k}")).cast(t)
    kinds = {"model": "string", "data": "string", "lora_r": "int", "lr": "double", "chunk_size": "int"}
    return runs.withColumns({"run": F.when(stem == "result", folder).otherwise(stem)} | {k: of(k, t) for k, t in kinds.items()})


def rate_label(lr: Column) -> Column:
    """A rate as it is shown: 0 is an update that is skipped."""
    return F.when(lr == 0, F.lit("skip")).when(lr.isNotNull(), F.regexp_replace(F.format_string("%.6f", lr), "0+$", ""))


def run_label(model: str, data: str, rank: str, chunk: str, lr: str) -> Column:
    """Model, data, rank, chunk and rate of a run, without what is not known."""
    part = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(name), F.col(c).cast("string")))
    rate = F.when(F.col(lr).isNotNull(), F.concat(F.lit("lr "), rate_label(F.col(lr))))
    return F.concat_ws(" ", F.col(model), F.col(data), part("r", rank), part("c", chunk), rate)


def run_manifest(grid: DataFrame, one: Callable[[dict], dict], *, done: DataFrame | None = None) -> DataFrame:
    """run_id, status, value: `one` called with each row that is not done; an error, or an end without a value, is a failure of that row alone."""
    rows = grid if done is None else grid.join(done.select("run_id"), "run_id", "left_anti")

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    value = one(row).get("value")
                except Exception:  # a row's error is its status
                    value = None
                out.append((row["run_id"], "failed" if value is None else "finished", value))
            yield pd.DataFrame(out, columns=["run_id", "status", "value"])

    return rows.mapInPandas(run, "run_id string, status string, value double")
