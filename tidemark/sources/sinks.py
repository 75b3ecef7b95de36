"""Sinks: rolling shards, byte slices, summaries, guarded output."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import RunConfig
from tidemark.functions import coder
from tidemark.operators.streams import segments


def roll(rows: DataFrame, limit: int, *, key: str, order: str, size: str) -> DataFrame:
    """Adds shard: a shard that holds `limit` bytes or more is full, so one may exceed it by a record.

    Rolls depend on earlier rolls: one pass over each key's sizes in order (two numbers a record).
    """
    kinds = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, held, out = 0, 0, []
        pdf = pdf.sort_values(order)
        for n in pdf[size]:
            if held >= limit:
                shard, held = shard + 1, 0
            held += n
            out.append(shard)
        return pdf.assign(shard=out)

    cols = [key, order, size]
    return rows.select(*cols).groupBy(key).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in cols) + ", shard long")


def slices(sizes: DataFrame, width: int) -> DataFrame:
    """Key columns, shard, bytes: exact slices of `width` bytes, at least one."""
    last = F.greatest(F.ceil(F.col("size") / width), F.lit(1)).cast("bigint") - 1
    cut = sizes.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return cut.withColumn("bytes", F.least(F.lit(width).cast("bigint"), F.col("size") - F.col("shard") * width)).drop("size")


def metrics_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", "true").csv(path)


def summary_csv(parts: list[DataFrame], path: str) -> None:
    """Rows with the union of all columns; missing values are blank."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out.write.option("header", "true").csv(path)


def boundary_csv(records: DataFrame, path: str) -> None:
    """Per boundary and horizon, with six decimals."""
    records.select(*(F.format_string("%.6f", c).alias(c) if t == "double" else F.col(c) for c, t in records.dtypes)).write.option("header", "true").csv(path)


def json_summary(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def guarded(rows: DataFrame, path: str, *, marker: str = "_tidemark", force: bool = False) -> None:
    """Writes Parquet and then the marker; a folder that holds files but no marker of an earlier run is refused unless forced."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at) and len(fs.listStatus(at)) and not fs.exists(jvm.org.apache.hadoop.fs.Path(path, marker)) and not force:
        raise FileExistsError(f"{path} holds files that no earlier run has marked as its own")
    rows.write.mode("overwrite").parquet(path)
    fs.create(jvm.org.apache.hadoop.fs.Path(path, marker)).close()


def write_archives(stream: DataFrame, config: RunConfig, path: str, *, block: int = 65_536) -> None:
    """A table of archives: stream, block, meta (JSON) and blob of each stretch of block bytes, coded on line."""
    settings = {"hash": config.settings_hash("online"), "interval": config.train_interval}
    meta = json.dumps(coder.archive_meta(config, "online", config.environment()), sort_keys=True)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data = b"".join(pdf.sort_values("start")["data"])
        chunks = [data[i : i + config.chunk_size] for i in range(0, len(data), config.chunk_size)]
        blob = coder.compress(chunks, interval=config.train_interval, online=True, settings=settings)
        return pd.DataFrame({"stream": pdf["stream"].iloc[:1], "block": pdf["unit"].iloc[:1], "meta": [meta], "blob": [blob]})

    segments(stream, block).groupBy("stream", "unit").applyInPandas(run, "stream string, block long, meta string, blob binary").write.parquet(path)


def read_archives(spark: SparkSession, path: str, config: RunConfig) -> DataFrame:
    """stream, block, data: archives decoded; one that was made otherwise than the configuration says is an error."""
    settings = {"hash": config.settings_hash("online"), "interval": config.train_interval}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for meta in pdf["meta"].unique():
                coder.check_meta(json.loads(meta), config, "online", config.environment())
            data = [coder.decompress(bytes(b), interval=config.train_interval, online=True, settings=settings) for b in pdf["blob"]]
            yield pdf[["stream", "block"]].assign(data=data)

    return spark.read.parquet(path).mapInPandas(run, "stream string, block long, data binary")
