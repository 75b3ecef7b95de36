"""One run from a configuration to its table of chunks: python -m tidemark.run CONFIG.json --data DIR --out DIR."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import RunConfig
from tidemark.operators import branch, chunking, costs, gk, streams

#: With the default rate and epochs an update adds one count for each byte.
UNIT_RATE, UNIT_EPOCHS = 5e-5, 3


def schedule(config: RunConfig) -> costs.Schedule:
    """Chunks, intervals and how strongly an update counts: by its rate and epochs."""
    strength = config.lr / UNIT_RATE * config.epochs_per_train / UNIT_EPOCHS
    return costs.Schedule(chunk=config.chunk_size, interval=config.train_interval, strength=strength, all_seen=config.train_on_all)


def chunk_table(stream: DataFrame, config: RunConfig, prior: DataFrame | None = None) -> DataFrame:
    """run, mode, chunk, length, chunk_bits: payload of each chunk in whole bytes, for each mode that the configuration asks for.

    Of each stream at most max_bytes are coded. A chunk's bits are 8 times the bytes of its payload; headers belong to no chunk.
    """
    per = costs.chunk_costs(chunking.prefix_cap(stream, config.max_bytes), schedule(config), prior)
    modes = ("static", "online") if config.mode == "both" else (config.mode,)
    payload = lambda c: (8 * F.ceil(F.col(c) / (8 * costs.UNIT))).cast("bigint")
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), payload(m).alias("chunk_bits")) for m in modes)))
    return per.select(F.col("stream").alias("run"), "chunk", "length", rows.alias("r")).select("run", "r.mode", "chunk", "length", "r.chunk_bits")


def boundary_table(stream: DataFrame, config: RunConfig, prior: DataFrame | None = None) -> DataFrame:
    """What the configured probe records at each boundary: transfer or candidates of branching; boundaries exist only where online coding ran."""
    if config.mode == "static":
        raise ValueError("a static run has no boundaries")
    kept = chunking.prefix_cap(stream, config.max_bytes)
    if config.branch_lrs:
        rates = tuple(x / UNIT_RATE * config.epochs_per_train / UNIT_EPOCHS for x in config.branch_lrs)
        return branch.records(kept, rates, schedule(config))
    if config.measure_gk:
        return gk.records(costs.interval_costs(kept, schedule(config), prior))
    raise ValueError("the configuration asks for no probe of boundaries")


def totals(chunks: DataFrame) -> DataFrame:
    """run, mode, n_chunks, n_boundaries (0 unless online), symbols, payload_bytes, rate in bits per symbol."""
    out = chunks.groupBy("run", "mode").agg(F.count("*").alias("n_chunks"), F.sum("length").alias("symbols"), (F.sum("chunk_bits") / 8).cast("bigint").alias("payload_bytes"))
    return out.withColumn("rate", 8 * F.col("payload_bytes") / F.greatest("symbols", F.lit(1)))


def symbol_name(modality: str) -> str:
    """What a rate is counted by."""
    return {"text": "byte", "image": "subpixel", "audio": "sample"}[modality]


def main(argv: list[str] | None = None) -> int:
    """Exit code 0 when the run's table was written, 2 for a bad configuration, 1 for any other error."""
    p = argparse.ArgumentParser(prog="tidemark.run")
    p.add_argument("config")
    p.add_argument("--data", required=True, help="Parquet with stream, order and text columns")
    p.add_argument("--out", required=True)
    p.add_argument("--stream", default="source")
    p.add_argument("--order", default="doc_id")
    a = p.parse_args(argv)
    try:
        config = RunConfig.load(Path(a.config).read_text())
    except (OSError, ValueError) as e:
        print(f"configuration: {e}", file=sys.stderr)
        return 2
    try:
        spark = SparkSession.builder.getOrCreate()
        stream = streams.as_stream(spark.read.parquet(a.data), stream=a.stream, order=a.order)
        chunk_table(stream, config).write.mode("errorifexists").parquet(a.out)
    except Exception as e:  # the command's one place where an error becomes an exit code
        print(f"run: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
