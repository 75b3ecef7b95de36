"""Streaming queries over `events`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.streaming import intervals


def interval_stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the stream reader takes folders or globs
    return intervals.run_available(spark, f"{sf_dir}/events.parquet*", f"events_{uuid.uuid4().hex}")


def interval_batch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.windowed(spark.read.parquet(f"{sf_dir}/events.parquet"))


QUERIES = {f.__name__: f for f in (interval_stream_events, interval_batch_events)}

_SQL = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n, sum(round(value * 1000)::BIGINT)::BIGINT AS total FROM events GROUP BY ALL"
ORACLE_SQL = {"interval_stream_events": _SQL, "interval_batch_events": _SQL}
