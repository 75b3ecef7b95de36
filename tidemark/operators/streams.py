"""Byte streams: documents laid end to end, cut into chunks, counted by byte value."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a stream that one block of the two-level prefix sum holds at most.
BLOCK = 4096


def running_before(df: DataFrame, value: Column, *, keys: tuple[str, ...], order: str, out: str, ties: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """Adds the sum of value over earlier rows (by the integer column order, then ties) of the same keys.

    Sums of blocks of the order column first, so that no single task sorts a whole stream.
    Null keys are a key of their own; rows without an order come first, in one block.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_value", value)
    totals = blocked.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*(F.col(k).alias(f"_at_{k}") for k in (*keys, "_block")), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in (*keys, "_block")))
    joined = blocked.join(starts, same).withColumn(out, (F.col("_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).cast("bigint"))
    return joined.drop("_block", "_value", "_start", *(f"_at_{k}" for k in (*keys, "_block")))


def rows_of(docs: DataFrame, *, stream: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """stream, seq, data (UTF-8 bytes) of each row of docs; null text is empty."""
    return docs.select(F.col(stream).cast("string").alias("stream"), F.col(order).cast("bigint").alias("seq"), F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8").alias("data"))


def as_stream(docs: DataFrame, *, stream: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """stream, seq, data (UTF-8 bytes), start (byte offset in the stream), one row per row of docs; null text is empty.

    Rows without a stream are a stream of their own (null); of rows with one order value the
    lesser bytes come first; rows without an order value come first of all.
    """
    rows = rows_of(docs, stream=stream, order=order, text=text)
    return running_before(rows, F.octet_length("data").cast("bigint"), keys=("stream",), order="seq", out="start", ties=("data",))


def segments(stream: DataFrame, width: int) -> DataFrame:
    """stream, unit (number of the width-byte unit), start (byte offset), data: each row's bytes cut at unit borders."""
    size = F.octet_length("data")
    first, last = F.expr(f"start div {width}"), F.expr(f"(start + octet_length(data) - 1) div {width}")
    cut = stream.where(size > 0).withColumn("unit", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.lit(0).cast("bigint"), F.col("unit") * width - F.col("start"))
    hi = F.least(size.cast("bigint"), (F.col("unit") + 1) * width - F.col("start"))
    return cut.select("stream", "unit", (F.col("start") + lo).alias("start"), F.col("data").substr((lo + 1).cast("int"), (hi - lo).cast("int")).alias("data"))


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 4096):
            part = b.slice(lo, 4096)
            raw = part.column(2).cast(pa.large_binary())
            _, offs, data = raw.buffers()
            offs = np.frombuffer(offs, np.int64)[raw.offset : raw.offset + len(raw) + 1]
            row = np.repeat(np.arange(len(raw)), np.diff(offs))
            count = np.bincount(row * 256 + np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], minlength=256 * len(raw))
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at // 256)), part.column(1).take(pa.array(at // 256)), pa.array((at % 256).astype(np.int32)), pa.array(count[at])], ["stream", "unit", "sym", "c"])


def byte_counts(stream: DataFrame, width: int, out: str = "chunk") -> DataFrame:
    """stream, unit number, sym, c: how often each byte value occurs in each unit."""
    found = segments(stream, width).select("stream", "unit", "data").mapInArrow(_histogram, "stream string, unit long, sym int, c long")
    return found.groupBy("stream", F.col("unit").alias(out), "sym").agg(F.sum("c").alias("c"))
