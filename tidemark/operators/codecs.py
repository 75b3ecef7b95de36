"""Lossless round trips and codec baselines, one group of bytes at a time."""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import RunConfig
from tidemark.functions import coder, lanes
from tidemark.operators.streams import segments

CODECS = ("zlib", "lzma", "zstd", "brotli", "cmix", "png", "webp", "jxl", "flac", "optimfrog")
#: Bytes of blocks that are coded side by side.
AT_ONCE = 1 << 22


def round_trip(stream: DataFrame, config: RunConfig, *, block: int = 65_536) -> DataFrame:
    """stream, block, bytes, archive_bytes, payload_bytes, equal: each stretch of block bytes coded and decoded anew.

    A long stream is coded in independent stretches, so that no task holds a whole one.
    """
    settings = {"hash": config.settings_hash("online"), "interval": config.train_interval}
    chunk, interval = config.chunk_size, config.train_interval

    def measure(blocks: list[tuple]) -> pa.RecordBatch:
        """Blocks (stream, number, bytes) coded in lanes, framed, parsed and decoded.

        A state follows from the bytes before it, so while what is decoded is equal, the decoder's states are the coder's.
        """
        raw = [d for _, _, d in blocks]
        cut = [(i, j, d[at : at + chunk]) for i, d in enumerate(raw) for j, at in enumerate(range(0, len(d), chunk))]
        size = np.array([len(c) for *_, c in cut])
        by = np.argsort(-size, kind="stable")
        rows = np.frombuffer(b"".join(c.ljust(chunk, b"\0") for *_, c in cut), np.uint8).reshape(-1, chunk)[by, : size.max()]
        below, state = lanes.tables(rows, size[by], np.array([i for i, *_ in cut])[by], np.array([j for _, j, _ in cut])[by], interval)
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        coded = lanes.encode(rows, size[by], below, state)
        ends = np.cumsum([-(-len(d) // chunk) for d in raw]).tolist()
        packed = [coder.build(settings, len(d), size[lo:hi].tolist(), [coded[k] for k in back[lo:hi]]) for d, lo, hi in zip(raw, [0, *ends[:-1]], ends, strict=True)]
        parsed = [coder.parse(p) for p in packed]
        payloads, lengths = [x for p in parsed for x in p[4]], np.array([n for p in parsed for n in p[3]])
        again = lanes.decode([payloads[k] for k in by], lengths[by], below, state)
        same = ((again == rows) | (np.arange(rows.shape[1]) >= size[by][:, None])).all(1)[back]
        equal = [bool(same[lo:hi].all()) and p[2] == len(d) and p[0] == settings for d, p, lo, hi in zip(raw, parsed, [0, *ends[:-1]], ends, strict=True)]
        cols = [pa.array([s for s, *_ in blocks], pa.string()), pa.array([n for _, n, _ in blocks], pa.int64()), *(pa.array(v, pa.int64()) for v in ([len(d) for d in raw], [len(p) for p in packed], [sum(map(len, p[4])) for p in parsed])), pa.array(equal, pa.bool_())]
        return pa.RecordBatch.from_arrays(cols, ["stream", "block", "bytes", "archive_bytes", "payload_bytes", "equal"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, blocks, held = None, [], [], 0
        for b in batches:
            for name, unit, data in zip(*b.columns, strict=True):
                now = name.as_py(), unit.as_py()
                if now != key and parts:
                    blocks.append((*key, b"".join(parts)))
                    held, parts = held + len(blocks[-1][2]), []
                    if held >= AT_ONCE:
                        yield measure(blocks)
                        blocks, held = [], 0
                key = now
                parts.append(data.as_py())
        if parts:
            blocks.append((*key, b"".join(parts)))
        if blocks:
            yield measure(blocks)

    tasks = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = segments(stream, block).repartition(tasks, "stream", "unit").sortWithinPartitions("stream", "unit", "start").select("stream", "unit", "data")
    return rows.mapInArrow(run, "stream string, block long, bytes long, archive_bytes long, payload_bytes long, equal boolean")


@lru_cache(maxsize=1)
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=19)


def _absent() -> set[str]:
    """Codecs that are not installed; each search for a missing module costs more than a small piece."""
    out = set()
    for name in CODECS:
        with suppress(Exception):
            out |= {name} if size(name, b"x") is None else set()
    return out


def size(name: str, raw: bytes) -> int | None:
    """Bytes that a codec makes of raw; None where it is not installed."""
    if name == "zlib":
        return len(zlib.compress(raw, 9))
    if name == "lzma":
        # the preset's 64 MiB for a dictionary are cleared anew for each value; with room for the value, matches and sizes are the same
        room = min(max(1 << 16, 1 << (8 * len(raw)).bit_length()), 1 << 26)
        return len(lzma.compress(raw, format=lzma.FORMAT_ALONE, filters=[{"id": lzma.FILTER_LZMA1, "preset": 9 | lzma.PRESET_EXTREME, "dict_size": room}]))
    if name == "zstd":
        try:
            return len(_zstd().compress(raw))
        except ImportError:
            return None
    if name == "brotli":
        try:
            import brotli
        except ImportError:
            return None
        return len(brotli.compress(raw, quality=11))
    return None


def baselines(items: DataFrame, key: str, data: str = "data", *, piece: int | None = None) -> DataFrame:
    """key, codec, status, original, compressed, ratio, rate_pct, bpb: of whole values, or of pieces of that many bytes, summed.

    Codecs that are not installed are reported as skipped; an error of one does not stop the others.
    """

    def run(batches):
        absent = _absent()
        for pdf in batches:
            rows = []
            for k, raw in zip(pdf["k"], pdf["d"], strict=True):
                raw = bytes(raw)
                pieces = [raw[i : i + piece] for i in range(0, len(raw), piece)] if piece else [raw]
                for name in CODECS:
                    try:
                        sizes = [None if name in absent else size(name, p) for p in pieces]
                        rows.append((k, name, "skipped", len(raw), None) if None in sizes else (k, name, "ok", len(raw), sum(sizes)))
                    except Exception as e:  # one codec's error is a row, not the job's
                        rows.append((k, name, f"error: {type(e).__name__}", len(raw), None))
            yield pd.DataFrame(rows, columns=["k", "codec", "status", "original", "compressed"]).astype({"compressed": "Int64"})

    # rows are dealt anew: a file of one row group would be one task's
    dealt = items.select(F.col(key).alias("k"), F.col(data).alias("d")).repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = dealt.mapInPandas(run, f"k {dict(items.dtypes)[key]}, codec string, status string, original long, compressed long")
    return with_rates(out.withColumnRenamed("k", key))


def with_rates(sizes: DataFrame) -> DataFrame:
    """Adds ratio, rate in percent (100 / ratio) and bits per byte (0.08 of that)."""
    ratio = F.col("original") / F.greatest(F.col("compressed"), F.lit(1))
    return sizes.withColumn("ratio", F.when(F.col("compressed").isNotNull(), ratio)).withColumn("rate_pct", 100 / F.col("ratio")).withColumn("bpb", F.col("rate_pct") * 0.08)


def with_total(sizes: DataFrame, key: str) -> DataFrame:
    """Rows by key and codec, and a row for each codec over all keys (null key)."""
    per = sizes.where("status = 'ok'").rollup("codec", key).agg(F.sum("original").alias("original"), F.sum("compressed").alias("compressed")).where("codec is not null")
    return with_rates(per)
