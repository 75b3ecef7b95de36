"""Images as patches and sound as clips: media cut into blobs that stand alone, and put together again.

An image is (sample, width, height, pixels): rows of RGB bytes, top row first.  A sound is
(sample, rate, pcm): one channel of floats in -1 to 1.  A blob is a whole file of its own, a
24-bit BMP of one patch or a WAV of one stretch, so that a coder sees one format throughout.
Blobs of a sample are numbered from 0; a medium is put together from the blobs of one sample,
which are as large as that sample.  A null or empty medium has no blobs.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.coder import wav

BMP_HEADER, WAV_HEADER = 54, 44
RATE = 8_000

Cut = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def decode_payload(spec: Column) -> Column:
    """Bytes of a payload given as a struct of (bytes, hex, values): the first that is not null; numbers are bytes by value modulo 256."""
    digits = F.transform(spec["values"], lambda v: F.lpad(F.hex(F.pmod(v, F.lit(256)).cast("bigint")), 2, "0"))
    return F.coalesce(spec["bytes"], F.unhex(spec["hex"]), F.unhex(F.array_join(digits, "")))


def load_payloads(rows: DataFrame, path: str) -> DataFrame:
    """Adds data: the bytes of the file that the column names, read by Spark; null where there is none."""
    files = rows.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(rows.select(path).where(F.col(path).isNotNull()).first()[0].rsplit("/", 1)[0]) if not rows.where(F.col(path).isNotNull()).isEmpty() else None
    if files is None:
        return rows.withColumn("data", F.lit(None).cast("binary"))
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    return rows.join(files.select(name(F.col("path")).alias("_name"), F.col("content").alias("data")), name(F.col(path)) == F.col("_name"), "left").drop("_name")


def pcm16(x: Column) -> Column:
    """A sample of -1 to 1 as a 16-bit integer: scaled by 32768, clipped, fraction cut off."""
    return F.greatest(F.least(x * 32768, F.lit(32767.0)), F.lit(-32768.0)).cast("int")


def bmp(pixels: np.ndarray) -> bytes:
    """A 24-bit bitmap of (height, width, 3) RGB bytes: bottom row first, rows padded to four bytes."""
    height, width, _ = pixels.shape
    rows = np.zeros((height, -(-3 * width // 4) * 4), np.uint8)
    rows[:, : 3 * width] = pixels[::-1, :, ::-1].reshape(height, 3 * width)
    size = rows.size
    return b"BM" + struct.pack("<IHHI", BMP_HEADER + size, 0, 0, BMP_HEADER) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, size, 2835, 2835, 0, 0) + rows.tobytes()


def bmp_pixels(blob: bytes) -> np.ndarray:
    if blob[:2] != b"BM" or len(blob) < BMP_HEADER:
        raise ValueError("not a bitmap")
    width, height = struct.unpack_from("<ii", blob, 18)
    stride = -(-3 * width // 4) * 4
    rows = np.frombuffer(blob, np.uint8, height * stride, BMP_HEADER).reshape(height, stride)
    return rows[::-1, : 3 * width].reshape(height, width, 3)[:, :, ::-1]


def cut_patches(size: int) -> Cut:
    """Batches of (sample, width, height, pixels) to batches of sample, index, x, y, blob."""
    if size < 1:
        raise ValueError("a patch holds a pixel at least")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sample, width, height, raw in zip(pdf["sample"], pdf["width"], pdf["height"], pdf["pixels"], strict=True):
                if raw is None or not len(raw):
                    continue
                image = np.frombuffer(raw, np.uint8).reshape(height, width, 3)
                cols, rows = -(-width // size), -(-height // size)
                whole = np.zeros((rows * size, cols * size, 3), np.uint8)
                whole[:height, :width] = image
                for i in range(rows * cols):
                    y, x = i // cols * size, i % cols * size
                    out.append((sample, i, x, y, bmp(whole[y : y + size, x : x + size])))
            yield pd.DataFrame(out, columns=["sample", "index", "x", "y", "blob"])

    return run


def patches(images: DataFrame, size: int) -> DataFrame:
    """sample, index, x, y, blob: row-major patches of size by size, padded with zeros at the right and below."""
    return images.select("sample", "width", "height", "pixels").mapInPandas(cut_patches(size), f"sample {dict(images.dtypes)['sample']}, index int, x int, y int, blob binary")


def retiled(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """sample, width, height, pixels of patches put at their places and cropped; sizes: sample, width, height."""
    kind = dict(cells.dtypes)["sample"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sample, widths, heights, lists = b.columns
            at, cells = lists.offsets.to_numpy(), lists.values
            xs, ys, blobs = cells.field("x").to_numpy(), cells.field("y").to_numpy(), cells.field("blob")
            pixels = []
            for width, height, lo, hi in zip(widths.to_numpy(), heights.to_numpy(), at[:-1], at[1:], strict=True):
                parts = [(xs[i], ys[i], bmp_pixels(blobs[i].as_buffer())) for i in range(lo, hi)]
                whole = np.zeros((max(y + p.shape[0] for _, y, p in parts), max(x + p.shape[1] for x, _, p in parts), 3), np.uint8)
                for x, y, p in parts:
                    whole[y : y + p.shape[0], x : x + p.shape[1]] = p
                pixels.append(whole[:height, :width].tobytes())
            yield pa.RecordBatch.from_arrays([sample, widths, heights, pa.array(pixels, pa.binary())], ["sample", "width", "height", "pixels"])

    # lists of a sample's patches, and a worker takes many of them at once: a group of Python's own costs more than its patches
    whole = cells.where("sample is not null and blob is not null").groupBy("sample").agg(F.collect_list(F.struct("x", "y", "blob")).alias("cells"))
    one = sizes.dropDuplicates(["sample"])
    rows = whole.join(one, "sample").select("sample", F.col("width").cast("int"), F.col("height").cast("int"), "cells")
    return rows.mapInArrow(run, f"sample {kind}, width int, height int, pixels binary")


def shard_patches(images: DataFrame, size: int, order: str) -> DataFrame:
    """Patches of all images of a shard: adds sample_idx, the image's place in its shard by `order`."""
    from pyspark.sql import Window

    placed = images.withColumn("sample_idx", F.row_number().over(Window.partitionBy("shard").orderBy(order)) - 1)
    return patches(images, size).join(placed.select("sample", "shard", "sample_idx"), "sample")


def cut_clips(chunk_ms: int) -> Cut:
    """Batches of (sample, rate, pcm) to batches of sample, index, blob."""
    step = RATE * chunk_ms // 1000
    if step < 1:
        raise ValueError("a stretch holds a sample at least")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sample, rate, pcm in zip(pdf["sample"], pdf["rate"], pdf["pcm"], strict=True):
                if pcm is None or not len(pcm):
                    continue
                if rate % RATE:
                    raise ValueError(f"a rate of {rate} is no multiple of {RATE}")
                wide = np.clip(np.asarray(pcm, np.float64)[:: rate // RATE] * 32768, -32768, 32767).astype(np.int64)
                raw = ((wide >> 8) + 128).astype(np.uint8)
                out += [(sample, k, wav(raw[at : at + step].tobytes())) for k, at in enumerate(range(0, len(raw), step))]
            yield pd.DataFrame(out, columns=["sample", "index", "blob"])

    return run


def clips(sounds: DataFrame, chunk_ms: int) -> DataFrame:
    """sample, index, blob: stretches of chunk_ms at 8 kHz and 8 bits, each with a WAV header; the last may be shorter.

    Of a higher rate, which must be a multiple of 8 kHz, every rate / 8000-th value is kept.
    """
    return sounds.select("sample", "rate", "pcm").mapInPandas(cut_clips(chunk_ms), f"sample {dict(sounds.dtypes)['sample']}, index int, blob binary")


def measured(header: int, out: str) -> Cut:
    """Batches with a blob to batches with blob_bytes and, as `out`, the sum of the bytes after its header."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = np.array([len(b) for b in pdf["blob"]], np.int64)
            ends = np.cumsum(size)
            before = np.concatenate([[0], np.cumsum(np.frombuffer(b"".join(pdf["blob"]), np.uint8), dtype=np.int64)])
            yield pdf.drop(columns="blob").assign(**{"blob_bytes": size, out: before[ends] - before[np.minimum(ends - size + header, ends)]})

    return run


def in_turn(*steps: Cut) -> Cut:
    """Steps over batches as one: what they hand on stays in one worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for step in steps:
            batches = step(batches)
        return batches

    return run


def joined(blobs: DataFrame) -> DataFrame:
    """sample, pcm: the values of a sample's stretches without their headers, end to end."""
    parts = blobs.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("index", F.expr(f"substring(blob, {WAV_HEADER + 1})").alias("b")))).alias("_p"))
    return parts.select("sample", F.unhex(F.array_join(F.transform("_p", lambda x: F.hex(x["b"])), "")).alias("pcm"))


def reconstructed(blobs: DataFrame, framing: str) -> DataFrame:
    """sample, index, data by the column framing: 'wav' joins a sample's stretches into one; without a framing blobs stay as they are."""
    sound = joined(blobs.where(F.col(framing) == "wav")).select("sample", F.lit(0).alias("index"), F.col("pcm").alias("data"))
    return sound.unionByName(blobs.where(F.col(framing).isNull()).select("sample", "index", F.col("blob").alias("data")))
