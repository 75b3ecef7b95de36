"""Images and sounds made from the keys of `part`, cut into blobs and put together again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import media as M

PATCH, CHUNK_MS, SOUND_RATE = 16, 100, 16_000
#: Images or sounds that a worker makes at once.
AT_ONCE = 500


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts dealt to as many tasks as a shuffle has: their media are a thousand times larger than the file, which may be one task's."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images are as wide and high as a part's size and key say."""
    return _parts(spark, sf_dir).select(F.col("p_partkey").cast("bigint").alias("sample"), (F.col("p_size") + 8).cast("int").alias("width"), (F.col("p_partkey") % 40 + 5).cast("int").alias("height"))


def _draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds pixels: their colours follow from their places."""
    for pdf in batches:
        for at in range(0, len(pdf), AT_ONCE):
            part, pixels = pdf.iloc[at : at + AT_ONCE], []
            for k, w, h in zip(part["sample"], part["width"], part["height"], strict=True):
                y, x, c = np.ogrid[:h, :w, :3]
                pixels.append(((k * 31 + x * 7 + y * 13 + c * 29) % 256).astype(np.uint8).tobytes())
            yield part.assign(pixels=pixels)


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir).mapInPandas(_draw, "sample long, width int, height int, pixels binary")


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select(F.col("p_partkey").cast("bigint").alias("sample"))


def _play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A thousand values and more at 16 kHz, each a function of the part's key and the place."""
    for pdf in batches:
        for at in range(0, len(pdf), AT_ONCE):
            part, pcm = pdf.iloc[at : at + AT_ONCE], []
            for k in part["sample"].tolist():
                t = np.arange(k * 37 % 3000 + 1000)
                pcm.append((t * t * 3 + t * 11 + k * 37) % 65536 / 32768.0 - 1)
            yield part.assign(rate=SOUND_RATE, pcm=pcm)


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sounds are made and cut in one worker: no value of theirs passes through the JVM."""
    return _keys(spark, sf_dir).mapInPandas(M.in_turn(_play, M.cut_clips(CHUNK_MS)), "sample long, index int, blob binary")


def image_patches(spark, sf_dir):
    """Patches as bitmaps: their places, sizes and the sum of their pixels."""
    steps = M.in_turn(_draw, M.cut_patches(PATCH), M.measured(M.BMP_HEADER, "pixel_sum"))
    return _sizes(spark, sf_dir).mapInPandas(steps, "sample long, index int, x int, y int, blob_bytes long, pixel_sum long")


def image_retiled(spark, sf_dir):
    """Images put together from their patches and cropped."""
    sizes = _sizes(spark, sf_dir)
    cells = sizes.mapInPandas(M.in_turn(_draw, M.cut_patches(PATCH)), "sample long, index int, x int, y int, blob binary")
    return M.retiled(cells, sizes).select("sample", "width", "height", F.md5(F.hex("pixels")).alias("md5"))


def image_shards(spark, sf_dir):
    """Patches of shards of 16 images: of each image its place in the shard and how many patches it has."""
    images = _images(spark, sf_dir).withColumn("shard", F.expr("sample div 16"))
    return M.shard_patches(images, PATCH, "sample").groupBy("shard", "sample_idx", "sample").agg(F.count("*").alias("patches"))


def audio_clips(spark, sf_dir):
    """Stretches of 100 ms as WAV files: sizes and the sum of their values."""
    steps = M.in_turn(_play, M.cut_clips(CHUNK_MS), M.measured(M.WAV_HEADER, "value_sum"))
    return _keys(spark, sf_dir).mapInPandas(steps, "sample long, index int, blob_bytes long, value_sum long")


def audio_joined(spark, sf_dir):
    back = M.joined(_clips(spark, sf_dir))
    return back.select("sample", F.octet_length("pcm").cast("bigint").alias("bytes"), F.md5(F.hex("pcm")).alias("md5"))


def media_reconstructed(spark, sf_dir):
    """Sounds of even keys have a framing and become one value; the blobs of odd ones stay as they are."""
    blobs = _clips(spark, sf_dir).withColumn("framing", F.when(F.col("sample") % 2 == 0, F.lit("wav")))
    return M.reconstructed(blobs, "framing").select("sample", "index", F.octet_length("data").cast("bigint").alias("bytes"))


def pcm_from_float(spark, sf_dir):
    """Quantities as samples, of which some are beyond the range and are clipped."""
    x = (F.col("l_quantity").cast("double") - 25) / 20
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", M.pcm16(x).alias("pcm"))


def payload_decode(spark, sf_dir):
    """Pages whose bytes come as such, as hex digits or as numbers."""
    raw = F.encode("html", "utf-8")
    kind = F.col("page_id") % 3
    numbers = F.transform(F.filter(F.split(F.hex(raw), "(?<=\\G..)"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int"))
    spec = F.struct(F.when(kind == 0, raw).alias("bytes"), F.when(kind == 1, F.hex(raw)).alias("hex"), F.when(kind == 2, numbers).alias("values"))
    got = spark.read.parquet(f"{sf_dir}/pages.parquet").where("html is not null").select("page_id", M.decode_payload(spec).alias("data"))
    return got.select("page_id", F.octet_length("data").cast("bigint").alias("bytes"), F.md5("data").alias("md5"))


QUERIES = {f.__name__: f for f in (image_patches, image_retiled, image_shards, audio_clips, audio_joined, media_reconstructed, pcm_from_float, payload_decode)}

_IMG = f"im AS (SELECT p_partkey::BIGINT AS sample, (p_size + 8)::BIGINT AS w, (p_partkey % 40 + 5)::BIGINT AS h FROM part), ce AS (SELECT *, (w + {PATCH - 1}) // {PATCH} AS cols FROM im), pa AS (SELECT *, unnest(range(cols * ((h + {PATCH - 1}) // {PATCH}))) AS i FROM ce)"
_SND = "sn AS (SELECT p_partkey::BIGINT AS sample, (p_partkey::BIGINT * 37) % 3000 + 1000 AS n FROM part), va AS (SELECT sample, j, ((((2 * j) * (2 * j) * 3 + (2 * j) * 11 + sample * 37) % 65536 - 32768) >> 8) + 128 AS v FROM (SELECT sample, unnest(range((n + 1) // 2)) AS j FROM sn))"

ORACLE_SQL = {
    "image_patches": f"WITH {_IMG}, px AS (SELECT sample, i, cols, w, h, (i % cols) * {PATCH} AS x0, (i // cols) * {PATCH} AS y0, unnest(range({PATCH * PATCH})) AS p FROM pa), pp AS (SELECT *, x0 + p % {PATCH} AS x, y0 + p // {PATCH} AS y FROM px) SELECT sample, i::INTEGER AS index, x0::INTEGER AS x, y0::INTEGER AS y, {M.BMP_HEADER + 3 * PATCH * PATCH}::BIGINT AS blob_bytes, coalesce(sum((sample * 31 + x * 7 + y * 13) % 256 + (sample * 31 + x * 7 + y * 13 + 29) % 256 + (sample * 31 + x * 7 + y * 13 + 58) % 256) FILTER (x < w AND y < h), 0)::BIGINT AS pixel_sum FROM pp GROUP BY sample, i, x0, y0",
    "image_retiled": f"WITH {_IMG}, bt AS (SELECT sample, w, h, unnest(range(w * h * 3)) AS b FROM im) SELECT sample, w::INTEGER AS width, h::INTEGER AS height, md5(string_agg(upper(lpad(to_hex((sample * 31 + ((b // 3) % w) * 7 + (b // 3 // w) * 13 + (b % 3) * 29) % 256), 2, '0')), '' ORDER BY b)) AS md5 FROM bt GROUP BY sample, w, h",
    "image_shards": f"WITH {_IMG} SELECT sample // 16 AS shard, (dense_rank() OVER (PARTITION BY sample // 16 ORDER BY sample) - 1)::INTEGER AS sample_idx, sample, count(*)::BIGINT AS patches FROM pa GROUP BY sample",
    "audio_clips": f"WITH {_SND} SELECT sample, (j // {8 * CHUNK_MS})::INTEGER AS index, ({M.WAV_HEADER} + count(*))::BIGINT AS blob_bytes, sum(v)::BIGINT AS value_sum FROM va GROUP BY ALL",
    "audio_joined": f"WITH {_SND} SELECT sample, count(*)::BIGINT AS bytes, md5(string_agg(upper(lpad(to_hex(v), 2, '0')), '' ORDER BY j)) AS md5 FROM va GROUP BY 1",
    "media_reconstructed": f"WITH {_SND} SELECT sample, 0::INTEGER AS index, count(*)::BIGINT AS bytes FROM va WHERE sample % 2 = 0 GROUP BY 1 UNION ALL SELECT sample, (j // {8 * CHUNK_MS})::INTEGER, ({M.WAV_HEADER} + count(*))::BIGINT FROM va WHERE sample % 2 = 1 GROUP BY ALL",
    "pcm_from_float": "SELECT l_orderkey, l_linenumber, trunc(greatest(least((l_quantity::DOUBLE - 25) / 20 * 32768, 32767), -32768))::INTEGER AS pcm FROM lineitem",
    "payload_decode": "SELECT page_id, octet_length(encode(html))::BIGINT AS bytes, md5(html) AS md5 FROM pages WHERE html IS NOT NULL",
}
