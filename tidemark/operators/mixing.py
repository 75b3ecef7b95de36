"""Mixed-domain streams: prefixes of several sources end to end, with byte ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BACK = 8192


def targets(blocks: DataFrame, total: int) -> DataFrame:
    """(order, dataset, weight): adds target, the block's share of total bytes, rounded half to even."""
    whole = blocks.agg(F.sum("weight").alias("_w"))
    return blocks.join(F.broadcast(whole)).withColumn("target", F.bround(F.lit(float(total)) * F.col("weight") / F.col("_w")).cast("bigint")).drop("_w")


def safe_cuts(stream: DataFrame, wanted: DataFrame) -> DataFrame:
    """dataset, bytes: how much of each stream (stream, seq, start, data) a block takes.

    A cut in the middle of a character backs off to its start, then to just after the
    last newline within BACK bytes before it; a stream that is not longer than its
    target is taken whole.
    """
    ends = stream.groupBy(F.col("stream").alias("dataset")).agg(F.max(F.col("start") + F.octet_length("data")).alias("size"))
    plan = wanted.join(ends, "dataset", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("bigint")))
    # only rows that overlap the last BACK bytes (and the first excluded byte) matter
    near = stream.join(F.broadcast(plan.select(F.col("dataset").alias("stream"), "target", "size")), "stream")
    near = near.where("target < size and start <= target and start + octet_length(data) > target - " + str(BACK + 8))
    lo = F.greatest(F.lit(0).cast("bigint"), F.col("target") - BACK - 8 - F.col("start"))
    part = F.hex(F.col("data").substr((lo + 1).cast("int"), F.lit(BACK + 16)))
    at = near.select("stream", "target", F.posexplode(F.filter(F.split(part, "(?<=\\G..)"), lambda x: x != "")).alias("i", "h"), (F.col("start") + lo).alias("from")).withColumn("pos", F.col("from") + F.col("i"))
    lead = ~F.col("h").rlike("^[89AB]")
    cut = at.where((F.col("pos") <= F.col("target")) & lead).groupBy("stream", "target").agg(F.max("pos").alias("cut"))
    line = at.where("h = '0A'").select("stream", (F.col("pos") + 1).alias("after"))
    best = cut.join(line, "stream", "left").groupBy("stream", "target", "cut").agg(F.max(F.when((F.col("after") <= F.col("cut")) & (F.col("after") > F.col("cut") - BACK), F.col("after"))).alias("line"))
    taken = best.select(F.col("stream").alias("dataset"), F.coalesce("line", "cut").alias("_cut"))
    return plan.join(taken, "dataset", "left").withColumn("bytes", F.when(F.col("target") >= F.col("size"), F.col("size")).otherwise(F.col("_cut"))).drop("_cut")


def ranges(blocks: DataFrame) -> DataFrame:
    """Adds half-open byte_start and byte_end by order, and share of the whole in percent."""
    w = Window.partitionBy(F.lit(0)).orderBy("order")  # a table of a few blocks
    end = F.sum("bytes").over(w)
    return blocks.withColumns({"byte_start": end - F.col("bytes"), "byte_end": end, "share_pct": F.col("bytes") * 100.0 / F.sum("bytes").over(Window.partitionBy(F.lit(0)))})


def domain_at(units: DataFrame, blocks: DataFrame, at: str) -> DataFrame:
    """Adds domain: the block that holds byte `at`, else the last; 'stream' without blocks."""
    b = F.broadcast(blocks.select("dataset", "byte_start", "byte_end"))
    last = F.broadcast(blocks.agg(F.max_by("dataset", "byte_end").alias("_last")))
    joined = units.join(b, (F.col(at) >= F.col("byte_start")) & (F.col(at) < F.col("byte_end")), "left").join(last)
    return joined.withColumn("domain", F.coalesce("dataset", "_last", F.lit("stream"))).drop("dataset", "byte_start", "byte_end", "_last")


def built(stream: DataFrame, blocks: DataFrame, *, strict: bool = False) -> DataFrame:
    """order, dataset, bytes, start, at, data: the pieces of each block's prefix, at their place in the mixed stream.

    strict: a source shorter than its target is an error.
    """
    plan = blocks
    if strict:
        short = F.col("bytes") < F.col("target")
        plan = plan.withColumn("bytes", F.when(short & (F.col("bytes") == F.col("size")), F.raise_error(F.concat(F.lit("too short: "), F.col("dataset"))).cast("bigint")).otherwise(F.col("bytes")))
    few = F.broadcast(plan.select("order", "dataset", "bytes", "byte_start"))  # a row for each block of the mix
    rows = stream.join(few, stream["stream"] == few["dataset"]).where((F.col("start") < F.col("bytes")) & (F.octet_length("data") > 0))
    cut = F.least(F.octet_length("data").cast("bigint"), F.col("bytes") - F.col("start")).cast("int")
    return rows.select("order", "dataset", "bytes", "start", (F.col("byte_start") + F.col("start")).alias("at"), F.col("data").substr(F.lit(1), cut).alias("data"))


def verified(pieces: DataFrame) -> DataFrame:
    """order, dataset, bytes, pieces, md5 (of the pieces' digests in order), exact (a prefix without gaps), valid (UTF-8), switches (between domains)."""
    digest = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", F.md5(F.hex("data")).alias("h")))), lambda x: x["h"]), ""))
    n = F.octet_length("data").cast("bigint")
    per = pieces.groupBy("order", "dataset", "bytes").agg(F.count("*").alias("pieces"), digest.alias("md5"), F.sum(n).alias("_sum"), F.max(F.col("start") + n).alias("_end"), F.bool_and(F.is_valid_utf8(F.col("data").cast("string"))).alias("valid"))
    blocks = F.broadcast(per.agg((F.count("*") - 1).alias("switches")))
    return per.withColumn("exact", (F.col("_sum") == F.col("bytes")) & (F.col("_end") == F.col("bytes"))).join(blocks).select("order", "dataset", "bytes", "pieces", "md5", "exact", "valid", "switches")
