"""Chunks, orders, intervals, windows, padding: all as expressions over arrays and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAD = 256
PATCH = 16


def windows(tokens: Column, size: int) -> Column:
    """Consecutive windows of at most size entries; an empty array is one empty window."""
    count = F.greatest(F.ceil(F.size(tokens) / size).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(tokens, i * size + 1, F.lit(size)))


def document_windows(docs: DataFrame, tokens: Column, size: int, *, id_col: str = "doc_id") -> DataFrame:
    """doc_idx, chunk_idx, total_chunks, token_ids of each document's windows."""
    if size < 1:
        raise ValueError("the window must hold a token")
    cut = docs.select(F.col(id_col).alias("doc_idx"), windows(tokens, size).alias("_w"))
    return cut.select("doc_idx", F.size("_w").alias("total_chunks"), F.posexplode("_w").alias("chunk_idx", "token_ids"))


def text_windows(docs: DataFrame, size: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_idx, chunk_idx, total_chunks, piece: windows of characters, cut from the text without an array of characters."""
    if size < 1:
        raise ValueError("the window must hold a character")
    rows = docs.select(F.col(id_col).alias("doc_idx"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    rows = rows.withColumn("total_chunks", F.greatest(F.ceil(F.char_length("_t") / size).cast("int"), F.lit(1)))
    cut = F.transform(F.sequence(F.lit(0), F.col("total_chunks") - 1), lambda i: F.substring(F.col("_t"), i * size + 1, F.lit(size)))
    return rows.select("doc_idx", "total_chunks", F.posexplode(cut).alias("chunk_idx", "piece"))


def word_chunks(docs: DataFrame, size: int, overlap: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos, chunk: windows of size words, each overlapping the one before; the last ones may lie within it."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive, and overlap at least 0 and less than size")
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    step = size - overlap
    rows = docs.select(F.col(id_col).alias("doc_id"), words.alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.size("_w") - 1, F.lit(step))
    return rows.select("doc_id", "_w", F.posexplode(starts).alias("pos", "_s")).select("doc_id", "pos", F.array_join(F.slice("_w", F.col("_s") + 1, F.lit(size)), " ").alias("chunk"))


def reassembled(segments: DataFrame) -> DataFrame:
    """stream, bytes, md5 of each stream put together again from segments (stream, unit, start, data)."""
    parts = segments.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("start", F.hex("data").alias("h")))).alias("_p"))
    whole = F.unhex(F.array_join(F.transform("_p", lambda x: x["h"]), ""))
    return parts.select("stream", F.octet_length(whole).cast("bigint").alias("bytes"), F.md5(whole).alias("md5"))


def grouped(chunks: DataFrame, size: int, *, run: str = "stream", order: str = "chunk") -> DataFrame:
    """Adds k (number of the group of size consecutive chunks) and is_tail (the group is short)."""
    rows = chunks.withColumn("k", F.floor((F.row_number().over(Window.partitionBy(run).orderBy(order)) - 1) / size))
    return rows.withColumn("is_tail", F.count("*").over(Window.partitionBy(run, "k")) < size)


def update_boundaries(per_run: DataFrame, interval: int, *, n_col: str = "n_chunks") -> DataFrame:
    """One row for each multiple of the interval below the number of chunks."""
    n = F.col(n_col)
    marks = F.when(n > interval, F.sequence(F.lit(interval).cast("bigint"), n - 1, F.lit(interval).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return per_run.withColumn("boundary", F.explode(marks))


def permuted(chunks: DataFrame, seed: int | None, *, run: str = "stream", order: str = "chunk") -> DataFrame:
    """Adds coded_at: the place in coding order, a function of (seed, chunk) alone; natural order without a seed."""
    key = [F.md5(F.concat(F.lit(f"{seed}:"), F.col(order).cast("string")))] if seed is not None else []
    return chunks.withColumn("coded_at", (F.row_number().over(Window.partitionBy(run).orderBy(*key, order)) - 1).cast("bigint"))


def capped_items(items: DataFrame, cap: int, *, run: str = "stream", order: str = "seq", n_col: str = "n_chunks") -> DataFrame:
    """Whole items while their chunks stay within the cap; the first is always kept."""
    before = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(n_col).over(before), F.lit(0))
    return items.withColumn("_seen", seen).where((F.col("_seen") == 0) | (F.col("_seen") + F.col(n_col) <= cap)).drop("_seen")


def prefix_cap(stream: DataFrame, cap: int) -> DataFrame:
    """Rows of (stream, seq, start, data) within the first cap bytes; the last is cut."""
    kept = stream.where(F.col("start") < cap)
    return kept.withColumn("data", F.col("data").substr(F.lit(1), F.least(F.octet_length("data").cast("bigint"), F.lit(cap) - F.col("start")).cast("int")))


def context_tail(chunks: DataFrame, length: int, *, run: str = "stream", order: str = "chunk", tokens: str = "token_ids") -> DataFrame:
    """Adds tail: the last `length` tokens of earlier rows; null before any, or for length 0."""
    if not length:
        return chunks.withColumn("tail", F.lit(None).cast("array<int>"))
    # empty rows add nothing; of the others each holds a token at least, so `length` of them are enough
    rows = chunks.withColumn("_full", (F.size(tokens) > 0).cast("int"))
    rows = rows.withColumn("_rank", F.sum("_full").over(Window.partitionBy(run).orderBy(order)).cast("int"))
    before = Window.partitionBy(run).orderBy("_rank").rangeBetween(-length, Window.currentRow)
    pairs = F.collect_list(F.struct(F.col(order).alias("o"), F.col(tokens).alias("t"))).over(before)
    earlier = F.flatten(F.transform(F.array_sort(F.filter(pairs, lambda p: p["o"] < F.col(order))), lambda p: p["t"]))
    tail = F.slice("_flat", F.greatest(F.size("_flat") - length + 1, F.lit(1)), F.lit(length))
    return rows.withColumn("_flat", earlier).withColumn("tail", F.when(F.size("_flat") > 0, tail)).drop("_flat", "_full", "_rank")


def padded_length(n: Column, patch: int = PATCH) -> Column:
    """Symbols after padding to a multiple of the patch."""
    return n + F.pmod(-n, F.lit(patch))


def pad(tokens: Column, patch: int = PATCH, value: int = PAD) -> Column:
    return F.concat(tokens, F.array_repeat(F.lit(value), F.pmod(-F.size(tokens), F.lit(patch))))


def unpad(tokens: Column, value: int = PAD) -> Column:
    """Without trailing pad symbols."""
    keep = F.aggregate(F.transform(tokens, lambda x, i: F.when(x != value, i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.slice(tokens, F.lit(1), keep)


def extension_tokens(name: Column, patch: int = PATCH) -> Column:
    """UTF-8 bytes of a lower-case extension without its dots, at most a patch of them."""
    clean = F.hex(F.encode(F.regexp_replace(F.lower(name), r"^\.+", ""), "utf-8"))
    return F.slice(F.transform(F.filter(F.split(clean, "(?<=\\G..)"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int")), 1, patch)


def mask(ones: Column, total: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(1), ones), F.array_repeat(F.lit(0), total - ones))


def training_windows(units: DataFrame, size: int) -> DataFrame:
    """(stream, k, bytes) cut in windows of at most size; those of fewer than two symbols go: stream, k, window, length."""
    n = F.col("bytes")
    cut = units.withColumn("window", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(n / size), F.lit(1)) - 1)))
    length = F.least(F.lit(size).cast("bigint"), n - F.col("window") * size)
    return cut.withColumn("length", length).where("length >= 2").select("stream", "k", "window", "length")


def patch_grid(width: Column, height: Column, patch: int) -> Column:
    """Row-major cells of an image padded right and below: array of (index, x, y, width, height)."""
    cols, rows = F.ceil(width / patch).cast("int"), F.ceil(height / patch).cast("int")
    return F.transform(F.sequence(F.lit(0), cols * rows - 1), lambda i: F.struct(i.alias("index"), (i % cols * patch).alias("x"), (F.floor(i / cols).cast("int") * patch).alias("y"), F.lit(patch).alias("width"), F.lit(patch).alias("height")))
