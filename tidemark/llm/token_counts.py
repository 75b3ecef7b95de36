"""Token counts of documents in flat, unindexed token files, by a vectorised scan for separators.

A file is nothing but little-endian unsigned 16-bit ids; a document is what lies
between two end-of-document ids.  Files are read by Spark (any store it can read)
and cut into blocks.  Each block is searched at once for the separator; documents
within a block are complete there.  For those that cross blocks, a prefix scan over
one small row per block carries the last open start forward, past any number of
blocks without a separator.

A document may begin with its own id (HEADER digits of 15 bits each, which no
separator equals); a block is read with HEADER ids of the next one, so that a
header that crosses blocks is whole in the block where its document starts.

Defined cases: an empty file has no document; two separators in a row are an empty
document; ids after the last separator are a document that is not terminated; null
text has no tokens; a null doc_id is kept as null; repeated rows are counted each; an
empty table has no file and gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.word_tokens import vocabulary_path, word_tokenizer

#: <|endoftext|> of the vocabulary; text never yields it.
SEPARATOR = 49_407
HEADER = 5
#: Tokens of a block.
BLOCK = 1 << 18
#: Documents of a file at most, and bytes, as far as one document allows: Spark reads a file as one value, so files are kept small.
FILE_DOCUMENTS, FILE_BYTES = 2_000, 1 << 30


def _headers(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Five 15-bit digits of each 64-bit id, lowest first; bit 14 of the last marks null."""
    u = ids.astype(np.int64).view(np.uint64)
    out = np.empty((len(u), HEADER), "<u2")
    for k in range(HEADER):
        out[:, k] = (u >> np.uint64(15 * k)) & np.uint64(0x7FFF)
    out[:, -1] |= null.astype("<u2") << 14
    return out


def _ids(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids whose headers begin at starts, and which of them are null (or cut off by the end of the file)."""
    at = starts[:, None] + np.arange(HEADER)
    cut = at[:, -1] >= len(tokens)
    digits = tokens[np.minimum(at, max(len(tokens) - 1, 0))].astype(np.uint64) if len(tokens) else np.zeros(at.shape, np.uint64)
    u = np.zeros(len(starts), np.uint64)
    for k in range(HEADER):
        u |= (digits[:, k] & np.uint64(0x7FFF if k < HEADER - 1 else 0xF)) << np.uint64(15 * k)
    return u.view(np.int64), cut | (digits[:, -1] & np.uint64(0x4000) > 0)


def write_flat(docs: DataFrame, out: str, *, path: str | None = None, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenises documents into flat files of at most FILE_DOCUMENTS documents, written by Spark itself to any store.

    The text writer puts a record's bytes and then the line separator: here a
    document's ids and the separator's two bytes.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(path)
        for b in batches:
            null = np.asarray(b.column(0).is_null())
            ids = np.asarray(b.column(0).fill_null(0)).astype(np.int64)
            for c in K.chunks(b.column(1)):
                tokens, offs = tok.encode(c)
                n = np.diff(offs)
                size = n + HEADER
                begin = np.cumsum(size) - size
                flat = np.empty(int(size.sum()), "<u2")
                flat[begin[:, None] + np.arange(HEADER)] = _headers(ids[c.lo : c.hi], null[c.lo : c.hi])
                flat[K.ragged(begin + HEADER, n)] = tokens
                edges = np.append(begin, len(flat)).astype(np.int64) * 2
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(edges), pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([raw], ["ids"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, "ids binary")
    # a token has a byte of text at least
    longest = docs.agg(F.max(F.octet_length(text_col))).first()[0] or 0
    most = min(FILE_DOCUMENTS, max(1, FILE_BYTES // (2 * (longest + HEADER + 1))))
    rows.select(F.col("ids").cast("string").alias("value")).write.option("maxRecordsPerFile", most).option("encoding", "ISO-8859-1").option("lineSep", separator.to_bytes(2, "little").decode("latin-1")).text(out)


def read_blocks(spark: SparkSession, path: str, *, block: int = BLOCK, halo: int = HEADER) -> DataFrame:
    """file, block_no, n_tokens (of the file), payload: a block's ids and the first `halo` of the next.

    Spark reads a file as one value, so files are limited to 2 GB; token shards are cut smaller than that.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.col("length") / (2 * block)).cast("int") - 1), lambda i: F.col("content").substr(i * (2 * block) + 1, F.lit(2 * (block + halo))))
    return files.select(F.col("path").alias("file"), F.expr("length div 2").alias("n_tokens"), F.posexplode(cut).alias("block_no", "payload")).select("file", "block_no", "n_tokens", "payload")


def _scan(block: int, separator: int, header: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, number, total, payload in zip(*(b.column(k) for k in range(4)), strict=True):
                no, total = number.as_py(), total.as_py()
                tokens = np.frombuffer(payload.as_buffer(), "<u2", len(payload.as_buffer()) // 2)
                base = no * block
                own = min(block, total - base)
                ends = np.flatnonzero(tokens[:own] == separator)
                starts = ends + 1
                if no == 0:
                    starts = np.concatenate(([0], starts))
                starts = starts[starts + base < total]
                ids, null = _ids(tokens, starts) if header else (np.zeros(len(starts), np.int64), np.ones(len(starts), bool))
                closed = ends if no == 0 else ends[1:]
                n = len(closed)
                lists = [pa.array([x], pa.list_(t)) for x, t in (((starts[:n] + base), pa.int64()), ((closed - starts[:n]), pa.int64()))]
                names = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(ids[:n], mask=null[:n]))
                first_end = int(ends[0]) + base if no and len(ends) else None
                still = len(starts) > n
                open_start = int(starts[n]) + base if still else None
                open_id = int(ids[n]) if still and not null[n] else None
                yield pa.RecordBatch.from_arrays([pa.array([file.as_py()]), pa.array([no], pa.int32()), pa.array([total]), pa.array([first_end], pa.int64()), pa.array([open_start], pa.int64()), pa.array([open_id], pa.int64()), names, *lists], ["file", "block_no", "n_tokens", "first_end", "open_start", "open_id", "ids", "starts", "lengths"])

    return run


def scan_documents(blocks: DataFrame, *, block: int = BLOCK, separator: int = SEPARATOR, header: int = HEADER) -> DataFrame:
    """file, start, doc_id, n_tokens (header not counted), terminated: one row per document."""
    seen = blocks.select("file", "block_no", "n_tokens", "payload").mapInArrow(_scan(block, separator, header), "file string, block_no int, n_tokens long, first_end long, open_start long, open_id long, ids array<long>, starts array<long>, lengths array<long>")
    before = Window.partitionBy("file").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.when(F.col("open_start").isNotNull(), F.struct(F.col("open_start").alias("s"), F.col("open_id").alias("i")))
    # A block with an end and no open start after it closes what came before.
    state = F.coalesce(opened, F.when(F.col("first_end").isNotNull(), F.struct(F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("i"))))
    seen = seen.withColumn("_carry", F.last(state, ignorenulls=True).over(before))
    is_last = (F.col("block_no") + 1) * block >= F.col("n_tokens")

    def row(i, s, n, done):
        return F.struct(i.alias("doc_id"), s.alias("start"), n.alias("n"), F.lit(done).alias("terminated"))

    inner = F.transform(F.arrays_zip("ids", "starts", "lengths"), lambda x: row(x["ids"], x["starts"], x["lengths"], True))
    crossing = F.when(F.col("first_end").isNotNull() & F.col("_carry.s").isNotNull(), F.array(row(F.col("_carry.i"), F.col("_carry.s"), F.col("first_end") - F.col("_carry.s"), True)))
    tail_start = F.when(F.col("open_start").isNotNull() | F.col("first_end").isNotNull(), F.col("open_start")).otherwise(F.col("_carry.s"))
    tail_id = F.when(F.col("open_start").isNotNull() | F.col("first_end").isNotNull(), F.col("open_id")).otherwise(F.col("_carry.i"))
    tail = F.when(is_last & tail_start.isNotNull(), F.array(row(tail_id, tail_start, F.col("n_tokens") - tail_start, False)))
    none = F.array().cast("array<struct<doc_id:bigint,start:bigint,n:bigint,terminated:boolean>>")
    out = seen.select("file", F.explode(F.concat(F.coalesce(crossing, none), inner, F.coalesce(tail, none))).alias("d"))
    return out.select("file", "d.start", "d.doc_id", F.greatest(F.col("d.n") - header, F.lit(0)).cast("long").alias("n_tokens"), "d.terminated")
