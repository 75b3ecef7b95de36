"""Jaccard self-join of word n-gram sets by vertical partitioning.

The global n-gram order runs from rare to common (by a fixed-size sketch of
document counts over all rows) and then by hash.  A document's rarest n-grams, its
prefix, must share an entry with that of every document it links with; lists of
documents by prefix n-gram give candidates.  A document with more n-grams of its own
than a link allows is in no list.  For the candidates the global order
is cut into ranges, so many that one holds about FRAGMENT n-grams of a mean document: each document's set becomes one row for each range that
it has n-grams in, keyed by range and document; overlaps are counted range by range,
each in a partition of its own, and the partial counts are summed for each pair, which
makes the test exact.

Only classes are wanted, so pairs within one class need no second link.  Exact
copies are one candidate.  In a first round each list's most central member is
paired with the others, so a group of near copies of any size gives a number of
pairs in proportion to its size; components of the links are formed.  In a second
round the pairs of a list whose ends are still in different components are tested,
unless the number of lists they can have in common rules a link out, so that no
link between classes is lost.

Defined cases: null text and texts without a word have no n-gram and link with
nothing; a text of fewer words than n has its whole sequence as its one n-gram;
rows are judged one by one, also when doc_ids repeat; rows with a null doc_id link
with nothing and have a null component; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.components import connected_components
from tidemark.llm.store import Scratch, join_facts, materialise

N = 5
PERCENT = 80
#: N-grams of a mean document in one fragment; there are two fragments at least.
FRAGMENT = 128
#: The sketch has 2**SKETCH_BITS counters, whatever the size of the input.
SKETCH_BITS = 22
_BLOCKS = 64


def ngram_sets(c: K.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct n-grams of each document, sorted."""
    c = K.lower_ascii(c)
    w = K.split_words(c)
    h = K.hash_spans(c.data, w.starts, w.ends)
    at = K.window_starts(w, n)
    grams, doc = K.ngrams(h, n)[at], np.searchsorted(w.offsets, at, "right") - 1
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        grams = np.concatenate((grams, K.sequence_hash(h, w.offsets)[short]))
        doc = np.concatenate((doc, short))
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return doc[keep], grams[keep]


def _bucket(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> np.uint64(64 - bits)).astype(np.int64)


def _measure(n: int, bits: int):
    """A row for each document with its set's size, and at a task's end the task's counters, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << bits, np.uint32)
        names = ["_key", "n", "block", "salt", "payload"]
        for b in batches:
            for c in K.chunks(b.column(1)):
                doc, grams = ngram_sets(c, n)
                count += np.bincount(_bucket(grams, bits), minlength=1 << bits).astype(np.uint32)
                size = np.bincount(doc, minlength=c.hi - c.lo).astype(np.int64)
                none = pa.nulls(len(size), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.lo, c.hi - c.lo), pa.array(size), none, none, pa.nulls(len(size), pa.binary())], names)
        if count.any():
            salt = TaskContext.get().partitionId()
            parts = [zlib.compress(x.astype("<u8").tobytes(), 1) for x in np.split(count, _BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.nulls(_BLOCKS, pa.int64()), pa.nulls(_BLOCKS, pa.int64()), pa.array(np.arange(_BLOCKS, dtype=np.int32)), pa.array(np.full(_BLOCKS, salt, np.int32)), pa.array(parts, pa.binary())], names)

    return run


def _sum_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(x), "<u8") for x in pdf["payload"])
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "salt": pdf["salt"].iloc[:1] // 64, "payload": [zlib.compress(total.tobytes(), 1)]})


def _levels(blocks: DataFrame, bits: int) -> np.ndarray:
    """Quarter-octave levels of the summed counters: 2**bits bytes, the only thing that goes to the driver."""
    tasks = blocks.agg(F.max("salt")).first()[0]
    if tasks is None:
        return np.zeros(1 << bits, np.uint8)
    while tasks:  # a tree of sums of at most 64 blocks
        blocks = blocks.withColumn("_g", F.expr("salt div 64")).groupBy("block", "_g").applyInPandas(_sum_blocks, "block int, salt int, payload binary")
        tasks //= 64
    got = {r["block"]: np.frombuffer(zlib.decompress(r["payload"]), "<u8") for r in blocks.select("block", "payload").toLocalIterator()}
    count = np.concatenate([got[k] for k in range(_BLOCKS)]).astype(np.float64)
    return np.minimum(255, np.floor(4 * np.log2(1 + count))).astype(np.uint8)


def _order(grams: np.ndarray, levels: np.ndarray, bits: int) -> np.ndarray:
    """The place of an n-gram in the global order."""
    return (levels[_bucket(grams, bits)].astype(np.uint64) << np.uint64(56)) | (K.mix64(grams) >> np.uint64(8))


def _prefixes(n: int, percent: int, levels, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.value
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for c in K.chunks(b.column(1)):
                doc, grams = ngram_sets(c, n)
                order = np.lexsort((_order(grams, table, bits), doc))
                grams = grams[order]
                size = np.bincount(doc, minlength=c.hi - c.lo)
                first = np.cumsum(size) - size
                length = np.minimum(size, size - (size * percent + 99) // 100 + 1)
                at = K.ragged(first, length)
                of = np.repeat(np.arange(len(size)), length)
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(grams[at])), pa.array(keys[c.lo + of]), pa.array(size[of].astype(np.int32))], ["_h", "_key", "_n"])

    return run


def _segments(n: int, cuts: np.ndarray, levels, bits: int):
    """Each document's set, cut at `cuts` of the global order: a row for each range that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.value
        for b in batches:
            for c in K.chunks(b.column(1)):
                doc, grams = ngram_sets(c, n)
                part = np.searchsorted(cuts, _order(grams, table, bits), "right")
                k = len(cuts) + 1
                group = doc * k + part
                order = np.argsort(group, kind="stable")
                size = np.bincount(group, minlength=(c.hi - c.lo) * k)
                some = np.flatnonzero(size)
                edges = np.concatenate(([0], np.cumsum(size[some])))
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(K.signed(grams[order])))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(c.lo + some // k)), pa.array((some % k).astype(np.int32)), lists], ["_key", "_range", "_grams"])

    return run


def _cuts(levels: np.ndarray, fragments: int) -> np.ndarray:
    """Places of the global order that split the counted n-grams into ranges of like mass."""
    mass = np.bincount(levels, weights=np.exp2(levels / 4.0), minlength=256)
    total, at, out = np.cumsum(mass), 0.0, []
    for k in range(1, fragments):
        want = total[-1] * k / fragments
        lv = int(np.searchsorted(total, want))
        at = (want - (total[lv] - mass[lv])) / mass[lv] if mass[lv] else 0.0
        out.append((lv << 56) | int(at * ((1 << 56) - 1)))
    return np.array(sorted(out), np.uint64)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows apart: equal for rows of one id and one text."""
    return F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col))


def join_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT, fragment: int = FRAGMENT, sketch_bits: int = SKETCH_BITS, keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of docs.

    keyed: also row_key, as row_key() gives it, and class_key (null for rows that link with nothing by definition).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    ident, text = F.col(id_col).cast("bigint"), F.col(text_col)
    plain = docs.select(ident.alias("_id"), row_key(id_col, text_col).alias("_key"), text.alias("_text"), F.md5(text).alias("_md5"))
    measured = scratch.save(plain.select("_key", "_text").mapInArrow(_measure(n, sketch_bits), "_key long, n long, block int, salt int, payload binary"), "ngram-sketch")
    table = _levels(measured.where("block is not null").select("block", "salt", "payload"), sketch_bits)
    found = measured.where("block is null").agg(F.count("*").alias("rows"), F.avg("n").alias("mean")).first()
    documents, fragments = int(found["rows"]), max(2, -(-int(found["mean"] or 0) // fragment))
    levels, cuts = spark.sparkContext.broadcast(table), _cuts(table, fragments)
    sizes = measured.where("block is null").select("_key", "n").distinct()

    # Texts by row key: one exchange for the prefixes and the segments. Of equal texts the first row stands for all.
    rows = plain.select("_id", "_key", "_text").repartition("_key")
    head = plain.where("_id is not null and _md5 is not null").groupBy("_md5").agg(F.min(F.struct("_id", "_key")).alias("s")).select("_md5", F.col("s._key").alias("_head"))
    firsts = head.select(F.col("_head").alias("_key"))
    found = rows.join(firsts.hint("shuffle_hash"), "_key", "left_semi").select("_key", "_text").mapInArrow(_prefixes(n, percent, levels, sketch_bits), "_h long, _key long, _n int")
    over = Window.partitionBy("_h")
    lists = found.repartition("_h").withColumn("_first", F.min("_key").over(over)).withColumn("_last", F.max("_key").over(over)).where("_first < _last")
    lists = scratch.save(lists.select("_h", "_key", "_n"), "ngram-lists")
    # How much of a document's prefix others share: the text that copies were made from has no n-gram of its own.
    central = lists.groupBy("_key", "_n").agg(F.count("*").alias("k")).select("_key", (F.col("k") * 1000 / (F.col("_n") * (100 - percent) / 100 + 1)).cast("int").alias("_central"))
    lists = scratch.save(lists.join(central, "_key"), "ngram-lists")

    def alike(a: str, b: str) -> Column:
        return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, na, nb) whose overlaps, counted fragment by fragment and summed, reach the similarity."""
        ends = pairs.select(F.col("a").alias("_key")).union(pairs.select(F.col("b").alias("_key"))).distinct()
        parts = rows.join(ends.hint("shuffle_hash"), "_key", "left_semi").select("_key", "_text").mapInArrow(_segments(n, cuts, levels, sketch_bits), "_key long, _range int, _grams array<long>")
        parts = scratch.save(parts, "ngram-segments")
        left = parts.select(F.col("_key").alias("a"), "_range", F.col("_grams").alias("_ga"))
        right = parts.select(F.col("_key").alias("b"), "_range", F.col("_grams").alias("_gb"))
        each = pairs.withColumn("_range", F.explode(F.array(*(F.lit(k) for k in range(fragments)))))
        partial = each.join(right, ["b", "_range"]).join(left, ["a", "_range"]).select("a", "b", "na", "nb", F.size(F.array_intersect("_ga", "_gb")).alias("k"))
        shared = partial.groupBy("a", "b", "na", "nb").agg(F.sum("k").alias("k"))
        return shared.where(100 * F.col("k") >= percent * (F.col("na") + F.col("nb") - F.col("k"))).select("a", "b")

    def pairs_of(df: DataFrame) -> DataFrame:
        return df.select(F.least("_key", "_p._key").alias("a"), F.greatest("_key", "_p._key").alias("b"), F.when(F.col("_key") < F.col("_p._key"), F.col("_n")).otherwise(F.col("_p._n")).cast("long").alias("na"), F.when(F.col("_key") < F.col("_p._key"), F.col("_p._n")).otherwise(F.col("_n")).cast("long").alias("nb")).distinct()

    # Stars: each list's most central member with the others.
    pivot = F.max(F.struct("_central", "_key", "_n")).over(over)
    stars = scratch.save(pairs_of(lists.repartition("_h").withColumn("_p", pivot).where(F.col("_key") != F.col("_p._key")).where(alike("_n", "_p._n"))), "ngram-stars")
    links = scratch.save(verified(stars), "ngram-links")
    classes = connected_components(links.toDF("u", "v"), scratch)

    # Lists whose members are still in different components.
    placed = lists.join(classes.select(F.col("id").alias("_key"), "component"), "_key", "left").withColumn("_c", F.coalesce("component", "_key"))
    placed = placed.repartition("_h").withColumn("_c1", F.min("_c").over(over)).withColumn("_c2", F.max("_c").over(over)).where("_c1 < _c2").select("_h", "_key", "_n", "_c")
    placed = scratch.save(placed, "ngram-mixed")

    # What is left: all pairs of one list whose ends are in different components.
    # Common n-grams are in both prefixes or behind the prefix that ends first, so `need` of a pair's lists are common;
    # in an order of lists from small to large, the first common one leaves need - 1 others behind it on both sides.
    size = placed.groupBy("_h").agg(F.count("*").alias("_size"))
    mine = Window.partitionBy("_key")
    placed = placed.join(size, "_h").withColumn("_left", F.count("*").over(mine) - F.row_number().over(mine.orderBy("_size", "_h")) + 1)
    placed = scratch.save(placed, "ngram-mixed")
    one = placed.select("_h", F.col("_key").alias("a"), F.col("_n").cast("long").alias("na"), F.col("_c").alias("ca"), F.col("_left").alias("la"))
    two = placed.select("_h", F.col("_key").alias("b"), F.col("_n").cast("long").alias("nb"), F.col("_c").alias("cb"), F.col("_left").alias("lb"))
    behind = F.floor((F.greatest("na", "nb") * percent + 99) / 100) - 1
    need = F.ceil((F.col("na") + F.col("nb")) * (percent / (100.0 + percent)) - 1e-9) - behind
    near = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & alike("na", "nb") & (F.least("la", "lb") >= need)
    rest = one.join(two, (one["_h"] == two["_h"]) & near).select("a", "b", "na", "nb").distinct()
    rest = scratch.save(rest.join(stars.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "na", "nb"), "ngram-rest")
    if not rest.isEmpty():
        more = scratch.save(verified(rest), "ngram-links")
        if not more.isEmpty():
            classes = connected_components(links.union(more).toDF("u", "v"), scratch)

    # Classes of rows: each text's head, the head's component, the smallest doc_id of all members.
    members = plain.select("_id", "_key", "_md5").join(head, "_md5", "left").join(sizes, "_key", "left").join(classes.select(F.col("id").alias("_head"), "component"), "_head", "left")
    members = materialise(members.select("_id", "_key", F.col("n").alias("_n"), F.when(F.col("_id").isNotNull() & (F.col("n") > 0), F.coalesce("component", "_head")).alias("_class")), "ngram-members")
    scratch.drop()
    least = members.where("_class is not null").groupBy("_class").agg(F.min("_id").alias("_least"), F.count("*").alias("_size"))
    extra = [F.col("_key").alias("row_key"), F.col("_class").alias("class_key")] if keyed else []
    return join_facts(members, least, "_class", "_size", documents).select(F.col("_id").alias("doc_id"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("_least", "_id").alias("component_id"), *extra)
