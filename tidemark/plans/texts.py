"""Chunking, text and source functions over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import texts as T
from tidemark.operators import chunking as C
from tidemark.operators import streams
from tidemark.plans import sqltext as S
from tidemark.sources import readers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.as_stream(_docs(spark, sf_dir))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, chunk, bytes from sizes alone."""
    sizes = _docs(spark, sf_dir).groupBy(F.col("source").alias("stream")).agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("size"))
    rows = sizes.where("size > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(size - 1) div 512"))))
    return rows.select("stream", "chunk", F.least(F.lit(512).cast("bigint"), F.col("size") - F.col("chunk") * 512).alias("bytes"))


def chunk_text_fixed(spark, sf_dir):
    """Hash of each 512-byte chunk."""
    parts = streams.segments(_stream(spark, sf_dir), 512).groupBy("stream", F.col("unit").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("start", F.hex("data").alias("h")))).alias("p"))
    h = F.array_join(F.transform("p", lambda x: x["h"]), "")
    return parts.select("stream", "chunk", F.md5(h).alias("md5"))


def chunk_docs_windows(spark, sf_dir):
    """Windows of at most 256 characters of each document."""
    w = C.text_windows(_docs(spark, sf_dir), 256)
    return w.select("doc_idx", F.col("chunk_idx").cast("bigint"), F.col("total_chunks").cast("bigint"), F.char_length("piece").cast("bigint").alias("n_tokens"), F.md5("piece").alias("md5"))


def chunk_words_overlap(spark, sf_dir):
    w = C.word_chunks(_docs(spark, sf_dir), 64, 16)
    return w.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.md5("chunk").alias("md5"))


def chunk_reassemble(spark, sf_dir):
    return C.reassembled(streams.segments(_stream(spark, sf_dir), 512))


def bytes_padded(spark, sf_dir):
    n = F.octet_length("html").cast("bigint")
    return _table(spark, sf_dir, "pages").where("html is not null and octet_length(html) > 0").select("page_id", n.alias("n"), C.padded_length(n).alias("padded"), C.padded_length(n).alias("_p")).select("page_id", "n", "padded", (F.col("_p") / 16).cast("bigint").alias("patches"))


def model_input_mask(spark, sf_dir):
    """Patches of a page's model input: extension, payload and end; the mask within the longest of the batch."""
    p = bytes_padded(spark, sf_dir).withColumn("used", F.col("patches") + 2).withColumn("batch", F.expr("page_id div 16"))
    p = p.withColumn("width", F.max("used").over(Window.partitionBy("batch")))
    m = C.mask(F.col("used").cast("int"), F.col("width").cast("int"))
    ext = C.extension_tokens(F.lit(".HTML"))
    return p.select("page_id", "used", "width", F.array_join(m, "").alias("mask"), F.array_join(ext, ",").alias("ext"))


def interval_groups(spark, sf_dir):
    g = C.grouped(_chunks(spark, sf_dir), 4)
    return g.groupBy("stream", "k", "is_tail").agg(F.count("*").alias("chunks"), F.sum("bytes").alias("bytes"))


def update_boundaries(spark, sf_dir):
    per = _chunks(spark, sf_dir).groupBy("stream").agg(F.count("*").alias("n_chunks"))
    return C.update_boundaries(per, 4)


def training_windows(spark, sf_dir):
    units = C.grouped(_chunks(spark, sf_dir), 4).where("not is_tail").groupBy("stream", "k").agg(F.sum("bytes").alias("bytes"))
    return C.training_windows(units, 768)


def coding_order_permuted(spark, sf_dir):
    return C.permuted(_chunks(spark, sf_dir), 7).select("stream", "chunk", "coded_at")


def coding_order_restored(spark, sf_dir):
    """Hashes of chunks as they are coded, in permuted order, and brought back: of the sequence as coded and as restored."""
    parts = streams.segments(_stream(spark, sf_dir), 512).groupBy("stream", F.col("unit").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("start", F.hex("data").alias("h")))).alias("p"))
    coded = C.permuted(parts.select("stream", "chunk", F.md5(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("h")), 7)
    # the decoder knows the order from the chunks' numbers and the seed alone
    order = C.permuted(_chunks(spark, sf_dir), 7).select("stream", "coded_at", F.col("chunk").alias("place"))
    back = coded.select("stream", "coded_at", "h").join(order, ["stream", "coded_at"])
    chain = lambda c: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(c, "h"))), lambda x: x["h"]), ""))
    return back.groupBy("stream").agg(chain("coded_at").alias("as_coded"), chain("place").alias("restored"), F.count("*").alias("n"))


def prefix_cap_bytes(spark, sf_dir):
    kept = C.prefix_cap(_stream(spark, sf_dir), 10_000)
    return kept.groupBy("stream").agg(F.count("*").alias("docs"), F.sum(F.octet_length("data")).alias("bytes"))


def max_chunks_whole_item(spark, sf_dir):
    items = _docs(spark, sf_dir).select(F.col("source").alias("stream"), F.col("doc_id").alias("seq"), F.ceil(F.octet_length("text") / 512).alias("n_chunks"))
    return C.capped_items(items, 64).groupBy("stream").agg(F.count("*").alias("items"), F.sum("n_chunks").alias("chunks"))


def context_tail(spark, sf_dir):
    """The last 32 characters said before each turn of a conversation."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda x: x != "").alias("t"))
    out = C.context_tail(rows, 32, run="conv_id", order="turn", tokens="t")
    return out.select("conv_id", "turn", F.array_join("tail", "").alias("tail"))


def varint_lengths(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.varint_length(F.col("n_chars")).alias("len_chars"), T.varint_length(F.col("doc_id")).alias("len_id"))


def char_diff_subs(spark, sf_dir):
    """Characters that lower-casing changes."""
    d = _docs(spark, sf_dir).select("text", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("low"))
    return T.substitutions(d, "text", "low")


def char_diff_multiset(spark, sf_dir):
    """Characters that collapsing white space removes or adds."""
    d = _docs(spark, sf_dir).select("text", F.regexp_replace("text", "[ \n]+", "_").alias("flat"))
    return T.multiset_difference(d, "text", "flat")


def changed_chunks(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "text", F.replace("text", F.lit("the"), F.lit("THE")).alias("new"))
    return T.changed_chunks(d, "text", "new").select("doc_id", "n_chunks", "n_changed")


def tokenizer_tag(spark, sf_dir):
    names = ["Qwen/Qwen3-1.7B", "models/qwen2.5-7b/", "Org/Some_Model v2", "gpt2", "a/b/--X--", "org/my-qwen2"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    return rows.select("name", T.tokenizer_tag(F.col("name")).alias("tag"))


def parse_size(spark, sf_dir):
    rows = spark.createDataFrame([(n,) for n in ("10", "1_000", "10K", "2.5mb", "1G", "3gb", "0.5k")], "size string")
    return rows.select("size", T.parse_size(F.col("size")).alias("bytes"))


def human_bytes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.human_bytes(F.col("n_chars")).alias("shown"))


def autopick_text_column(spark, sf_dir):
    return T.widest_text_column(_docs(spark, sf_dir))


def row_to_text(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.md5(T.first_present(["role", "text"])).alias("md5"), F.md5(T.strict_concat(["role", "text"])).alias("joined"))


def records_skip_then_take(spark, sf_dir):
    """Skip 5 records, take 40, then drop empty texts (every seventh is made empty): fewer than 40 remain."""
    some = _docs(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 7 != 0, F.col("text")).otherwise(F.lit("")))
    return readers.records(some, "doc_id", skip=5, n=40).select("doc_id", "n_chars")


def domain_spans(spark, sf_dir):
    """Runs of documents of one language in order of doc_id, within blocks of 1000 ids."""
    d = _docs(spark, sf_dir).select("doc_id", "lang", F.expr("doc_id div 1000").alias("block"))
    w = Window.partitionBy("block").orderBy("doc_id")
    d = d.withColumn("new", (~F.col("lang").eqNullSafe(F.lag("lang").over(w))).cast("int")).withColumn("span", F.sum("new").over(w))
    return d.groupBy("block", "span", "lang").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n"))


def domain_spans_whole(spark, sf_dir):
    """Runs of documents of one language in order of doc_id, over all ids: runs within blocks, joined by a scan over one row per block."""
    d = _docs(spark, sf_dir).select("doc_id", "lang", F.expr("doc_id div 1000").alias("block"))
    w = Window.partitionBy("block").orderBy("doc_id")
    d = d.withColumn("new", F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col("lang").eqNullSafe(F.lag("lang").over(w))).cast("int"))).withColumn("run", F.sum("new").over(w))
    runs = d.groupBy("block", "run", "lang").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n"))
    # the language in a struct: min_by and max_by give null for a null language too, but a struct is told from no block before
    ends = runs.groupBy("block").agg(F.max("run").alias("runs"), F.min_by(F.struct("lang"), "run").alias("begin"), F.max_by(F.struct("lang"), "run").alias("end"))
    over = Window.orderBy("block")
    before = F.lag("end").over(over)
    ends = ends.withColumn("goes_on", (before.isNotNull() & before["lang"].eqNullSafe(F.col("begin")["lang"])).cast("int"))
    ends = ends.select("block", (F.sum(F.col("runs") - F.col("goes_on")).over(over) - F.col("runs")).alias("before"))
    return runs.join(ends, "block").groupBy((F.col("before") + F.col("run")).alias("span"), "lang").agg(F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("n").alias("n"))


def length_stats(spark, sf_dir):
    n = F.col("n_chars")
    p = lambda x: F.floor(F.percentile(n, x))
    s = _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.avg(n).alias("m"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.max(n).alias("max"))
    return s.select("lang", "n", S.q6(F.col("m")).alias("mean"), "p50", "p90", "p95", "p99", "max", S.q6(F.col("p99") / F.greatest("p50", F.lit(1))).alias("tail_ratio"))


def length_batches(spark, sf_dir):
    """Documents of a source sorted by length, in batches of eight."""
    w = Window.partitionBy("source").orderBy("n_chars", "doc_id")
    d = _docs(spark, sf_dir).withColumn("batch", F.expr("(row_number() over (partition by source order by n_chars, doc_id) - 1) div 8").cast("bigint"))
    del w
    return d.groupBy("source", "batch").agg(F.count("*").alias("n"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))


def device_shards(spark, sf_dir):
    """Documents dealt to four workers in turn."""
    d = _docs(spark, sf_dir).withColumn("worker", F.pmod("doc_id", F.lit(4)))
    return d.groupBy("worker").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def batch_sizes(spark, sf_dir):
    """Batch that fits free memory: three quarters of it over what one item takes, within 1 and 64 and the items there are."""
    d = _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))
    fit = F.floor(F.lit(1_000_000) * 0.75 / F.col("longest"))
    return d.select("source", F.greatest(F.lit(1), F.least(F.lit(64).cast("bigint"), F.col("n"), fit)).cast("bigint").alias("batch"))


def image_patch_grid(spark, sf_dir):
    """Cells of images as wide and high as a part's size and key suggest."""
    p = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 8).alias("w"), (F.col("p_partkey") % 40 + 5).cast("int").alias("h"))
    g = p.select("p_partkey", F.explode(C.patch_grid(F.col("w"), F.col("h"), 16)).alias("c"))
    return g.groupBy("p_partkey").agg(F.count("*").alias("cells"), F.max("c.x").cast("bigint").alias("last_x"), F.max("c.y").cast("bigint").alias("last_y"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_text_fixed, chunk_docs_windows, chunk_words_overlap, chunk_reassemble, bytes_padded, model_input_mask, interval_groups,
        update_boundaries, training_windows, coding_order_permuted, coding_order_restored, prefix_cap_bytes, max_chunks_whole_item, context_tail,
        varint_lengths, char_diff_subs, char_diff_multiset, changed_chunks, tokenizer_tag, parse_size, human_bytes, autopick_text_column,
        row_to_text, records_skip_then_take, domain_spans, domain_spans_whole, length_stats, length_batches, device_shards, batch_sizes, image_patch_grid,
    )
}

_CH = "sizes AS (SELECT source AS stream, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS size FROM documents GROUP BY 1),\nch AS (SELECT stream, chunk, least(512, size - chunk * 512)::BIGINT AS bytes FROM (SELECT stream, size, unnest(range((size + 511) // 512)) AS chunk FROM sizes))"
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda x: x <> '')"
_PAGES = "pg AS (SELECT page_id, octet_length(encode(html))::BIGINT AS n FROM pages WHERE html IS NOT NULL AND html <> ''),\npp AS (SELECT page_id, n, n + (16 - n % 16) % 16 AS padded, (n + (16 - n % 16) % 16) // 16 AS patches FROM pg)"

ORACLE_SQL = {
    "chunk_text_fixed": S.query(S.COUNTS.rsplit("cnt AS", 1)[0].rstrip().rstrip(","), select="SELECT stream, pos // 512 AS chunk, md5(string_agg(upper(lpad(to_hex(sym), 2, '0')), '' ORDER BY pos)) AS md5 FROM bytes_at GROUP BY ALL"),
    "chunk_docs_windows": "SELECT doc_id AS doc_idx, i AS chunk_idx, greatest((length(t) + 255) // 256, 1)::BIGINT AS total_chunks, length(substr(t, i * 256 + 1, 256))::BIGINT AS n_tokens, md5(substr(t, i * 256 + 1, 256)) AS md5 FROM (SELECT doc_id, coalesce(text, '') AS t, unnest(range(greatest((length(coalesce(text, '')) + 255) // 256, 1)))::BIGINT AS i FROM documents)",
    "chunk_words_overlap": f"WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents) SELECT doc_id, i::BIGINT AS pos, md5(array_to_string(words[i * 48 + 1 : i * 48 + 64], ' ')) AS md5 FROM (SELECT doc_id, words, unnest(range((len(words) + 47) // 48)) AS i FROM w WHERE len(words) > 0)",
    "chunk_reassemble": "SELECT source AS stream, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes, md5(string_agg(coalesce(text, ''), '' ORDER BY doc_id)) AS md5 FROM documents GROUP BY 1",
    "bytes_padded": S.query(_PAGES, select="SELECT * FROM pp"),
    "model_input_mask": S.query(_PAGES, "u AS (SELECT page_id, patches + 2 AS used, max(patches + 2) OVER (PARTITION BY page_id // 16) AS width FROM pp)", select="SELECT page_id, used, width, repeat('1', used) || repeat('0', width - used) AS mask, '104,116,109,108' AS ext FROM u"),
    "interval_groups": S.query(_CH, select="SELECT stream, chunk // 4 AS k, count(*) < 4 AS is_tail, count(*)::BIGINT AS chunks, sum(bytes)::BIGINT AS bytes FROM ch GROUP BY stream, chunk // 4"),
    "update_boundaries": S.query(_CH, "n AS (SELECT stream, count(*)::BIGINT AS n_chunks FROM ch GROUP BY 1)", select="SELECT stream, n_chunks, unnest(range(4, n_chunks, 4)) AS boundary FROM n"),
    "training_windows": S.query(_CH, "g AS (SELECT stream, chunk // 4 AS k, sum(bytes)::BIGINT AS n FROM ch GROUP BY ALL HAVING count(*) = 4)", select="SELECT * FROM (SELECT stream, k, w AS window, least(768, n - w * 768)::BIGINT AS length FROM (SELECT *, unnest(range((n + 767) // 768)) AS w FROM g)) WHERE length >= 2"),
    "coding_order_permuted": S.query(_CH, select="SELECT stream, chunk, row_number() OVER (PARTITION BY stream ORDER BY md5('7:' || chunk), chunk) - 1 AS coded_at FROM ch"),
    "coding_order_restored": S.query(
        S.COUNTS.rsplit("cnt AS", 1)[0].rstrip().rstrip(","),
        "hs AS (SELECT stream, pos // 512 AS chunk, md5(string_agg(upper(lpad(to_hex(sym), 2, '0')), '' ORDER BY pos)) AS h FROM bytes_at GROUP BY ALL)",
        select="SELECT stream, md5(string_agg(h, '' ORDER BY md5('7:' || chunk), chunk)) AS as_coded, md5(string_agg(h, '' ORDER BY chunk)) AS restored, count(*)::BIGINT AS n FROM hs GROUP BY 1",
    ),
    "prefix_cap_bytes": "WITH p AS (SELECT source AS stream, octet_length(encode(coalesce(text, ''))) AS n, sum(octet_length(encode(coalesce(text, '')))) OVER (PARTITION BY source ORDER BY doc_id) - octet_length(encode(coalesce(text, ''))) AS start FROM documents) SELECT stream, count(*)::BIGINT AS docs, sum(least(n, 10000 - start))::BIGINT AS bytes FROM p WHERE start < 10000 GROUP BY 1",
    "max_chunks_whole_item": "WITH p AS (SELECT source AS stream, doc_id, ceil(octet_length(encode(text)) / 512.0)::BIGINT AS n FROM documents), q AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY stream ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM p) SELECT stream, count(*)::BIGINT AS items, sum(n)::BIGINT AS chunks FROM q WHERE seen = 0 OR seen + n <= 64 GROUP BY 1",
    "context_tail": "SELECT conv_id, turn, nullif(right(string_agg(coalesce(text, ''), '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 32), '') AS tail FROM conversations",
    "varint_lengths": "SELECT doc_id, greatest(1, ceil(length(bin(n_chars)) / 7.0))::BIGINT AS len_chars, greatest(1, ceil(length(bin(doc_id)) / 7.0))::BIGINT AS len_id FROM documents",
    "char_diff_subs": "SELECT old, new, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(text, '')) AS old, unnest(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')) AS new FROM documents) WHERE old <> new GROUP BY ALL",
    "char_diff_multiset": "WITH a AS (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY 1), b AS (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(text, '[ \n]+', '_', 'g'), '')) AS c FROM documents) WHERE c <> '' GROUP BY 1) SELECT coalesce(a.c, b.c) AS char, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0)::BIGINT AS removed, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0)::BIGINT AS added FROM a FULL JOIN b ON a.c = b.c WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)",
    "changed_chunks": "WITH d AS (SELECT doc_id, text AS a, replace(text, 'the', 'THE') AS b, (length(text) + 2047) // 2048 AS n FROM documents), x AS (SELECT doc_id, n, (substr(a, i * 2048 + 1, 2048) <> substr(b, i * 2048 + 1, 2048))::INT AS ch FROM (SELECT *, unnest(range(n)) AS i FROM d)) SELECT d.doc_id, d.n::BIGINT AS n_chunks, coalesce(sum(ch), 0)::BIGINT AS n_changed FROM d LEFT JOIN x USING (doc_id) GROUP BY d.doc_id, d.n",
    "tokenizer_tag": "SELECT name, tag FROM (VALUES ('Qwen/Qwen3-1.7B', 'qwen3'), ('models/qwen2.5-7b/', 'qwen2.5'), ('Org/Some_Model v2', 'some-model-v2'), ('gpt2', 'gpt2'), ('a/b/--X--', 'x'), ('org/my-qwen2', 'my-qwen2')) AS t(name, tag)",
    "parse_size": "SELECT size, bytes::BIGINT AS bytes FROM (VALUES ('10', 10), ('1_000', 1000), ('10K', 10240), ('2.5mb', 2621440), ('1G', 1073741824), ('3gb', 3221225472), ('0.5k', 512)) AS t(size, bytes)",
    "human_bytes": "SELECT doc_id, CASE WHEN n_chars >= 1048576 THEN printf('%.1fMB', n_chars / 1048576.0) WHEN n_chars >= 1024 THEN printf('%.1fKB', n_chars / 1024.0) ELSE printf('%.1fB', n_chars::DOUBLE) END AS shown FROM documents",
    "autopick_text_column": "SELECT * FROM (SELECT 'text' AS \"column\", sum(length(text))::BIGINT AS chars FROM documents UNION ALL SELECT 'lang', sum(length(lang))::BIGINT FROM documents UNION ALL SELECT 'source', sum(length(source))::BIGINT FROM documents) ORDER BY chars DESC, 1 LIMIT 1",
    "row_to_text": "SELECT conv_id, turn, md5(concat_ws(chr(10), nullif(role, ''), nullif(text, ''))) AS md5, md5(role || text) AS joined FROM conversations",
    "records_skip_then_take": "SELECT doc_id, n_chars FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 40 OFFSET 5) WHERE doc_id % 7 <> 0 AND text <> ''",
    "domain_spans": "WITH a AS (SELECT doc_id, lang, doc_id // 1000 AS block, (lang IS DISTINCT FROM lag(lang) OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id))::INT AS new FROM documents), b AS (SELECT *, sum(new) OVER (PARTITION BY block ORDER BY doc_id)::BIGINT AS span FROM a) SELECT block, span, lang, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*)::BIGINT AS n FROM b GROUP BY block, span, lang",
    "length_stats": S.query("s AS (SELECT lang, count(*)::BIGINT AS n, avg(n_chars) AS m, floor(quantile_cont(n_chars, 0.5))::BIGINT AS p50, floor(quantile_cont(n_chars, 0.9))::BIGINT AS p90, floor(quantile_cont(n_chars, 0.95))::BIGINT AS p95, floor(quantile_cont(n_chars, 0.99))::BIGINT AS p99, max(n_chars) AS max FROM documents GROUP BY 1)", select="SELECT lang, n, round(m, 6) AS mean, p50, p90, p95, p99, max, round(p99 / greatest(p50, 1), 6) AS tail_ratio FROM s"),
    "length_batches": "SELECT source, batch, count(*)::BIGINT AS n, min(n_chars) AS shortest, max(n_chars) AS longest FROM (SELECT source, n_chars, (row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1) // 8 AS batch FROM documents) GROUP BY ALL",
    "device_shards": "SELECT doc_id % 4 AS worker, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1",
    "batch_sizes": "SELECT source, greatest(1, least(64, count(*), floor(1000000 * 0.75 / max(n_chars))))::BIGINT AS batch FROM documents GROUP BY 1",
    "image_patch_grid": "SELECT p_partkey, (ceil((p_size + 8) / 16.0) * ceil((p_partkey % 40 + 5) / 16.0))::BIGINT AS cells, (16 * (ceil((p_size + 8) / 16.0) - 1))::BIGINT AS last_x, (16 * (ceil((p_partkey % 40 + 5) / 16.0) - 1))::BIGINT AS last_y FROM part",
}
