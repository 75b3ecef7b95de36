"""Readers and sinks on small files."""

import json
import sys
import types
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.functions import texts
from tidemark.operators import chunking, codecs, rate
from tidemark.sources import readers, sinks


def test_text_shards(spark, tmp_path):
    for i, t in enumerate(("ab\n", "cdé")):
        (tmp_path / f"part-{i:03}.txt").write_text(t)
    (tmp_path / "other.txt").write_text("no")
    rows = readers.text_shards(spark, str(tmp_path), cap=6).orderBy("seq").collect()
    assert [bytes(r.data) for r in rows] == [b"ab\n", "cdé".encode()[:3]]
    got = readers.text_shards(spark, str(tmp_path), cap=6).select(readers.valid_text(F.col("data")).alias("t")).collect()
    assert {r.t for r in got} == {"ab\n", "cd"}


def test_json_lines(spark, tmp_path):
    lines = ['{"text": "a"}', "", "oops", '{"text": ""}', '{"text": "b"}', '{"text": "c"}']
    p = tmp_path / "x.jsonl"
    p.write_text("\n".join(lines))
    assert [r.text for r in readers.json_lines(spark, str(p), skip=1, n=1).collect()] == ["b"]


def test_registry(spark):
    readers.loader("tiny_set")(lambda s, p: s.range(1))
    assert readers.load(spark, "/x/Tiny-Set/").count() == 1
    with pytest.raises(ValueError, match="there are"):
        readers.load(spark, "/x/other")


def test_members_and_media(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("t.txt", "hi")
        z.writestr("__MACOSX/t.txt", "no")
    assert [(r.name, bytes(r.data)) for r in readers.members(spark, str(tmp_path)).collect()] == [("t.txt", b"hi")]
    (tmp_path / "p.PNG").write_bytes(b"1")
    assert readers.media(spark, str(tmp_path), readers.IMAGES).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.media(spark, str(tmp_path), readers.AUDIO)


def test_results(spark, tmp_path):
    run = tmp_path / "0001"
    run.mkdir()
    one = {"mode": "static", "chunk_lengths": [4, 4], "chunk_bits": [30, 30]}
    (run / "result.json").write_text(json.dumps({"args": {"lr": "1"}, "config": {}, "results": [one, one | {"mode": "online", "chunk_bits": [30, 20]}]}))
    (tmp_path / "0002").mkdir()
    (tmp_path / "0002" / "result.json").write_text('{"results": []}')
    r = readers.run_results(spark, str(tmp_path / "*" / "result.json"))
    assert [(x.run_id, x.problem) for x in readers.invalid_results(r).collect()] == [("0002", "no results")]
    long = readers.chunk_records(r)
    assert rate.check_layout(long).first().same_layout and long.count() == 4


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("k", i, n) for i, n in enumerate((5, 6, 1, 20, 1))], "key string, at int, n long")
    assert [r.shard for r in sinks.roll(rows, 10, key="key", order="at", size="n").orderBy("at").collect()] == [0, 0, 1, 1, 2]
    assert [r.bytes for r in sinks.slices(spark.createDataFrame([("k", 0), ("m", 11)], "key string, size long"), 10).orderBy("key", "shard").collect()] == [0, 10, 1]
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "mine").write_text("x")
    with pytest.raises(FileExistsError):
        sinks.guarded(rows, str(tmp_path / "out"))
    sinks.guarded(rows, str(tmp_path / "new"))
    sinks.guarded(rows, str(tmp_path / "new"))


def test_codecs(spark):
    d = spark.createDataFrame([("a", bytearray(b"x" * 5000))], "key string, data binary")
    rows = {r.codec: r for r in codecs.baselines(d, "key").collect()}
    assert rows["zlib"].status == "ok" and rows["zlib"].compressed < 100 and rows["cmix"].status == "skipped"
    pieces = {r.codec: r for r in codecs.baselines(d, "key", piece=2048).collect()}
    assert pieces["zlib"].compressed > rows["zlib"].compressed


def test_codecs_over_whole_documents(spark, tmp_path):
    docs = [(1, "a", "to be or not " * 500), (2, "a", None), (3, "b", "x" * 3000)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.codec, r.source): (r.original, r.compressed) for r in registry.queries()["codec_baselines_whole"](spark, str(tmp_path)).collect()}
    size = lambda t: len(zlib.compress((t or "").encode(), 9))
    assert got["zlib", "a"] == (6500, size(docs[0][2]) + size(None)) and got["zlib", "b"] == (3000, size(docs[2][2]))
    assert got["zlib", None] == (9500, sum(size(t) for _, _, t in docs))


def test_brotli_where_installed(monkeypatch):
    monkeypatch.setitem(sys.modules, "brotli", types.SimpleNamespace(compress=lambda raw, quality: raw[:quality]))
    assert codecs.size("brotli", b"x" * 50) == 11
    monkeypatch.setitem(sys.modules, "brotli", None)
    assert codecs.size("brotli", b"x" * 50) is None


def test_texts(spark):
    df = spark.createDataFrame([("abc", "abd")], "a string, b string")
    assert [tuple(r) for r in texts.substitutions(df, "a", "b").collect()] == [("c", "d", 1)]
    assert {tuple(r) for r in texts.multiset_difference(df, "a", "b").collect()} == {("c", 1, 0), ("d", 0, 1)}
    grid = spark.range(1).select(chunking.patch_grid(F.lit(17), F.lit(16), 16).alias("g")).first().g
    assert [(c.x, c.y) for c in grid] == [(0, 0), (16, 0)]
    with pytest.raises(Exception, match="missing"):
        spark.createDataFrame([(None,)], "a string").select(texts.strict_concat(["a"])).collect()
