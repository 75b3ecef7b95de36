"""Runs, media, ingest, and the cases at the edge of the measurements; expectations are worked out by hand."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import run
from tidemark.config import RunConfig
from tidemark.functions import coder
from tidemark.functions import texts as T
from tidemark.operators import adjacency, branch, gk, ledger, media, mixing, streams
from tidemark.sources import ingest, sinks


def test_streams_keep_every_row(spark):
    rows = [("a", 1, "xx"), ("a", 1, "y"), (None, 2, "zzz"), ("a", None, "q"), ("a", 9000, "w"), (None, 2, None)]
    got = streams.as_stream(spark.createDataFrame(rows, "source string, doc_id long, text string")).collect()
    places = {(r.stream, r.seq, bytes(r.data)): r.start for r in got}
    assert len(got) == 6
    assert places == {("a", None, b"q"): 0, ("a", 1, b"xx"): 1, ("a", 1, b"y"): 3, ("a", 9000, b"w"): 4, (None, 2, b""): 0, (None, 2, b"zzz"): 0}


def records(spark, t, pre):
    return spark.createDataFrame([(k, "d", 4, float(p), float(p - x), float(p), float(p)) for k, (x, p) in enumerate(zip(t, pre))], "k long, domain string, h int, adj_pre double, adj_post double, ctrl_pre double, ctrl_post double")


def test_bootstrap_of_few_boundaries(spark):
    one = adjacency.bootstrap(records(spark, [3], [10])).first()
    assert math.isnan(one.lo) and math.isnan(one.hi)
    none = adjacency.bootstrap(records(spark, [], []).limit(0)).first()
    assert none is None or none.lo is None or math.isnan(none.lo)
    flat = adjacency.bootstrap(records(spark, [1, 2], [0, 0]), n_boot=50).first()
    assert (flat.lo, flat.hi) == (0.0, 0.0)
    same = adjacency.bootstrap(records(spark, [1, 1, 1], [10, 10, 10]), n_boot=50).first()
    assert (same.lo, same.hi) == (10.0, 10.0)


def verdict_of(spark, t=2.0, g=3.0, share=0.5, p=0.01, lo=0.5, lobo=0.2, same=True):
    row = spark.createDataFrame([(t, g, share, p, lo, lobo, same)], "t double, g double, share double, p double, lo double, lobo double, same boolean")
    name, why = adjacency.verdict(*(F.col(c) for c in ("t", "g", "share", "p", "lo", "lobo", "same")))
    r = row.select(name.alias("v"), why.alias("w")).first()
    return r.v, list(r.w)


def test_verdicts(spark):
    assert verdict_of(spark) == ("PASS", [])
    assert verdict_of(spark, same=False) == ("FAIL", ["direction differs between datasets"])
    assert verdict_of(spark, lo=None)[0] == "FAIL" and verdict_of(spark, lo=float("nan"))[0] == "FAIL"
    assert verdict_of(spark, p=None)[0] == "FAIL" and verdict_of(spark, lobo=None)[1] == ["rests on one block"]
    assert verdict_of(spark, t=0.4)[0] == "SIGNIFICANT-BUT-SMALL" and verdict_of(spark, share=None)[0] == "SIGNIFICANT-BUT-SMALL"


def test_null_sample(spark):
    got = adjacency.null_sample(records(spark, [1], [50]), n_perm=40, seed=1).collect()
    assert len(got) == 40 and {r.t_pct for r in got} == {2.0, -2.0}


def test_guarded_wants_its_own_marker(spark, tmp_path):
    rows = spark.range(3)
    rows.write.parquet(str(tmp_path / "other"))
    with pytest.raises(FileExistsError):
        sinks.guarded(rows, str(tmp_path / "other"))
    sinks.guarded(rows, str(tmp_path / "mine"))
    sinks.guarded(spark.range(5), str(tmp_path / "mine"))
    assert spark.read.parquet(str(tmp_path / "mine")).count() == 5


def test_run_table(spark):
    docs = spark.createDataFrame([("s", 1, "ab" * 40), ("s", 2, "ab" * 40)], "source string, doc_id long, text string")
    config = RunConfig(chunk_size=32, train_interval=2, max_bytes=150)
    rows = run.chunk_table(streams.as_stream(docs), config).collect()
    static = sorted((r.chunk, r.length, r.chunk_bits) for r in rows if r.mode == "static")
    # under the empty state a byte costs log2(256) = 8 bits
    assert static == [(0, 32, 256), (1, 32, 256), (2, 32, 256), (3, 32, 256), (4, 22, 176)]
    online = {r.chunk: r.chunk_bits for r in rows if r.mode == "online"}
    # after 64 bytes, half of each: (32 + 0.5) / (64 + 128)
    assert online[0] == 256 and online[2] == 8 * math.ceil(-32 * math.log2(32.5 / 192) / 8)
    t = {r["mode"]: r for r in run.totals(run.chunk_table(streams.as_stream(docs), config)).collect()}
    assert t["static"].n_chunks == 5 and t["static"].payload_bytes == 150 and t["online"].payload_bytes < 150
    with pytest.raises(ValueError):
        run.boundary_table(streams.as_stream(docs), RunConfig(mode="static", measure_gk=True))
    assert run.boundary_table(streams.as_stream(docs), RunConfig(chunk_size=32, train_interval=2, measure_gk=True)).count() == 2


def test_payloads_agree_with_costs(spark):
    """The coder's payload of a chunk and the cost model's bits differ by its rounding to bytes alone."""
    text = b"the tide turns and the tide turns again, " * 30
    chunks = [text[i : i + 128] for i in range(0, len(text), 128)]
    packed = coder.compress(chunks, interval=4, online=True, settings={"hash": "x", "interval": 4})
    sizes = [len(p) for p in coder.parse(packed)[4]]
    docs = spark.createDataFrame([("s", 1, text.decode())], "source string, doc_id long, text string")
    rows = run.chunk_table(streams.as_stream(docs), RunConfig(chunk_size=128, train_interval=4, mode="online"))
    bits = [r.chunk_bits for r in rows.orderBy("chunk").collect()]
    assert len(bits) == len(sizes) and all(abs(8 * n - b) <= 0.04 * b + 32 for n, b in zip(sizes, bits))


def test_run_command(spark, tmp_path, capsys):
    spark.createDataFrame([("s", 1, "abc" * 30)], "source string, doc_id long, text string").write.parquet(str(tmp_path / "in"))
    (tmp_path / "good.json").write_text(json.dumps({"chunk_size": 16}))
    (tmp_path / "bad.json").write_text(json.dumps({"chunk_sizes": 16}))
    assert run.main([str(tmp_path / "good.json"), "--data", str(tmp_path / "in"), "--out", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
    assert run.main([str(tmp_path / "bad.json"), "--data", str(tmp_path / "in"), "--out", str(tmp_path / "new")]) == 2
    assert run.main([str(tmp_path / "good.json"), "--data", str(tmp_path / "none"), "--out", str(tmp_path / "new")]) == 1
    capsys.readouterr()


def test_bitmaps():
    rng = np.random.default_rng(1)
    for h, w in ((1, 1), (5, 3), (16, 16)):
        pixels = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        blob = media.bmp(pixels)
        assert blob[:2] == b"BM" and len(blob) == 54 + h * (-(-3 * w // 4) * 4)
        assert (media.bmp_pixels(blob) == pixels).all()
    with pytest.raises(ValueError):
        media.bmp_pixels(b"no bitmap")


def test_media_with_nothing(spark):
    images = spark.createDataFrame([(1, 2, 1, bytearray(b"abcdef")), (2, 4, 4, None)], "sample long, width int, height int, pixels binary")
    p = media.patches(images, 4)
    assert [(r["sample"], r["index"]) for r in p.collect()] == [(1, 0)]
    back = media.retiled(p, images.select("sample", "width", "height")).first()
    assert bytes(back.pixels) == b"abcdef" and (back.width, back.height) == (2, 1)
    sounds = spark.createDataFrame([(1, 8000, [0.0, 1.0, -1.0]), (2, 8000, None), (3, 8000, [])], "sample long, rate int, pcm array<double>")
    assert bytes(media.joined(media.clips(sounds, 1)).first().pcm) == bytes([128, 255, 0])
    with pytest.raises(ValueError):
        media.clips(sounds, 0)
    got = spark.createDataFrame([(0.5,), (2.0,), (-2.0,), (-0.00004,)], "x double").select(media.pcm16(F.col("x")).alias("v")).collect()
    assert [r.v for r in got] == [16384, 32767, -32768, -1]


def test_payload_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"hello")
    rows = spark.createDataFrame([(1, str(tmp_path / "a.bin")), (2, str(tmp_path / "b.bin")), (3, None)], "id long, path string")
    assert {r.id: r.data and bytes(r.data) for r in media.load_payloads(rows, "path").collect()} == {1: b"hello", 2: None, 3: None}


def test_distributions_and_bits(spark):
    p = T.pdf_normalised(spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 0.0)], "k string, n double"), "n", "k")
    assert sorted(r.p for r in p.collect()) == pytest.approx([1e-30, 0.25, 0.75])
    with pytest.raises(Exception, match="without mass"):
        T.pdf_normalised(spark.createDataFrame([("a", 0.0)], "k string, n double"), "n", "k").collect()
    bits = spark.createDataFrame([("101",), ("0000000100000010",)], "b string").select(T.padded_bits(F.col("b")).alias("b"))
    got = bits.select("b", T.bits_to_bytes(F.col("b")).alias("d")).select("b", "d", T.bytes_to_bits(F.col("d")).alias("again")).collect()
    assert [(r.b, bytes(r.d)) for r in got] == [("00000101", b"\x05"), ("0000000100000010", b"\x01\x02")] and all(r.b == r.again for r in got)


def test_ingest(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\n3,4\n")
    (tmp_path / "t.jsonl").write_text('{"a": 1}\n')
    cat = {"csv": ingest.DataSet(str(tmp_path / "t.csv"), "csv"), "lines": ingest.DataSet(str(tmp_path / "t.jsonl"), "jsonl", lambda df: df.where("a > 1")), "bad": ingest.DataSet(str(tmp_path / "none"), "text")}
    s = ingest.ingest(spark, cat, ["csv", "bad", "lines", "what"], out=str(tmp_path / "out"))
    assert [(r.name, r.status, r.rows) for r in s.orderBy("place").collect()] == [("csv", "ok", 2), ("bad", "failed", None), ("lines", "ok", 0), ("what", "failed", None)]
    assert ingest.exit_code(s) == 1 and ingest.exit_code(s.where("status = 'ok'")) == 0
    again = ingest.ingest(spark, cat, ["csv"], done={"csv"})
    assert again.first().status == "skipped" and ingest.ingest(spark, cat, ["csv"], done={"csv"}, force=True).first().status == "ok"
    (tmp_path / "side.json").write_text('{"x": 5}')
    (tmp_path / "broken.json").write_text("{")
    assert [r.x for r in ingest.sidecar(spark, str(tmp_path / "side.json"), "x int").collect()] == [5]
    assert ingest.sidecar(spark, str(tmp_path / "broken.json"), "x int").isEmpty() and ingest.sidecar(spark, str(tmp_path / "no.json"), "x int").isEmpty()


def test_short_sources_are_refused(spark):
    docs = spark.createDataFrame([("a", 1, "é\nb"), ("b", 1, "xy")], "lang string, doc_id long, text string")
    stream = streams.as_stream(docs, stream="lang")
    plan = mixing.targets(spark.createDataFrame([(0, "a", 1.0), (1, "b", 1.0)], "order int, dataset string, weight double"), 6)
    cut = mixing.ranges(mixing.safe_cuts(stream, plan))
    rows = mixing.verified(mixing.built(stream, cut)).orderBy("order").collect()
    assert [(r.dataset, r.bytes, r.exact, r.valid, r.switches) for r in rows] == [("a", 3, True, True, 1), ("b", 2, True, True, 1)]
    with pytest.raises(Exception, match="too short: b"):
        mixing.built(stream, cut, strict=True).collect()


def test_archive_checks():
    env = RunConfig().environment()
    meta = coder.archive_meta(RunConfig(), "online", env)
    coder.check_meta(meta, RunConfig(), "online", env)
    for bad, word in (({"role": "static"}, "role"), ({"modality": "image"}, "modality"), ({"settings": "0"}, "settings"), ({"environment": {}}, "environment")):
        with pytest.raises(ValueError, match=word):
            coder.check_meta(meta | bad, RunConfig(), "online", env)
    # the first difference is named
    with pytest.raises(ValueError, match="role"):
        coder.check_meta(meta | {"role": "static", "settings": "0"}, RunConfig(), "online", env)


def test_archives_as_tables(spark, tmp_path):
    docs = spark.createDataFrame([("s", 1, "tide " * 100), ("t", 1, "")], "source string, doc_id long, text string")
    sinks.write_archives(streams.as_stream(docs), RunConfig(chunk_size=64), str(tmp_path / "a"))
    back = {r.stream: bytes(r.data) for r in sinks.read_archives(spark, str(tmp_path / "a"), RunConfig(chunk_size=64)).collect()}
    assert back == {"s": b"tide " * 100}
    with pytest.raises(Exception, match="settings"):
        sinks.read_archives(spark, str(tmp_path / "a"), RunConfig(chunk_size=64, train_interval=9)).collect()


def test_empty_measurements(spark):
    none = spark.createDataFrame([], "run string, phase long, curr_tokens long, curr_bytes long, curr_pre double, curr_post double, curr_base double, next_tokens long, next_bytes long, next_pre double, next_post double")
    assert gk.summary(none).isEmpty()
    total = gk.total(none).first()
    assert (total.n, total.harmful_fraction, total.stream_g, total.transfer_efficiency) == (0, 0.0, 0.0, 0.0)
    assert spark.range(1).select(branch.percent(F.lit(2.0), F.lit(3), F.lit(0.0)).alias("x"), branch.percent(F.lit(2.0), F.lit(3), F.lit(60.0)).alias("y")).first()[:] == (0.0, 10.0)
    assert spark.range(1).select(ledger.rate_label(F.lit(0.0)).alias("r")).first().r == "skip"
