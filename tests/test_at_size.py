"""What keeps queries in proportion to their input: how they are planned, and that other cuts give the same rows."""

import lzma
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tidemark import registry
from tidemark.config import RunConfig
from tidemark.functions import coder, lanes
from tidemark.operators import codecs, context, costs, media, streams

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_media_are_made_and_cut_in_one_worker(spark):
    for name, workers in (("audio_clips", 1), ("image_patches", 1), ("audio_joined", 1), ("media_reconstructed", 2), ("image_retiled", 1)):
        text = plan(spark, name)
        assert text.count("MapInPandas") == workers and "FlatMapGroupsInPandas" not in text
        assert "lambda" not in text or name == "audio_joined"
        assert "REPARTITION_BY_NUM" in text  # a small file's media are not one task's


def test_bytes_are_summed_without_a_row_for_each():
    blobs = [b"", b"headA", b"headAB" + bytes([255]) * 300, b"he"]
    got = pd.concat(media.measured(4, "s")(iter([pd.DataFrame({"k": range(4), "blob": blobs})])))
    assert got["blob_bytes"].tolist() == [0, 5, 306, 2] and got["s"].tolist() == [sum(b[4:]) for b in blobs]


def test_many_images_are_put_together_at_once(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(w), int(h), bytearray(rng.integers(0, 256, 3 * w * h, dtype=np.uint8).tobytes())) for k, (w, h) in enumerate(rng.integers(1, 20, (40, 2)))]
    images = spark.createDataFrame(rows, "sample long, width int, height int, pixels binary")
    back = media.retiled(media.patches(images, 7), images.select("sample", "width", "height"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    sounds = spark.createDataFrame([(k, 8000, rng.uniform(-1, 1, 70 + k).tolist()) for k in range(20)], "sample long, rate int, pcm array<double>")
    whole = {r["sample"]: bytes(r.pcm) for r in media.joined(media.clips(sounds, 1)).collect()}  # nine stretches and more
    assert whole == {r["sample"]: bytes(((np.clip(np.array(r.pcm) * 32768, -32768, 32767).astype(int) >> 8) + 128).tolist()) for r in sounds.collect()}


def test_lzma_clears_no_more_than_a_value_needs():
    rng = np.random.default_rng(2)
    values = [b"", b"a", b"to be or not " * 150, bytes(2048), rng.integers(0, 256, 2048, dtype=np.uint8).tobytes(), rng.integers(0, 3, 30_000, dtype=np.uint8).tobytes(), b"abcd" * 20_000 + b"x"]
    start = time.process_time()
    want = [len(lzma.compress(v, format=lzma.FORMAT_ALONE, preset=9 | lzma.PRESET_EXTREME)) for v in values]
    whole, start = time.process_time() - start, time.process_time()
    assert [codecs.size("lzma", v) for v in values] == want
    assert time.process_time() - start < whole / 2


def test_codecs_are_dealt_to_more_tasks_than_files(spark):
    assert "REPARTITION_BY_NUM" in plan(spark, "codec_baselines") and "REPARTITION_BY_NUM" in plan(spark, "codec_baselines_whole")


def test_context_cells_over_streams_of_any_length(spark, monkeypatch):
    rng = np.random.default_rng(3)
    text = lambda n: "".join(rng.choice(list("abcd é"), n))
    rows = [(f"s{s}", t, text(int(n))) for s in range(6) for t, n in enumerate(rng.integers(0, 90, 5))] + [("long", t, text(700)) for t in range(3)] + [(None, 0, "left out"), ("z", 0, None), ("one", 2, "x")]
    docs = spark.createDataFrame(rows, "stream string, seq long, text string").repartition(3)
    for chunk, interval in ((8, 1), (8, 3)):
        want = set()
        for ctx in (0, 1):
            pairs = context.pair_counts(streams.as_stream(docs.where("stream is not null"), stream="stream", order="seq"), chunk, interval, ctx)
            for mode in ("static", "online"):
                want |= {(r.stream, ctx, mode, r.bits) for r in context.cell(pairs, mode == "online").collect()}
        for at_once in (1, 24, 50, 1 << 18):  # streams end and go on within and between what is taken at once
            run = context._walk(chunk, interval, (0, 1))
            monkeypatch.setattr(context, "AT_ONCE", at_once)
            seen: dict = {}
            ordered = sorted(((s, t, (x or "").encode()) for s, t, x in rows if s is not None), key=lambda r: r[:2])
            batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[2] for r in part], pa.binary())], ["stream", "data"]) for part in (ordered[:4], ordered[4:30], ordered[30:])]
            for b in run(iter(batches)):
                for r in b.to_pylist():
                    key = r["stream"], r["ctx"], r["mode"]
                    seen[key] = seen.get(key, 0) + r["bits"]
            assert {(*k, v) for k, v in seen.items()} == want
        assert {tuple(r) for r in context.cells(streams.rows_of(docs, stream="stream", order="seq"), chunk, interval, (0, 1)).collect()} == want


def test_context_cells_shuffle_texts_once(spark):
    for name in ("context_cells", "context_square", "context_table"):
        text = plan(spark, name)
        assert text.count("MapInArrow") == 1 and text.count("Scan parquet") == 1 and "Generate" not in text and "Join" not in text


@pytest.mark.parametrize("name", ["online_cost_all_seen", "online_cost_pretrained", "interval_measures", "branch_records"])
def test_spans_of_any_width_give_the_same_costs(spark, monkeypatch, name):
    rows = lambda: sorted(map(str, registry.queries()[name](spark, SF).collect()))
    want = rows()
    for chunks in (4, 12):
        monkeypatch.setattr(costs, "SPAN_CHUNKS", chunks)
        assert rows() == want


def test_costs_are_worked_out_without_joins(spark):
    text = plan(spark, "interval_measures")
    assert text.count("MapInArrow") == 2 and "Join" not in text  # counts of spans, and the costs
    assert "MapInArrow" not in plan(spark, "branch_percent") + plan(spark, "gk_cumulative_regret") + plan(spark, "rate_cumulative")  # made once, then read


def test_lanes_code_as_the_coder_does(spark):
    rng = np.random.default_rng(4)
    blocks = [rng.integers(0, 256, 5000, dtype=np.uint8).tobytes(), b"a" * 3000, bytes(1), b"to be or not to be " * 190, rng.integers(0, 2, 2048, dtype=np.uint8).tobytes(), b"\0\xff" * 33_000, bytes(rng.geometric(0.3, 70_000).clip(0, 255).astype(np.uint8))]
    config = RunConfig()
    rows = [(f"s{i}", d[at : at + 700], at) for i, d in enumerate(blocks) for at in range(0, len(d), 700)] + [(None, b"no stream", 0)]
    stream = spark.createDataFrame([(s, bytearray(d), at) for s, d, at in rows], "stream string, data binary, start long")
    settings = {"hash": config.settings_hash("online"), "interval": config.train_interval}
    for block in (4096, 65_536):
        want = set()
        for name, d in [*((f"s{i}", d) for i, d in enumerate(blocks)), (None, b"no stream")]:
            for k, at in enumerate(range(0, len(d), block)):
                part = d[at : at + block]
                chunks = [part[i : i + config.chunk_size] for i in range(0, len(part), config.chunk_size)]
                packed = coder.compress(chunks, interval=config.train_interval, online=True, settings=settings)
                assert coder.decompress(packed, interval=config.train_interval, online=True, settings=settings) == part
                want.add((name, k, len(part), len(packed), sum(map(len, coder.parse(packed)[4])), True))
        assert {tuple(r) for r in codecs.round_trip(stream, config, block=block).collect()} == want
    chunks = np.frombuffer(blocks[0][:512], np.uint8).reshape(1, 512)
    below, state = lanes.tables(chunks, np.array([512]), np.array([0]), np.array([0]), 4)
    payload = lanes.encode(chunks, np.array([512]), below, state)
    assert (lanes.decode(payload, np.array([512]), below, state) == chunks).all()
    assert (lanes.decode([payload[0][:9] + b"?" + payload[0][10:]], np.array([512]), below, state) != chunks).any()


def test_round_trips_have_no_group_of_pandas_each(spark):
    for name in ("roundtrip_check", "eval_per_doc", "eval_totals"):
        assert "FlatMapGroupsInPandas" not in plan(spark, name)
