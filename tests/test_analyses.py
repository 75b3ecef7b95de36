"""Hand-computed expectations of the analyses."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.operators import adjacency, branch, chunking, context, gk, ledger, mixing, rate


def near(a, b, tol=1e-9):
    return abs(a - b) <= tol


@pytest.fixture
def boundaries(spark):
    rows = [("r", 0, 100, 400, 800.0, 760.0, 850.0, 100, 400, 800.0, 720.0), ("r", 1, 100, 400, 800.0, 600.0, 700.0, 100, 400, 800.0, 840.0)]
    return spark.createDataFrame(rows, "run string, phase int, curr_tokens long, curr_bytes long, curr_pre double, curr_post double, curr_base double, next_tokens long, next_bytes long, next_pre double, next_post double")


def test_gk_signs_and_units(boundaries):
    g = {r.phase: r for r in gk.with_gains(boundaries).collect()}
    assert (g[0].g, g[1].g, g[0].din, g[1].din, g[0].regret, g[1].regret) == (80, -40, 40, 200, -50, 100)
    for unit, want in (("rel", 0.1), ("bpb", 0.2), ("bpt", 0.8)):
        assert near(gk.normalised(boundaries, unit).where("phase = 0").first().g, want)


def test_gk_summary(boundaries):
    b, r = gk.summary(boundaries, "bpb").first(), gk.summary(boundaries, "rel").first()
    assert near(b.harmful_fraction, 0.5) and near(b.mean_g, 0.05) and near(r.mean_g, 0.025)
    assert near(b.stream_g, 0.05) and near(r.stream_g, 0.025) and near(r.mean_din, 0.15)
    assert near(b.transfer_efficiency, 40 / 240) and near(b.worse_than_base, 0.5)
    assert near(r.stream_regret, 50 / 1550) and near(b.stream_regret, 50 / 800)
    assert [x.cum_regret for x in gk.cumulative_regret(boundaries).orderBy("phase").collect()] == [-50, 50]
    assert gk.regret_crossing(boundaries).first().first_phase == 1


def test_gk_without_base(boundaries):
    s = gk.summary(boundaries.withColumn("curr_base", F.lit(None).cast("double")), "bpb").first()
    assert not s.has_regret and near(s.mean_g, 0.05) and s.stream_regret == 0


@pytest.fixture
def cands(spark):
    nxt = {0: (100.0, 90.0, 80.0, 95.0), 1: (100.0, 95.0, 96.0, 100.0), 2: (100.0, 100.0, 99.99, 110.0)}
    cur = {0: (200.0, 180.0, 150.0, 140.0), 1: (200.0, 185.0, 170.0, 160.0), 2: (200.0, 190.0, 175.0, 165.0)}
    lrs = (0.0, 3e-5, 1e-4, 3e-4)
    rows = [("r", p, i, lr, cur[p][i], nxt[p][i]) for p in nxt for i, lr in enumerate(lrs)]
    return spark.createDataFrame(rows, "run string, phase int, pos int, lr double, curr_bits double, next_bits double").withColumn("phase", F.col("phase").cast("bigint"))


def test_branch(cands):
    b = {r.phase: r for r in branch.best(cands).collect()}
    assert (b[0].best_lr, b[0].best_bits, b[0].second_bits, b[0].near_tie) == (1e-4, 80, 90, False) and b[2].near_tie
    g = branch.gains(cands).where("phase = 0 and pos = 2").first()
    assert (g.g, g.din) == (20, 50)
    t = {r.lr: r for r in branch.totals(cands).collect()}
    assert near(t[1e-4].total, 275.99) and near(t[0.0].excess, 25.01) and near(t[3e-4].excess, 30.01, 1e-6) and near(t[1e-4].win_fraction, 2 / 3)
    o = branch.oracle(cands).first()
    assert o.best_fixed_lr == 1e-4 and near(o.oracle_total, 274.99) and near(o.headroom, 1 / 275.99, 1e-6)
    raw = [r.lr for r in branch.actions(cands).orderBy("phase").collect()]
    held = [r.lr for r in branch.actions(cands, stable=True).orderBy("phase").collect()]
    assert raw == [1e-4, 3e-5, 1e-4] and held == [1e-4, 3e-5, 3e-5]
    assert branch.switches(branch.actions(cands)).first().switches == 2


def test_branch_domains(spark):
    b = spark.createDataFrame([("r", 0, 400), ("r", 1, 400), ("r", 2, 400)], "run string, phase int, next_bytes long")
    blocks = spark.createDataFrame([("A", 0, 800), ("B", 800, 2000)], "dataset string, byte_start long, byte_end long")
    assert [r.domain for r in branch.with_domain(b, blocks).orderBy("phase").collect()] == ["A", "B", "B"]


def _records(spark, pairs):
    rows = [(k, "d", 4, 400.0, 400.0 - a, 400.0, 400.0 - c) for k, (a, c) in enumerate(pairs)]
    return spark.createDataFrame(rows, "k int, domain string, h int, adj_pre double, adj_post double, ctrl_pre double, ctrl_post double")


def test_adjacency_aggregate(spark):
    a = adjacency.aggregate(_records(spark, [(20, 8), (16, 12)])).first()
    assert near(a.t_pct, 2.0) and near(a.g_adj_pct, 4.5) and near(a.t_share, 16 / 36) and a.positive_fraction == 1 and near(a.mean_t, 8)


@pytest.mark.parametrize("pairs, want", [([(20, 8)] * 8, "PASS"), ([(20, 19)] * 8, "SIGNIFICANT-BUT-SMALL"), ([(8, 20)] * 8, "FAIL")])
def test_adjacency_verdict(spark, pairs, want):
    r = _records(spark, pairs)
    a, b = adjacency.aggregate(r).first(), adjacency.bootstrap(r, n_boot=500).first()
    p, lobo = adjacency.permutation(r).first().p, adjacency.leave_one_out(r).first().lobo_min
    name, _ = adjacency.verdict(*(F.lit(x) for x in (a.t_pct, a.g_adj_pct, a.t_share, p, b.lo, lobo, a.t_pct > 0)))
    assert spark.range(1).select(name).first()[0] == want


def test_adjacency_plan(spark):
    iv = spark.createDataFrame([(k, "d", 10) for k in range(40)], "k long, domain string, base long")
    plan = adjacency.plan(iv, h=4, k=4, n_target=3, seed=0).collect()
    ks = sorted({r.k for r in plan})
    assert len(ks) == 3 and all(b - a >= 5 for a, b in zip(ks, ks[1:]))
    for r in plan:
        assert 0 <= r.control <= 36 and abs(r.control - r.k) >= 8 and (r.control + 4 <= r.k or r.control >= r.k + 5)
    assert all(sum(r.k == k for r in plan) == 4 for k in ks)
    assert adjacency.plan(iv, h=4, k=100, n_target=3, seed=0).isEmpty()


def test_context_square(spark):
    cells = [("d", c, m, b) for c, s, o in ((0, 1000, 900), (2048, 950, 880), (6144, 900, 860)) for m, b in (("static", s), ("online", o))]
    sq = {r.ctx: r for r in context.squares(spark.createDataFrame(cells, "dataset string, ctx int, mode string, bits long")).collect()}
    a, b = sq[2048], sq[6144]
    assert (a.gain_b, a.gain_c, a.gain_d, a.d_vs_c, a.d_vs_b, a.additive, a.overlap) == (10, 5, 12, 7, 2, 15, 3)
    assert (b.gain_c, b.gain_d, b.d_vs_c) == (10, 14, 4)
    assert context.squares(spark.createDataFrame([("d", 2048, "static", 1)], "dataset string, ctx int, mode string, bits long")).isEmpty()


def test_context_tail(spark):
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate(([1, 2], [], [3], [4, 5]))], "stream string, chunk int, token_ids array<int>")
    tails = [r.tail for r in chunking.context_tail(rows, 3).orderBy("chunk").collect()]
    assert tails == [None, [1, 2], [1, 2], [1, 2, 3]]
    assert chunking.context_tail(rows, 0).where("tail is not null").isEmpty()


def test_rate(spark):
    df = spark.createDataFrame([("r", 0, 10, 80.0, 90.0), ("r", 1, 10, 80.0, 60.0)], "run string, chunk int, length long, static double, online double")
    assert rate.break_even(df).first()["first"] == 1
    s = rate.summary(df).first()
    assert near(s.delta_pct, 6.25) and s.static_payload == 20
    long = spark.createDataFrame([("r", "static", 0, 5), ("r", "online", 0, 6)], "run string, mode string, chunk int, length long")
    assert not rate.check_layout(long).first().same_layout


def test_ledger(spark):
    with pytest.raises(ValueError, match="modality.*both fixed"):
        ledger.validate({"grid": {"a": [1]}, "fixed": {"a": 2}})
    grid = ledger.expand(spark, {"modality": "text", "grid": {"lora_r": [4, 8], "b": ["x", "y"]}}).orderBy("run_id").collect()
    assert [(r.run_id, r.b, r.lora_r, r.lora_alpha) for r in grid] == [("0000", "x", 4, 8), ("0001", "x", 8, 16), ("0002", "y", 4, 8), ("0003", "y", 8, 16)]
    d = spark.createDataFrame([(1, 10, 5, 1), (1, 10, 5, -1), (2, 8, 4, 1)], "doc int, original_bytes long, compressed_bytes long, roundtrip_ok int")
    assert {r.doc: r.roundtrip_ok for r in ledger.per_document(d, "doc").collect()} == {1: 0, 2: 1}


def test_mixing_cut(spark):
    text = "aa\nbbé" + "c" * 10
    rows = spark.createDataFrame([("x", 0, bytearray(text.encode()), 0)], "stream string, seq long, data binary, start long")
    for target, want in ((6, 3), (3, 3), (99, 17)):
        plan = spark.createDataFrame([(0, "x", target)], "order int, dataset string, target long")
        assert mixing.safe_cuts(rows, plan).first().bytes == want


def test_padding(spark):
    df = spark.createDataFrame([([1, 256, 2],), ([],)], "t array<int>")
    got = [(len(r.p), r.u) for r in df.select(chunking.pad(F.col("t")).alias("p"), chunking.unpad(chunking.pad(F.col("t"))).alias("u")).collect()]
    assert got == [(16, [1, 256, 2]), (0, [])]
    assert math.isclose(1.0, 1.0)


def test_domain_spans_cross_blocks(spark, tmp_path):
    rng = random.Random(6)
    ids = sorted(rng.sample(range(9000), 3000)) + list(range(20_000, 20_003))
    langs = [("en", "fr", None)[i // 700 % 3] if i < 6000 else "de" for i in ids]
    langs[5] = "fr"
    spark.createDataFrame(list(zip(ids, langs, strict=True)), "doc_id long, lang string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for k, (_, group) in enumerate(itertools.groupby(zip(ids, langs, strict=True), key=lambda x: x[1])):
        group = list(group)
        want.append((k + 1, group[0][1], group[0][0], group[-1][0], len(group)))
    got = registry.queries()["domain_spans_whole"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == want
