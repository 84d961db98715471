"""Vectors worked by hand from the rules."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from takeline.functions import columns as C
from takeline.operators import decode, detections, evaluate, fusion, integrity, prior, sampling, spans
from takeline.schema import FRAME_LISTING, SPAN, TAKE


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_stamp(spark):
    names = ["Depth_2025-06-11_13-21-46.616_00000067_Color.png", "readme.png", "x_2025-06-11_00-00-00.000_00000000.json", "x_2025-06-11_13-21-46.61_00000067.png", None]
    got = spark.createDataFrame([(n,) for n in names], "f string").select(C.stamp(F.col("f")).alias("s")).collect()
    assert [r["s"] and tuple(r["s"]) for r in got] == [("2025-06-11", 48106616, 67), None, ("2025-06-11", 0, 0), None, None]


LISTING = [
    ("a", "Depth_Color", 0, "x_2025-06-11_00-00-01.000_00000010.png"), ("a", "Depth_Color", 0, "x_2025-06-11_00-00-01.900_00000019.png"), ("a", "IR", 1, "x_2025-06-11_00-00-09.000_00000001.png"),
    ("b", "Depth_Color", 0, "no.png"), ("b", "Depth_Color", 0, "nor.png"), ("b", "IR", 1, "x_2025-06-11_00-00-03.000_00000030.png"),
    ("c", "Skeleton", 2, "x_2025-06-11_00-00-05.000_00000040.json"), ("d", "root", 3, "nothing"),
]


def test_span_cascade(spark):
    df = spark.createDataFrame(LISTING, FRAME_LISTING)
    assert rows(spans.spans(df)) == [("a", "2025-06-11", 1000, 10, 1900, 19), ("b", "2025-06-11", 3000, 30, 3000, 30), ("c", "2025-06-11", 5000, 40, 5000, 40)]
    assert [r[0] for r in rows(spans.spans(spans.visible(df, "Skeleton_only")))] == ["c"]
    assert rows(spans.spans(spans.visible(df, "Depth_hidden")))[0][2] == 9000
    assert spans.spans(spans.visible(df, "all_clock_hidden")).count() == 0
    with pytest.raises(ValueError):
        spans.visible(df, "odd")


SPANS = [("c1", "D1", 1000, 10, 1900, 19), ("c2", "D1", 3000, 30, 3500, 35), ("c3", "D1", 5000, 40, 5400, 44), ("c4", "D1", 5000, 40, 5450, 44), ("c5", "D1", 5000, 44, 5400, 40), ("c6", "D1", 86399900, 5, 100, 7), ("c7", "D2", 1000, 10, 1900, 19)]


def test_clock(spark):
    takes, rejected = spans.clock_takes(spark.createDataFrame(SPANS, SPAN))
    assert [r[:4] for r in rows(takes)] == [("c1", "clock_D1_0", 0, 2), ("c2", "clock_D1_0", 1, 2), ("c3", "clock_D1_1000", 0, 1), ("c7", "clock_D2_0", 0, 1)]
    assert [(c, r.split()[0]) for c, r in rows(rejected)] == [("c4", "not"), ("c5", "nonmonotone"), ("c6", "nonmonotone")]
    same = spark.createDataFrame([("x", "D", 0, 0, 100, 1), ("y", "D", 0, 0, 100, 1)], SPAN)
    assert [r[0] for r in sorted(spans.clock_takes(same, "reverse_identical")[0].collect(), key=lambda r: r["position"])] == ["y", "x"]
    assert spans.ties(same).first()[0] == 1 and spans.ties(same.limit(0)).first()[0] == 0
    assert spans.same_partition(takes, takes.withColumn("take_id", F.upper("take_id"))).count() == 0
    assert spans.same_partition(takes, takes.where("clip_id <> 'c2'")).count() == 2


@pytest.mark.parametrize(("end", "last", "start", "first", "date", "new"), [(100000, 50, 160000, 51, "d", False), (100000, 50, 160001, 51, "d", True), (100000, 50, 101000, 49, "d", True), (100000, 50, 101000, 50, "d", False), (100000, 50, 101000, 51, "e", True)])
def test_gap_rule(spark, end, last, start, first, date, new):
    df = spark.createDataFrame([("a", "d", 90000, 40, end, last), ("b", date, start, first, start + 100, first + 1)], SPAN)
    got = {r["clip_id"]: (r["date"], r["take_no"]) for r in spans.gap_takes(df, 60000).collect()}
    assert (got["a"] != got["b"]) == new


def test_chains(spark):
    s = spark.createDataFrame([("A", "d", 0.0, 10.0, 2), ("B", "d", 129.9, 140.0, 2), ("C", "d", 260.0, 270.0, 2), ("D", "d", 300.0, 310.0, 3)], "take_id string, date string, start double, end double, n int")
    assert rows(spans.chains(s)) == [("A", "A", 2), ("B", "A", 2)]


def probs(spark, data, extra=0):
    return spark.createDataFrame([(k, [float(x) for x in v] + [0.0] * extra) for k, v in data.items()], "clip_id string, p array<double>")


def test_borrowing(spark):
    p = probs(spark, {"t": (0.6, 0.4), "o": (0.2, 0.8), "z": (1.0, 0.0)})
    takes = spark.createDataFrame([("t", "T", 0), ("o", "O", 0)], "clip_id string, take_id string, position int")
    chain = spark.createDataFrame([("T", "T"), ("O", "T")], "take_id string, chain_id string")
    got = {r["clip_id"]: r["p"] for r in fusion.borrow(p, takes, chain).collect()}
    assert got["t"] == pytest.approx([0.5147186257614, 0.4852813742386], abs=1e-12) and got["o"] == pytest.approx([0.2167125223584, 0.7832874776416], abs=1e-12) and got["z"] == [1.0, 0.0]
    few = {r["clip_id"]: r["p"] for r in fusion.borrow(p, takes, chain, min_coverage=0.7).collect()}
    assert few["t"] == [0.6, 0.4]


def test_fusion(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    r = one(spark, g=C.geometric(arr(0.7, 0.3), arr(0.1, 0.9), 0.2), a=C.arithmetic(arr(0.7, 0.3), arr(0.1, 0.9), 0.2), off=fusion.gated(arr(0.7, 0.3), arr(0.1, 0.9), F.lit(False), "geometric"),
            av=fusion.available_average(arr(0.7, 0.3), [(F.lit(True), arr(0.1, 0.9)), (F.lit(False), arr(0.5, 0.5))]), none=fusion.available_average(arr(0.7, 0.3), [(F.lit(False), arr(0.5, 0.5))]))
    assert r["g"] == pytest.approx([0.5593176833574, 0.4406823166426], abs=1e-12) and r["a"] == pytest.approx([0.58, 0.42]) and r["off"] == [0.7, 0.3]
    assert r["av"] == pytest.approx([0.58, 0.42]) and r["none"] == [0.7, 0.3]
    bad = probs(spark, {"ok": (0.5, 0.5), "sum": (0.5, 0.4), "neg": (1.5, -0.5), "nan": (float("nan"), 1.0), "zero": (0, 0)})
    found = fusion.invalid(bad.unionByName(probs(spark, {"ok": (0.5, 0.5)})), 2)
    assert {(r["clip_id"], r["reason"].split()[0]) for r in found.collect()} == {("ok", "duplicate"), ("sum", "not"), ("neg", "not"), ("nan", "not"), ("zero", "not")}


def brute(p, prior_, weight=0.75):
    lp, lt = np.log(np.clip(p, 1e-12, None)), np.log(np.clip(prior_, 1e-12, None))
    every = [(sum(lp[i, c] for i, c in enumerate(t)) + weight * sum(lt[a, b] for a, b in itertools.pairwise(t)), t) for t in itertools.permutations(range(p.shape[1]), len(p))]
    z = np.array([s for s, _ in every])
    w = np.exp(z - z.max())
    m = np.zeros(p.shape)
    for x, (_, t) in zip(w / w.sum(), every, strict=True):
        for i, c in enumerate(t):
            m[i, c] += x
    return max(every, key=lambda e: e[0])[1], m


def test_decoders():
    flat = np.full((2, 2), 0.5)
    assert decode.decode_take(np.array([[0.6, 0.4]]), flat, "map").tolist() == [0]
    assert decode.decode_take(np.array([[0.6, 0.4], [0.9, 0.1]]), flat, "map").tolist() == [1, 0]
    m = decode.marginals(np.array([[0.6, 0.3, 0.1], [0.5, 0.4, 0.1]]), np.full((3, 3), 1 / 3))
    assert m == pytest.approx(np.array([[0.526316, 0.315789, 0.157895], [0.350877, 0.491228, 0.157895]]), abs=1e-6)
    rng = np.random.default_rng(0)
    for n in (2, 3, 4):
        for _ in range(20):
            p, t = rng.dirichlet(np.ones(5), n), rng.dirichlet(np.ones(5), 5)
            best, mass = brute(p, t)
            assert decode.decode_take(p, t, "map").tolist() == list(best)
            assert decode.marginals(p, t, width=10**6) == pytest.approx(mass)
            lp = np.log(p)
            assert sum(lp[i, c] for i, c in enumerate(decode.assign(p))) == pytest.approx(max(sum(lp[i, c] for i, c in enumerate(q)) for q in itertools.permutations(range(5), n)))
    wide = decode.decode_take(rng.dirichlet(np.ones(40), 20), np.full((40, 40), 1 / 40), "map")
    assert len(set(wide.tolist())) == 20


@pytest.mark.parametrize(("hide", "covered", "argmax"), [(lambda i: False, 405, 0), (lambda i: i % 7 == 0, 347, 58), (lambda i: i % 3 != 0, 135, 405), (lambda i: True, 0, 405)])
def test_coverage_drill(spark, hide, covered, argmax):
    ids = [f"clip{i:03d}" for i in range(405)]
    rng = np.random.default_rng(1)
    p = probs(spark, {c: v for c, v in zip(ids, rng.dirichlet(np.ones(40), 405), strict=True)})
    clips = p.select("clip_id")
    takes = spark.createDataFrame([(c, f"t{i // 3}", i % 3) for i, c in enumerate(ids) if not hide(i)], "clip_id string, take_id string, position int")
    assert decode.coverage(clips, takes, p).first()["covered"] == covered
    how = {r["how"]: r["count"] for r in decode.decode_with_fallback(clips, takes, p, np.full((40, 40), 1 / 40)).groupBy("how").count().collect()}
    assert how.get("argmax", 0) == argmax and how.get("decoded", 0) == 405 - argmax
    decode.check_inputs(clips, takes, p)
    with pytest.raises(ValueError, match="duplicate"):
        decode.check_inputs(clips.unionByName(clips.limit(1)), takes, p)


def test_missing_oversize_submission(spark):
    ids = [f"c{i}" for i in range(42)]
    p = probs(spark, {c: (0.3, 0.7) for c in ids[:41]})
    clips = spark.createDataFrame([(c,) for c in ids], "clip_id string")
    takes = spark.createDataFrame([(c, "t", i) for i, c in enumerate(ids)], "clip_id string, take_id string, position int")
    out = decode.decode_with_fallback(clips, takes, p, np.full((2, 2), 0.5), classes=40)
    assert {(r["label"], r["how"]) for r in out.collect()} == {(1, "argmax"), (0, "missing")}
    template = spark.createDataFrame([(0, "a\\b\\c1/", 0), (1, "c41", 0)], "row_no int, path string, prediction int")
    assert rows(decode.submission(template, out)) == [(0, "a\\b\\c1/", 1), (1, "c41", 0)]
    with pytest.raises(Exception, match="no label"):
        decode.submission(template.withColumn("path", F.lit("zz")), out).collect()


def test_prior(spark):
    seq = spark.createDataFrame([("t", 0, 0), ("t", 1, None), ("t", 2, 1), ("t", 3, 2)], "take string, position int, label int")
    got = {(r["prev"], r["next"]): r["p"] for r in prior.transition_prior(prior.bigrams(seq, ["take"], ["position"]), spark.range(40).select(F.col("id").cast("int").alias("cls"))).collect()}
    assert got[0, 1] == 2 / 41 and got[0, 2] == 1 / 41 and got[5, 9] == 1 / 40 and len(got) == 1600


def test_evaluation(spark):
    j = evaluate.jackknife(spark.createDataFrame([(3, 10), (5, 9), (8, 10)], "h int, n int"), "h", "n").first()
    assert j["se"] == pytest.approx(0.15194440998017, abs=1e-12)
    pairs = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 2, 1)], "clip string, t int, f int")
    got = evaluate.pair_agreement(pairs, "t", "f").first()
    assert (got["precision"], got["recall"], got["exact"], got["groups"]) == (pytest.approx(1 / 3), 1.0, 0, 2)
    c = evaluate.contrast(spark.createDataFrame([(0, 0, 1), (1, 0, 1), (2, 0, 0)], "y int, parent int, label int")).first()
    assert (c["rescued"], c["lost"], c["net"]) == (1, 1, 0)
    w = evaluate.all_windows(spark.createDataFrame([("t", ["a", "b", "c"]), ("e", [])], "take_id string, members array<string>"))
    assert w.count() == 6


def test_sampling(spark):
    r = one(spark, a=C.even_picks(F.lit(100), 32), b=C.even_picks(F.lit(1), 32), c=C.even_picks(F.lit(0), 4), s=C.segment_picks(F.lit(10), 4), t=C.segment_picks(F.lit(2), 4), z=C.segment_picks(F.lit(0), 3))
    assert r["a"] == np.linspace(0, 99, 32).round().astype(int).tolist() and r["b"] == [0] and r["c"] == [] and r["s"] == [1, 3, 6, 8] and r["t"] == [0, 0, 1, 1] and r["z"] == [0, 0, 0]
    d = one(spark, **{f"e{e}": C.view_draw("p", 42, F.lit(e), F.lit("clipA")) for e in range(4)})
    assert [d[f"e{e}"] for e in range(4)] == [bool(hashlib.sha256(f"p|42|{e}|clipA".encode()).digest()[0] & 1) for e in range(4)]
    takes = spark.createDataFrame([(f"{t}{i}", t, i, 5) for t in "abcdefgh" for i in range(5)], "clip_id string, take_id string, position int, take_size int")
    sizes = spark.createDataFrame([(0.0, 0.5, 2), (0.5, 1.0, 9)], "u_low double, u_high double, size int")
    for contiguous in (False, True):
        a = rows(sampling.thin(takes, sizes, 4, 1, contiguous))
        assert a == rows(sampling.thin(takes.repartition(3), sizes, 4, 1, contiguous)) and {len([x for x in a if x[:2] == k]) for k in {x[:2] for x in a}} <= {2, 5}
        if contiguous:
            assert all(x[3] - x[4] == next(y[3] for y in a if y[:2] == x[:2] and y[4] == 0) for x in a)
    assert rows(sampling.sample_exactly(takes, "clip_id", 7, 3)) == rows(sampling.sample_exactly(takes.repartition(5), "clip_id", 7, 3))
    g = {r["user"]: r["grp"] for r in sampling.inner_groups(spark.createDataFrame([(f"user{i}",) for i in (10, 1, 2, 9, 11, 30)], "user string")).collect()}
    assert g == {"user1": 0, "user2": 1, "user9": 2, "user10": 3, "user11": 0, "user30": 1}
    b = sampling.cluster_bootstrap(spark.createDataFrame([(i, i % 3, 3) for i in range(12)], "u int, h int, n int"), "u", "h", "n", 400, 1).first()
    assert b["mean"] == pytest.approx(1 / 3, abs=0.03) and 0.05 < b["se"] < 0.12


def box(x, y, score, probe, w=100, h=200):
    return ("c", probe, float(x), float(y), float(x + w), float(y + h), score)


BOX = "clip_id string, probe int, x1 double, y1 double, x2 double, y2 double, score double"


def test_windows(spark):
    make = lambda *b: spark.createDataFrame(list(b), BOX)
    got = detections.person_windows(make(box(100, 100, 0.9, 0)), 640).first()
    assert tuple(got)[:5] == ("c", 60, 10, 340, 290) and got["source"] == "strong"
    reason = lambda *b: detections.accept(make(*b), 640).first()
    assert reason(*(box(100, 100, 0.2, k) for k in range(3)))["reason"] == "sparse"
    assert reason(*(box(100, 100, 0.2, k) for k in range(4)))["reason"] == "agree"
    assert reason(*(box(150 * k, 100, 0.2, k) for k in range(4)))["reason"] == "scattered"
    r = reason(box(100, 100, 0.31, 0), box(100, 100, 0.05, 1))
    assert (r["reason"], r["n_detected"]) == ("strong", 1)
    assert detections.best_per_probe(make(box(0, 0, 0.5, 0), box(9, 0, 0.7, 0))).first()["x1"] == 9.0
    frames = spark.createDataFrame([("c", 100, 200)], "clip_id string, height int, width int")
    assert [tuple(r) for r in detections.tiles(frames).orderBy("tile").collect()] == [("c", 0, 0, 0, 60, 120), ("c", 1, 0, 80, 60, 120), ("c", 2, 40, 0, 60, 120), ("c", 3, 40, 80, 60, 120)]
    w = spark.createDataFrame([("c", -2, 0, 2, 4)], "clip_id string, top int, left int, bottom int, right int")
    s = {(r["gy"], r["gx"]): r["support"] for r in detections.patch_support(w, 10, 10, 4).collect()}
    assert s[0, 0] == 0 and s[1, 3] == 0 and s[2, 0] == 1


def test_pixels(spark):
    still = [("c", f, y, x, 10) for f in range(3) for y in range(8) for x in range(8)]
    moving = [("m", f, y, x, 10 + 60 * (f == 1 and 2 <= y < 6 and 1 <= x < 3)) for f in range(3) for y in range(8) for x in range(8)]
    px = spark.createDataFrame(still + moving, "clip_id string, frame_no int, y int, x int, depth_rank int")
    got = {r[0]: tuple(r)[1:] for r in detections.motion_boxes(px, 8, 8, margin=0.25, min_side=2).collect()}
    assert got["c"] == (0, 0, 8, 8) and got["m"] == (1, 0, 7, 5)
    crop = detections.crop_pad(px.where("clip_id = 'm' and frame_no = 1").withColumnRenamed("depth_rank", "value"), spark.createDataFrame([("m", -1, -1, 1, 1)], "clip_id string, top int, left int, bottom int, right int"), 8, 8)
    assert crop.count() == 4 and {r["value"] for r in crop.collect()} == {10}
    pal = spark.createDataFrame([(5, 1)], "packed_rgb int, depth_rank int")
    assert rows(detections.decode_palette(spark.createDataFrame([(5,), (6,)], "packed_rgb int"), pal)) == [(5, 1), (6, 255)]
    ref = spark.createDataFrame([(i, i, 0, 0) for i in range(256)], "idx int, r int, g int, b int")
    lut = detections.build_palette(spark.createDataFrame([(0, 9), (1 << 16, 5), (200 << 16, 5), (100 << 16, 1)], "packed_rgb int, n int"), ref, 2)
    assert rows(lut) == [(200 << 16, 254), (1 << 16, 0)] or sorted(map(tuple, lut.collect())) == [(1 << 16, 0), (200 << 16, 254)]
    assert detections.smoothness(px.where("clip_id = 'c'")).first()["smoothness"] == 0.0


def test_integrity(spark):
    blobs = spark.createDataFrame([("k", "u1", [2, 2], bytearray(b"abcd")), ("j", "u1", [0], bytearray(b""))], "key string, dtype string, shape array<long>, blob binary")
    m = integrity.manifest(blobs)
    assert {r["key"]: r["elements"] for r in m.collect()} == {"k": 4, "j": 0}
    assert integrity.manifest_faults(m, m).count() == 0
    assert rows(integrity.manifest_faults(m.where("key = 'k'").withColumn("dtype", F.lit("f4")), m)) == [("j", "missing"), ("k", "different")]
    pairs = spark.createDataFrame([("a", bytearray(range(200)) * 5, bytearray(range(200)) * 5), ("b", bytearray(b"xyz"), None)], "key string, blob binary, base binary")
    coded = integrity.pack_deltas(pairs).cache()
    assert {r["key"]: bytes(r["blob"]) for r in integrity.unpack_deltas(coded, pairs).collect()} == {"a": bytes(range(200)) * 5, "b": b"xyz"}
    with pytest.raises(Exception, match="complete stream|Error"):
        integrity.unpack_deltas(coded.withColumn("packed", F.expr("substring(packed, 1, length(packed) - 1)")), pairs).collect()
    q = integrity.quantize(spark.createDataFrame([("t", 0, 1.0), ("t", 1, -0.5), ("t", 2, 0.004)], "key string, idx int, w double"), ["key"])
    assert [r["code"] for r in q.orderBy("idx").collect()] == [127, -64, 1]
    assert all(abs(r["w"] - v) < 0.004 for r, v in zip(integrity.dequantize(q).orderBy("idx").collect(), (1.0, -0.5, 0.004), strict=True))
    rec = integrity.recipe(spark.createDataFrame([("x", ["a=1", "b=2=3", "a=4"])], "cache string, kv array<string>"))
    assert {(r["k"], r["v"]) for r in rec.collect()} == {("a", "4"), ("b", "2=3")}
    other = spark.createDataFrame([("a", "5"), ("c", "1")], "k string, v string")
    assert [tuple(r) for r in integrity.recipe_differences(rec, other).orderBy("k").collect()] == [("a", "4", "5", "differs"), ("b", "2=3", None, "missing"), ("c", None, "1", "extra")]
    assert {r["argument"] for r in integrity.recipe_arguments(rec, {"a": "--a", "b": "--b"}).collect()} == {"--a=4", "--b=2=3"}
    with pytest.raises(Exception, match="unknown key"):
        integrity.recipe_arguments(rec, {"a": "--a"}).collect()
    keys = lambda *k: spark.createDataFrame([(x, x.upper()) for x in k], "slot string, key string")
    assert integrity.key_map(keys("a"), keys("a")).count() == 1
    with pytest.raises(Exception, match="one-sided"):
        integrity.key_map(keys("a", "b"), keys("a")).collect()


def test_columns(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    r = one(
        spark, am=C.argmax(arr(0.2, 0.4, 0.4)), top=C.top_classes(arr(0.2, 0.4, 0.4), 2), sp=C.split_id(F.lit("a/u/3")), dev=C.device_prefix(F.lit("W(E5)")), fold=C.fold_of_path(F.lit("x/folds/fold3.pt")), sq=C.square_window(F.lit(0), F.lit(0), F.lit(4), F.lit(10), 1.5),
        rs=C.resample(arr(0.0, 10.0, 20.0), 5), v=C.velocity(arr(1.0, 4.0)), f=C.readout_features(arr(1.0), arr(3.0)), t=C.temperature(arr(0.5, 0.5), 2.0), h=C.soft_target(arr(0.2, 0.8), F.lit(0), "half"), so=C.smoothed_onehot(F.lit(1), 4, 0.1), pk=C.packed_rgb(F.lit(1), F.lit(2), F.lit(3)),
    )
    assert r["am"] == 1 and [tuple(s) for s in r["top"]] == [(0.4, 1), (0.4, 2)] and tuple(r["sp"]) == ("a", "u", "3") and r["dev"] == "W" and r["fold"] == 3
    assert tuple(r["sq"]) == (-6, -2, 10, 12) and r["rs"] == [0.0, 5.0, 10.0, 15.0, 20.0] and r["v"] == [0.0, 3.0] and r["f"] == [1.0, 3.0, 3.0, 2.0] and r["t"] == pytest.approx([0.5, 0.5])
    assert r["h"] == pytest.approx([0.6, 0.4]) and math.fsum(r["so"]) == pytest.approx(1) and r["pk"] == 66051
    with pytest.raises(Exception, match="no fold"):
        one(spark, x=C.fold_of_path(F.lit("fold3.pt")))


def test_take_schema(spark):
    takes, _ = spans.clock_takes(spark.createDataFrame(SPANS, SPAN))
    assert [f"{n} {t}" for n, t in takes.dtypes] == [x.strip().replace("long", "bigint") for x in TAKE.split(",")]
