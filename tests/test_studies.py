"""Composed evaluations, mended windows and strict readers, against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from takeline.functions import columns as C
from takeline.operators import codec, detections, evaluate, skeletons, spans, studies
from takeline.schema import SPAN
from takeline.sources import files


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("frames", ["last_frame", None])
def test_gap_takes_without_device(spark, frames):
    """Hours with mended edges number takes as one window per date does."""
    rng = random.Random(1)
    data = []
    for i in range(400):
        start = rng.choice([0, 3_599_000, 3_600_000, 7_200_000, rng.randrange(40_000_000)]) + rng.randrange(3)
        first = rng.randrange(100)
        data.append((f"c{i:03d}", rng.choice(["d", "e", None]), start, first, start + rng.choice([0, 500, 4_000_000]), first + rng.randrange(5)))
    want = {}
    for date in ("d", "e", None):
        before, no = None, 0
        for clip, _, start, first, end, last in sorted((r for r in data if r[1] == date), key=lambda r: (r[2], r[0])):
            no += before is None or start - before[0] > 60_000 or (frames is not None and first < before[1])
            want[clip], before = no, (end, last)
    df = spark.createDataFrame(data, SPAN)
    got = spans.gap_takes(df, 60_000, frames=frames)
    assert got.columns == [*df.columns, "take_no"] and {r["clip_id"]: r["take_no"] for r in got.collect()} == want
    one = spans.gap_takes(df.withColumn("dev", F.lit("x")), 60_000, ("dev",), frames)
    assert {r["clip_id"]: r["take_no"] for r in one.collect()} == want
    assert spans.gap_takes(df.limit(0), 60_000).count() == 0


def test_row_windows_are_all_windows(spark):
    takes = spark.createDataFrame([(t, i, f"{t}{i:02d}") for t, n in (("a", 1), ("b", 3), ("c", 12)) for i in range(n)], "take_id string, position int, clip_id string")
    assert rows(evaluate.row_windows(takes, 8)) == rows(evaluate.all_windows(evaluate.ordered_members(takes), 8))


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_quantiles_by_rank(spark, n):
    x = np.random.default_rng(n).integers(0, 20, n).astype(float)
    got = evaluate.quantiles_by_rank(spark.createDataFrame([(float(v),) for v in x], "v double"), "v", (0.0, 0.05, 0.5, 0.9, 1.0)).first()
    assert list(got) == pytest.approx(np.quantile(x, [0, 0.05, 0.5, 0.9, 1]).tolist())


def test_ranked_is_a_numbering(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 1000).alias("k"), "id")
    assert [(r["k"], r["id"]) for r in spans.ranked(df, ["k", "id"], "i").orderBy("i").collect()] == sorted((k * 7919 % 1000, k) for k in range(5000))
    assert spans.ranked(df.limit(0), ["k"], "i").count() == 0


def test_clips_without_boxes(spark):
    boxes = spark.createDataFrame([("a", 0, 0.0, 0.0, 9.0, 9.0, 0.9)], "clip_id string, probe int, x1 double, y1 double, x2 double, y2 double, score double")
    clips = spark.createDataFrame([("a",), ("b",)], "clip_id string")
    assert rows(detections.accept(boxes, 640, clips=clips)) == [("a", "strong", 1, 0.9), ("b", "none", 0, 0.0)]


def test_greedy_selection():
    value = {"a": 3, "b": 5, "c": 4, "ab": 6, "bc": 5, "abc": 9}
    asked = []
    score = lambda s: asked.append(s) or value["".join(sorted(s))]
    assert studies.greedy_selection(["a", "b", "c"], score) == (["b", "a"], [5, 6])  # "bc" is no better than "b"
    assert len(asked) == 5 and studies.greedy_selection([], score) == ([], [])
    assert studies.greedy_selection(["c", "b"], lambda s: 5) == (["c"], [5])  # a tie adds nothing


def test_gates(spark):
    def verdict(kind, decoded, primary, exact, raw=0.0):
        data = [("designated", f, raw, float(d)) for f, d in enumerate(decoded)] + [("primary", f, raw, float(d)) for f, d in enumerate(primary)] + [("exact_length", 0, raw, float(exact))]
        return evaluate.gate_forms(spark.createDataFrame(data, "population string, fold int, raw double, decoded double"), kind).first()["accepted"]

    assert verdict("root", [1, 1, 1, -1.0], [0.0] * 4, 0.0) and not verdict("root", [1, 1, 1, -1.1], [0.0] * 4, 0.0)
    assert not verdict("root", [3, 1, -0.5, -0.5], [0.0] * 4, 0.0) and not verdict("root", [2.0] * 3, [1.0] * 4, 1.0)
    assert verdict("increment", [0.5, 0.3, 0.7, -0.5], [0.0] * 4, 0.0) and not verdict("increment", [0.3] * 4, [-0.1] * 4, 0.0)
    assert verdict("exploratory", [1, 1, -0.5, -0.5], [0.0] * 4, -0.1) and not verdict("exploratory", [1, 1, -0.5, -0.5], [0.0] * 4, -0.2)
    assert verdict("pilot", [0.5, 0.0], [0.25, 0.25], -9) and not verdict("pilot", [0.5, 0.5], [0.5, 0.5], 0, raw=-0.3)
    assert verdict("fourfold", [1, 1, 1, -1.0], [0.5] * 4, 0.1) and not verdict("fourfold", [1, 1, 1, -1.0], [0.5] * 4, 0.0)


def test_registered_needs_every_clip(spark):
    clips = spark.createDataFrame([("a",), ("b",)], "clip_id string")
    registry = spark.createDataFrame([("x", "P", "MAP")], "config string, source string, decoder string")
    some = spark.createDataFrame([("P", "a", [1.0])], "source string, clip_id string, p array<double>")
    with pytest.raises(Exception, match="no probabilities: x b"):
        studies.registered(registry, some, clips).collect()


def test_windows_beyond_the_classes_are_left_out(spark):
    n = 12
    windows = spark.createDataFrame([("full_take", 0, t, f"{t}{i}", i) for t, k in (("a", n), ("b", 3)) for i in range(k)], "population string, repeat int, take_id string, clip_id string, position int")
    p = windows.select(F.lit("A").alias("config"), "clip_id", F.array(*(F.lit(1 / 5) for _ in range(5))).alias("p"))
    done = studies.decode_windows(windows, p, windows.select("clip_id", F.lit(0).alias("fold")), {0: np.full((5, 5), 0.2)}, (0.0, 1.0), classes=5)
    assert {r["take_id"] for r in done.collect()} == {"b"} and done.count() == 6
    assert all(len({r["label"] for r in g}) == 3 for _, g in itertools.groupby(done.orderBy("weight").collect(), lambda r: r["weight"]))


def test_poses(spark):
    rng = np.random.default_rng(0)
    pose = rng.normal(size=(17, 3))
    df = spark.createDataFrame([(pose.tolist(),)], "k array<array<double>>")
    k = F.col("k")
    r = df.select(skeletons.mirrored(skeletons.mirrored(k)).alias("m"), skeletons.turned(skeletons.turned(k, F.lit(0.4)), F.lit(-0.4)).alias("t"), skeletons.bone_vectors(k).alias("v"), skeletons.bone_lengths(k).alias("l")).first()
    assert np.allclose(r["m"], pose) and np.allclose(r["t"], pose)
    assert np.allclose([np.linalg.norm(r["v"][b]) for _, b in skeletons.BONES], r["l"])


def test_names_that_are_none(spark):
    one = spark.range(1)
    assert one.select(C.model_slot(F.lit("fc.weight")).alias("s")).first()["s"] is None
    assert one.select(C.model_slot(F.lit("layer3.12.conv2.bn.running_mean")).alias("s")).first()["s"] == (3, 12, "norm_b", "running_mean")
    for bad in ("fused-x.npz", "other_test.npz"):
        with pytest.raises(Exception, match="no cache name"):
            one.select(C.cache_parts(F.lit(bad), ("fused",))).collect()


@pytest.mark.parametrize("bits", [1, 3, 7, 8])
def test_bit_packed(spark, bits):
    rng = np.random.default_rng(bits)
    codes = rng.integers(0, 1 << bits, 13)
    df = spark.createDataFrame([("k", i, int(c)) for i, c in enumerate(codes)], "key string, idx int, code int")
    stream = "".join(f"{c:0{bits}b}"[::-1] for c in codes)
    want = bytes(int(stream[i : i + 8].ljust(8, "0")[::-1], 2) for i in range(0, len(stream), 8))
    assert bytes(codec.bit_packed(df, ["key"], "idx", "code", bits).first()["stream"]) == want


def test_receipts_read_back(spark, tmp_path):
    one = spark.createDataFrame([(1, "x")], "n int, s string")
    files.receipt(b=one, a=one).write.text(str(tmp_path / "r"))
    assert files.read_receipt(spark, str(tmp_path / "r"), "a struct<n int, s string>, b struct<n int, s string>").first() == ((1, "x"), (1, "x"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text("{no")
    with pytest.raises(Exception):  # noqa: B017
        files.read_receipt(spark, str(tmp_path / "bad"), "a int").collect()


def test_caches(spark, tmp_path):
    """A cache written and read gives its rows in order again; frames of two modalities stand side by side."""
    from takeline.sources import caches

    rows = spark.createDataFrame([("a", "x", 2, [3.0]), ("a", "x", 1, [2.0]), ("a", "z", 0, [9.0]), ("b", "y", 0, [1.0])], "clip_id string, device string, t_idx int, ch array<double>")
    cache = caches.imu_cache(rows, ("x", "y"))
    caches.write_cache(cache, str(tmp_path / "imu"))
    assert [tuple(r) for r in caches.read_cache(spark, str(tmp_path / "imu")).orderBy("clip_id", "t_idx").collect()] == [("a", "x", 1, [2.0]), ("a", "x", 2, [3.0]), ("b", "y", 0, [1.0])]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        caches.write_cache(cache, str(tmp_path / "imu"))
    frames = [(c, m, k, not (c == "dead" and m == "I" and k == 1) and not (c == "gone" and m == "D" and k == 0)) for c in ("good", "dead", "gone") for m in "DI" for k in range(2)]
    listing = spark.createDataFrame(frames, "clip_id string, modality string, frame_no int, readable boolean")
    part = lambda m: listing.where(F.col("modality") == m).select("clip_id", "frame_no", F.array(F.lit(m), F.col("frame_no").cast("string")).alias("data"))
    got = rows_of(caches.fused_cache(listing, part("D"), part("I")))
    assert got == [("dead", 0, ["D", "0"], None, False), ("dead", 1, ["D", "1"], None, False), ("good", 0, ["D", "0"], ["I", "0"], True), ("good", 1, ["D", "1"], ["I", "1"], True)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_windows_of_equal_content_are_decoded_once(spark):
    """Labels are those of each window decoded alone; equal windows, also of configurations that agree there, share a content."""
    from takeline.operators.decode import beams

    rng = random.Random(5)
    draw = lambda: [x / 10 for x in rng.sample(range(1, 10), 4)]
    p = {c: draw() for c in "abcdefg"}
    other = p | {"c": draw()}
    probabilities = spark.createDataFrame([(k, c, v) for k, t in (("A", p), ("B", other), ("C", p)) for c, v in t.items() if (k, c) != ("C", "g")], "config string, clip_id string, p array<double>")
    folds = spark.createDataFrame([(c, 0 if c < "e" else 1) for c in p], "clip_id string, fold int")
    takes = {"one": "ab", "two": "cd", "again": "ab", "turned": "ba", "single": "e", "late": "fg", "long": "abcde"}
    windows = spark.createDataFrame([("x", r, t, c, i) for r in (0, 1) for t, cs in takes.items() for i, c in enumerate(cs)], "population string, repeat int, take_id string, clip_id string, position int")
    priors = {0: np.random.default_rng(0).dirichlet(np.ones(4), 4), 1: np.full((4, 4), 0.25)}
    asked = studies.asked_windows(windows, probabilities, folds, 4).collect()
    assert len(asked) == 3 * 2 * 6  # the long one has more clips than classes
    same = {}
    for r in asked:
        same.setdefault(r["content"], set()).add((r["config"], r["take_id"]))
    assert sorted(map(sorted, same.values())) == sorted(map(sorted, [{(k, t) for k in "ABC" for t in ("one", "again")}, {(k, "turned") for k in "ABC"}, {("A", "two"), ("C", "two")}, {("B", "two")}, {(k, "single") for k in "ABC"}, {("A", "late"), ("B", "late")}, {("C", "late")}]))
    got = {}
    for r in studies.decode_windows(windows, probabilities, folds, priors, (0.0, 0.75), classes=4).collect():
        got[r["config"], r["weight"], r["repeat"], r["take_id"], r["clip_id"]] = (r["fold"], r["raw"], r["label"])
    want = {}
    for config, table in (("A", p), ("B", other), ("C", {c: v for c, v in p.items() if c != "g"})):
        for t, cs in takes.items():
            cs = [c for c in cs if c in table]
            if len(cs) <= 4:
                m, fold = np.array([table[c] for c in cs]), 0 if cs[0] < "e" else 1
                for w in (0.0, 0.75):
                    labels = m.argmax(1) if len(cs) == 1 else beams(m, priors[fold], w, 64, 16)[1][0]
                    want |= {(config, w, r, t, c): (fold, int(m[i].argmax()), int(labels[i])) for i, c in enumerate(cs) for r in (0, 1)}
    assert got == want


def test_paired_bootstrap(spark):
    """All cells under the same draws, by the hash that the draws are keyed with; a subject may lack a cell."""
    import hashlib

    rng = random.Random(9)
    hits = {(c, w, s): (rng.randrange(0, 8), 8) for c in "AB" for w in (0.0, 0.5) for s in range(6) if (c, w, s) != ("B", 0.5, 2)}
    df = spark.createDataFrame([(*k, *v) for k, v in hits.items()], "config string, weight double, subject int, hits long, n long")
    got = {(r["config"], r["weight"]): r for r in studies.paired_bootstrap(df, ["config", "weight"], {"config": "A", "weight": 0.5}, 40, 3).collect()}
    cells = sorted(got)
    pick = lambda r, j: int(int(hashlib.sha256(f"3|{r}|{j}".encode()).hexdigest()[:12], 16) / 16**12 * 6)
    x = np.array([[sum(hits.get((*c, s), (0, 0))[0] for s in some) / sum(hits.get((*c, s), (0, 0))[1] for s in some) for c in cells] for some in ([pick(r, j) for j in range(6)] for r in range(40))])
    first = cells.index(("A", 0.5))
    for k, c in enumerate(cells):
        d = x[:, k] - x[:, first]
        point = [sum(v[i] for (a, b, _), v in hits.items() if (a, b) == c) for i in (0, 1)]
        want = [point[0] / point[1], x[:, k].std(ddof=1), *np.percentile(x[:, k], [5, 95]), None, d.std(ddof=1), *np.percentile(d, [5, 95]), (d > 0).mean(), (x.argmax(1) == k).mean()]
        assert all(b is None or a == pytest.approx(b) for a, b in zip(tuple(got[c])[2:], want, strict=True))
    assert got["A", 0.5]["gain"] == got["A", 0.5]["gain_se"] == 0 and sum(r["best"] for r in got.values()) == pytest.approx(1)
    with pytest.raises(ValueError, match="no cell"):
        studies.paired_bootstrap(df, ["config", "weight"], {"config": "C", "weight": 0.5}, 4, 3)


def test_fold_contrasts(spark):
    df = spark.createDataFrame([("p", f, float(r), float(d)) for f, (r, d) in enumerate([(1, -2), (3, 0), (-1, 5)])] + [("q", 0, 1.0, 1.0)], "population string, fold int, raw double, decoded double")
    got = {(r["population"], r["metric"]): tuple(r)[2:] for r in studies.fold_contrasts(df).collect()}
    assert got["p", "raw"] == pytest.approx((3, 1.0, 2, 2 / 3**0.5)) and got["p", "decoded"][:3] == (3, 1.0, 1) and got["q", "raw"][3] is None


def test_quantisation_gate(spark):
    def rows(cost=0.1, gain=1.0, folds=4, settings=("x", "y")):
        out = []
        for s in settings:
            for f in range(folds):
                out += [(s, f, "a", 0.8, 0.8), (s, f, "b", 0.8 - gain / 100, 0.8 - (gain if f else -0.2) / 100), (s, f, "c", 0.8 + cost / 100, 0.8 + cost / 100)]
        return spark.createDataFrame(out, "setting string, fold int, arm string, raw double, decoded double")

    gate = lambda df: {r["eligible"] for r in evaluate.quantisation_gate(df, "a", "b", "c").collect()}
    assert gate(rows()) == {True}
    assert gate(rows(cost=0.6)) == gate(rows(gain=-0.1)) == gate(rows(folds=3)) == gate(rows(folds=5)) == {False}
    worst = rows(cost=0.0).withColumn("raw", F.when((F.col("arm") == "c") & (F.col("fold") == 0) & (F.col("setting") == "x"), 0.8101).otherwise(F.col("raw")))
    assert gate(worst) == {False}
    assert gate(rows().where("not (arm = 'c' and fold = 1)")) == {False}
    few = rows().withColumn("decoded", F.when((F.col("arm") == "b") & (F.col("fold") == 1), 0.81).otherwise(F.col("decoded")))
    assert gate(few) == {False}
    assert evaluate.quantisation_gate(rows().limit(0), "a", "b", "c").collect() == []


def test_blends_and_curves(spark):
    p = {"a": [0.7, 0.2, 0.1], "b": [0.1, 0.8, 0.1]}
    q = {"a": [0.2, 0.2, 0.6]}
    members = spark.createDataFrame([(m, c, v) for m, t in (("p", p), ("q", q)) for c, v in t.items()], "member string, clip_id string, p array<double>")
    settings = spark.createDataFrame([("one", "p", 3.0, False), ("mean", "p", 3.0, False), ("mean", "q", 1.0, False), ("product", "p", 3.0, True), ("product", "q", 1.0, True)], "config string, member string, weight double, geometric boolean")
    got = {(r["config"], r["clip_id"]): r["p"] for r in studies.blends(members, settings).collect()}
    assert set(got) == {("one", "a"), ("one", "b"), ("mean", "a"), ("product", "a")}  # b lacks a member
    assert got["one", "b"] == pytest.approx(p["b"]) and got["mean", "a"] == pytest.approx([0.575, 0.2, 0.225])
    g = np.array(p["a"]) ** 0.75 * np.array(q["a"]) ** 0.25
    assert got["product", "a"] == pytest.approx((g / g.sum()).tolist())
    rows = [(c, w, "x", f, r, a) for c, w, a0 in (("A", 0.0, 0.5), ("A", 1.0, 0.7), ("A", 2.0, 0.7), ("B", 0.0, 0.6), ("B", 1.0, 0.4)) for f in (0, 1) for r, a in ((0, a0), (1, a0 + 0.1 * f))]
    curves = spark.createDataFrame(rows, "config string, weight double, population string, fold int, repeat int, accuracy double")
    best = {r["config"]: (r["stated"], r["best_weight"], r["best"]) for r in studies.best_weights(curves, 0.0).collect()}
    assert best["A"] == pytest.approx((0.525, 1.0, 0.725)) and best["B"] == pytest.approx((0.625, 0.0, 0.625))
    row = studies.paired_curves(studies.at_best(curves, "A", "x"), studies.at_best(curves, "B", "x")).first()
    assert (row["pairs"], row["wins"]) == (4, 4) and row["mean"] == pytest.approx(0.1) and row["se"] == pytest.approx(0, abs=1e-9)
    pooled = {(r["config"], r["weight"], r["fold"]): r["accuracy"] for r in studies.pooled_curves(curves).collect()}
    assert pooled["A", 1.0, 1] == pytest.approx(0.75) and pooled["A", 1.0, None] == pytest.approx(0.725) and len(pooled) == 15
