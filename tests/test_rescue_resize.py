"""The tile cascade and the resampling filter against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from takeline.operators import detections, resize

BOXES = "clip_id string, probe int, x1 double, y1 double, x2 double, y2 double, score double"
FRAMES = "clip_id string, height int, width int"


def test_only_failed_clips_reach_the_tiles(spark):
    frames = spark.createDataFrame([("good", 100, 200), ("weak", 100, 200), ("moved", 480, 640), ("lost", 50, 60), ("bad", 100, 200)], FRAMES)
    plain = spark.createDataFrame([("good", 0, 50.0, 40.0, 70.0, 80.0, 0.9), ("weak", 0, 1.0, 1.0, 2.0, 2.0, 0.05), ("bad", 0, 0.0, 0.0, 9.0, 9.0, 0.2), ("moved", 1, 0.0, 0.0, 5.0, 5.0, 0.2)], BOXES)
    asked = []

    def detector(offsets):
        asked.extend((r["clip_id"], r["tile"]) for r in offsets.collect())
        rows = [("weak", 0, t, 10.0, 5.0, 20.0, 25.0, s) for t, s in ((0, 0.4), (1, 0.4), (2, 0.3))]  # the first tile of equal ones
        rows += [("weak", 1, 3, 10.0, 5.0, 20.0, 25.0, 0.5), ("weak", 1, 3, 0.0, 0.0, 1.0, 1.0, 0.45), ("weak", 2, 0, 0.0, 0.0, 9.0, 9.0, 0.0), ("moved", 0, 2, 1.0, 1.0, 2.0, 2.0, 0.2)]
        return spark.createDataFrame(rows, BOXES.replace("probe int,", "probe int, tile int,"))

    motion = spark.createDataFrame([("moved", 10, 20, 30, 50), ("good", 1, 1, 2, 2)], "clip_id string, top int, left int, bottom int, right int")
    got = {r["clip_id"]: tuple(r)[1:] for r in detections.rescued_windows(frames, plain, detector, motion).collect()}
    assert set(asked) == {(c, t) for c in ("weak", "moved", "lost", "bad") for t in range(4)}
    assert got["good"][4:] == (1, "strong", 0.9)
    # Probe 0: tile 0, centre (15, 15); probe 1: tile 3 at (40, 80), centre (95, 55); side max(20 * 1.4, 0.35 * 200).
    assert got["weak"] == (0, 20, 70, 90, 2, "tiled", 0.5)
    assert got["moved"] == (5, 20, 35, 50, 0, "motion", 0.2) and got["lost"] == (0, 0, 50, 60, 0, "whole", 0.0) and got["bad"] == (0, 0, 100, 200, 0, "whole", 0.0)


def test_tile_boxes_as_a_table(spark):
    frames = spark.createDataFrame([("a", 100, 200), ("b", 100, 200)], FRAMES)
    plain = spark.createDataFrame([("a", 0, 50.0, 40.0, 70.0, 80.0, 0.9)], BOXES)
    tiled = spark.createDataFrame([(c, 0, 1, 1.0, 1.0, 9.0, 9.0, 0.8) for c in "ab"], BOXES.replace("probe int,", "probe int, tile int,"))
    none = spark.createDataFrame([], "clip_id string, top int, left int, bottom int, right int")
    assert {r["clip_id"]: r["source"] for r in detections.rescued_windows(frames, plain, tiled, none).collect()} == {"a": "strong", "b": "tiled"}


def plain_resize(image, height, width):
    def across(m, n_out):
        out = np.zeros((m.shape[0], n_out), np.int64)
        for i in range(n_out):
            a = [max(0, 2 * max(m.shape[1], n_out) - abs((2 * j + 1) * n_out - (2 * i + 1) * m.shape[1])) for j in range(m.shape[1])]
            out[:, i] = (2 * (m * np.array(a)).sum(1) + sum(a)) // (2 * sum(a))
        return out
    return across(across(image, width).T, height).T


@pytest.mark.parametrize("size, to", [((7, 5), (3, 9)), ((1, 4), (5, 1)), ((6, 6), (6, 6)), ((20, 3), (2, 3))])
def test_resize(spark, size, to):
    rng = np.random.default_rng(1)
    images = {(c, f): rng.integers(0, 256, size) for c in "ab" for f in range(2)}
    rows = [(c, f, y, x, int(v), *size) for (c, f), m in images.items() for (y, x), v in np.ndenumerate(m)]
    df = spark.createDataFrame(rows, "clip_id string, frame_no int, y int, x int, value int, height int, width int").repartition(7)
    got = {k: np.full(to, -1) for k in images}
    for r in resize.resized(df, *to).collect():
        got[r["clip_id"], r["frame_no"]][r["y"], r["x"]] = r["value"]
    for k, m in images.items():
        assert (got[k] == plain_resize(m, *to)).all()
        if size == to:
            assert (got[k] == m).all()
    assert resize.resized(df.limit(0), *to).count() == 0


def test_support_of_a_mask(spark):
    """As the mask itself, resized in floats, cut and averaged."""
    rng = random.Random(2)
    windows = [(f"w{i}", rng.randrange(-30, 20), rng.randrange(-30, 20), s := rng.choice([9, 30, 61]), s) for i in range(6)]
    df = spark.createDataFrame([(c, t, x, t + h, x + w) for c, t, x, h, w in windows], "clip_id string, top int, left int, bottom int, right int")
    got = {(r["clip_id"], r["gy"], r["gx"]): r["support"] for r in detections.patch_support(df, 25, 35, 4, 24, 2).collect()}

    def shares(low, n, size):
        out = []
        for i in range(24):
            a = [max(0, 2 * max(n, 24) - abs((2 * j + 1) * 24 - (2 * i + 1) * n)) for j in range(n)]
            out.append(sum(v for j, v in enumerate(a) if 0 <= low + j < size) / sum(a))
        return np.array(out)
    for c, t, x, h, w in windows:
        mask = np.outer(shares(t, h, 25), shares(x, w, 35))[2:22, 2:22].reshape(4, 5, 4, 5).mean((1, 3))
        assert np.allclose([[got[c, gy, gx] for gx in range(4)] for gy in range(4)], mask)
    with pytest.raises(ValueError, match="one length"):
        detections.patch_support(df, 25, 35, 6, 24, 2)


def test_fused_pixels_have_one_size(spark):
    frames = spark.createDataFrame([("c", m, f, True) for m in "DI" for f in range(2)] + [("d", "D", 0, True), ("d", "I", 0, False)], "clip_id string, modality string, frame_no int, readable boolean")
    pixels = frames.select("clip_id", "modality", "frame_no", F.explode(F.when(F.col("modality") == "D", F.array(*map(F.lit, range(3)))).otherwise(F.array(F.lit(3)))).alias("channel")).crossJoin(spark.range(30).select((F.col("id") / 6).cast("int").alias("y"), (F.col("id") % 6).cast("int").alias("x"), F.col("id").cast("int").alias("value")))
    windows = spark.createDataFrame([("c", -1, 0, 6, 7), ("d", 0, 0, 4, 4)], "clip_id string, top int, left int, bottom int, right int")
    got = detections.fused_pixels(detections.four_channels(frames), pixels, windows, 5, 6, 3).collect()
    assert {(r["clip_id"], r["k"], r["channel"]) for r in got} == {("c", k, c) for k in range(2) for c in range(4)} | {("d", 0, c) for c in range(3)}
    assert len(got) == (8 + 3) * 9
    cut = np.arange(30).reshape(5, 6)[np.clip(np.arange(-1, 6), 0, 4)][:, np.clip(np.arange(7), 0, 5)]
    assert sorted((r["y"], r["x"], r["value"]) for r in got if (r["clip_id"], r["k"], r["channel"]) == ("c", 1, 3)) == sorted((y, x, int(v)) for (y, x), v in np.ndenumerate(plain_resize(cut, 3, 3)))
