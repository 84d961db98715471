"""Pixel augmentation against plain Python with the same keyed draws."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from takeline.operators import augment

PIXELS = "clip_id string, frame_no int, channel int, y int, x int, value int"
DRAWS = "clip_id string, epoch int, side int, top int, left int, flip boolean, box_top int, box_left int, box_height int, box_width int"


def clip_pixels(spark, size=(6, 7), clips="ab"):
    rng = np.random.default_rng(0)
    images = {(c, f, ch): rng.integers(0, 255, size) for c in clips for f in range(2) for ch in range(2)}
    return images, spark.createDataFrame([(*k, y, x, int(v)) for k, m in images.items() for (y, x), v in np.ndenumerate(m)], PIXELS).repartition(5)


def collected(df, shape):
    out = {}
    for r in df.collect():
        out.setdefault((r["clip_id"], r["epoch"], r["frame_no"], r["channel"]), np.full(shape, -1))[r["y"], r["x"]] = r["value"]
    return out


def test_one_draw_for_all_frames(spark):
    images, px = clip_pixels(spark)
    draws = spark.createDataFrame([("a", 1, 4, 1, 2, True, 0, 1, 2, 3), ("a", 2, 4, 2, 3, False, None, None, None, None), ("b", 1, 4, 0, 0, False, 3, 3, 1, 1)], DRAWS)
    got = collected(augment.applied(px, draws, 4, fill=9), (4, 4))
    assert len(got) == 3 * 4
    for (c, e, f, ch), m in got.items():
        top, left = {("a", 1): (1, 2), ("a", 2): (2, 3), ("b", 1): (0, 0)}[c, e]
        want = images[c, f, ch][top : top + 4, left : left + 4].copy()
        if (c, e) == ("a", 1):
            want = want[:, ::-1].copy()
            want[0:2, 1:4] = 9
        if c == "b":
            want[3, 3] = 9
        assert (m == want).all()


def test_scaled_windows(spark):
    """A window of another side is resized to the crop; one of the crop's side is not touched."""
    images, px = clip_pixels(spark)
    draws = spark.createDataFrame([("a", 1, 6, 0, 1, False, None, None, None, None), ("b", 1, 2, 3, 3, True, None, None, None, None)], DRAWS)
    got = collected(augment.applied(px, draws, 3), (3, 3))
    assert all((m >= 0).all() for m in got.values()) and len(got) == 8
    flat = px.withColumn("value", F.lit(77))
    assert all((m == 77).all() for m in collected(augment.applied(flat, draws, 3), (3, 3)).values())


def test_draws(spark):
    clips = spark.createDataFrame([(f"c{i}", e, 20, 30) for i in range(200) for e in (1, 2)], "clip_id string, epoch int, height int, width int")
    a = augment.drawn(clips, 1, 16, (0.5, 1.5), 0.3, 0.4, 0.5, 4)
    rows = {(r["clip_id"], r["epoch"]): r for r in a.collect()}
    assert rows == {(r["clip_id"], r["epoch"]): r for r in augment.drawn(clips.repartition(9), 1, 16, (0.5, 1.5), 0.3, 0.4, 0.5, 4).collect()}
    u = lambda what, c, e: int(hashlib.sha256(f"1|{what}|{e}|{c}".encode()).hexdigest()[:12], 16) / 16**12
    for (c, e), r in rows.items():
        side = min(max(round(16 * (0.5 + u("scale", c, e))), 4), 20)
        assert r["side"] == side and r["top"] == int(u("top", c, e) * (21 - side)) and r["left"] == int(u("left", c, e) * (31 - side)) and r["flip"] == (u("flip", c, e) < 0.3)
        assert (r["box_top"] is not None) == (u("erase", c, e) < 0.4)
        if r["box_top"] is not None:
            assert 4 <= r["box_height"] <= 8 and r["box_top"] + r["box_height"] <= 16 and r["box_left"] + r["box_width"] <= 16
    assert 80 < sum(r["flip"] for r in rows.values()) < 160 and len({r["side"] for r in rows.values()}) > 8
    plain = augment.centred(clips, 16).first()
    assert (plain["side"], plain["top"], plain["left"], plain["flip"], plain["box_top"]) == (16, 2, 7, False, None)


def test_depth_and_time(spark):
    px = spark.createDataFrame([("c", 0, 0, 0, i, v) for i, v in enumerate((0, 3, 100, 254, 255))], PIXELS)
    u = int(hashlib.sha256(b"2|depth|5|c").hexdigest()[:12], 16) / 16**12
    offset = int(u * 21) - 10
    assert [r["value"] for r in augment.shifted_depth(px, 2, 10, F.lit(5)).orderBy("x").collect()] == [*(max(0, min(254, v + offset)) for v in (0, 3, 100, 254)), 255]
    frames = spark.createDataFrame([("none", 0), ("short", 3), ("long", 50)], "clip_id string, n int")
    got = {}
    for r in augment.time_cropped(frames, 1, 0.5, F.lit(1)).orderBy("clip_id", "k").collect():
        got.setdefault(r["clip_id"], []).append(r["frame_no"])
    assert got["short"] == [0, 1, 2] and len(got["long"]) == 50 and got["long"] == sorted(got["long"]) and 24 <= got["long"][-1] - got["long"][0] < 50 and set(got) == {"short", "long"}
    with pytest.raises(Exception, match="clip_id"):
        augment.time_cropped(frames.drop("clip_id"), 1, 0.5, F.lit(1)).collect()
