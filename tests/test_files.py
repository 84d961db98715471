import struct
import zlib

import pytest

from takeline.operators import spans
from takeline.sources import files
from takeline.streaming import sessions


def png(path, pixels):
    """A small image, rows of (r, g, b)."""
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in pixels)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_listing_and_images(spark, tmp_path):
    for clip, folder, name in (("c1", "Depth_Color", "Depth_2025-06-11_13-21-46.616_00000067_Color.png"), ("c1", "IR", "IR_2025-06-11_13-21-47.616_00000077.png"), ("c2", "IR", "bad.png")):
        (tmp_path / clip / folder).mkdir(parents=True, exist_ok=True)
        png(tmp_path / clip / folder / name, [[(255, 0, 0), (0, 0, 255)]])
    (tmp_path / "c2" / "IR" / "bad.png").write_bytes(bytes(100))
    listing = files.frame_listing(spark, str(tmp_path))
    assert {(r["clip_id"], r["source"], r["priority"]) for r in listing.collect()} == {("c1", "Depth_Color", 0), ("c1", "IR", 1), ("c2", "IR", 1)}
    assert [tuple(r) for r in spans.spans(listing).collect()] == [("c1", "2025-06-11", 48106616, 67, 48106616, 67)]
    images = files.frames(spark, str(tmp_path))
    assert sorted(r["readable"] for r in images.collect()) == [False, True, True]
    px = files.pixels(images).select("y", "x", "r", "g", "b").distinct()
    assert {tuple(r) for r in px.collect()} == {(0, 0, 255, 0, 0), (0, 1, 0, 0, 255)}


def test_skeletons(spark):
    good = '{"people": [{"keypoints": [' + ",".join(["[1.0, 2.0, 0.5]"] * 17) + "]}]}"
    df = spark.createDataFrame([("a", 0, good), ("a", 1, "{"), ("a", 2, '{"people": []}'), ("a", 3, '{"people": [{"keypoints": [[1.0]]}]}'), ("a", 4, None)], "clip_id string, frame_no int, raw string")
    assert [(r["frame_no"], len(r["keypoints"])) for r in files.skeletons(df).collect()] == [(0, 17)]


def test_imu(spark, tmp_path):
    (tmp_path / "clip").mkdir()
    row = lambda d, n=16: ",".join(["t", f"{d}(E5:9E)", *(str(k) for k in range(n))])
    (tmp_path / "clip" / "x.csv").write_bytes("时间,设备\n".encode("gbk") + "\n".join([row("WA"), "", row("WA", 3), row("ZZ"), row("WA").replace("15", "x"), row("WB"), row("WA")]).encode())
    got = {(r["clip_id"], r["device"], r["t_idx"], len(r["ch"])) for r in files.imu(spark, str(tmp_path), ("WA", "WB")).collect()}
    assert got == {("clip", "WA", 0, 16), ("clip", "WB", 0, 16), ("clip", "WA", 1, 16)}


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("﻿path,prediction\na,1\n".encode())
    df = files.read_csv(spark, str(tmp_path / "t.csv"), "path string, prediction int")
    assert [tuple(r) for r in df.collect()] == [("a", 1)]
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "t.csv"), "prediction int, path string")
    assert files.write_csv_once(df, str(tmp_path / "out"), "path").count() == 1
    with pytest.raises(Exception, match="EXISTS|exists"):
        files.write_csv_once(df, str(tmp_path / "out"), "path")
    got = files.receipt(b=spark.range(1).selectExpr("2 y", "1 x"), a=spark.range(1).selectExpr("'q' z")).first()[0]
    assert got == '{"a":{"z":"q"},"b":{"x":1,"y":2}}'


def test_stream_sessions(spark, tmp_path):
    rows = [("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:01:00"), ("u", "2024-01-01 00:03:00"), ("v", "2024-01-01 00:00:30"), ("u", "2024-01-01 09:00:00")]
    spark.createDataFrame(rows, "k string, t string").selectExpr("k", "cast(t as timestamp) ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    q = sessions.session_takes(stream, "60 seconds", "10 minutes", ["k"]).writeStream.outputMode("append").format("memory").queryName("takes").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {(r["k"], r["clips"]) for r in spark.table("takes").collect()}
    assert ("v", 1) in got and sum(n for k, n in got if k == "u") >= 3
