"""Coded tensors: streams against plain bit strings, layouts against numpy, and streams and bases that don't fit."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from takeline.operators import codec


def codes_frame(spark, tensors, scale=None):
    rows = [(k, i, int(c), float(scale[k][i]) if scale else 1.0) for k, t in tensors.items() for i, c in enumerate(t)]
    return spark.createDataFrame(rows, "key string, idx long, code int, scale double").repartition(5)


@pytest.mark.parametrize("bits", range(1, 9))
def test_packing_both_ways(spark, bits):
    rng = np.random.default_rng(bits)
    tensors = {"a": rng.integers(0, 1 << bits, 10_001), "b": rng.integers(0, 1 << bits, 4096), "c": [(1 << bits) - 1], "d": [0] * 9}
    df = codes_frame(spark, tensors)
    chunks = codec.packed_chunks(df, ["key"], "idx", "code", bits)
    whole = {r["key"]: (r["n"], bytes(r["stream"])) for r in codec.bit_packed(df, ["key"], "idx", "code", bits).collect()}
    for k, t in tensors.items():
        want = np.packbits(np.unpackbits(np.array(t, np.uint8)[:, None], axis=1, count=bits, bitorder="little").reshape(-1), bitorder="little").tobytes()
        assert whole[k] == (len(t), want)
    back = codec.bit_unpacked(chunks, ["key"], bits).collect()
    assert sorted((r["key"], r["idx"], r["code"]) for r in back) == sorted((k, i, int(c)) for k, t in tensors.items() for i, c in enumerate(t))


def test_packing_refuses(spark):
    one = lambda rows: spark.createDataFrame(rows, "key string, idx long, code int")
    for rows, why in (([("a", 0, 8)], "not a code"), ([("a", 0, -1)], "not a code"), ([("a", 0, 1), ("a", 2, 1)], "places are not"), ([("a", 0, 1), ("a", 0, 1)], "places are not"), ([("a", i, 1) for i in range(20) if not 8 <= i < 16], "places are not"), ([("a", 5000, 1)], "places are not")):
        with pytest.raises(Exception, match=why):
            codec.bit_packed(one(rows), ["key"], "idx", "code", 3).collect()
    chunk = spark.createDataFrame([("a", 0, 3, bytearray(b"\xff\x01"))], "key string, chunk long, n int, stream binary")
    assert [r["code"] for r in codec.bit_unpacked(chunk, ["key"], 3).orderBy("idx").collect()] == [7, 7, 7]
    for stream, why in ((b"\xff", "wrong length"), (b"\xff\x03", "unused bits"), (b"\xff\x01\x00", "wrong length")):
        with pytest.raises(Exception, match=why):
            codec.bit_unpacked(chunk.withColumn("stream", F.lit(bytearray(stream))), ["key"], 3).collect()
    assert codec.bit_packed(one([]), ["key"], "idx", "code", 3).collect() == []


def test_numbers_in_one_order(spark):
    rows = [(f"k{i % 3}", i * 7 % 101, i) for i in range(100)]
    got = codec.numbered(spark.createDataFrame(rows, "key string, a int, b int").repartition(7), ["key"], ["a", "b"]).collect()
    for key in {r[0] for r in rows}:
        want = sorted((a, b) for k, a, b in rows if k == key)
        assert [(r["a"], r["b"]) for r in sorted((r for r in got if r["key"] == key), key=lambda r: r["idx"])] == want
        assert sorted(r["idx"] for r in got if r["key"] == key) == list(range(len(want)))


def tensors_of(seed, bits, n=3000):
    rng = np.random.default_rng(seed)
    top = (1 << (bits - 1)) - 1
    base = {"a": rng.integers(-127, 128, n), "b": np.round(rng.normal(0, 20, 500)).clip(-127, 127).astype(int), "one": np.array([5])}
    scales = {k: (np.repeat(rng.uniform(0.5, 2, 1 + len(v) // 50), 50)[: len(v)], np.repeat(rng.choice([0.0, 0.7, 1.3], 1 + len(v) // 50), 50)[: len(v)]) for k, v in base.items()}
    target = {k: (np.round(v * top / 127) + rng.integers(-1, 2, len(v))).clip(-top, top).astype(int) for k, v in base.items()}
    target["b"] = rng.permutation(target["b"])
    return base, target, {k: s[0] for k, s in scales.items()}, {k: s[1] for k, s in scales.items()}


@pytest.mark.parametrize("bits", [7, 8])
def test_layouts_and_round_trip(spark, bits, monkeypatch):
    monkeypatch.setattr(codec, "BLOCK", 64)
    base, target, base_scale, scale = tensors_of(bits, bits)
    b, t = codes_frame(spark, base, base_scale), codes_frame(spark, target, scale)
    got = {}
    for r in codec.residual_layouts(t, b, bits).collect():
        got.setdefault((r["key"], r["method"]), {})[r["place"]] = r["byte"]
    for k in base:
        order = np.argsort(base[k], kind="stable")
        if bits < 8:
            guess = np.rint(base[k] * 63 / 127)
        else:
            guess = np.clip(np.rint(base[k] * np.divide(base_scale[k], scale[k], out=np.ones(len(base[k])), where=scale[k] != 0)), -127, 127)
        for method, want in (("original-residual", (target[k] - base[k]) % 256), ("scale-context-residual", ((target[k] - guess.astype(int)) % 256)[order])):
            assert [v for _, v in sorted(got[k, method].items())] == want.tolist()
    payload, manifest = codec.encode_delta(t, b, bits, 1000)
    kept = {r["key"]: (r["m"], r["n"]) for r in payload.groupBy("key").agg(F.min("method").alias("m"), F.count_distinct("method").alias("n")).collect()}
    assert all(n == 1 for _, n in kept.values()) and payload.where("key = 'a'").count() == 3
    back = {(r["key"], r["idx"]): (r["code"], r["scale"]) for r in codec.decode_delta(payload, manifest, b, t.select("key", "idx", "scale"), bits, 1000).collect()}
    assert back == {(k, i): (int(c), float(scale[k][i])) for k, v in target.items() for i, c in enumerate(v)}

    for other, why in ((b.withColumn("code", F.when(F.col("idx") == 0, F.col("code") - F.signum("code").cast("int")).otherwise(F.col("code"))), "another base"), (b.where("key != 'b'"), "another base"), (b.where("idx != 1"), "another base")):
        with pytest.raises(Exception, match=why):
            codec.decode_delta(payload, manifest, other, t.select("key", "idx", "scale"), bits, 1000).collect()
    with pytest.raises(Exception, match="wrong hash of"):
        codec.decode_delta(payload, manifest.withColumn("sha256", F.lit("0")), b, t.select("key", "idx", "scale"), bits, 1000).collect()
    with pytest.raises(Exception, match="don't meet|wrong hash"):
        codec.decode_delta(payload.where("not (key = 'a' and chunk = 1)"), manifest, b, t.select("key", "idx", "scale"), bits, 1000).collect()
    with pytest.raises(Exception, match="one side only"):
        codec.residual_layouts(t.where("idx != 0"), b, bits).collect()


def test_faulty_streams(spark):
    layout = codec.byte_layouts(spark.createDataFrame([("k", i, i % 7) for i in range(4000)], "key string, idx long, value long"), 4)
    payload = codec.smallest(layout, 3000).cache()
    assert codec.from_layout(codec.layout_bytes(payload, 3000), 4).where("value != idx % 7").count() == 0
    cut = F.expr("substring(packed, 1, length(packed) - 3)")
    changed = F.concat(F.expr("substring(packed, 1, 20)"), F.lit(bytearray(b"\x55\xaa")), F.expr("substring(packed, 23, length(packed))"))
    for column, value in (("packed", cut), ("packed", F.concat("packed", F.lit(bytearray(b"x")))), ("packed", changed), ("length", F.col("length") - 1), ("length", F.col("length") + 1), ("sha256", F.sha2("sha256", 256)), ("codec", F.lit("other"))):
        with pytest.raises(Exception, match="k, chunk"):
            codec.layout_bytes(payload.withColumn(column, value), 3000).collect()


@pytest.mark.parametrize("width", [1, 2, 4])
def test_planes(spark, width):
    rng = random.Random(width)
    values = {k: [rng.randrange(-(1 << (8 * width - 1)), 1 << (8 * width - 1)) for _ in range(n)] for k, n in (("a", 700), ("b", 1))}
    df = spark.createDataFrame([(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)], "key string, idx long, value long").repartition(3)
    layouts = codec.byte_layouts(df, width)
    raw = np.array(values["a"], f"<i{width}").tobytes()
    want = {"identity": raw} | ({"byteplanes": np.frombuffer(raw, np.uint8).reshape(-1, width).T.tobytes()} if width > 1 else {})
    assert {r["method"]: bytes(r["raw"]) for r in codec.chunked(layouts).where("key = 'a'").collect()} == want
    for method in want:
        back = codec.from_layout(layouts.where(F.col("method") == method), width).collect()
        assert sorted((r["key"], r["idx"], r["value"]) for r in back) == sorted((k, i, v) for k, vs in values.items() for i, v in enumerate(vs))


def test_many_codes_in_linear_time(spark):
    """Half a million codes in one tensor take a few seconds either way."""
    df = spark.range(500_000).selectExpr("'t' AS key", "id AS idx", "CAST((id * 2654435761 % 1000003) % 128 AS INT) AS code")
    packed = codec.packed_chunks(df, ["key"], "idx", "code", 7)
    back = codec.bit_unpacked(packed, ["key"], 7)
    assert back.join(df.withColumnRenamed("code", "want"), ["key", "idx"]).where("code = want").count() == back.count() == 500_000
