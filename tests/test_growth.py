"""Queries whose results or costs went wrong as tables grew, on tables small enough to see it."""

import lzma

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from takeline.operators import integrity
from takeline.streaming import takes


def test_codes_of_single_floats(spark, tmp_path):
    """0.16 as a float is a little less than 0.16, and a thousand times it is 160 as a float, but less as a double."""
    import duckdb

    rows = np.full((2, 64), 0.16, np.float32)
    rows[1] = [0.225, -0.173, 0.242, 0.161] * 16
    table = pa.table({"vec_id": [1, 2], "embedding": pa.array(rows.tolist(), pa.list_(pa.float32())), "label": pa.array([0, 1], pa.int32())})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = entry.queries()["bit_packed_codes"](spark, str(tmp_path)).select("vec_id", "n", "stream").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT vec_id, n, stream FROM ({entry.oracle_sql()["bit_packed_codes"]})").fetchall())


def test_texts_are_coded_once_and_dealt(spark, tmp_path):
    """One row group is no longer one task, each text is coded once, and a small dictionary codes as the default one does."""
    from pyspark.sql import functions as F

    pq.write_table(pa.table({"key": [str(i) for i in range(400)], "blob": [b"%d " % i * (i % 50) for i in range(400)]}), tmp_path / "t.parquet")
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            calls.add(len(batch))
            yield batch

    pairs = spark.read.parquet(str(tmp_path / "t.parquet")).withColumn("base", F.reverse(F.col("blob").cast("string")).cast("binary"))
    counted = pairs.mapInPandas(seen, pairs.schema)
    coded = integrity.pack_deltas(counted)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert coded.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    calls.value = 0
    back = integrity.unpack_deltas(coded, pairs).collect()
    assert calls.value == 400 and {r["key"]: bytes(r["blob"]) for r in back} == {r["key"]: bytes(r["blob"]) for r in pairs.collect()}
    for blob in (b"", b"x", b"abc " * 5000, np.random.default_rng(0).bytes(70_000)):
        assert len(integrity._lzma(blob)) == len(lzma.compress(blob)) and lzma.decompress(integrity._lzma(blob)) == blob


def test_a_timer_for_each_arrival():
    """However many clips of a key come together, they ask for one timer and write one row of state."""
    from unittest import mock

    import pandas as pd

    handle = mock.MagicMock()
    processor = takes._Takes(["device"], 60_000, None)
    processor.init(handle)
    rows = pd.DataFrame({"start_ms": range(1000, 6000), "clip_id": [f"c{i}" for i in range(5000)], "end_ms": range(1000, 6000), "first_frame": 0, "last_frame": 0})
    now = mock.MagicMock(**{"getCurrentWatermarkInMs.return_value": 0})
    assert list(processor.handleInputRows(("a",), iter([rows[2500:], rows[:2500]]), now)) == []
    assert handle.registerTimer.call_args_list == [mock.call(1000)] and processor.waiting.appendValue.call_count == 1


def test_one_worker_for_a_bag(spark):
    """The members of a bag answer in one pass, as each of them alone does."""
    from takeline.operators import heads

    rng = np.random.default_rng(3)
    members = [(heads.Head(rng.normal(size=2), np.ones(2), rng.normal(size=(3, 2)), rng.normal(size=3), (0, 2, 3), 1), 1.0) for _ in range(3)]
    x = rng.normal(size=(heads.ANSWERED + 5, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>").repartition(1)
    bag = heads.bagged(df, members, 4, calibrated=False)
    assert bag._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {r["id"]: r["p"] for r in bag.collect()}
    want = np.mean([h.probabilities(x, 4) for h, _ in members], axis=0)
    assert np.allclose([got[i] for i in range(len(x))], want, atol=1e-9)


def test_a_base_is_read_twice(spark):
    """Decoding reads its base to check it and to use it, and no more."""
    from takeline.operators import codec

    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    base = spark.createDataFrame([("a", i, i * 7 % 250 - 125, 0.5) for i in range(300)], "key string, idx long, code int, scale double").coalesce(1)
    payload, manifest = codec.encode_delta(base, base)
    payload, manifest = payload.cache(), manifest.cache()
    assert payload.count() and manifest.count()
    back = codec.decode_delta(payload, manifest, base.mapInPandas(seen, base.schema), base.select("key", "idx", "scale"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, base.collect()))
    assert reads.value <= 600


def test_curves_are_made_once(spark):
    """What the fusion queries read several times decodes nothing again."""
    import os

    import pytest

    from takeline.plans import comparisons

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    assert "MapInPandas" not in comparisons.fusion_curves(spark, folder)._jdf.queryExecution().optimizedPlan().toString()


def test_members_are_dealt_by_clip(spark):
    """Few members with many clips: no task gets all of a member's rows, and no row is made for each class."""
    from pyspark.sql import functions as F

    from takeline.operators import studies

    members = spark.createDataFrame([(m, str(i), [0.5, 0.25, 0.25]) for m in "pq" for i in range(400)], "member string, clip_id string, p array<double>")
    odd = [("p", "odd", None), ("q", "odd", [1.0]), ("p", "twice", [0.5, 0.5]), ("p", "twice", [0.5, 0.5]), ("q", "twice", [0.5, 0.5]), ("p", "short", [0.5, 0.5]), ("q", "short", [0.25]), ("p", "gap", [0.5, None]), ("q", "gap", [0.25, None])]
    members = members.unionByName(spark.createDataFrame(odd, members.schema))
    settings = spark.createDataFrame([("mean", "p", 1.0, False), ("mean", "q", 1.0, False), ("last", "q", 2.0, False)], "config string, member string, weight double, geometric boolean")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mixed = studies.blends(members, settings)
        plan = mixed._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(member" not in plan and "explode(p" not in plan
        most = mixed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert most < 400
    got = {(r["config"], r["clip_id"]): r["p"] for r in mixed.collect()}
    assert got["mean", "7"] == [0.5, 0.25, 0.25] and got["mean", "short"] == [0.375] and got["mean", "gap"] == [0.375, None] and got["last", "odd"] == [1.0]
    assert ("mean", "odd") not in got and ("mean", "twice") not in got and len(got) == 2 * 400 + 2 + 4


def test_weight_curves_are_dealt_by_clip(spark, tmp_path, monkeypatch):
    """The whole query gives a task no more of a member than of its clips, and says what its SQL says."""
    import duckdb

    from takeline.operators import studies

    rng = np.random.default_rng(5)
    table = pa.table({"vec_id": range(120), "embedding": pa.array(rng.normal(size=(120, 64)).astype(np.float32).tolist(), pa.list_(pa.float32())), "label": pa.array(rng.integers(0, 10, 120).tolist(), pa.int32())})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    plans, curves = [], studies.accuracy_curves

    def seen(decoded, truth):
        plans.append(decoded._jdf.queryExecution().executedPlan().toString())
        return curves(decoded, truth)

    monkeypatch.setattr(studies, "accuracy_curves", seen)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = entry.queries()["weight_curves"](spark, str(tmp_path)).select("config", "weight", "population", "fold", "accuracy").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) == 1 and "hashpartitioning(member" not in plans[0]
    assert "hashpartitioning(clip_id" in plans[0]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.execute(f"SELECT config, weight, population, fold, accuracy FROM ({entry.oracle_sql()["weight_curves"]})").fetchall()
    assert len(got) == len(want) == 240
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_rungs_are_decided_once(spark):
    """A later rung's tasks don't sort, join and judge again what an earlier one has decided."""
    from takeline.operators import detections

    box = "clip_id string, probe int, x1 double, y1 double, x2 double, y2 double, score double"
    frames = spark.createDataFrame([(f"c{i}", 100, 200) for i in range(60)], "clip_id string, height int, width int")
    plain = spark.createDataFrame([(f"c{i}", 0, 50.0, 40.0, 70.0, 80.0, 0.9 if i % 3 == 0 else 0.2) for i in range(50)], box)
    tiled = spark.createDataFrame([(f"c{i}", 0, 1, 1.0, 1.0, 9.0, 9.0, 0.8 if i % 3 == 1 else 0.15) for i in range(60)], box.replace("probe int,", "probe int, tile int,"))
    motion = spark.createDataFrame([(f"c{i}", 10, 20, 30, 50) for i in range(0, 60, 2)], "clip_id string, top int, left int, bottom int, right int")
    for key, value in {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}.items():
        spark.conf.set(key, value)
    try:
        found = detections.rescued_windows(frames, plain, tiled, motion)
        assert found._jdf.queryExecution().executedPlan().toString().count("Sort [") <= 4
        got = {r["clip_id"]: (r["source"], r["n_detected"], r["best_score"]) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    first = {f"c{i}": ("strong", 1, 0.9) for i in range(0, 50, 3)}
    second = {f"c{i}": ("tiled", 1, 0.8) for i in range(60) if i % 3 == 1}
    rest = {f"c{i}": ("motion" if i % 2 == 0 else "whole", 0, 0.15) for i in range(60) if f"c{i}" not in first and f"c{i}" not in second}
    assert got == first | second | rest and found.count() == 60
