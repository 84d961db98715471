"""Takes over streams equal takes over tables, whatever the order within the lateness, and across restarts."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from takeline.operators import spans
from takeline.streaming import takes

SCHEMA = "device string, clip_id string, ts timestamp, end_ms long, first_frame int, last_frame int"
START = 1_700_000_000_000


@pytest.fixture(autouse=True)
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", takes.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def clips(seed, n=120):
    rng = random.Random(seed)
    out, now, frame = [], {d: START + 1000 for d in "ab"}, dict.fromkeys("ab", 0)
    for i in range(n):
        d = rng.choice("ab")
        now[d] += rng.choice([0, 1000, 20_000, 60_001, 60_000, 90_000])
        frame[d] = rng.choice([0, frame[d], frame[d] + 5, max(0, frame[d] - 3)])
        length = rng.choice([0, 500, 3000])
        out.append((d, f"c{rng.randrange(1000):03}{i}", now[d], now[d] + length, frame[d], frame[d] + rng.randrange(4)))
        now[d] += length
        frame[d] = out[-1][5]
    return sorted(out, key=lambda x: x[2])


def row(x):
    return (x[0], x[1], datetime.datetime.fromtimestamp(x[2] / 1000, datetime.UTC).replace(tzinfo=None), *x[3:])


def batch(spark, rows, frames):
    df = spark.createDataFrame(list(map(row, rows)), SCHEMA).withColumns({"date": F.lit("d"), "start_ms": F.unix_millis("ts")})
    found = spans.gap_takes(df, 60_000, ("device",), frames)
    w = Window.partitionBy("device", "take_no")
    return sorted(tuple(r) for r in found.select("device", "clip_id", F.min("start_ms").over(w), (F.row_number().over(w.orderBy("start_ms", "clip_id")) - 1).cast("long")).collect())


def streamed(spark, tmp_path, files, frames, late="10 minutes", sink="out", stop_after=None):
    """Write files one by one and run the stream over each, as if it were restarted every time."""
    source = tmp_path / "in"
    source.mkdir(exist_ok=True)
    for k, rows in enumerate(files):
        spark.createDataFrame(list(map(row, rows)), SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        found = takes.stream_takes(stream, 60_000, late, ["device"], frames)
        q = found.writeStream.format("parquet").option("path", str(tmp_path / sink)).option("checkpointLocation", str(tmp_path / f"{sink}-state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / sink)).collect())


END = [("z", "end", START + 10**9, START + 10**9, 0, 0)]  # moves the watermark on


@pytest.mark.parametrize("frames", ["last_frame", "first_frame", None])
def test_stream_equals_table(spark, tmp_path, frames):
    """Files in order, restarted from the checkpoint for each."""
    rows = clips(1)
    got = streamed(spark, tmp_path, [rows[:50], rows[50:90], rows[90:] + END], frames)
    assert got == batch(spark, rows, frames)


def test_out_of_order_and_late(spark, tmp_path):
    """Out of order within the lateness is the same; a clip behind the watermark is dropped."""
    rows = clips(2, 60)
    shuffled = rows[:30]
    random.Random(0).shuffle(shuffled)
    late = ("a", "late", START, START, 0, 0)
    assert rows[29][2] - START < 20 * 60_000
    got = streamed(spark, tmp_path, [shuffled[:15], shuffled[15:], rows[30:] + END, [late, ("z", "end2", START + 2 * 10**9, START + 2 * 10**9, 0, 0)]], "last_frame", late="100 minutes")
    assert [r for r in got if r[0] != "z"] == batch(spark, rows, "last_frame")
    assert ("z", "end", START + 10**9, 0) in got and not any(r[1] == "late" for r in got)


def test_needs_its_state_store(spark):
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    with pytest.raises(ValueError, match="providerClass"):
        takes.stream_takes(spark.createDataFrame([], SCHEMA), 1, "1 minute", ["device"])
