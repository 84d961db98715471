"""Sources and sinks: frame listings, images, skeletons, inertial CSV, checked CSV, receipts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takeline.operators.spans import SOURCES
from takeline.schema import IMU
from takeline.sources.settled import settled

#: Channels of a device row, and encodings in the order they are tried.
IMU_CHANNELS = 16
ENCODINGS = ("utf-8", "gbk", "cp1252")


def frame_listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``clip_id, source, priority, file_name`` of files below ``root/<clip>/``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.*").load(f"{root}/{glob}").select("path")
    below = F.split(F.element_at(F.split("path", root.rstrip("/").rsplit("/", 1)[-1] + "/"), -1), "/")
    folder = F.when(F.size(below) > 2, F.get(below, 1)).otherwise(F.lit("root"))
    priority = F.array_position(F.array(*map(F.lit, SOURCES)), folder) - 1
    return files.select(F.get(below, 0).alias("clip_id"), folder.alias("source"), priority.cast("int").alias("priority"), F.element_at(below, -1).alias("file_name")).where("priority >= 0")


def frames(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images: ``path, height, width, channels, data`` (blue, green, red), unreadable ones with ``readable`` false."""
    image = spark.read.format("image").option("recursiveFileLookup", "true").load(root).select("image.*")
    return image.select(F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), "data", (F.col("height") > 0).alias("readable"))


def pixel_rows(images: DataFrame) -> DataFrame:
    """``path, y, r, g, b`` of readable three-channel images: a row for each of an image's rows, its values as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, height, width, data in zip(*(batch.column(c).to_pylist() for c in ("path", "height", "width", "data")), strict=True):
                blue, green, red = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32).T
                ends = pa.array(np.arange(height + 1, dtype=np.int32) * width)
                listed = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(c))) for c in (red, green, blue)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * height), pa.array(np.arange(height, dtype=np.int32)), *listed], names=["path", "y", "r", "g", "b"])

    return images.where("readable and channels = 3").select("path", "height", "width", "data").mapInArrow(run, "path string, y int, r array<int>, g array<int>, b array<int>")


def pixels(images: DataFrame) -> DataFrame:
    """``path, y, x, r, g, b`` of readable three-channel images, a row for each pixel."""
    return pixel_rows(images).select("path", "y", F.posexplode(F.arrays_zip("r", "g", "b")).alias("x", "c")).select("path", "y", "x", "c.*")


def availability(images: DataFrame, clip: str = "clip_id", modality: str = "modality") -> DataFrame:
    """``clip_id, I, D``: whether any frame of a modality could be read."""
    some = lambda m: F.coalesce(F.bool_or(F.when(F.col(modality) == m, F.col("readable"))), F.lit(False))
    return images.groupBy(F.col(clip).alias("clip_id")).agg(some("I").alias("I"), some("D").alias("D"))


def skeletons(raw: DataFrame, joints: int = 17) -> DataFrame:
    """``clip_id, frame_no, keypoints``: the first person of each JSON text; corrupt, empty and misshapen ones go."""
    parsed = F.from_json("raw", "people array<struct<keypoints:array<array<double>>>>")
    first = raw.select("clip_id", "frame_no", F.get(parsed["people"], 0)["keypoints"].alias("keypoints"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = (F.size("keypoints") == joints) & F.forall("keypoints", lambda j: (F.size(j) == 3) & F.forall(j, finite))
    return first.where(F.coalesce(good, F.lit(False)))


def imu(spark: SparkSession, root: str, devices: tuple[str, ...]) -> DataFrame:
    """Rows of inertial CSV files of unsure encoding: header, blank, short and malformed lines and other devices go.

    The first encoding that reads the whole file is used; else bytes are replaced.
    """
    known = set(devices)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for path, content in zip(files["path"], files["content"], strict=True):
                for encoding in ENCODINGS:
                    try:
                        text = content.decode(encoding)
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    text = content.decode("utf-8", "replace")
                count: dict[str, int] = {}
                rows = []
                for line in text.lstrip("﻿").splitlines()[1:]:
                    cells = [c.strip() for c in line.split(",")]
                    device = cells[1].split("(")[0].strip() if len(cells) >= IMU_CHANNELS + 2 else None
                    if device not in known:
                        continue
                    try:
                        channels = [float(c) for c in cells[2 : 2 + IMU_CHANNELS]]
                    except ValueError:
                        continue
                    rows.append((path.rsplit("/", 2)[-2], device, count.get(device, 0), channels))
                    count[device] = count.get(device, 0) + 1
                yield pd.DataFrame(rows, columns=["clip_id", "device", "t_idx", "ch"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(root).select("path", "content").mapInPandas(run, IMU)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, which may begin with a byte order mark; the columns must be the schema's, in order."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names
    header = spark.read.text(path).first()
    if header is not None and header[0].lstrip("﻿").strip() != ",".join(names):
        raise ValueError(f"header {header[0]!r} is not {names}")
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def write_csv_once(df: DataFrame, path: str, order: str) -> DataFrame:
    """Write sorted CSV with LF ends to a path that must not exist; read it back and raise unless it is the same."""
    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    df = settled(df)  # written and compared as it is now
    df.orderBy(order).write.mode("errorifexists").option("header", True).option("lineSep", "\n").csv(path)
    back = df.sparkSession.read.schema(schema).option("header", True).csv(path)
    if back.exceptAll(df).limit(1).count() or df.exceptAll(back).limit(1).count():
        raise ValueError(f"{path} does not read back as written")
    return back


def receipt(**frames_: DataFrame) -> DataFrame:
    """One row ``json`` of one-row tables, each under its name, keys sorted."""
    out = None
    for name, df in sorted(frames_.items()):
        one = df.select(F.struct(*sorted(df.columns)).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out.select(F.to_json(F.struct(*out.columns)).alias("json"))


def read_receipt(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Receipts written as JSON lines; a line that is not JSON of the schema raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def ragged(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """One row per clip with its rows as an ordered array; a clip is as long as a recording's cut."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *values))).alias("data"))
