"""Caches per modality: one row a clip (and device), its rows as an ordered array, written once as Parquet.

A clip is as long as a recording's cut, so its array is bounded by nature; clips are never gathered together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takeline.operators import detections, resize, skeletons
from takeline.sources import files
from takeline.sources.settled import settled


def _sized(cache: DataFrame) -> DataFrame:
    return cache.withColumn("n", F.size("data"))


def skeleton_cache(raw: DataFrame) -> DataFrame:
    """``clip_id, data, n``: usable poses of JSON texts in frame order, centred and scaled per clip."""
    poses = skeletons.normalised(files.skeletons(raw))
    return _sized(files.ragged(poses, "clip_id", ["frame_no"], ["keypoints"]))


def imu_cache(rows: DataFrame, devices: tuple[str, ...]) -> DataFrame:
    """``clip_id, device, data, n``: channels in time order of the named devices."""
    known = rows.where(F.col("device").isin(*devices)).withColumn("key", F.struct("clip_id", "device"))
    return _sized(files.ragged(known, "key", ["t_idx"], ["ch"])).select("key.*", "data", "n")


def depth_cache(pixels: DataFrame, palette: DataFrame, windows: DataFrame, height: int, width: int) -> DataFrame:
    """``clip_id, frame_no, data, n``: a clip's window of each frame, colours read as depth, row by row."""
    ranks = detections.decode_palette(pixels.drop("depth_rank"), palette).withColumnRenamed("depth_rank", "value")
    cut = detections.crop_pad(ranks, windows, height, width).withColumn("key", F.struct("clip_id", "frame_no"))
    return _sized(files.ragged(cut, "key", ["wy", "wx"], ["value"])).select("key.*", "data", "n")


def fused_cache(frames: DataFrame, depth: DataFrame, infrared: DataFrame, most: int = 32) -> DataFrame:
    """``clip_id, k, depth, infrared, aligned``: the chosen frames' arrays side by side; a dead infrared channel is empty.

    ``depth``, ``infrared``: ``clip_id, frame_no, data``.
    """
    chosen = detections.four_channels(frames, most)
    d = depth.select("clip_id", F.col("frame_no").alias("depth_no"), F.col("data").alias("depth"))
    i = infrared.select("clip_id", F.col("frame_no").alias("ir_no"), F.col("data").alias("infrared"))
    both = chosen.join(d, ["clip_id", "depth_no"]).join(i, ["clip_id", "ir_no"], "left")
    return both.select("clip_id", "k", "depth", F.when(~F.col("ir_dead"), F.col("infrared")).alias("infrared"), "aligned")


def image_cache(pixels: DataFrame, side: int) -> DataFrame:
    """``clip_id, frame_no, data, n``: every frame at ``side x side``, row by row; ``pixels`` have their frame's ``height, width``."""
    sized = resize.resized(pixels, side, side).withColumn("key", F.struct("clip_id", "frame_no"))
    return _sized(files.ragged(sized, "key", ["y", "x"], ["value"])).select("key.*", "data", "n")


def sized_frames(frames: DataFrame, pixels: DataFrame, windows: DataFrame, height: int, width: int, side: int, most: int = 32) -> tuple[DataFrame, DataFrame]:
    """``clip_id, frame_no, data`` of the chosen frames of depth and of infrared, cut to the clip's window at ``side x side``."""
    chosen = detections.four_channels(frames, most)
    sized = settled(detections.fused_pixels(chosen, pixels, windows, height, width, side).join(chosen.select("clip_id", "k", "depth_no", "ir_no"), ["clip_id", "k"]))
    of = lambda own, number: files.ragged(sized.where(own).withColumn("key", F.struct("clip_id", F.col(number).alias("frame_no"))), "key", ["channel", "y", "x"], ["value"]).select("key.*", "data")
    return of(F.col("channel") < 3, "depth_no"), of(F.col("channel") == 3, "ir_no")


def write_cache(cache: DataFrame, path: str) -> None:
    """To a path that must not exist."""
    cache.write.mode("errorifexists").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows one by one again; columns that a query does not use are not read."""
    cache = spark.read.parquet(path)
    keys = [c for c in cache.columns if c not in ("data", "n")]
    return cache.select(*keys, F.explode("data").alias("row")).select(*keys, "row.*")
