"""Poses of 17 joints as ``array<array<double>>`` (x, y, height): bones, size, mirror, yaw, cuts in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takeline.functions.columns import resample
from takeline.operators.sampling import draw

#: Bones as (parent, child), pairs of left and right joints, and the least summed bone length of a body.
BONES = ((0, 1), (1, 2), (2, 3), (0, 4), (4, 5), (5, 6), (0, 7), (7, 8), (8, 9), (9, 10), (8, 11), (11, 12), (12, 13), (8, 14), (14, 15), (15, 16))
MIRRORED = ((1, 4), (2, 5), (3, 6), (11, 14), (12, 15), (13, 16))
MIN_SIZE = 1.0


def _joint(pose: Column, k: int) -> Column:
    return F.get(pose, F.lit(k))


def bone_lengths(pose: Column) -> Column:
    """Length of each bone."""
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return F.array(*(F.sqrt(square(_joint(pose, a), _joint(pose, b))) for a, b in BONES))


def bone_vectors(pose: Column) -> Column:
    """Each joint less its parent; zeros for the root."""
    parent = {b: a for a, b in BONES}
    vector = lambda k: F.zip_with(_joint(pose, k), _joint(pose, parent[k]), lambda x, y: x - y)
    return F.array(*(vector(k) if k in parent else F.array(*[F.lit(0.0)] * 3) for k in range(len(BONES) + 1)))


def mirrored(pose: Column) -> Column:
    """Left and right swapped, the first coordinate negated."""
    to = {a: b for pair in MIRRORED for a, b in (pair, pair[::-1])}
    return F.array(*(F.transform(_joint(pose, to.get(k, k)), lambda v, i: F.when(i == 0, -v).otherwise(v)) for k in range(len(BONES) + 1)))


def turned(pose: Column, angle: Column) -> Column:
    """Turned about the vertical by an angle."""
    x, y = (lambda j: F.get(j, 0)), (lambda j: F.get(j, 1))
    return F.transform(pose, lambda j: F.array(F.cos(angle) * x(j) - F.sin(angle) * y(j), F.sin(angle) * x(j) + F.cos(angle) * y(j), F.get(j, 2)))


def normalised(poses: DataFrame) -> DataFrame:
    """``clip_id, frame_no, keypoints``: centred on the root in the plane, divided by the clip's median summed bone length
    if that reaches ``MIN_SIZE``."""
    centred = F.transform("keypoints", lambda j: F.array(F.get(j, 0) - F.get(_joint(F.col("keypoints"), 0), 0), F.get(j, 1) - F.get(_joint(F.col("keypoints"), 0), 1), F.get(j, 2)))
    rows = poses.select("clip_id", "frame_no", centred.alias("keypoints"))
    size = F.aggregate(bone_lengths(F.col("keypoints")), F.lit(0.0), lambda a, x: a + x)
    scale = rows.groupBy("clip_id").agg(F.percentile(size, 0.5).alias("scale"))  # over the frames of one clip
    by = F.when(F.col("scale") >= MIN_SIZE, F.col("scale")).otherwise(1.0)
    return rows.join(scale, "clip_id").select("clip_id", "frame_no", F.transform("keypoints", lambda j: F.transform(j, lambda v: v / by)).alias("keypoints"))


def keyed_yaw(seed: int, epoch: Column, clip_id: Column, most: float) -> Column:
    """An angle in ``[-most, most)`` by hash of seed, epoch and clip: one for a whole clip."""
    return (draw(seed, "yaw", epoch, clip_id) * 2 - 1) * most


def keyed_time_crop(x: Column, n: Column, seed: int, epoch: Column, clip_id: Column, least: float, frames: int) -> Column:
    """A run of a clip's ``n`` values with a hashed length (at least a part ``least``) and start, stretched to ``frames``."""
    keep = F.greatest(F.lit(2), F.floor(n * (least + (1 - least) * draw(seed, "keep", epoch, clip_id)))).cast("int")
    start = F.least(F.floor(draw(seed, "start", epoch, clip_id) * (n - keep + 1)), n - keep).cast("int")
    return resample(F.when(n >= 4, F.slice(x, start + 1, keep)).otherwise(x), frames)

