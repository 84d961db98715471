"""Augmentation of pixel clips by keyed draws: one draw a clip and epoch, the same for all its frames and channels.

A draw is a row: window, flip and erased box.  Applying it is a join of pixels with rows and a change of coordinates, so
results don't depend on partitions, order or workers, and a clip can be made again from its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takeline.operators import resize
from takeline.operators.sampling import draw


def _below(u: Column, n: Column) -> Column:
    """A whole number of ``0 .. n - 1`` from a number in [0, 1)."""
    return F.floor(u * n).cast("int")


def drawn(clips: DataFrame, seed: int, crop: int, scale: tuple[float, float] = (1.0, 1.0), flip: float = 0.0, erase: float = 0.0, erased_part: float = 0.25, least_side: int = 16) -> DataFrame:
    """``clip_id, epoch, side, top, left, flip, box_top, box_left, box_height, box_width`` of ``clip_id, epoch, height, width``.

    The window's side is ``crop`` times a number between ``scale``'s, at least ``least_side``, at most the frame's; a clip is
    flipped or has a box of up to ``erased_part`` of the cropped frame erased with the given probabilities (no box: null).
    """
    u = lambda what: draw(seed, what, F.col("epoch"), F.col("clip_id"))
    side = F.least(F.greatest(F.rint(F.lit(crop) * (scale[0] + (scale[1] - scale[0]) * u("scale"))).cast("int"), F.lit(least_side)), F.col("height"), F.col("width"))
    size = lambda what: F.greatest(F.lit(1), F.floor(crop * erased_part * (0.5 + 0.5 * u(what)))).cast("int")
    rows = clips.select("clip_id", "epoch", "height", "width", side.alias("side"), (u("flip") < flip).alias("flip"), (u("erase") < erase).alias("_erase"), size("box height").alias("_h"), size("box width").alias("_w"))
    box = lambda c: F.when(F.col("_erase"), c)
    return rows.select(
        "clip_id", "epoch", "side", _below(u("top"), F.col("height") - F.col("side") + 1).alias("top"), _below(u("left"), F.col("width") - F.col("side") + 1).alias("left"), "flip",
        box(_below(u("box top"), F.lit(crop) - F.col("_h") + 1)).alias("box_top"), box(_below(u("box left"), F.lit(crop) - F.col("_w") + 1)).alias("box_left"), box(F.col("_h")).alias("box_height"), box(F.col("_w")).alias("box_width"),
    )


def centred(clips: DataFrame, crop: int) -> DataFrame:
    """The draw that is none: the window in the middle of each frame."""
    side = F.least(F.lit(crop), F.col("height"), F.col("width"))
    none = [F.lit(None).cast("int").alias(c) for c in ("box_top", "box_left", "box_height", "box_width")]
    return clips.select("clip_id", "epoch", side.alias("side"), F.floor((F.col("height") - side) / 2).cast("int").alias("top"), F.floor((F.col("width") - side) / 2).cast("int").alias("left"), F.lit(False).alias("flip"), *none)


def applied(pixels: DataFrame, draws: DataFrame, crop: int, fill: int = 0) -> DataFrame:
    """``clip_id, epoch, frame_no, channel, y, x, value`` at ``crop x crop`` of ``clip_id, frame_no, channel, y, x, value``."""
    met = pixels.join(draws.select("clip_id", "epoch", "side", "top", "left"), "clip_id")
    y, x = F.col("y") - F.col("top"), F.col("x") - F.col("left")
    inside = met.where((y >= 0) & (y < F.col("side")) & (x >= 0) & (x < F.col("side")))
    cut = inside.select("clip_id", F.struct("epoch", "frame_no", "channel").alias("frame_no"), y.alias("y"), x.alias("x"), "value", "side")
    same = cut.where(F.col("side") == crop).select("clip_id", "frame_no", "y", "x", "value")
    other = resize.resized(cut.where(F.col("side") != crop).withColumns({"height": F.col("side"), "width": F.col("side")}), crop, crop)
    sized = same.unionByName(other).select("clip_id", "frame_no.*", "y", "x", "value").join(draws.drop("side", "top", "left"), ["clip_id", "epoch"])
    turned = sized.withColumn("x", F.when(F.col("flip"), crop - 1 - F.col("x")).otherwise(F.col("x")))
    within = lambda c, low, n: (F.col(c) >= F.col(low)) & (F.col(c) < F.col(low) + F.col(n))
    erased = F.coalesce(within("y", "box_top", "box_height") & within("x", "box_left", "box_width"), F.lit(False))
    return turned.select("clip_id", "epoch", "frame_no", "channel", "y", "x", F.when(erased, F.lit(fill)).otherwise(F.col("value")).cast("int").alias("value"))


def shifted_depth(depth: DataFrame, seed: int, most: int, epoch: Column, invalid: int = 255) -> DataFrame:
    """``value`` of every valid pixel moved by one number of ``-most .. most`` for its clip, within the scale."""
    offset = _below(draw(seed, "depth", epoch, F.col("clip_id")), F.lit(2 * most + 1)) - most
    moved = F.greatest(F.least(F.col("value") + offset, F.lit(invalid - 1)), F.lit(0))
    return depth.withColumn("value", F.when(F.col("value") == invalid, F.col("value")).otherwise(moved).cast("int"))


def time_cropped(frames: DataFrame, seed: int, least: float, epoch: Column) -> DataFrame:
    """``clip_id, k, frame_no`` of ``clip_id, n``: a run of at least a part ``least`` of a clip's frames, as many of them as before, each the nearest."""
    n = F.col("n")
    keep = F.greatest(F.lit(2), F.floor(n * (least + (1 - least) * draw(seed, "keep", epoch, F.col("clip_id"))))).cast("int")
    start = F.least(_below(draw(seed, "start", epoch, F.col("clip_id")), n - keep + 1), n - keep)
    rows = frames.where(n > 0).select("clip_id", "n", F.when(n >= 4, keep).otherwise(n).alias("keep"), F.when(n >= 4, start).otherwise(0).alias("start"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    pick = F.rint(F.col("k") * ((F.col("keep") - 1) / F.greatest(n - 1, F.lit(1)))).cast("int")
    return rows.select("clip_id", "k", (F.col("start") + pick).alias("frame_no"))
