"""Separable resampling with a triangle filter that widens as an image shrinks, in whole numbers.

Output place ``i`` of ``n_out`` takes input place ``j`` of ``n_in`` with weight ``2 m - |(2 j + 1) n_out - (2 i + 1) n_in|``
(``m``: the larger of both), where that is positive.  The weights of a size are few and the same for all its images: a
sparse table, joined once for columns and once for rows, each followed by a sum and rounding half up, so results don't
depend on the order of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _weight(n_in: Column, n_out: int, i: Column, j: Column) -> Column:
    return 2 * F.greatest(n_in, F.lit(n_out)) - F.abs((2 * j + 1) * n_out - (2 * i + 1) * n_in)


def weights(sizes: DataFrame, n_out: int) -> DataFrame:
    """``n_in, i, j, a, total`` of each distinct ``n_in``: the weight of ``j`` for ``i``, and the sum over ``j``."""
    n_in, most = F.col("n_in"), F.greatest(F.col("n_in"), F.lit(n_out))
    places = sizes.select(F.col("n_in").cast("long").alias("n_in")).distinct().where("n_in > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_out - 1).cast("long"))))
    centre = (2 * F.col("i") + 1) * n_in
    low, high = F.floor((centre - 2 * most) / (2 * n_out)), F.ceil((centre + 2 * most) / (2 * n_out))
    taps = places.withColumn("j", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, n_in - 1))))
    kept = taps.withColumn("a", _weight(n_in, n_out, F.col("i"), F.col("j"))).where("a > 0")
    return kept.join(kept.groupBy("n_in", "i").agg(F.sum("a").alias("total")), ["n_in", "i"])


def _pass(pixels: DataFrame, place: str, size: str, n_out: int, keys: list[str]) -> DataFrame:
    table = weights(pixels.select(F.col(size).alias("n_in")), n_out)
    met = pixels.join(table, (F.col(size) == F.col("n_in")) & (F.col(place) == F.col("j")))
    summed = met.groupBy(*keys, F.col("i").alias("_i")).agg(F.sum(F.col("value") * F.col("a")).alias("_s"), F.sum("a").alias("_t"))
    return summed.select(*keys, F.col("_i").cast("int").alias(place), F.floor((2 * F.col("_s") + F.col("_t")) / (2 * F.col("_t"))).cast("int").alias("value"))


def resized(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """``clip_id, frame_no, y, x, value`` (whole numbers) of images ``clip_id, frame_no, y, x, value, height, width``.

    A place without a pixel has no weight.
    """
    keys = ["clip_id", "frame_no"]
    sizes = pixels.select(*keys, "y", "x", "value", "height", "width")
    across = _pass(sizes, "x", "width", width, [*keys, "y", "height"])
    return _pass(across, "y", "height", height, [*keys, "x"]).select(*keys, "y", "x", "value")


def cell_shares(spans: DataFrame, size: int, side: int, grid: int, border: int = 0) -> DataFrame:
    """``low, high, cell, share``: of each distinct span ``low .. high``, resized to ``side`` places, what part of each cell lies in ``0 .. size``.

    The first and last ``border`` places are cut off, the rest falls into ``grid`` cells of equal length.
    """
    if (side - 2 * border) % grid:
        raise ValueError("the cells are not of one length")
    step = (side - 2 * border) // grid
    known = spans.select("low", "high").distinct().withColumn("n_in", (F.col("high") - F.col("low")).cast("long"))
    met = known.join(weights(known, side), "n_in").where((F.col("i") >= border) & (F.col("i") < side - border))
    at = F.col("low") + F.col("j")
    inside = met.groupBy("low", "high", "i").agg((F.sum(F.when((at >= 0) & (at < size), F.col("a")).otherwise(0)) / F.any_value("total")).alias("s"))
    return inside.groupBy("low", "high", F.floor((F.col("i") - border) / step).cast("int").alias("cell")).agg(F.avg("s").alias("share"))
