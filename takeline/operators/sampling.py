"""Sampling keyed by hashes, so results don't depend on partitions or order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeline.operators.spans import ranked


def draw(*key: Column | str | int) -> Column:
    """A number in [0, 1) from sha2 of the key's parts joined by ``|``."""
    text = F.concat_ws("|", *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 12), 16, 10).cast("long") / F.lit(float(16**12))


def thin(takes: DataFrame, sizes: DataFrame, repeats: int, seed: int, contiguous: bool = False) -> DataFrame:
    """Takes cut to target sizes, ``repeats`` times: ``repeat, take_id, clip_id, position, new_position``.

    ``sizes``: ``u_low, u_high, size``, a partition of [0, 1) by target size (a small table by nature).  Positions are
    drawn at random or as one run with a random start; order is kept.  A target beyond the take keeps it whole.
    """
    drawn = takes.select("take_id", "clip_id", "position", "take_size").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    drawn = drawn.withColumn("u", draw(seed, "size", F.col("repeat"), F.col("take_id")))
    drawn = drawn.join(F.broadcast(sizes), (F.col("u") >= F.col("u_low")) & (F.col("u") < F.col("u_high"))).withColumn("size", F.least("size", "take_size"))
    own = Window.partitionBy("repeat", "take_id")
    if contiguous:
        start = F.floor(draw(seed, "start", F.col("repeat"), F.col("take_id")) * (F.col("take_size") - F.col("size") + 1))
        kept = drawn.where((F.col("position") >= start) & (F.col("position") < start + F.col("size")))
    else:
        place = F.row_number().over(own.orderBy(draw(seed, F.col("repeat"), F.col("take_id"), F.col("position")), "position"))
        kept = drawn.withColumn("_r", place).where("_r <= size")
    return kept.select("repeat", "take_id", "clip_id", "position", (F.row_number().over(own.orderBy("position", "clip_id")) - 1).cast("int").alias("new_position"))


def sample_exactly(table: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The ``n`` rows with the smallest draws (ties by key): the same rows whatever the partitions."""
    return table.orderBy(draw(seed, F.col(key)), key).limit(n)


def inner_groups(users: DataFrame, split: int = 9, groups: int = 4) -> DataFrame:
    """``user, grp``: users in numeric order, those up to ``split`` first, dealt round-robin."""
    number = F.regexp_extract("user", r"\d+", 0).try_cast("int")
    ordered = users.select("user").distinct().withColumns({"number": number, "high": number > split})
    placed = ranked(ordered, ["high", "number", "user"], "i")
    return placed.select("user", F.pmod("i", F.lit(groups)).cast("int").alias("grp"))


def cluster_bootstrap(per_cluster: DataFrame, cluster: str, num: str, den: str, draws: int, seed: int) -> DataFrame:
    """Mean, standard error and percentile interval of ``sum(num) / sum(den)`` over resampled clusters.

    Each draw takes as many clusters as there are, with replacement: place ``j`` of draw ``r`` picks a cluster by hash.
    The clusters are numbered over sorted ranges and joined by number, so draws x clusters rows are made and no list is held.
    """
    rows = per_cluster.select(F.col(cluster).alias("cluster"), F.col(num).alias("num"), F.col(den).alias("den"))
    numbered = ranked(rows, ["cluster"], "i").select("i", "num", "den")
    size = numbered.agg(F.count("*").alias("k"))  # one row
    places = numbered.select(F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("r")).crossJoin(F.broadcast(size))
    picked = places.withColumn("i", F.floor(draw(seed, F.col("r"), F.col("j")) * F.col("k"))).join(numbered, "i")
    each = picked.groupBy("r").agg(F.try_divide(F.sum("num"), F.sum("den")).alias("x"))
    return each.agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("se"), F.percentile("x", 0.025).alias("low"), F.percentile("x", 0.975).alias("high"))
