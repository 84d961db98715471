"""Clips to spans and takes: stamps, clock checks, grouping, order, chains.

Windows are partitioned by date, device or take, never global.  Ties are broken by ``clip_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeline.functions.columns import stamp
from takeline.sources.settled import settled

#: Sources of stamps in order of preference, and the diagnostic visibility modes.
SOURCES = ("Depth_Color", "IR", "Skeleton", "root")
MODES = ("normal", "Depth_hidden", "IR_hidden", "Skeleton_only", "partial_clock", "below50_clock", "all_clock_hidden")


def visible(listing: DataFrame, mode: str = "normal") -> DataFrame:
    """Rows of a frame listing that a visibility mode lets through.

    The modulo modes number the clips by name; ranks are counted over ranges of the name order, not in one task.
    """
    if mode not in MODES:
        raise ValueError(mode)
    if mode == "normal":
        return listing
    shown = {"Depth_hidden": SOURCES[1:3], "IR_hidden": (SOURCES[0], SOURCES[2]), "Skeleton_only": SOURCES[2:3], "all_clock_hidden": ()}.get(mode, SOURCES[:3])
    out = listing.where(F.col("source").isin(*shown)) if shown else listing.limit(0)
    step, keep = {"partial_clock": (7, F.col("i") % 7 != 0), "below50_clock": (3, F.col("i") % 3 == 0)}.get(mode, (0, None))
    if not step:
        return out
    numbers = ranked(listing.select("clip_id").distinct(), ["clip_id"], "i")
    return out.join(numbers.where(keep).select("clip_id"), "clip_id", "left_semi")


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number the rows from 0 in a total order, by a range sort and the sizes of the ranges before (a row each).

    The ranges are written before they are counted, since sampling their bounds again could give others.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    within = settled(parted.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1))
    sizes = within.groupBy("_part").agg(F.count("*").alias("_n"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.join(F.broadcast(base.select("_part", "_base")), "_part").withColumn(name, F.col("_base") + F.col("_in")).drop("_part", "_in", "_base")


def spans(listing: DataFrame) -> DataFrame:
    """One span per clip from the first source that has any readable stamp; clips without one have no row."""
    stamped = listing.withColumn("s", stamp(F.col("file_name"))).where("s is not null")
    best = stamped.groupBy("clip_id", "priority").agg(F.min("s").alias("a"), F.max("s").alias("b"))
    first = best.groupBy("clip_id").agg(F.min_by(F.struct("a", "b"), "priority").alias("x"))
    return first.select("clip_id", F.col("x.a.date").alias("date"), F.col("x.a.ms").alias("start_ms"), F.col("x.a.frame").alias("first_frame"), F.col("x.b.ms").alias("end_ms"), F.col("x.b.frame").alias("last_frame"))


def clock_check(table: DataFrame, tick_ms: int = 100) -> DataFrame:
    """Add ``origin_ms`` and ``reject_reason`` (null: an exact clock)."""
    monotone = (F.col("last_frame") >= F.col("first_frame")) & (F.col("end_ms") >= F.col("start_ms"))
    exact = F.col("end_ms") - F.col("start_ms") == tick_ms * (F.col("last_frame") - F.col("first_frame")).cast("long")
    reason = F.when(~monotone, "nonmonotone span").when(~exact, f"not an exact {tick_ms} ms clock")
    return table.withColumns({"origin_ms": F.col("start_ms") - tick_ms * F.col("first_frame").cast("long"), "reject_reason": reason})


def clock_takes(table: DataFrame, order: str = "start_end", tick_ms: int = 100) -> tuple[DataFrame, DataFrame]:
    """``(take table, rejected)``: clips whose recorder started at the same moment are one take."""
    checked = clock_check(table, tick_ms)
    good = checked.where("reject_reason is null").withColumn("take_id", F.concat(F.lit("clock_"), F.col("date"), F.lit("_"), F.col("origin_ms").cast("string")))
    by: list[Column] = {
        "start_end": [F.col("start_ms"), F.col("end_ms"), F.col("clip_id")],
        "stable_start": [F.col("start_ms"), F.col("clip_id")],
        "reverse_identical": [F.col("start_ms"), F.col("end_ms"), F.col("clip_id").desc()],
    }[order]
    rejected = checked.where("reject_reason is not null").select("clip_id", F.col("reject_reason").alias("reason"))
    return take_table(good, by), rejected


def take_table(clips: DataFrame, order: list[Column]) -> DataFrame:
    """Position and size columns for clips with a ``take_id``."""
    w = Window.partitionBy("take_id")
    return clips.select(
        "clip_id", "take_id", (F.row_number().over(w.orderBy(*order)) - 1).cast("int").alias("position"), F.count("*").over(w).cast("int").alias("take_size"),
        "date", (F.col("start_ms") / 1000.0).alias("seconds"), F.col("first_frame").alias("frame"),
    )


def gap_takes(table: DataFrame, gap_ms: int, device: tuple[str, ...] = (), frames: str | None = "last_frame") -> DataFrame:
    """Add ``take_no`` per date and device: a take ends where the next clip starts over ``gap_ms`` after it, or its
    counter is below the one before (``frames``: the column it is held against, None for no such rule).

    Without a device a date would be one task: then the windows are hours, and each hour gets the last clip and the
    number of takes of those before from a table of a row per date and hour.
    """
    keys = [*device, "date"]
    before = F.struct(F.col("end_ms").alias("end"), F.col(frames or "end_ms").alias("frame"))
    hours = [] if device else ["_hour"]
    rows = table if device else table.withColumn("_hour", F.floor(F.col("start_ms") / 3_600_000))
    w = Window.partitionBy(*keys, *hours).orderBy("start_ms", "clip_id")
    rows = rows.withColumn("_before", F.lag(before).over(w))
    if hours:
        last = rows.groupBy(*keys, *hours).agg(F.max_by(before, F.struct("start_ms", "clip_id")).alias("_last"))
        last = last.withColumn("_last", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_hour")))
        rows = _with_hour(rows, last, keys).withColumn("_before", F.coalesce("_before", "_last")).drop("_last")
    new = F.col("start_ms") - F.col("_before.end") > gap_ms
    if frames:
        new = new | (F.col("first_frame") < F.col("_before.frame"))
    marked = rows.withColumn("_new", F.coalesce(new.cast("int"), F.lit(1))).drop("_before")
    number = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    if hours:
        sums = marked.groupBy(*keys, *hours).agg(F.sum("_new").alias("_takes"))
        sums = sums.withColumn("_base", F.coalesce(F.sum("_takes").over(Window.partitionBy(*keys).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        marked = _with_hour(marked.withColumn("_in", number), sums.drop("_takes"), keys)
        number = F.col("_in") + F.col("_base")
    return marked.withColumn("take_no", number.cast("long")).select(*table.columns, "take_no")


def _with_hour(rows: DataFrame, by_hour: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the other columns of a table by keys and hour; a null key meets a null key."""
    named = by_hour.select(*(F.col(c).alias(f"{c}_") if c in (*keys, "_hour") else F.col(c) for c in by_hour.columns))
    on = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*keys, "_hour")]
    return rows.join(named, on).drop(*(f"{c}_" for c in (*keys, "_hour")))


def take_summary(takes: DataFrame) -> DataFrame:
    """Take id, date, start of its first and last clip, clips."""
    return takes.groupBy("take_id").agg(F.any_value("date").alias("date"), F.min("seconds").alias("start"), F.max("seconds").alias("end"), F.count("*").cast("int").alias("n"))


def chains(summary: DataFrame, gap_seconds: float = 120.0, device: tuple[str, ...] = ()) -> DataFrame:
    """``take_id, chain_id, chain_size`` of takes that follow one of the same size on the same date within the gap."""
    w = Window.partitionBy(*device, "date").orderBy("start", "take_id")
    joined = (F.col("start") - F.lag("end").over(w) < gap_seconds) & (F.col("n") == F.lag("n").over(w))
    marked = summary.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    numbered = marked.withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*device, "date", "_chain")
    named = numbered.withColumns({"chain_id": F.first("take_id").over(own.orderBy("start", "take_id")), "chain_size": F.count("*").over(own).cast("int")})
    return named.where("chain_size > 1").select(*device, "take_id", "chain_id", "chain_size")


def size_histogram(takes: DataFrame, key: list[str]) -> DataFrame:
    return takes.groupBy(*key).agg(F.count("*").alias("take_size")).groupBy("take_size").agg(F.count("*").alias("takes"))


def ties(table: DataFrame) -> DataFrame:
    """Clips beyond the first with the same date, start and end."""
    n = table.groupBy("date", "start_ms", "end_ms").count()
    return n.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("ties"))


def same_partition(a: DataFrame, b: DataFrame) -> DataFrame:
    """``take_id, clips, surplus`` of member sets that one grouping (``take_id, clip_id``) has more of (``surplus`` < 0: ``b``).

    No row means equal whatever the names.  A set is known by its size and two sums over hashes of its members, so no
    task holds a set.
    """
    side = lambda d, sign: d.select(F.lit(sign).alias("side"), F.col("take_id").cast("string").alias("take_id"), "clip_id").distinct()
    hashed = F.xxhash64("clip_id"), F.xxhash64(F.lit("again"), F.col("clip_id")).cast("decimal(38,0)")
    sets = side(a, 1).unionByName(side(b, -1)).groupBy("side", "take_id").agg(F.count("*").alias("clips"), F.bit_xor(hashed[0]).alias("mixed"), F.sum(hashed[1]).alias("total"))
    return sets.groupBy("clips", "mixed", "total").agg(F.min("take_id").alias("take_id"), F.sum("side").alias("surplus")).where("surplus != 0").select("take_id", "clips", "surplus")
