"""Fusion of class probabilities with explicit rules for what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeline.functions.columns import arithmetic, geometric, total, valid_probabilities
from takeline.schema import CLASSES, FLOOR

#: Phases of the fault drill, and what they mask of (local view, I, D).
PHASES = ("warm", "Ipartial", "Iall", "Dpartial", "Dall", "localpartial", "localall", "newall", "allmissing")


def invalid(probabilities: DataFrame, classes: int = CLASSES) -> DataFrame:
    """Rows that are no distribution, and ids that occur twice; ``reason`` says which."""
    twice = probabilities.groupBy("clip_id").count().where("count > 1").select("clip_id", F.lit("duplicate id").alias("reason"))
    bad = probabilities.where(~valid_probabilities(F.col("p"), classes)).select("clip_id", F.lit("not a distribution").alias("reason"))
    return twice.unionByName(bad)


def long_form(probabilities: DataFrame) -> DataFrame:
    return probabilities.select("clip_id", F.posexplode("p").alias("cls", "p"))


def pair_average(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(a + b) / 2`` where ``b`` has the clip, else ``a``."""
    joined = a.join(b.withColumnRenamed("p", "q"), "clip_id", "left")
    return joined.select("clip_id", F.when(F.col("q").isNotNull(), F.zip_with("p", "q", lambda x, y: (x + y) / 2)).otherwise(F.col("p")).alias("p"))


def gated(base: Column, q: Column, present: Column, kind: str, weight: float = 0.2) -> Column:
    """``geometric`` or ``arithmetic`` blend where ``present``, else the base."""
    return F.when(present, {"geometric": geometric, "arithmetic": arithmetic}[kind](base, q, weight)).otherwise(base)


def available_average(base: Column, readouts: list[tuple[Column, Column]], weight: float = 0.2) -> Column:
    """``(1 - weight) base + weight * mean`` of the readouts that are present; the base if none is."""
    n = sum((p.cast("int") for p, _ in readouts), F.lit(0))

    def mixed(x: Column, i: Column) -> Column:
        there = sum((F.when(p, F.get(q, i)).otherwise(0.0) for p, q in readouts), F.lit(0.0))
        return F.lit(1 - weight) * x + F.lit(weight) * there / n

    return F.when(n > 0, F.transform(base, mixed)).otherwise(base)


def fuse_members(members: DataFrame, weight: Column, kind: str) -> DataFrame:
    """Fusion of any number of members in long form ``clip_id, cls, p`` by normalised weights."""
    w = members.withColumn("_w", weight)
    if kind == "arithmetic":
        out = w.groupBy("clip_id", "cls").agg((F.sum(F.col("_w") * F.col("p")) / F.sum("_w")).alias("v"))
    else:
        z = w.groupBy("clip_id", "cls").agg((F.sum(F.col("_w") * F.log(F.greatest("p", F.lit(FLOOR)))) / F.sum("_w")).alias("z"))
        out = z.withColumn("v", F.exp(F.col("z") - F.max("z").over(Window.partitionBy("clip_id")))).drop("z")
    return out.select("clip_id", "cls", (F.col("v") / F.sum("v").over(Window.partitionBy("clip_id"))).alias("p"))


def phase_masks(clips: DataFrame) -> DataFrame:
    """``clip_id, phase, local, I, D`` for all phases of the fault drill; ``clips`` has ``row_no, local, I, D``."""
    phases = F.explode(F.array(*map(F.lit, PHASES))).alias("phase")
    seventh = F.pmod("row_no", F.lit(7)) == 0

    def shown(k: str) -> Column:
        gone = (F.col("phase") == f"{k}all") | (F.col("phase") == "allmissing")
        if k != "local":
            gone = gone | (F.col("phase") == "newall")
        return F.col(k) & ~gone & ~((F.col("phase") == f"{k}partial") & seventh)

    return clips.select("*", phases).select("clip_id", "phase", *(shown(k).alias(k) for k in ("local", "I", "D")))


def borrow(probabilities: DataFrame, takes: DataFrame, chain: DataFrame, weight: float = 0.25, min_coverage: float = 0.5) -> DataFrame:
    """Clips of chained takes borrow from the clips at their position in the chain's other takes.

    ``log p + weight * sum of the others' log p``, softmax.  Takes with clips that lack probabilities neither give nor
    get; below the coverage (clips in the take table over all clips) nothing changes.  ``clip_id, p``.
    """
    listed = takes.join(probabilities.select("clip_id", "p"), "clip_id", "left")
    whole = listed.groupBy("take_id").agg(F.bool_and(F.col("p").isNotNull()).alias("whole")).where("whole").select("take_id")
    used = chain.select("take_id", "chain_id").join(whole, "take_id")
    rows = listed.join(used, "take_id").select("clip_id", "chain_id", "position", F.posexplode("p").alias("cls", "p")).withColumn("lp", F.log(F.greatest("p", F.lit(FLOOR))))
    group = Window.partitionBy("chain_id", "position", "cls")
    z = rows.withColumns({"z": F.col("lp") + weight * (F.sum("lp").over(group) - F.col("lp")), "takes": F.count("*").over(group)}).where("takes > 1")
    clip = Window.partitionBy("clip_id")
    e = z.withColumn("e", F.exp(F.col("z") - F.max("z").over(clip)))
    new = e.groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("cls", "e"))).alias("x"))
    new = new.select("clip_id", F.transform("x", lambda s: s["e"]).alias("v")).select("clip_id", F.transform("v", lambda x: x / total(F.col("v"))).alias("q"))
    coverage = takes.join(probabilities, "clip_id", "left_semi").agg(F.count("*").alias("c")).crossJoin(probabilities.agg(F.count("*").alias("n")))
    coverage = coverage.select((F.col("c") / F.greatest("n", F.lit(1)) >= min_coverage).alias("enough"))  # one row
    out = probabilities.join(new, "clip_id", "left").crossJoin(F.broadcast(coverage))
    return out.select("clip_id", F.when(F.col("enough") & F.col("q").isNotNull(), F.col("q")).otherwise(F.col("p")).alias("p"))


def region_pool(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Support-weighted mean of ``z`` by region; a plain mean where no patch, or every patch, has full support."""
    some = F.sum("support")
    plain = (some <= 0) | (some == F.count("*"))
    return tokens.groupBy(*by).agg(F.when(plain, F.avg("z")).otherwise(F.try_divide(F.sum(F.col("z") * F.col("support")), some)).alias("z"))
