"""Transition prior over labels that follow each other in a take."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bigrams(clips: DataFrame, take: list[str], order: list[str], label: str = "label") -> DataFrame:
    """``prev, next`` of neighbours; clips without a label are dropped first."""
    w = Window.partitionBy(*take).orderBy(*order)
    pairs = clips.where(F.col(label).isNotNull()).withColumn("prev", F.lag(label).over(w))
    return pairs.where("prev is not null").withColumn("next", F.col(label))


def transition_prior(pairs: DataFrame, classes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Add-one counts, each row of the matrix normalised; ``classes``: one column ``cls`` (small by nature).

    ``by``: further keys, each with a matrix of its own over the same classes.
    """
    counts = pairs.groupBy(*by, "prev", "next").agg(F.count("*").alias("n"))
    grid = classes.select(F.col("cls").alias("prev")).crossJoin(classes.select(F.col("cls").alias("next")))
    if by:
        grid = pairs.select(*by).distinct().crossJoin(grid)
    full = grid.join(counts, [*by, "prev", "next"], "left").withColumn("c", F.coalesce("n", F.lit(0)) + 1)
    return full.select(*by, "prev", "next", (F.col("c") / F.sum("c").over(Window.partitionBy(*by, "prev"))).alias("p"))


def leave_fold_out(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """One prior per ``fold``, counted over the other folds: all counts less the fold's own, so pairs are read once."""
    own = pairs.groupBy("fold", "prev", "next").agg(F.count("*").alias("own"))
    every = own.groupBy("prev", "next").agg(F.sum("own").alias("n"))
    grid = classes.select(F.col("cls").alias("prev")).crossJoin(classes.select(F.col("cls").alias("next"))).crossJoin(own.select("fold").distinct())
    full = grid.join(every, ["prev", "next"], "left").join(own, ["fold", "prev", "next"], "left")
    full = full.withColumn("c", F.coalesce("n", F.lit(0)) - F.coalesce("own", F.lit(0)) + 1)
    return full.select("fold", "prev", "next", (F.col("c") / F.sum("c").over(Window.partitionBy("fold", "prev"))).alias("p"))
