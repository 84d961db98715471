"""Joint decoding of takes: labels of one take differ, neighbours follow the prior.

Takes of up to three clips are exact in SQL.  Longer ones run a beam search over gathered takes in Arrow batches; a take
has at most as many clips as there are classes, so it is small.  Ties: the larger score, then the lower class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from takeline.functions.columns import argmax, last_component
from takeline.schema import CLASSES, FLOOR


def _logs(p: np.ndarray) -> np.ndarray:
    return np.log(np.clip(p, FLOOR, None))


def beams(p: np.ndarray, prior: np.ndarray, weight: float, width: int, candidates: int) -> tuple[np.ndarray, np.ndarray]:
    """Final beam: scores and label rows, best first.  Extension of all beams is one array operation a clip."""
    lp, n = _logs(p), len(p)
    if n == 1:
        return np.array([lp[0].max()]), np.array([[lp[0].argmax()]])
    step = weight * _logs(prior)
    scores, rows = np.zeros(1), np.zeros((1, 0), np.int64)
    for i in range(n):
        order = np.argsort(-lp[i], kind="stable")
        for classes in (order[:candidates], np.arange(p.shape[1])):
            grown = np.repeat(scores[:, None], len(classes), 1) + lp[i, classes]
            if i:
                grown += step[rows[:, -1]][:, classes]
                grown[(rows[:, :, None] == classes).any(1)] = -np.inf
            if np.isfinite(grown).any():  # else every candidate is used in every beam, and all classes are tried
                break
        flat = grown.ravel()
        best = np.argsort(-flat, kind="stable")[:width]
        best = best[np.isfinite(flat[best])]
        b, c = np.divmod(best, len(classes))
        scores, rows = flat[best], np.c_[rows[b], classes[c]]
    return scores, rows


def assign(p: np.ndarray) -> np.ndarray:
    """Distinct labels with the largest sum of logs, by successive shortest augmenting paths."""
    cost = -_logs(p)
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        reach, back, seen = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, column, so_far = row, -1, 0.0
        trail = [row]
        while True:
            slack = so_far + cost[at] - u[at] - v
            closer = ~seen & (slack < reach)
            reach[closer], back[closer] = slack[closer], column
            column = int(np.where(seen, np.inf, reach).argmin())
            so_far = reach[column]
            seen[column] = True
            if owner[column] < 0:
                break
            at = int(owner[column])
            trail.append(at)
        u[row] += so_far
        for c in np.flatnonzero(seen):
            if owner[c] >= 0:
                u[owner[c]] += so_far - reach[c]
            v[c] -= so_far - reach[c]
        while column >= 0:  # shift owners along the path
            before = int(back[column])
            owner[column] = owner[before] if before >= 0 else row
            column = before
    out = np.zeros(n, np.int64)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def marginals(p: np.ndarray, prior: np.ndarray, weight: float = 0.75, width: int = 256) -> np.ndarray:
    """Class mass per clip over the final beam; exact over all distinct label rows for up to three clips."""
    n, k = p.shape
    if n == 1:
        return p / p.sum(1, keepdims=True)
    full = k ** min(n, 3)
    scores, rows = beams(p, prior, weight, full if n <= 3 else width, k)
    w = np.exp(scores - scores.max())
    out = np.zeros((n, k))
    for i in range(n):
        np.add.at(out[i], rows[:, i], w / w.sum())
    return out


def decode_take(p: np.ndarray, prior: np.ndarray | None, mode: str) -> np.ndarray:
    """Labels of one take; ``mode``: ``map`` (64 beams, 16 candidates), ``marginal`` or ``assign``."""
    if len(p) == 1:
        return p.argmax(1)
    if mode == "assign" or prior is None:
        return assign(p)
    return marginals(p, prior).argmax(1) if mode == "marginal" else beams(p, prior, 0.75, 64, 16)[1][0]


def decode_takes(takes: DataFrame, probabilities: DataFrame, prior: np.ndarray | None, mode: str = "map", classes: int = CLASSES) -> DataFrame:
    """``clip_id, take_id, label`` of takes that have at most ``classes`` clips with probabilities."""
    rows = takes.join(probabilities.select("clip_id", "p"), "clip_id").select("take_id", "position", "clip_id", "p")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for take_id, members in zip(batch["take_id"], batch["members"], strict=True):
                labels = decode_take(np.stack([m["p"] for m in members]).astype(float), prior, mode)
                out += [(m["clip_id"], take_id, int(label)) for m, label in zip(members, labels, strict=True)]
            yield pd.DataFrame(out, columns=["clip_id", "take_id", "label"])

    return gathered(rows, ["take_id"], classes).mapInPandas(run, "clip_id string, take_id string, label int")


def gathered(rows: DataFrame, keys: list[str], classes: int, more: tuple[str, ...] = ()) -> DataFrame:
    """A row per group with its ``members`` (``position, clip_id, p`` and more) in order; groups beyond ``classes`` rows go
    before they are gathered."""
    small = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_n") <= classes)
    return small.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("position", "clip_id", "p", *more))).alias("members"))


def decode_with_fallback(clips: DataFrame, takes: DataFrame, probabilities: DataFrame, prior: np.ndarray | None, mode: str = "map", classes: int = CLASSES, min_coverage: float = 0.5) -> DataFrame:
    """``clip_id, label, how`` for every clip of ``clips``: ``decoded``, ``argmax`` or ``missing`` (class 0).

    Takes are decoded only if clips in a take and with probabilities are at least ``min_coverage`` of all.
    """
    inside = takes.join(clips, "clip_id", "left_semi")
    enough = coverage(clips, inside, probabilities).select((F.col("coverage") >= min_coverage).alias("_enough"))  # one row
    decoded = decode_takes(inside.crossJoin(F.broadcast(enough)).where("_enough").drop("_enough"), probabilities, prior, mode, classes).select("clip_id", F.col("label").alias("joint"))
    out = clips.select("clip_id").join(probabilities.select("clip_id", argmax(F.col("p")).alias("own")), "clip_id", "left").join(decoded, "clip_id", "left")
    joint = F.col("joint").isNotNull()
    return out.select(
        "clip_id", F.when(joint, F.col("joint")).otherwise(F.coalesce("own", F.lit(0))).alias("label"),
        F.when(joint, "decoded").when(F.col("own").isNotNull(), "argmax").otherwise("missing").alias("how"),
    )


def coverage(clips: DataFrame, takes: DataFrame, probabilities: DataFrame) -> DataFrame:
    """One row: clips, covered clips, and their ratio."""
    covered = takes.join(probabilities, "clip_id", "left_semi").agg(F.count("*").alias("covered"))
    return clips.agg(F.count("*").alias("clips")).crossJoin(covered).withColumn("coverage", F.col("covered") / F.greatest("clips", F.lit(1)))


def fallback_report(clips: DataFrame, takes: DataFrame, probabilities: DataFrame, classes: int = CLASSES, min_coverage: float = 0.5) -> DataFrame:
    """One row: ``clips, takes, coverage, fell_back, filled_by_argmax, missing, oversize_takes`` of ``decode_with_fallback``."""
    inside = takes.join(clips, "clip_id", "left_semi").join(probabilities.select("clip_id"), "clip_id", "left_semi")
    sizes = inside.groupBy("take_id").agg(F.count("*").alias("n"))
    over = sizes.agg(F.count_if(F.col("n") > classes).alias("oversize_takes"), F.coalesce(F.sum(F.when(F.col("n") <= classes, F.col("n"))), F.lit(0)).alias("decodable"))
    known = probabilities.join(clips, "clip_id", "left_semi").agg(F.count("*").alias("known"))
    row = coverage(clips, takes.join(clips, "clip_id", "left_semi"), probabilities).crossJoin(over).crossJoin(known).crossJoin(takes.agg(F.count_distinct("take_id").alias("takes")))
    low = F.col("coverage") < min_coverage
    filled = F.col("known") - F.when(low, 0).otherwise(F.col("decodable"))
    missing = F.col("clips") - F.col("known")
    return row.select("clips", "takes", "coverage", (low | (filled > 0) | (missing > 0)).alias("fell_back"), filled.alias("filled_by_argmax"), missing.alias("missing"), F.when(low, 0).otherwise(F.col("oversize_takes")).alias("oversize_takes"))


def labels_of_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels in the order of a cache's rows ``row_no, clip_id``; -1 without one."""
    return rows.join(labels.select("clip_id", "label"), "clip_id", "left").select("row_no", "clip_id", F.coalesce("label", F.lit(-1)).alias("label"))


def check_inputs(clips: DataFrame, takes: DataFrame, probabilities: DataFrame) -> None:
    """Raise on duplicate ids, clips in two takes, and probabilities of unknown clips."""
    for rows, what in (
        (clips.groupBy("clip_id").count().where("count > 1"), "duplicate clip ids"),
        (takes.groupBy("clip_id").count().where("count > 1"), "clip in more than one take"),
        (probabilities.join(clips, "clip_id", "left_anti"), "probabilities of unknown clips"),
    ):
        if rows.limit(1).count():
            raise ValueError(what)


def submission(template: DataFrame, labels: DataFrame) -> DataFrame:
    """``row_no, path, prediction`` for the template's rows; a path without a label raises when its row is read."""
    named = template.withColumn("clip_id", last_component(F.col("path"))).join(labels.select("clip_id", "label"), "clip_id", "left")
    missing = F.raise_error(F.concat(F.lit("no label for "), F.col("path"))).cast("int")
    return named.select("row_no", "path", F.coalesce("label", missing).alias("prediction"))


def pair_map(rows: DataFrame, prior: DataFrame | None = None, weight: float = 0.75) -> DataFrame:
    """Exact best distinct labels of takes of two clips: ``take_id, label0, label1, score``.

    ``rows``: ``take_id, position, cls, lp`` (logs); ``prior``: ``prev, next, p``.
    """
    a = rows.where("position = 0").select("take_id", F.col("cls").alias("prev"), F.col("lp").alias("a"))
    b = rows.where("position = 1").select("take_id", F.col("cls").alias("next"), F.col("lp").alias("b"))
    pairs = a.join(b, "take_id").where("prev <> next")
    score = F.col("a") + F.col("b")
    if prior is not None:
        pairs = pairs.join(F.broadcast(prior), ["prev", "next"])  # a row per pair of classes
        score = score + weight * F.log(F.greatest("p", F.lit(FLOOR)))
    best = pairs.withColumn("score", score).groupBy("take_id").agg(F.max_by(F.struct("prev", "next", "score"), F.struct("score", -F.col("prev"), -F.col("next"))).alias("x"))
    return best.select("take_id", F.col("x.prev").alias("label0"), F.col("x.next").alias("label1"), F.col("x.score").alias("score"))


def triple_marginals(rows: DataFrame) -> DataFrame:
    """Exact marginals of takes of three clips under distinctness and an even prior: ``take_id, position, cls, m``."""
    part = lambda k: rows.where(f"position = {k}").select("take_id", F.col("cls").alias(f"c{k}"), F.col("lp").alias(f"l{k}"))
    joint = part(0).join(part(1), "take_id").where("c0 <> c1").join(part(2), "take_id").where("c0 <> c2 and c1 <> c2")
    joint = joint.withColumn("z", F.col("l0") + F.col("l1") + F.col("l2"))
    top = joint.groupBy("take_id").agg(F.max("z").alias("top"))
    joint = joint.join(top, "take_id").withColumn("w", F.exp(F.col("z") - F.col("top")))
    each = joint.select("take_id", "w", F.posexplode(F.array("c0", "c1", "c2")).alias("position", "cls"))
    mass = each.groupBy("take_id", "position", "cls").agg(F.sum("w").alias("w"))
    return mass.select("take_id", "position", "cls", (F.col("w") / F.sum("w").over(Window.partitionBy("take_id", "position"))).alias("m"))
