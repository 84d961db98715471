"""Readout heads: multinomial logistic regression over standardised features, and a bag of heads at their own temperatures.

Features are standardised by modality, joined to ``[I, D, I*D, |I-D|]`` and standardised again; the fit itself is
``pyspark.ml``'s, whose gradients are sums of each partition's.  A bag leaves one group of users out for each member,
which is fitted on the rest, and its temperature is the one at which the left-out rows' answers are likeliest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeline.functions import columns as C

#: Temperatures are looked for between these, until the place in logs is known to ``SEARCH_STEP``.
COLDEST, HOTTEST, SEARCH_STEP, SEARCH_POINTS = 0.25, 4.0, 1e-4, 21

#: Rows that a worker answers at a time.
ANSWERED = 2048


@dataclass(frozen=True)
class Head:
    """Mean and scale of the features, weights and bias by fitted class, and what the fit took."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    classes: tuple[int, ...]
    iterations: int

    def probabilities(self, x: np.ndarray, classes: int) -> np.ndarray:
        """By row over all classes; one that was not fitted has 0."""
        z = ((x - self.mean) / self.scale) @ self.weight.T + self.bias
        e = np.exp(z - z.max(1, keepdims=True))
        out = np.zeros((len(x), classes))
        out[:, self.classes] = e / e.sum(1, keepdims=True)
        return out


def moments(rows: DataFrame, x: str) -> DataFrame:
    """One row ``mean, scale`` of an array column by place: population deviation, 1 where it is 0."""
    s = rows.agg(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(x).cast("array<double>"))).alias("s"))
    n = F.col("s.count")
    deviation = F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * (n - 1) / n))
    return s.select(vector_to_array("s.mean").alias("mean"), F.transform(deviation, lambda v: F.when(v > 0, v).otherwise(1.0)).alias("scale"))


def standardised(rows: DataFrame, x: str, by: DataFrame) -> DataFrame:
    """``x`` less the mean, by the scale, of a row of ``moments``."""
    known = by.select(F.col("mean").alias("_mean"), F.col("scale").alias("_scale"))
    return rows.crossJoin(F.broadcast(known)).withColumn(x, C.standardise(F.col(x).cast("array<double>"), F.col("_mean"), F.col("_scale"))).drop("_mean", "_scale")


def design(rows: DataFrame, fitted: DataFrame, i: str = "i", d: str = "d", name: str = "x") -> DataFrame:
    """``rows`` with ``[I, D, I*D, |I-D|]`` of the two modalities, each standardised by its moments over ``fitted``."""
    for c in (i, d):
        rows = standardised(rows, c, moments(fitted, c))
    return rows.withColumn(name, C.readout_features(F.col(i), F.col(d))).drop(i, d)


def fit(rows: DataFrame, l2: float, weight: str | None = None, iterations: int = 1000, tolerance: float = 1e-13) -> Head:
    """A head for ``x, y``: least mean log loss plus ``l2 / 2`` times the squared weights of the standardised features.

    ``weight`` names a column of row weights.  Raises if the iterations did not suffice; classes without a row are left out.
    """
    scale = moments(rows, "x")
    classes = sorted(r[0] for r in rows.select("y").distinct().collect())  # a row for each class
    if len(classes) < 2:
        raise ValueError("a fit needs two classes")
    place = (F.array_position(F.array(*map(F.lit, classes)), F.col("y")) - 1).cast("double")
    prepared = standardised(rows, "x", scale).select(array_to_vector("x").alias("features"), place.alias("label"), (F.lit(1.0) if weight is None else F.col(weight)).alias("weight"))
    solver = LogisticRegression(family="multinomial", regParam=l2, elasticNetParam=0.0, standardization=False, weightCol="weight", maxIter=iterations, tol=tolerance)
    model = solver.fit(prepared)
    taken = model.summary.totalIterations
    if taken >= iterations:
        raise ValueError(f"no solution after {taken} iterations")
    known = scale.first()
    return Head(np.array(known["mean"]), np.array(known["scale"]), model.coefficientMatrix.toArray(), model.interceptVector.toArray(), tuple(classes), taken)


def gradient(rows: DataFrame, head: Head, l2: float) -> np.ndarray:
    """Of the fitted loss by class and feature, the bias last: a sum for each partition, added up by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(head.classes), len(head.mean) + 1)), 0
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, -1)
            y = batch.column("y").to_numpy()
            p = head.probabilities(x, max(head.classes) + 1)[:, head.classes] - (y[:, None] == np.array(head.classes))
            total += p.T @ np.c_[(x - head.mean) / head.scale, np.ones(len(x))]
            n += len(x)
        k = len(head.classes)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([n] * k, pa.int64()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["k", "n", "g"])

    parts = rows.select(F.col("x").cast("array<double>").alias("x"), "y").mapInArrow(run, "k int, n long, g array<double>")
    sums = parts.select("k", "n", F.posexplode("g").alias("j", "g")).groupBy("k", "j").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    out = np.zeros((len(head.classes), len(head.mean) + 1))
    for r in sums.collect():  # the size of the head
        out[r["k"], r["j"]] = r["g"] / r["n"]
    out[:, :-1] += l2 * head.weight
    return out


def answered(rows: DataFrame, head: Head, classes: int, name: str = "p") -> DataFrame:
    """``rows`` with the head's distribution for ``x``."""
    return answered_by(rows, [head], [name], classes)


def answered_by(rows: DataFrame, members: list[Head], names: list[str], classes: int) -> DataFrame:
    """``rows`` with each head's distribution for ``x``, in one pass: a task has one Python worker, however many heads."""
    schema = rows.select("*", *(F.array(F.lit(0.0)).alias(name) for name in names)).schema
    # Plain arrays: a worker that knew ``Head`` would load this module, and pyspark.ml with it.
    known = [(h.mean, h.scale, h.weight.T, h.bias, list(h.classes)) for h in members]
    some = ANSWERED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, some):
                batch = whole.slice(at, some)
                n = batch.num_rows
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
                columns = []
                for mean, scale, weight, bias, own in known:
                    z = ((x - mean) / scale) @ weight + bias
                    e = np.exp(z - z.max(1, keepdims=True))
                    out = np.zeros((n, classes))
                    out[:, own] = e / e.sum(1, keepdims=True)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, n * classes + 1, classes), pa.int32()), pa.array(out.ravel())))
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return rows.mapInArrow(run, schema)


def mean_loss(answers: DataFrame, temperatures: list[float]) -> list[float]:
    """Mean of ``-ln`` of the true class's share at each temperature, of ``p, y``; one pass."""
    rows = answers.select(C.logs(F.col("p")).alias("l"), "y", F.posexplode(F.array(*map(F.lit, temperatures))).alias("k", "t"))
    scaled = rows.select("k", "y", F.transform("l", lambda v: v / F.col("t")).alias("z")).withColumn("m", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("m")))
    own = F.log(total) + F.col("m") - F.get("z", F.col("y"))
    losses = scaled.select("k", F.least(own, -F.log(F.lit(C.FLOOR))).alias("x")).groupBy("k").agg(F.avg("x").alias("x")).collect()
    return [x for _, x in sorted((r["k"], r["x"]) for r in losses)]


def best_temperature(answers: DataFrame) -> float:
    """Where the mean loss is least: a grid in logs, then finer ones between the neighbours of its best point."""
    low, high = math.log(COLDEST), math.log(HOTTEST)
    while True:
        step = (high - low) / (SEARCH_POINTS - 1)
        grid = [low + step * k for k in range(SEARCH_POINTS)]
        losses = mean_loss(answers, [math.exp(g) for g in grid])
        k = losses.index(min(losses))
        if step <= SEARCH_STEP:
            return math.exp(grid[k])
        low, high = grid[max(k - 1, 0)], grid[min(k + 1, SEARCH_POINTS - 1)]


def fit_bag(rows: DataFrame, l2: float, classes: int, groups: int = 4) -> list[tuple[Head, float]]:
    """Heads and temperatures of ``x, y, grp``: member ``k`` is fitted without group ``k``, whose rows set its temperature."""
    members = []
    for k in range(groups):
        head = fit(rows.where(F.col("grp") != k), l2)
        members.append((head, best_temperature(answered(rows.where(F.col("grp") == k), head, classes).cache())))
    return members


def bagged(rows: DataFrame, members: list[tuple[Head, float]], classes: int, calibrated: bool = True) -> DataFrame:
    """``rows`` with ``p``, the mean of the members' distributions, each at its temperature if ``calibrated``."""
    names = [f"_p{k}" for k in range(len(members))]
    rows = answered_by(rows, [head for head, _ in members], names, classes)
    return rows.withColumn("p", C.bag([(F.col(n), t if calibrated else 1.0) for n, (_, t) in zip(names, members, strict=True)])).drop(*names)
