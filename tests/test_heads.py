"""Heads: the gradient at the solution, the design by numpy, temperatures by a fine grid, bags that leave their group out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from takeline.operators import heads


def made(spark, n=240, classes=3, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.normal(0, 1, (n, 4)) + 0.8 * np.eye(classes, 4)[y]
    x[:, 3] = 2.0  # a column without spread
    rows = [(i, int(c) * 2, i % 4, v.tolist(), float(1 + i % 2)) for i, (c, v) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(rows, "id int, y int, grp int, x array<double>, w double").repartition(3), x, y * 2


def test_solution_has_no_slope(spark):
    df, x, y = made(spark)
    head = heads.fit(df, 0.05)
    assert head.classes == (0, 2, 4) and np.abs(heads.gradient(df, head, 0.05)).max() < 1e-6
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    assert np.allclose(head.mean, x.mean(0)) and np.allclose(z, (x - head.mean) / head.scale)
    # Newton's method on the same loss, dense.
    k, d = 3, 5
    design, target, w = np.c_[z, np.ones(len(z))], np.eye(k)[y // 2], np.zeros((k, d))
    penalty = np.tile([0.05] * 4 + [1e-9], k)
    for _ in range(30):
        p = np.exp(design @ w.T)
        p /= p.sum(1, keepdims=True)
        g = ((p - target).T @ design / len(z)).ravel() + penalty * w.ravel()
        h = np.zeros((k * d, k * d))
        for a in range(k):
            for b in range(k):
                h[a * d : a * d + d, b * d : b * d + d] = (design * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ design / len(z)
        w -= np.linalg.lstsq(h + np.diag(penalty), g, rcond=None)[0].reshape(k, d)
    assert np.allclose(head.weight, w[:, :4], atol=1e-5) and np.allclose(head.bias - head.bias.mean(), w[:, 4] - w[:, 4].mean(), atol=1e-5)
    found = {r["id"]: r["p"] for r in heads.answered(df, head, 6).collect()}
    e = np.exp(design @ w.T)
    assert np.allclose([[found[i][c] for c in (0, 2, 4)] for i in range(len(x))], e / e.sum(1, keepdims=True), atol=1e-5)
    assert all(p[1] == p[3] == p[5] == 0 and sum(p) == pytest.approx(1) for p in found.values())


def test_weights_and_faults(spark):
    df, _, _ = made(spark)
    twice = df.unionByName(df.where("w = 2"))
    a, b = heads.fit(df, 0.1, "w"), heads.fit(twice.select("x", "y"), 0.1)
    p = lambda h: np.array([r["p"] for r in heads.answered(df.orderBy("id"), h, 5).collect()])
    assert np.abs(p(a) - p(b)).max() < 0.02  # the scale of the features differs a little
    with pytest.raises(ValueError, match="two classes"):
        heads.fit(df.where("y = 0"), 0.1)
    with pytest.raises(ValueError, match="no solution"):
        heads.fit(df, 1e-6, iterations=2)


def test_design(spark):
    rng = np.random.default_rng(1)
    i, d = rng.normal(2, 3, (50, 3)), rng.normal(0, 1, (50, 3))
    df = spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(i, d, strict=True))], "id int, i array<double>, d array<double>")
    got = np.array([r["x"] for r in heads.design(df, df.where("id < 30"), name="x").orderBy("id").collect()])
    z = [(m - m[:30].mean(0)) / m[:30].std(0) for m in (i, d)]
    assert np.allclose(got, np.concatenate([z[0], z[1], z[0] * z[1], np.abs(z[0] - z[1])], axis=1))


def test_temperature(spark):
    rng = np.random.default_rng(4)
    z = 3 * rng.normal(0, 1, (300, 4))
    y = np.array([rng.choice(4, p=np.exp(r / 2.2) / np.exp(r / 2.2).sum()) for r in z])
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    answers = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(p, y, strict=True)], "p array<double>, y int").cache()

    def loss(t):
        q = np.exp(z / t) / np.exp(z / t).sum(1, keepdims=True)
        return -np.log(q[np.arange(len(y)), y]).mean()

    grid = np.exp(np.linspace(np.log(1), np.log(4), 4001))
    assert heads.best_temperature(answers) == pytest.approx(grid[np.argmin([loss(t) for t in grid])], rel=1e-3)
    assert heads.mean_loss(answers, [1.0, 2.5]) == pytest.approx([loss(1.0), loss(2.5)])
    sure = answers.select("p", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("y"))
    assert heads.best_temperature(sure) == pytest.approx(heads.COLDEST)


def test_bag_leaves_its_group_out(spark):
    df, _, _ = made(spark)
    members = heads.fit_bag(df, 0.1, 5)
    other = df.withColumn("x", F.when(F.col("grp") == 2, F.transform("x", lambda v: v * 9)).otherwise(F.col("x")))
    changed = heads.fit_bag(other, 0.1, 5)
    for k in range(4):
        assert np.allclose(members[k][0].weight, changed[k][0].weight) == (k == 2)
    for calibrated in (True, False):
        got = np.array([r["p"] for r in heads.bagged(df, members, 5, calibrated).orderBy("id").collect()])
        x = np.array([r["x"] for r in df.orderBy("id").collect()])
        parts = []
        for h, t in members:
            q = np.maximum(h.probabilities(x, 5), 1e-12) ** (1 / (t if calibrated else 1.0))
            parts.append(q / q.sum(1, keepdims=True))
        assert np.allclose(got, np.mean(parts, axis=0))
