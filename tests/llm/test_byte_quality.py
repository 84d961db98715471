"""The byte network against a plain loop, its gradients against differences, and its accuracy on labels it hasn't seen."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from takeline.llm import byte_quality as B
from takeline.llm.common import read_table

TEXTS = [b"", b"a", b"abcdefg", b"abcdefgh", b"the cat the cat the cat sat", "é日本\U0001f600".encode() * 9, b"z" * 512, b"y" * 511 + b"xyz", bytes(range(32, 127)) * 30]


def plain(net, text):
    """Raw score by the definition, a window at a time."""
    n = len(text)
    starts = [0] if n <= B.CHUNK else [*range(0, n - B.CHUNK, B.CHUNK - B.OVERLAP), n - B.CHUNK]
    answers = []
    for s in starts:
        chunk = text[s : s + B.CHUNK]
        best = np.full(B.FILTERS, -np.inf)
        for i in range(max(len(chunk) - B.WIDTH, 0) + 1):
            x = np.zeros((B.WIDTH, B.VECTOR + 1))
            for k in range(B.WIDTH):
                if i + k < len(chunk):
                    j = i + k
                    seen = any(j >= lag and j + 8 <= len(chunk) and chunk[j : j + 8] == chunk[j - lag : j - lag + 8] for lag in range(1, B.ECHO + 1))
                    x[k] = [*net.vectors[chunk[j]], seen]
            best = np.maximum(best, x.ravel() @ net.filters)
        answers.append(np.maximum(best + net.filter_bias, 0))
    x = np.concatenate([np.mean(answers, axis=0), np.max(answers, axis=0)])
    return float(np.maximum(x @ net.hidden + net.hidden_bias, 0) @ net.out + net.out_bias[0])


def test_forward():
    net = B.new_network(3)
    net.filter_bias += 0.1
    assert np.allclose(net.raw(TEXTS), [plain(net, t) for t in TEXTS], atol=1e-4)
    assert np.allclose(net.raw(TEXTS), [net.raw([t])[0] for t in TEXTS], atol=1e-5)


def test_every_byte_is_under_a_filter():
    """Wherever a mark stands in a text of any length, whole windows around it are read."""
    for n in (600, 1024, 1025, 5000):
        rows, sizes, owners = B.chunks([bytes(n)])
        starts = [*range(0, n - B.CHUNK, B.CHUNK - B.OVERLAP), n - B.CHUNK]
        assert len(rows) == len(starts) and owners.max() == 0 and (sizes == B.CHUNK).all()
        covered = {s + i for s in starts for i in range(B.CHUNK - B.WIDTH + 1)}
        assert covered == set(range(n - B.WIDTH + 1))


def test_gradients():
    net = B.new_network(1)
    for name in B.PARAMETERS:
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.hidden_bias += np.linspace(-0.4, 0.5, B.HIDDEN)  # away from where the slope breaks
    y, weight = np.array([k % 2 for k in range(len(TEXTS))]), np.linspace(0.5, 2, len(TEXTS))

    def loss():
        z = net.combine(B.features(np.maximum(net.pooled(*B.chunks(TEXTS)[:2])[0], 0), B.chunks(TEXTS)[2], len(TEXTS))[0].astype(float))
        return float((weight * (np.logaddexp(0, z) - y * z)).mean())

    for name, g in zip(B.PARAMETERS, B.gradients(net, TEXTS, y, weight), strict=True):
        value, differences = getattr(net, name), []
        places = [np.unravel_index(i, value.shape) for i in np.argsort(-np.abs(g).ravel())[:12].tolist()]
        for at in places:
            old = value[at]
            value[at] = old + 1e-3
            up = loss()
            value[at] = old - 1e-3
            differences.append((up - loss()) / 2e-3)
            value[at] = old
        exact = np.array([g[at] for at in places])
        assert np.linalg.norm(exact - differences) <= 0.15 * np.linalg.norm(exact) > 0, name  # maxima may change places


def test_learns_what_is_labelled(spark):
    """Marks anywhere in long texts and words said again are found; columns, nulls, repeated rows and empty tables are as stated."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))

    def text(kind):
        w = [word() for _ in range(rng.randrange(30, 300))]
        if kind == 1:
            w[rng.randrange(len(w) - 5) :][:5] = []
            at = rng.randrange(len(w))
            w[at:at] = ["###", "$$$", "###"]
        if kind == 2:
            w = [x for x in w[: len(w) // 6] for _ in range(6)]
        return " ".join(w)

    kinds = [rng.choice([0, 0, 0, 1, 2]) for _ in range(900)]
    rows = [(i, text(k), k) for i, k in enumerate(kinds)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind int")
    labels = docs.select("doc_id", (F.col("kind") == 0).cast("int").alias("quality")).unionByName(spark.createDataFrame([(None, 1), (3, None), (5, None)], "doc_id long, quality int"))
    net = B.learn(docs, labels)
    asked = docs.select("doc_id", "text", "kind", F.lit("clash").alias("score"), F.lit(1).alias("y")).unionByName(spark.createDataFrame([(None, None, 9, "x", 1), (5000, "", 9, "x", 1), (5000, "", 9, "x", 1)], "doc_id long, text string, kind int, score string, y int"))
    got = B.score(asked, net).withColumn("held", B.held_out(F.col("doc_id")))
    found = got.collect()
    assert got.columns == ["doc_id", "text", "kind", "y", "score", "predicted", "held"] and len(found) == len(rows) + 3
    for r in found:
        assert r["held"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    away = [r for r in found if r["held"] and r["kind"] != 9]
    assert sum(r["predicted"] == (r["kind"] == 0) for r in away) >= 0.95 * len(away) > 100
    assert len({r["score"] for r in found if r["kind"] == 9}) == 1
    assert B.score(docs.limit(0), net).count() == 0
    assert B.learn(docs, labels.where("quality = 1")) is None and {r["score"] for r in B.score(docs.limit(3), None).collect()} == {1.0}


def test_held_out_labels_are_not_read(spark):
    """Turning every held-out label changes no score."""
    docs, labels = read_table(spark, "/root/testdata/sf0.001", "documents"), read_table(spark, "/root/testdata/sf0.001", "labels")
    turned = labels.withColumn("quality", F.when(B.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    texts = [t.encode() for t in ("some plain words here", "### $$$", "")]
    nets = [B.learn(docs, x) for x in (labels, turned)]
    assert nets[0] is not None and np.array_equal(nets[0].raw(texts), nets[1].raw(texts))


def test_bounds_and_long_texts(spark):
    """Only rows beyond ``max_bytes`` are kept from the sample; a text of several megabytes is scored whole."""
    docs = spark.createDataFrame([(i, ("good words " if i % 2 else "### bad ### ") * (1 + i % 5)) for i in range(80)] + [(100, "x " * 60_000)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert B.learn(docs, labels) is not None and B.learn(docs, labels, max_bytes=5) is None
    net = B.new_network()
    rng = random.Random(0)
    long = " ".join(str(rng.random()) for _ in range(300_000)).encode()
    assert len(long) > 5_000_000 and 0 <= net.score([long])[0] <= 1
    net.vectors[255] *= 20
    marked = net.pooled(*B.chunks([long + b"\xff" * 8])[:2])[0]
    assert not np.array_equal(marked[-1], net.pooled(*B.chunks([long])[:2])[0][-1])
