"""The manifest against the definition, level by level in plain Python."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from takeline.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return sha256(text.encode()).hexdigest()


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(nodes):
    """Root, and for each node the (place, siblings) of each level."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for leaf, k in enumerate(at):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            paths[leaf].append((k % 16, "".join(run[: k % 16] + run[k % 16 + 1 :])))
        nodes, at = [h("".join(nodes[s : s + 16])) for s in range(0, len(nodes), 16)], [k // 16 for k in at]
    return nodes[0], paths


def manifest(rows):
    """``(doc_id, source, leaf, subroot, root, path)`` of rows, the plain way."""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, h("".join(map(value, (row[0], row[1], row[2], row[3], row[4])))), row[0]))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    below = {s: climb([x[2] for x in sorted(trees[s])]) for s in order}
    root, above = climb([below[s][0] for s in order])
    return [(x[3], s, x[2], below[s][0], root, path + above[k]) for k, s in enumerate(order) for x, path in zip(sorted(trees[s]), below[s][1], strict=True)]


def rows(n=700, seed=0):
    rng = random.Random(seed)
    out = [(i, rng.choice(["a", "a", "a", "b", "É", "", None]), rng.choice(["en", None]), rng.choice([i, None]), rng.choice([None, "", "é ß\n", f"text {i}", "X" * 5000])) for i in range(n)]
    out += [(5, "a", "en", 1, "again"), (5, "a", "en", 1, "again"), (None, "a", None, None, None), (None, None, None, None, "x"), (9, "one", None, None, "alone")]
    out += [(10_000 + k, f"s{k:03}", None, k, "small source") for k in range(40)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_proofs(spark, depth):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).withColumns({"leaf": F.lit(1), "path": F.lit("clash"), "place": F.lit(None), "tree": F.lit("x")}).repartition(5)
    found = merkle.proofs(docs, {"twice": F.col("n_chars") * 2}, depth).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).withColumn("wrong", merkle.fold(F.sha2("leaf", 256), F.col("path")))
    got = [r.asDict(recursive=True) for r in found.collect()]
    key = lambda x: repr(x)
    assert sorted([(r["doc_id"], r["source"], r["leaf"], r["subroot"], r["root"], [(p["place"], p["siblings"]) for p in r["path"]]) for r in got], key=key) == sorted(manifest(data), key=key)
    assert all(r["folded"] == r["root"] != r["wrong"] for r in got)
    assert {(r["doc_id"], r["twice"]) for r in got} == {(x[0], None if x[3] is None else 2 * x[3]) for x in data}
    for r in found.select(merkle.path_digest(F.col("path")).alias("d"), "path").limit(5).collect():
        assert r["d"] == h("".join(p["siblings"] for p in r["path"]))


def test_one_row_one_source_and_none(spark):
    one = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    row = merkle.proofs(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] == h("1:1----") and row["path"] == [] and row["source"] is None
    assert merkle.proofs(one.limit(0)).collect() == []
    same = spark.createDataFrame([(1, "s", "en", 4, "copy")] * 300, SCHEMA).repartition(7)
    got = merkle.proofs(same, depth=1).select("root", "leaf", "path").collect()
    assert sorted(([(p["place"], p["siblings"]) for p in r["path"]] for r in got), key=repr) == sorted((p for *_, p in manifest([(1, "s", "en", 4, "copy")] * 300)), key=repr)


def test_long_text(spark):
    data = [(1, "s", "en", 9, "x" * 6_000_000), (2, "s", "en", 9, "y")]
    got = {r["doc_id"]: (r["leaf"], r["root"]) for r in merkle.proofs(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {x[0]: (x[2], x[4]) for x in manifest(data)}


def test_change_is_found(spark):
    """Any changed column, a moved row and a lost row change the root."""
    data = rows(60, 3)
    root = lambda d: manifest(d)[0][4]
    of = lambda d: merkle.proofs(spark.createDataFrame(d, SCHEMA), depth=1).first()["root"]
    assert of(data) == root(data)
    first = data[0]
    changed = [(*first[:2], "xx", *first[3:]), (*first[:3], 10**9, first[4]), (*first[:4], "other"), (first[0], "moved", *first[2:])]
    assert len({of([c, *data[1:]]) for c in changed} | {of(data), of(data[1:])}) == 6
