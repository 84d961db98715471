import random
from collections import Counter

import numpy as np
import pytest

from takeline.llm import near_dedup as N
from takeline.llm import substring_dedup as S
from takeline.llm.components import components
from tests.llm.corpus import documents, frame, split


def brute_repeats(rows, window):
    seen = Counter(tuple(w[i : i + window]) for _, x, *_ in rows for w in [split(x)] for i in range(len(w) - window + 1))
    out = []
    for i, x, *_ in rows:
        w = split(x)
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(v for k, v in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize(("window", "chunk"), [(35, 6_000_000), (35, 2000), (4, 3000), (7, 100_000)])
def test_repeats(spark, window, chunk):
    rows = documents()
    got = S.remove_repeats(frame(spark, rows), window, chunk_chars=chunk, bucket_chars=chunk).collect()
    assert sorted(map(tuple, got)) == brute_repeats(rows, window)


def test_repeats_carry_and_empty(spark):
    df = frame(spark)
    kept = S.remove_repeats(df, carry=tuple(df.columns))
    assert kept.columns == [*df.columns, "n_words", "n_removed", "kept_text"] and kept.count() == df.count()
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_repeats_of_one_row(spark, monkeypatch):
    """Rows equal in all columns are dealt to several chunks; columns may be named like the operator's own."""
    monkeypatch.setattr(S, "COPIES", 4)
    rows = documents()[:30] + [(None, documents()[2][1], "s")] * 40 + [(1, None, None)] * 9
    df = frame(spark, rows).selectExpr("doc_id", "text", "source", "1 as chunk", "2 as carried", "3 as row_hash", "4 as parts", "5 as bucket")
    docs, _ = S._dealt(df, ["doc_id"], 500)
    assert docs.where("carried.doc_id is null").select("chunk").distinct().count() >= 5
    kept = S.remove_repeats(df, carry=tuple(df.columns), chunk_chars=500).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in kept) == sorted((str(i), n, k, x) for i, n, k, x in brute_repeats([(str(i), x) for i, x, _ in rows], 35))
    assert {(r["chunk"], r["carried"], r["row_hash"], r["parts"], r["bucket"]) for r in kept} == {(1, 2, 3, 4, 5)}
    assert sorted(str((r["doc_id"], r["text"], r["source"])) for r in kept) == sorted(str(r) for r in rows)
    with pytest.raises(ValueError, match="n_words"):
        S.remove_repeats(df.selectExpr("*", "1 n_words"), carry=("n_words",))


def brute_near(rows, percent):
    sets = []
    for _, x, *_ in rows:
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in v) for v in split(x)]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    out = []
    for k, (i, *_) in enumerate(rows):
        c = min(rows[j][0] for j in range(len(rows)) if label[j] == label[k]) if sets[k] else i
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out)


def chained(seed=3, n=40):
    """Copies of copies: a family in which many pairs lie on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    x, rows = [f"v{k}" for k in rng.integers(0, 500, 150)], []
    for i in range(n):
        y = list(x)
        for k in rng.integers(0, 150, rng.integers(1, 6)):
            y[k] = f"e{i}_{k}"
        rows.append((i, " ".join(y), "s"))
        if i % 7 == 6:
            x = y
    return rows


@pytest.mark.parametrize("percent", [80, 85, 95])
@pytest.mark.parametrize("family_rows", [4000, 6])
def test_near(spark, percent, family_rows):
    rows = documents() + [(i + 5000, x, s) for i, x, s in chained()]
    got = N.near_duplicates(frame(spark, rows), percent, family_rows=family_rows).collect()
    assert sorted(map(tuple, got)) == brute_near(rows, percent)


def test_near_by_shingles(spark):
    """A family of few but long texts is cut into blocks as well."""
    rows = [(i, " ".join(f"{w}_{k}" for k in range(20) for w in x.split()), s) for i, x, s in chained(n=24)]
    got = N.near_duplicates(frame(spark, rows), 85, family_shingles=20_000).collect()
    assert max(r["n_shingles"] for r in got) > 2500 and sorted(map(tuple, got)) == brute_near(rows, 85)


@pytest.mark.parametrize("own", [60, 12])
def test_near_templates(spark, own):
    """Texts of one template are a family by their sketches; their own words part it again, and real copies stay together."""
    rng = np.random.default_rng(own)
    template = [f"t{k}" for k in range(90)]
    rows = []
    for i in range(150):
        mine = [f"m{i}_{k}" for k in range(own)]
        text = template[:45] + mine + template[45:]
        rows.append((i, " ".join(text), "s"))
        if i % 10 == 0:
            for j in range(3):
                text[int(rng.integers(0, 45))] = f"x{i}_{j}"
                rows.append((1000 + 10 * i + j, " ".join(text), "s"))
    got = N.near_duplicates(frame(spark, rows), 85, family_rows=20).collect()
    assert sorted(map(tuple, got)) == brute_near(rows, 85)


def test_near_one_id_for_all(spark):
    """Null ids, one id on all rows, and one row many times: no row meets the others of its id."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"u{k}" for k in rng.integers(0, 50_000, 60)) for _ in range(2500)]
    near = [t.replace(" ", f" x{i} ", 1) for i, t in enumerate(texts)]
    for i in (None, 7):
        rows = [(i, t, "s") for t in texts + near + [texts[0]] * 5000]
        got = N.near_duplicates(frame(spark, rows)).collect()
        assert len(got) == 10_000 and {(r["component_id"], r["kept"]) for r in got} == {(i, True)}
    rows = [(k, t, "s") for k, t in enumerate(texts + near)] + [(0, texts[0], "s")] * 5000
    got = N.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((i, i % 2500) for i, *_ in rows)


def test_near_odd_ids(spark):
    rows = [(None, "a b c d e f", "s"), (1, "a b c d e f", "s"), (1, "x y z", "s"), (2, "x y z", "s"), (2, None, "s"), (2, None, "s")]
    got = sorted(map(str, N.near_duplicates(frame(spark, rows)).collect()))
    assert got == sorted(map(str, [
        N_row(None, 2, 1, False), N_row(1, 2, 1, True), N_row(1, 1, 1, True), N_row(2, 1, 1, False), N_row(2, 0, 2, True), N_row(2, 0, 2, True),
    ]))
    assert N.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def N_row(i, n, c, k):
    from pyspark.sql import Row

    return Row(doc_id=i, n_shingles=n, component_id=c, kept=k)


def test_sketch_concentrates():
    rng = np.random.default_rng(0)
    for n in (1, 7, 300, 3000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.r_[a[: n * 4 // 5], rng.integers(0, 2**63, n - n * 4 // 5, dtype=np.uint64)]
        s = N.sketches([np.unique(a), np.unique(b)], 352)
        j = len(set(a.tolist()) & set(b.tolist())) / len({*a.tolist(), *b.tolist()})
        assert abs((s[0] == s[1]).mean() - j) < 0.12 and (s != np.uint64(2**64 - 1)).all()


def test_banding():
    for percent in (70, 80, 85, 90):
        bands, rows = N.banding(percent)
        assert bands * rows <= N.COORDINATES and (1 - (percent / 100) ** rows) ** bands <= N.MISS * 1.01


    for percent in (1, 2, 5, 40, 100):
        bands, rows = N.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= N.MISS * 1.01
    with pytest.raises(ValueError, match="percent"):
        N.banding(0)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(k, k + 1) for k in range(100, 130)]
    label = list(range(140))
    for a, b in edges:
        x, y = max(label[a], label[b]), min(label[a], label[b])
        label = [y if v == x else v for v in label]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in enumerate(label) if v != k}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_prefix_keeps_every_link(percent):
    """Sets that link share one of their rarest, whatever the reference knows of them; pages of a template share none."""
    rng = np.random.default_rng(percent)
    for k in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 10**6, n).astype(np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, int(rng.integers(0, len(a) + 1)), replace=False), rng.integers(0, 10**6, int(rng.integers(0, 8))).astype(np.uint64)]))
        known = np.unique(np.concatenate([rng.choice(a, len(a) // 2, replace=False), rng.integers(0, 10**6, 20).astype(np.uint64)]))
        texts = rng.integers(1, 5, len(known))
        both = len(np.intersect1d(a, b))
        x, y = (N.prefix(s, known, texts, percent) for s in (a, b))
        assert len(x) == len(a) - -(-len(a) * percent // 100) + 1
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            assert len(np.intersect1d(x, y))
    template = np.unique(rng.integers(0, 10**6, 200).astype(np.uint64))
    pages = [np.unique(np.concatenate([template, rng.integers(10**6, 10**12, 80).astype(np.uint64)])) for _ in range(50)]
    known, texts = np.unique(np.concatenate(pages[:10]), return_counts=True)
    rare = [N.prefix(p, known, texts, 85) for p in pages]
    assert len(np.unique(np.concatenate(rare))) == sum(map(len, rare))


def test_template_pages_meet_nobody(spark):
    """A family of twenty blocks of one template: its pages go on to no comparison, and a pair among them is found."""
    rng = random.Random(6)
    template = [f"t{k}" for k in range(150)]
    page = lambda i: " ".join(template + [f"own{i}x{k}" for k in range(90)])
    rows = [(i, page(i), "s") for i in range(400)] + [(1000, page(7).replace("own7x3", "other"), "s")]
    rng.shuffle(rows)
    sets = {i: N.shingle_set(t.encode(), 5, N.WordHashes()) for i, t, _ in rows}
    seen = {}
    first = spark.createDataFrame([(1, i, 0, i == 0, False, len(x), N.prefix(x, *np.unique(np.concatenate([sets[k] for k in range(0, 400, 40)]), return_counts=True), 85).view(np.int64).tolist()) for i, x in sets.items()], "family long, node long, centre long, linked boolean, near boolean, n_shingles long, rare array<long>")
    for r in N._parted(first).collect():
        seen.setdefault(r["family"], set()).add((r["node"], r["asks"]))
    assert list(seen.values()) == [{(7, True), (1000, True)}]
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(frame(spark, rows), 85, family_rows=20).collect()}
    assert got == {i: 7 if i == 1000 else i for i, _, _ in rows}
