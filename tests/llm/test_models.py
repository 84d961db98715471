import random
import zlib

import numpy as np
import pytest

from takeline.llm import decontaminate as D
from takeline.llm import quality as Q
from takeline.llm import toxicity as T
from tests.llm.corpus import documents, frame, split, words


def edit_distance_to_run(item, text):
    """Least edits from ``item`` to any run of ``text``, the plain way."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_run_distance():
    rng = random.Random(0)
    for _ in range(200):
        item, text = [rng.randrange(4) for _ in range(rng.randrange(1, 9))], [rng.randrange(4) for _ in range(rng.randrange(0, 14))]
        d, s, e = D.run_distance(np.array(item, np.uint64), np.array(text, np.uint64), 99)
        want = edit_distance_to_run(item, text)
        assert d == want or not text
        if text and d < len(item):
            assert edit_distance_to_run(text[s:e], item) >= 0 and edit_distance_to_run(item, text[s:e]) == d


def test_leaks(spark):
    rng = random.Random(5)
    items = [(k, " ".join(words(rng, n, 300))) for k, n in enumerate([6, 12, 20, 35, 60])] + [(9, None), (10, "")]
    rows = documents()
    for k, (item, text) in enumerate(items[:5] * 3):
        w = text.split()
        for _ in range(len(w) // 10):
            w[rng.randrange(len(w))] = "other"
        rows.append((2000 + k, " ".join(words(rng, 50)) + " " + " ".join(w).upper() + "!? " + " ".join(words(rng, 30)), "s"))
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 doc_id")
    norm = lambda x: [w.lower().strip(D._MARKS.decode()) or w.lower() for w in split(x)]
    want = set()
    for i, x, _ in rows:
        t = norm(x)
        for item, text in items:
            w = norm(text)
            if w and t and edit_distance_to_run(w, t) <= len(w) // 5:
                want.add((i, item, edit_distance_to_run(w, t)))
    for block in (D.BLOCK_CHARS, 200):
        got = [(r["doc_id"], r["item_id"], r["n_edits"]) for r in D.leaks(frame(spark, rows), bench, block_chars=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert D.leaks(frame(spark, rows).limit(0), bench).count() == 0 and D.leaks(frame(spark, rows), bench.limit(0)).count() == 0


def test_leaks_by_length(spark):
    """Items of every length are found at exactly 20 % of their words in substitutions, insertions and deletions."""
    rng = random.Random(12)
    items, rows = [], []
    for n in (5, 14, 25, 26, 37, 59, 120, 300):
        for _ in range(12):
            w = words(rng, n, 10**6)
            changed = []
            places = set(rng.sample(range(n), n // 5))
            for j, x in enumerate(w):
                kind = rng.choice("sid") if j in places else ""
                changed += {"": [x], "s": [f"new{j}"], "i": [f"new{j}", x], "d": []}[kind]
            items.append((len(items), " ".join(w)))
            rows.append((len(rows), " ".join(words(rng, 40, 10**6) + changed + words(rng, 40, 10**6)), "s"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["n_edits"]) for r in D.leaks(frame(spark, rows), bench).collect()}
    assert set(got) == set(range(len(rows)))
    for i, text in items:
        assert got[i][0] == i and got[i][1] == edit_distance_to_run(text.split(), rows[i][1].split()) <= len(text.split()) // 5


LENGTHS = (5, 8, 12, 20, 25, 26, 37, 50, 75, 120, 200, 400)


@pytest.mark.parametrize("kind", ["s", "i", "d", "sid"])
def test_recall_by_length(kind):
    """At exactly the allowed edits, the search finds 0.95 at least of items of each length; all that it proposes is verified."""
    rng = random.Random(kind)
    for n in LENGTHS:
        count, k = 220 if n <= 120 else 60, n * D.PERCENT // 100
        texts, items = [], []
        for _ in range(count):
            item = [rng.getrandbits(62) for _ in range(n)]
            places, changed = set(rng.sample(range(n), k)), []
            for j, word in enumerate(item):
                how = rng.choice(kind) if j in places else ""
                changed += {"": [word], "s": [rng.getrandbits(62)], "i": [rng.getrandbits(62), word], "d": []}[how]
            items.append(item)
            texts.append(np.array([rng.getrandbits(62) for _ in range(30)] + changed + [rng.getrandbits(62) for _ in range(30)], np.uint64))
        # Words stand for their hashes here: an item's text is its numbers, read back by the hashes it is given.
        block = D.Items([(i, " ".join(map(str, item))) for i, item in enumerate(items)], D.PERCENT, lambda w: np.array([int(x) for x in w], np.uint64))
        found = {d for d, i, edits, _, _ in block.found_in(texts) if d == i and edits <= k}
        assert len(found) >= 0.95 * count, (n, kind, len(found), count)


def test_leaks_of_other_ids(spark):
    """Ids of any type pass through; several blocks give what one does."""
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([("a", f"x {text} y"), (None, text), ("c", None), ("d", "no")], "doc_id string, text string")
    for kind, value in (("smallint", "7"), ("decimal(20,2)", "7.00"), ("date", "2020-01-01"), ("string", "7")):
        bench = spark.createDataFrame([(text,)], "text string").selectExpr(f"cast('{value}' as {kind}) item_id", "text")
        got = D.leaks(docs, bench)
        assert dict(got.dtypes)["item_id"] == kind
        assert sorted((str(r["doc_id"]), str(r["item_id"]), r["n_edits"]) for r in got.collect()) == [("None", value, 0), ("a", value, 0)]


def test_interaction():
    """An insult with a group mention is toxic; either alone is not."""
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        rows.append((np.unique(np.array([1] * a + [2] * b + rng.integers(10, 60, 6).tolist())), int(a and b)))
    m = T.fit_machine(rows, max_terms=60)
    score = lambda *t: float(m.score([[m.columns[x] for x in t]])[0])
    assert score(1, 2) > 0.7 > 0.3 > max(score(1), score(2))


def test_score_is_the_sum_of_terms_and_pairs():
    """The machine's score is the plain sum over terms and over pairs of terms; at the threshold the answer is 1."""
    rng = np.random.default_rng(4)
    m = T.Machine({k: k for k in range(9)}, -0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    for n in range(9):
        found = sorted(rng.choice(9, n, replace=False).tolist())
        z = m.bias + sum(m.weights[i] for i in found) + sum(float(m.factors[i] @ m.factors[j]) for a, i in enumerate(found) for j in found[a + 1 :])
        assert abs(m.score([found])[0] - 1 / (1 + np.exp(-z))) < 1e-12


def test_quality_score_is_the_sum_of_grams(spark):
    """A document's probability is Platt's curve of the mean weight of its words, word pairs and character n-grams."""
    rng = np.random.default_rng(6)
    model = Q.Model(rng.normal(size=Q.BUCKETS), 0.2, 1.3, -0.1)
    rows = [(i, t, "s") for i, (_, t, _) in enumerate(documents()) if i < 40] + [(90, "One \u00e9t\u00e9 one", "s"), (91, None, "s"), (92, "", "s")]
    bucket = lambda w: Q.word_grams([w])[0]
    hashes = Q.WordHashes()
    for r in Q.judge(frame(spark, rows), model).collect():
        w = (dict((i, t) for i, t, _ in rows)[r["doc_id"]] or "").encode().split()
        total = sum(model.weights[b] for x in w for b in bucket(x)) + sum(model.weights[Q.pair_buckets(hashes([a, b]))[0]] for a, b in zip(w, w[1:], strict=False))
        assert abs(r["quality"] - 1 / (1 + np.exp(-(1.3 * (total / max(len(w), 1) + 0.2) - 0.1)))) < 1e-9
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)
    texts = [f"^{x}$" for x in ("a", "\u00e9t\u00e9")]
    grams, owner = Q.word_grams([b"a", "\u00e9t\u00e9".encode()])
    assert np.bincount(owner).tolist() == [1 + sum(max(len(t) - n + 1, 0) for n in range(1, 5)) for t in texts]


def test_ties_at_thresholds(spark):
    """A score equal to the threshold is over it, for both classifiers."""
    flat = T.Machine({}, float(np.log(0.7 / 0.3)), np.zeros(0), np.zeros((0, 4)))
    p = float(flat.score([[]])[0])
    assert {r["predicted"] for r in T.score(frame(spark).select("doc_id", "text"), flat, threshold=p).collect()} == {1}
    half = Q.Model(np.zeros(Q.BUCKETS), 0.0, 1.0, 0.0)
    assert all(r["quality"] == 0.5 and r["kept"] == (not r["base_failed"]) for r in Q.judge(frame(spark), half).collect())


def labelled(spark, n=400):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        toxic, bad = i % 5 == 0, i % 4 == 1
        x = words(rng, 60) + (["scum", "worthless"] if toxic else [])
        rng.shuffle(x)
        docs.append((i, " ".join(w.upper() + "!!" for w in x) if bad else " ".join(x), "s"))
        labels.append((i, int(not bad), int(toxic)))
    return frame(spark, [*docs, (7000, None, "s"), (7001, "", "s")]), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"), docs, labels


def test_toxicity(spark):
    df, labels, docs, marks = labelled(spark)
    scored = {r["doc_id"]: r for r in T.score(df.select("doc_id", "text"), T.learn(df, labels)).collect()}
    out = [(i, t) for i, _, t in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([scored[i]["predicted"] == t for i, t in out]) > 0.95
    assert 0 <= scored[7000]["score"] == scored[7001]["score"] < 0.7
    held = {r["doc_id"]: r["h"] for r in df.select("doc_id", T.held_out(df["doc_id"]).alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in held.items())
    none = T.learn(df, labels.limit(0))
    assert none is None and {r["score"] for r in T.score(df.select("doc_id", "text"), none).collect()} == {0.0}
    assert T.score(df.limit(0), none).count() == 0


def test_clashing_columns_and_bounded_sample(spark):
    """Columns named like results are replaced; rows that repeat a labelled id are learnt from once."""
    df, labels, docs, marks = labelled(spark)
    named = df.selectExpr("doc_id", "text", "'x' score", "'y' predicted", "'z' kept", "1 y", "2 terms")
    machine = T.learn(named, labels)
    out = T.score(named, machine)
    assert out.columns == ["doc_id", "text", "kept", "y", "terms", "score", "predicted"] and out.where("kept = 'z' and y = 1 and score <= 1").count() == named.count()
    many = df.unionByName(df.where("doc_id = 3")).unionByName(df.where("doc_id = 3").selectExpr("doc_id", "concat(text, ' more') text", "source", "component_id", "n"))
    assert T.labelled_sample(many, labels.unionByName(labels), "toxic", 50).groupBy("doc_id").count().where("count > 1").count() == 0
    assert T.labelled_sample(many, labels, "toxic", 50).count() <= 50
    assert {tuple(r) for r in T.score(many.where("doc_id <> 3").select("doc_id", "text"), T.learn(many, labels)).collect()} == {tuple(r) for r in T.score(df.where("doc_id <> 3").select("doc_id", "text"), T.learn(df, labels)).collect()}
    assert Q.judge(named, Q.learn(named, labels)).where("kept").count() > 0


def brute_stats(text):
    w = split(text)
    three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    covered = {k + d for k, t in enumerate(three) if three.count(t) > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality(spark):
    df, labels, docs, marks = labelled(spark)
    model = Q.learn(df, labels)
    got = {r["doc_id"]: r for r in Q.judge(df, model).collect()}
    assert np.mean([got[i]["kept"] == bool(q) for i, q, _ in marks]) > 0.95
    assert Q.learn(df, labels.limit(0)) is None
    rows = [r for r in documents() if r[0] != 1008] + [(1, "a b c\na b c\n\n a b c\na b c", "s"), (2, "x # y\nx # y\n|é é|", None)]
    got = Q.judge(frame(spark, rows), None).collect()
    by = {(i, *brute_stats(t)) for i, t, _ in rows}
    assert {tuple(r)[:6] for r in got} == by
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed)
    assert Q.judge(df.limit(0), model).count() == 0


def test_passages_that_items_share():
    """Thousands of items with one opening, and a document that says it a thousand times: seconds, and no item but the one that is there."""
    import time
    import tracemalloc

    rng = random.Random(3)
    head = [f"s{k}" for k in range(25)]
    items = [(i, " ".join(head + [f"i{i}x{k}" for k in range(15)])) for i in range(5000)]
    hashes = D.WordHashes(D.normal_word)
    block = D.Items(items, 20, hashes)
    said = " ".join(" ".join(head) + " " + " ".join(f"r{rng.randrange(10**6)}" for _ in range(13)) for _ in range(1000))
    far = " ".join(f"i{i}x0" for i in range(0, 5000, 5))  # a rare word of a thousand items, far from the passage
    tracemalloc.start()
    start = time.perf_counter()
    found = list(block.found_in([hashes(x.encode().split()) for x in (said, said + " " + items[7][1], "z " * 200 + said + " z" * 200 + far)]))
    assert time.perf_counter() - start < 20 and tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()
    assert found == [(1, 7, 0, 38_000, 38_040)]


def test_repeated_items_and_equal_runs(spark):
    """Items that repeat an id or a text each have rows; of equally good runs the first is told; step sizes change nothing."""
    text = "one two three four five six"
    docs = spark.createDataFrame([(1, f"x {text} y {text}"), (None, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, text), (5, text), (6, text), (None, text.upper())], "item_id long, text string")
    got = sorted(map(tuple, D.leaks(docs, bench).collect()), key=repr)
    assert got == sorted([(d, i, 0, a, a + 6) for d, a in ((1, 1), (None, 0)) for i in (5, 5, 6, None)], key=repr)
    hashes = D.WordHashes(D.normal_word)
    rng = random.Random(8)
    items = [(k, " ".join(words(rng, rng.randrange(3, 60), 60))) for k in range(40)]
    texts = [hashes((" ".join(words(rng, 80, 60)) + " " + items[k % 40][1] + " " + " ".join(words(rng, 30, 60))).encode().split()) for k in range(60)]
    block = D.Items(items, 20, hashes)
    want = list(block.found_in(texts))
    whole, D.STEP_PAIRS = D.STEP_PAIRS, 7
    try:
        assert sorted(block.found_in(texts)) == sorted(want) and len(want) >= 60
    finally:
        D.STEP_PAIRS = whole


def test_pairs_of_neutral_terms_are_learnt():
    """An insult and a group that are each even between the labels: only both, or neither, is labelled."""
    rng = random.Random(0)
    rows, texts = [], []
    for i in range(1600):
        k = i % 4
        w = words(rng, 30, 300) + [f"insult{rng.randrange(3)}"] * (k in (0, 1)) + [f"group{rng.randrange(3)}"] * (k in (0, 2))
        rng.shuffle(w)
        texts.append((w, int(k in (0, 3))))
        rows.append((np.unique(np.array([t for x in w for t in T.word_terms(x.encode())], np.int32)), int(k in (0, 3))))
    machine = T.fit_machine(rows[:1200])
    assert all({*T.word_terms(x.encode())} & set(machine.columns) for x in ("insult0", "insult1", "group0", "group2"))
    p = machine.score([sorted({machine.columns[t] for t in x.tolist() if t in machine.columns}) for x, _ in rows[1200:]])
    assert np.mean([(q >= T.THRESHOLD) == bool(y) for q, (_, y) in zip(p, rows[1200:], strict=True)]) > 0.97


def test_chance_pairs_are_not_chosen():
    rng = random.Random(1)
    rows = [(np.unique(np.array([t for x in words(rng, 40, 500) for t in T.word_terms(x.encode())], np.int32)), rng.randrange(2)) for _ in range(1500)]
    counted = {t for x, _ in rows for t in x.tolist()}
    assert len(T.choose_terms(rows, 600)) < 0.02 * len(counted) + 5
