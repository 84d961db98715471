"""The audit against the definition in plain Python, dense over all kept terms."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from takeline.llm import divergence

SCHEMA = "text string, lang string, source string"


def brute(rows, k, min_docs):
    docs = [(["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")], lang or "", s or "") for t, lang, s in rows]
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang in {d[1] for d in docs}:
        held = Counter(w for t, x, _ in docs if x == lang for w in set(t))
        kept = sorted(w for w, n in held.items() if n >= min_docs)
        count = {s: Counter(w for t, x, y in docs if (x, y) == (lang, s) for w in t if held[w] >= min_docs) for s in {y for _, x, y in docs if x == lang}}
        whole = sum(count.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: E731, B023
        for s in count:
            pairs = [(-sum(f(share(count[s], w), share(count[o], w)) for w in kept), o.encode(), o) for o in count if o != s]
            terms = [(-f(share(count[s], w), share(whole, w)), w.encode(), w) for w in kept if count[s][w] and share(count[s], w) > share(whole, w)]
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", w, -v, i) for i, (v, _, w) in enumerate(sorted(terms)[:k], 1)]
    return sorted(out)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'klmno'[i // 10 % 5]}" for i in range(50)] + ["É", "éa", "ß", "Wak", "日本", "x", "xx", "xxx"]
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "c", "", None, "É"])
        some = rng.sample(words, 12)
        rows.append((rng.choice([" ", "-", "9", "\n", "[`{"]).join(rng.choice(some) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "en", "de", None]), source))
    return rows + [(None, "en", "only null"), ("", "fr", "p"), ("1 2 3", "fr", "q"), ("alone", "it", "z"), rows[0], rows[0]]


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("min_docs, k", [(1, 10), (4, 3), (10, 10), (1000, 10)])
def test_audit(spark, min_docs, k):
    rows = corpus(min_docs)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"count": F.lit(1), "value": F.lit("clash"), "term": F.lit(None), "rank": F.lit(0)}).repartition(5)
    assert got(divergence.audit(docs, k, min_docs)) == brute(rows, k, min_docs)


def test_flushes_keep_sums(spark, monkeypatch):
    """Counts and pair sums that leave a task early add up alike."""
    rows = corpus(7)
    for name, small in (("MAX_ENTRIES", 5), ("ROWS_OUT", 3), ("MAX_SUMS", 3), ("STEP_PAIRS", 4)):
        monkeypatch.setattr(divergence, name, small)
    assert got(divergence.audit(spark.createDataFrame(rows, SCHEMA), 10, 2)) == brute(rows, 10, 2)


def test_ties_by_bytes(spark):
    """Thousands of equal values with long common beginnings, a third of all in one group."""
    rng = random.Random(1)
    items = {"".join(rng.choice("aé日\U0001f600b") for _ in range(rng.randrange(0, 9))) for _ in range(4000)} | {"same" * 30 + f"{i:04}" for i in range(300)}
    rows = [("hot", 5, x) for x in items] + [("hot", 9, "z"), ("hot", 9, "a"), ("mixed", 0, "only")] + [(f"g{i % 7}", rng.randrange(4), x) for i, x in enumerate(sorted(items))]
    df = spark.createDataFrame([(g, x, v) for g, v, x in rows], "g string, item string, value long")
    want = sorted((g, x, -v, i) for g in {r[0] for r in rows} for i, (v, _, x) in enumerate(sorted((-v, x.encode(), x) for h, v, x in rows if h == g)[:12], 1))
    for few in (1000, 3):
        assert sorted(tuple(r) for r in divergence.tops(df, ["g"], 12, few).select("g", "item", "value", "rank").collect()) == want


def test_large_counts(spark):
    """Shares of counts whose product with the scale outgrows 64 bits."""
    n = 3 * 10**12
    df = spark.createDataFrame([(n, 7 * n, 10)], "c long, t long, v long")
    assert df.select(divergence.share(F.col("c"), F.col("t"), F.col("v"))).first()[0] == 1 + 10**9 * (n + 2) // (7 * n + 20)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_texts_and_terms(spark):
    """A text beyond a step's size counts whole; a term of a megabyte is one term."""
    rng = random.Random(3)
    long = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 6) for _ in range(1_300_000))
    assert len(long) > 4 << 20
    rows = [(long, "en", "a"), ("x" * 1_000_000 + " aa bbb", "en", "b"), ("aa y", "en", "c"), ("x" * 1_000_000, "en", "c")]
    assert got(divergence.audit(spark.createDataFrame(rows, SCHEMA), 10, 2)) == brute(rows, 10, 2)
