"""Small documents with copies, shared passages, nulls and long texts, for brute-force comparisons."""

import random


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents(seed=0, n=60):
    rng = random.Random(seed)
    passage = words(rng, 60)
    base = words(rng, 120)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            x = words(rng, rng.randrange(1, 200))
        elif kind == 1:
            x = words(rng, 20) + passage[: rng.randrange(20, 60)] + words(rng, 30)
        elif kind == 2:
            x = list(base)
            for _ in range(rng.randrange(0, 4)):
                x[rng.randrange(len(x))] = "EDIT"
        elif kind == 3:
            x = (words(rng, 5) * 20)[: rng.randrange(1, 100)]
        else:
            x = words(rng, 80)
        rows.append((i, rng.choice(["  ", " ", "\n", "\t"]).join(x), f"s{i % 3}"))
    rows += [(1000, None, "s0"), (1001, "", None), (1002, " \n ", "s1"), (1003, "One", "s1"), (1004, "one", "s1"), (1005, rows[2][1], "s2"), (1006, rows[2][1], "s2"), (1007, "É é ß \u00a0x ' \\", "s0"), (1008, " ".join(words(rng, 9000)), "s0")]
    return rows


SCHEMA = "doc_id long, text string, source string"


def frame(spark, rows=None):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    return df.withColumn("component_id", F.lit("clash")).withColumn("n", F.lit(None).cast("double"))


def split(text):
    return [w.decode() for w in (text or "").encode().split()]
