"""The pipeline's stages, each against a brute-force version on its own input."""

import random

import corpus_pipeline as C
from takeline.llm import queries
from takeline.llm.tokens import TokenIds
from tests.llm.corpus import documents, words
from tests.llm.test_dedup import brute_near, brute_repeats
from tests.llm.test_models import edit_distance_to_run


def folder(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, x, None, s, len(x or "")) for i, x, s in documents()]
    item = words(rng, 30)
    for k in range(240):
        toxic = k % 4 == 0
        x = words(rng, 70, 3000) + (["scum", "moron", "trash"] if toxic else [])
        if k in (1, 2):
            x[10:10] = item
        rng.shuffle(x) if toxic else None
        rows.append((3000 + k, " ".join(x), "en", f"s{k % 3}", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3000 + k, 1, int(k % 4 == 0)) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, " ".join(item)), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), item


def test_stages(spark, tmp_path):
    sf_dir, item = folder(spark, tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES:
        before = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := f"{sf_dir}/out-{name}")
        docs = spark.read.parquet(path)
        seen[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns
    ids = lambda rows: {r[0] for r in rows}

    before, after = seen["toxicity"]
    assert ids(before) - ids(after) == {3000 + k for k in range(0, 240, 4)}

    before, after = seen["near_dedup"]
    assert ids(after) == {i for i, _, _, kept in brute_near(before, 80) if kept}

    before, after = seen["substring_dedup"]
    want = {i: (gone, kept) for i, _, gone, kept in brute_repeats(before, 35)}
    texts = dict((i, x) for i, x, _ in before)
    assert {r["doc_id"]: r["text"] for r in after} == {i: kept if gone else texts[i] for i, (gone, kept) in want.items()}

    before, after = seen["decontamination"]
    leaky = {i for i, x, _ in before if x and edit_distance_to_run(item, [w.lower() for w in x.split()]) <= len(item) // 5}
    assert leaky and ids(before) - ids(after) == leaky

    before, after = seen["packing"]
    count = TokenIds()
    assert {i: len(count.ids((x or "").encode())) for i, x, _ in before} == {i: sum(r["length"] for r in after if r["doc_id"] == i) for i in ids(after)}


def test_null_and_repeated_ids(spark, tmp_path):
    """A row that goes takes no other row of its id with it."""
    rng = random.Random(4)
    a, b, c, d, item = (words(rng, n, 5000) for n in (60, 60, 60, 60, 30))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    row = lambda i, x: (i, " ".join(x), None, None, None)
    docs = spark.createDataFrame([row(7, a), row(None, a), row(None, b), row(8, a), row(8, c), row(None, d), row(None, d), (None, None, None, None, None), (9, "", None, None, None)], schema)
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in C.keep_one_of_near_copies(spark, docs, "").collect())
    assert kept == sorted([(7, " ".join(a)), (0, " ".join(b)), (8, " ".join(c)), (0, " ".join(d)), (0, ""), (9, "")])

    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([row(None, a + item), row(None, b), row(5, b + item + c), row(5, d), (None, None, None, None, None)], schema)
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in C.drop_leaks(spark, docs, str(tmp_path)).collect())
    assert kept == sorted([(0, " ".join(b)), (5, " ".join(d)), (0, "")])


def test_repeated_rows(spark):
    """Rows that repeat id and text leave one whole document, which substring dedup doesn't cut."""
    rng = random.Random(6)
    a, b, c = (" ".join(words(rng, n, 5000)) for n in (60, 60, 20))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, a, "en", "s", len(a))] * 3 + [(7, b, x, "s", len(b)) for x in ("de", "en")] + [(8, b, "en", "s", len(b)), (None, c, "en", "s", len(c)), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    stages = dict(C.STAGES)
    out = docs
    for name in ("near_dedup", "substring_dedup"):
        out = stages[name](spark, out, "")
        assert out.columns == docs.columns
        assert sorted(map(tuple, out.collect()), key=str) == sorted([(None, a, "en", "s", len(a)), (7, b, "de", "s", len(b)), (None, c, "en", "s", len(c)), (None, None, None, None, None)], key=str)


def test_clashing_columns(spark, tmp_path):
    """Columns named like the operators' own come through every filtering stage unchanged."""
    sf_dir, _ = folder(spark, tmp_path)
    names = ["score", "predicted", "n_words", "n_removed", "kept_text", "chunk", "key", "row", "gone_key", "sig", "node", "text_hash", "own_1", "carried"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", *(f"concat('{n}', doc_id) {n}" for n in names))
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := f"{sf_dir}/clash-{name}")
        docs = spark.read.parquet(path)
        rows = docs.collect()
        assert len(rows) > 100 and docs.columns[5:] == names
        assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    assert packed_ids(C.STAGES[-1][1](spark, docs, sf_dir)) == {r["doc_id"] for r in rows}


def packed_ids(pieces):
    return {r["doc_id"] for r in pieces.select("doc_id").collect()}


def test_run(spark, tmp_path):
    sf_dir, _ = folder(spark, tmp_path)
    assert queries.QUERIES["pipeline"](spark, sf_dir).count() > 0
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(str(empty / f"{name}.parquet"))
    assert C.run(spark, str(empty)).count() == 0
