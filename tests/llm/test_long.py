"""One text of several megabytes, beyond a step's size, among short ones: every operator takes it whole."""

import zlib

import numpy as np
import pytest

from takeline.llm import common, decontaminate, html_text, near_dedup, packing, quality, substring_dedup, token_files, toxicity, url_filters
from takeline.llm.tokens import TokenIds


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(0)
    long = " ".join(f"w{k}" for k in rng.integers(0, 50_000, 850_000))
    tail = " ".join(f"tail{k}" for k in range(40))
    assert len(long) > common.STEP_BYTES
    return {1: "a short text", 2: f"{long} {tail}", 3: None, 4: f"before {tail} after", 5: ""}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string").coalesce(1)


def test_statistics(docs, texts):
    got = {r["doc_id"]: r for r in quality.judge(docs, None).collect()}
    assert got[2]["n_words"] == 850_040 and got[2]["word_chars"] == sum(map(len, texts[2].split())) and got[1]["n_words"] == 3
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, None).collect()}
    assert scored == dict.fromkeys(texts, 0.0)


def test_repeats_and_copies(docs):
    cut = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert cut[2] == (850_040, 40) and cut[4] == (42, 40) and cut[1] == (3, 0)
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert near[2] == (850_036, 2) and near[4][1] == 4


def test_leak_at_the_end(spark, docs):
    bench = spark.createDataFrame([(9, " ".join(f"tail{k}" for k in range(5, 35)))], "item_id long, text string")
    assert sorted((r["doc_id"], r["n_edits"], r["first_word"]) for r in decontaminate.leaks(docs, bench).collect()) == [(2, 0, 850_005), (4, 0, 6)]


def test_ids(spark, docs, texts):
    want = {i: TokenIds().ids(None if t is None else t.encode()).astype("<u4") for i, t in texts.items()}
    path = token_files.write_token_files(docs)
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(spark, path).collect()} == {i: (len(w), zlib.crc32(w.tobytes())) for i, w in want.items()}
    pieces = packing.pack(docs).collect()
    assert {i: sum(r["length"] for r in pieces if r["doc_id"] == i) for i in texts} == {i: len(w) for i, w in want.items()}
    assert len(pieces) <= sum(2 + 2 * len(w) / 2048 for w in want.values()) + 12


def test_page_and_url(spark, texts):
    page = f"<html><body><nav>Menu</nav><article><p>{texts[2]}</p><p>End.</p></article></body></html>"
    assert html_text.main_text(page) == f"{texts[2]}\nEnd."
    url = "http://Example.net/en/" + "x" * common.STEP_BYTES
    df = url_filters.with_parts(spark.createDataFrame([(1, url)], "page_id long, url string"))
    row = url_filters.judge(df, url_filters.SITE_RULES + url_filters.WORD_RULES).first()
    assert (row["host"], row["rule"], row["verdict"], len(row["path"])) == ("example.net", "example.net/en/", "allow", len(url) - 18)
