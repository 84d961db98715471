"""A training corpus from ``documents``: toxicity, near-dedup, substring dedup, decontamination, packing.

Needs ``takeline.llm``, of whose job it is a part.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the
next stage's ``docs``.  All but the last return the columns of ``docs``.  A stage that drops documents names each by its
id and text, so a decision about one row with a null or repeated id leaves the others with that id alone.  Rows that
repeat both are one document: near-dedup leaves one of them, so that substring dedup doesn't take them for repeats of
each other and cut all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from takeline.llm import decontaminate, near_dedup, packing, substring_dedup, toxicity
from takeline.llm.common import read_table, remove_scratch, scratch_table

#: SQL has no words for learnt scores and tokenizers.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    machine = toxicity.learn(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    rows = docs.select("text", *(F.col(c).alias(f"own_{i}") for i, c in enumerate(docs.columns) if c != "text"))
    kept = toxicity.score(rows, machine).where("predicted = 0")
    return kept.select(*("text" if c == "text" else F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)))


def document_key() -> Column:
    """Names a row by its id and text; ordered by id, with null ids last."""
    return F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is not a ``doc_id`` of ``gone``."""
    gone = gone.select(F.col("doc_id").alias("key"))
    return docs.select(F.struct("*").alias("row"), document_key().alias("key")).join(gone, "key", "left_anti").select("row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, and one row of those that repeat id and text: the least by its columns."""
    judged = near_dedup.near_duplicates(docs.select(document_key().alias("doc_id"), "text"))
    gone = judged.where("not kept").select(F.col("doc_id").alias("key"))
    row = F.struct(*docs.columns)
    ordered = [c for c, kind in docs.dtypes if "map<" not in kind]
    least = F.min(row) if len(ordered) == len(docs.columns) else F.min_by(row, F.struct(*ordered))
    # Grouped and joined by the same key, so the texts are shuffled once, and repeated rows not at all.
    return docs.groupBy(document_key().alias("key")).agg(least.alias("row")).join(gone, "key", "left_anti").select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages are cut out; a document keeps its text to the byte if nothing is."""
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    rows = docs.select("text", *(F.col(c).alias(name) for c, name in own.items()))
    cut = substring_dedup.remove_repeats(rows, carry=tuple(rows.columns))
    changed = lambda new, old: F.when(F.col("n_removed") > 0, new).otherwise(F.col(old))
    named = {c: F.col(name) for c, name in own.items()} | {"text": changed(F.col("kept_text"), "text")}
    if "n_chars" in own:
        named["n_chars"] = changed(F.length("kept_text").cast("long"), own["n_chars"])
    return cut.select(*(named[c].alias(c) for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.leaks(docs.select(document_key().alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    return without(docs, found.select("doc_id").distinct())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of token ids in the corpus's mixture of sources."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_table(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # nothing reads it any more
            remove_scratch(spark, before)
        before = path
    return docs
