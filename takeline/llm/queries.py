"""Queries ``opN_<name>`` over the whole tables of a folder, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takeline.llm import byte_quality, chat_format, decontaminate, divergence, html_text, merkle, near_dedup, packing, quality, substring_dedup, token_files, toxicity, url_filters
from takeline.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.with_hostile(read_table(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.format_conversations(rows), in_order=True)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = url_filters.with_parts(read_table(spark, sf_dir, "pages").select("page_id", "url"))
    return url_filters.judge(pages, url_filters.SITE_RULES + url_filters.WORD_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents")).drop("ids")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.learn(documents, read_table(spark, sf_dir, "labels"))
    return toxicity.score(documents, machine).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(read_table(spark, sf_dir, "documents"))
    return token_files.read_token_files(spark, path).drop("ids")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(documents, quality.learn(documents, read_table(spark, sf_dir, "labels")))


def op11_byte_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    network = byte_quality.learn(documents, read_table(spark, sf_dir, "labels"))
    return byte_quality.score(documents, network).select("doc_id", byte_quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    presented = F.when(tampered, F.unhex(merkle.leaf_digest(F.translate("text", capitals, capitals.lower()))))
    found = merkle.proofs(documents, {"presented": presented})
    found = found.withColumn("folded_root", merkle.fold(F.coalesce(F.lower(F.hex("presented")), "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_chat_format, op2_url_filter, op3_packing, op4_substring_dedup, op5_near_dedup, op6_decontaminate, op7_toxicity, op8_html_text, op9_token_files, op10_quality, op11_byte_quality, op12_merkle, op13_divergence, pipeline)
}
