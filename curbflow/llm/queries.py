"""Registered queries of this subpackage and their SQL, where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, chat, conversation_repair, filter_audit, html_text, licenses, ngram_join, packing, quality_model,
    quality_rules, token_counts, token_files, vantage,
)
from .common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of every document."""
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), WORD_BPE)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of 1,024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, capacity=1024, end_id=0)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the rules on every document."""
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op5_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    vectors = table(spark, sf_dir, "embeddings")
    return vantage.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5, factor=1.0)


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold, score and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_model.classify(docs, table(spark, sf_dir, "labels"), threshold=0.3)
    return judged.select("doc_id", "held_out", "score", "predicted")


def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from each participant's view; masks as start+length."""
    views = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda m: F.concat_ws("+", m["start"].cast("string"), m["length"].cast("string")))
    return views.withColumn("mask", F.array_join(spans, " "))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses stated in the documents."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document written to Parquet lists and read back from them."""
    docs = table(spark, sf_dir, "documents")
    path = token_files.write_tokens(docs, token_files.token_folder(spark), BYTE_BPE, end_id=2)
    return token_files.digests(spark, path)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove per source, order and step."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after the fixed damage."""
    return conversation_repair.report(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_packing": op2_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_counts": op4_token_counts,
    "op5_vantage_points": op5_vantage_points,
    "op6_quality_model": op6_quality_model,
    "op7_chat_rotation": op7_chat_rotation,
    "op8_ngram_join": op8_ngram_join,
    "op9_license_scan": op9_license_scan,
    "op10_html_text": op10_html_text,
    "op11_token_files": op11_token_files,
    "op12_filter_audit": op12_filter_audit,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op3_quality_rules": quality_rules.oracle_sql(),
    "op5_vantage_points": vantage.oracle_sql(),
    "op7_chat_rotation": chat.oracle_sql(),
    "op12_filter_audit": filter_audit.oracle_sql(),
}
