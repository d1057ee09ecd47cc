"""From raw documents to training sequences: classifier, rules, near duplicates, packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and returns a
DataFrame that is written as Parquet and read again by the next one. All but the last
return the columns of ``docs``. Null and repeated rows, empty texts and extra columns are
handled as the operators say.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.llm import ngram_join, packing, quality_model, quality_rules
from curbflow.llm.common import stored, table
from curbflow.llm.queries import BYTE_BPE

# Documents below this score are rejected.
SCORE = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels at hand, does not reject."""
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_model.with_score(docs, model, name="_pipeline_score")
    return scored.where(F.col("_pipeline_score") >= SCORE).drop("_pipeline_score")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and every proven cutoff of their language."""
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text", "lang")
    measured = stored(quality_rules.measures(rows).drop("text"), "measured")
    limits = quality_rules.cutoffs(measured, table(spark, sf_dir, "labels"))
    return quality_rules.judge(measured, limits).where("kept").select("_row.*")


def _placed(docs: DataFrame) -> DataFrame:
    """``_doc`` (the row) and ``_key``: its id, null last, then file and row, which tell all rows apart.

    Stage input is a stored table, whose file positions outlast a lost task; anything
    else is stored first.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = stored(docs.select(F.struct("*").alias("_doc")), "rows")
    row = F.col("_doc") if docs.columns == ["_doc"] else F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    number = F.col("_doc.doc_id") if docs.columns == ["_doc"] else F.col("doc_id")
    key = F.struct(
        number.isNull().alias("unknown"), F.coalesce(number, F.lit(0)).alias("doc_id"),
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )
    return docs.select(row.alias("_doc"), key.alias("_key"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component: the one with the smallest id, null last.

    Every row is judged for itself, so of two texts under one id each may stay, and of
    repeated rows or copies without an id one stays. Texts without words link with nothing.
    """
    placed = _placed(docs)
    joined = ngram_join.jaccard_components(
        placed.select(F.col("_key").alias("doc_id"), F.col("_doc.text").alias("text"))
    )
    gone = joined.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone"))
    return placed.join(gone, F.col("_key") == F.col("_gone"), "left_anti").select("_doc.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1,024 tokens."""
    return packing.pack(docs, BYTE_BPE, capacity=1024, end_id=0)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("packing", sequences),
]

# Tokens and trained scores have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
