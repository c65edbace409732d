"""A corpus pipeline over ``documents``: language, lines, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in
the shared folder and reads it back as the next stage's ``docs``.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import broadcast_if, delete_path, new_area, set_aside, staged, table, write_table
from latticework.llm.decontaminate import decontaminate
from latticework.llm.language_id import fit, predict
from latticework.llm.line_dedup import line_dedup
from latticework.llm.ngram_join import similar_documents
from latticework.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: those without a letter, or below the calibrated score, go.

    Null and empty texts have no letter, so they go; rows without lang are judged but not learned from; equal rows are judged
    alike, each by itself; where no row has text and lang, nothing can be told and all go; further columns, those called like
    the model's own too, pass unchanged.
    """
    model = fit(docs.select("doc_id", "text", "lang"), F.lit(True))
    named, back = set_aside(docs, ("lang_pred", "score", "rejected"))
    return back(predict(named, model).where(~F.col("rejected")))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more in five documents or more stay in the largest doc_id only; n_chars follows the text.

    Every row stays: a null text comes back empty, and so does a text of nothing but such lines; rows that repeat a doc_id are one
    document to the count, and null doc_ids are one that sorts before all others; an empty table stays empty; further columns,
    those called n_lines and n_dropped too, pass unchanged.
    """
    named, back = set_aside(docs, ("n_lines", "n_dropped"))
    kept = back(line_dedup(named))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link at a similarity of 0.8 on five-word shingles the smallest doc_id of each component stays.

    Null and empty texts have no shingle, link with nothing and stay; rows that repeat a doc_id, and all rows without one, are
    one document: they stay or go together; an empty table stays empty; further columns pass unchanged.
    """
    area = new_area(spark, "near-copies")
    found = similar_documents(docs, words=5, percent=80, area=area)
    gone = staged(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    delete_path(spark, area)
    return docs.join(broadcast_if(gone, gone.count()), docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget.

    Every row is judged by its own text: null and empty texts hold nothing and stay, equal rows go or stay alike, null and
    repeated doc_ids cost no other row; without items all stay; further columns pass unchanged.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in sequences of 1024 tokens: one row a piece.

    Null and empty texts are the closing token alone; every row is packed, equal ones and those without a doc_id too; an empty
    table gives no piece; further columns are left out.
    """
    return pack(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", repeated_lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", packed),
]
#: Language scores and edit distances have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = new_area(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = write_table(stage(spark, docs, sf_dir), f"{area}/{k}")
    return docs
