"""Corpus pipeline: quality rules, language ID, near-dedup, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import language_id, minhash_dedup, packing, pii, quality_rules
from cohortlens.llm.common import stored, table
from cohortlens.session import lookup_side

#: A document goes where the best language is hardly likelier than others.
LEAST_LANGUAGE_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts fail; repeated rows are judged alike
    and stay or go together; other columns, null or not, are left as they are."""
    return quality_rules.kept_documents(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network knows; it learns from those that came in. Texts without a
    letter go; rows without lang are judged, only not learnt from; repeated rows are judged alike.
    Without any row to learn from all texts are unknown."""
    judged = language_id.identify(docs, language_id.fit(docs))
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return judged.where(known).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Of rows that repeat
    both id and text one stays, and so of equal texts without id; texts without words, or without
    id, are near to nothing else."""
    found = minhash_dedup.near_duplicates(docs).where(~F.col("kept"))
    left = docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    # few rows share an id, so that only theirs are compared
    shared = stored(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("doc_id").alias("shared_id")))
    if shared.isEmpty():
        return left
    same = F.col("doc_id").eqNullSafe(F.col("shared_id"))
    alone = left.join(lookup_side(shared), same, "left_anti")
    again = left.join(lookup_side(shared), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return alone.unionByName(again)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text. Null and empty
    texts stay so; repeated rows are changed alike; without spans to learn from only the exact
    patterns are replaced."""
    hidden = pii.redact(docs, pii.fit(docs))
    return hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences, with their ids. Null and empty texts are one piece,
    the end id; repeated rows and rows without id are packed like others."""
    return packing.pack_documents(docs, with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("language id", language),
    ("near-dedup", near_dedup),
    ("personal data", personal_data),
    ("packing", packed),
]
#: The language network, the sketches and the tagger have no SQL form; tests hold run() against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
