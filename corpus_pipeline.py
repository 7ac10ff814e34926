"""A corpus made ready for training, in five stages; each works on all that the one before has kept.

1. language: documents whose language is rejected (no letters, or far from every language's centroids) go.
2. near_dedup: of each group of near-duplicates the document with the smallest id stays.
3. secrets: found secrets are replaced by a mark in the text; no document goes.
4. mixing: documents get the number of copies that brings their source to its target weight; copies are equal rows.
5. packing: all tokens are packed into sequences; one row per piece.

The first four return the columns of documents as they came; n_chars follows the text where it changes, and a null
n_chars stays null. Repeated rows are kept or go together, and null ids are ids like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakescan.llm.common import forget, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MARK = "[SECRET]"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lakescan.llm.langid import fit_unheld, predict

    found = predict(docs, fit_unheld(docs), [c for c in COLUMNS if c != "text"], with_text=True)
    return found.where("NOT rejected").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lakescan.llm.near_dedup import near_duplicates

    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lakescan.llm.secret_scan import redact

    return redact(docs, MARK).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lakescan.llm.mixing import mixed_documents

    return mixed_documents(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lakescan.llm.packing import pack_documents

    return pack_documents(docs, with_ids=False).drop("ids")


STAGES = [("language", language), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: Packing has no SQL form (and language identification none either): the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
