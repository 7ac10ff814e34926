"""The queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, near_dedup, substring_dedup
from .common import new_path, table


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_tokens, token_digests, write_tokens

    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return token_digests(read_tokens(spark, path))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan, text_of

    found = scan(table(spark, sf_dir, "documents"))
    base = F.sha2(text_of(F.filter("spans", lambda x: x["kind"] != "random")), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", base.alias("base_sha256"), text_of(F.col("spans")).alias("spans"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    # The vectors have no structure (64 dimensions alike): only a share of all rows gives a recall of 0.9. See the README.
    return nearest(table(spark, sf_dir, "embeddings"), curves=16, share=0.08)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit_unheld, held_out, predict

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs, fit_unheld(docs), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_fingerprints, op3_near_dedup, op4_mixing, op5_packing, op6_token_files, op7_substring_dedup, op8_secret_scan, op9_nearest, op10_language_id)}
ORACLE_SQL = {"op3_near_dedup": near_dedup.ORACLE_SQL, "op4_mixing": mixing.ORACLE_SQL, "op7_substring_dedup": substring_dedup.ORACLE_SQL}
