"""Token-id files: Parquet list columns whose encodings, row groups and page indexes serve selective reads.

Layout: rows in ascending doc_id (nulls first, ties by text) over range partitions. ``tokens`` is dictionary-encoded;
the sorted integers beside it are delta-encoded. Small pages with a column index let a reader skip to a doc_id range,
and the metadata columns can be read without touching the token pages.

Null and empty texts give the end id alone. Repeated rows and ids are each written. Extra columns are not read.
An empty table gives files without rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, map_texts, written
from .tokenize import encoder, tokenizer_path

SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, tokens array<int>"


#: So many parts (12 bytes each) are sent to all tasks; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def write_options(row_group_bytes: int = 32 << 20, page_rows: int = 2000) -> dict[str, str]:
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part", "start_in_part", "n_tokens")}
    return plain | {
        "compression": "zstd",
        "parquet.compression.codec.zstd.level": "1",
        "parquet.enable.dictionary": "true",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.row.count.limit": str(page_rows),
    }


def tokens_of(docs: DataFrame, tokenizer: str, kind: str, end: int) -> DataFrame:
    """doc_id, part, start_in_part, n_tokens, tokens; a part is a range of doc_id, and parts ascend."""

    def make():
        enc, part, before = encoder(tokenizer, kind, 700_000), TaskContext.get().partitionId(), 0

        def step(texts, keys):
            nonlocal before
            ids, stops = enc.encode(texts, end)
            starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
            lists = pa.ListArray.from_arrays(np.append(starts, stops[-1]).astype(np.int32), ids.view(np.int32))
            out = {"doc_id": keys["doc_id"], "part": np.full(len(texts), part, np.int32), "start_in_part": before + starts, "n_tokens": stops - starts, "tokens": lists}
            before += int(stops[-1])
            return out

        return step

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return map_texts(ordered, ["doc_id"], "text", make, SCHEMA, most=8_000_000)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, kind: str = "byte", end: int = 0, **sizes: int) -> None:
    """Write the token files of (doc_id, text). tokenizer: a vocabulary file; sizes: see write_options."""
    tokenizer = tokenizer or tokenizer_path("byte_bpe_50k.json")
    with batches_of(docs.sparkSession, 1500):
        tokens_of(docs, tokenizer, kind, end).write.options(**write_options(**sizes)).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the number of ids of all documents before. Unused columns are not read."""
    files = spark.read.schema(SCHEMA).parquet(path)
    # A row for each write task, so one task can add them up; broadcast only if there are few of them.
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = written(totals.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("base")), "token-parts")
    few = base.count() <= MOST_BROADCAST
    return files.join(F.broadcast(base) if few else base, "part").withColumn("start", F.col("base") + F.col("start_in_part"))


def token_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (little-endian unsigned 32-bit ids) of rows of read_tokens()."""
    schema = T.StructType.fromDDL("doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches):
        for b in batches:
            lists = b.column(2)
            offsets = lists.offsets.to_numpy()
            ids = memoryview(lists.values.to_numpy().astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(ids[4 * a : 4 * z]) for a, z in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "tokens").mapInArrow(run, schema)
