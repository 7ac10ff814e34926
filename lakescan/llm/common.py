"""Helpers that the training-data operators share: reading, shared folders, batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lakescan.session import shared_folder

#: White space of the word contract: space and the bytes 0x09 to 0x0D.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that this process has written, for clear().
_FOLDERS: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.add(path)
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The frame as a table in the shared folder: its lineage is cut and lost executors cost no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._folder = path
    return found


def forget(*frames: DataFrame) -> None:
    """Delete tables, as written() gave them, that no lazy plan reads any more."""
    for df in frames:
        _FOLDERS.discard(df._folder)
        _delete(df.sparkSession, df._folder)


def clear(spark: SparkSession) -> None:
    """Delete all tables that operators have written for results which have been read or saved by now."""
    while _FOLDERS:
        _delete(spark, _FOLDERS.pop())


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what is run (not only planned) in the block: for rows that may be large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_slices(texts: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Cut a batch into (from, to) of about that many bytes of text, so that what Python holds for it stays small."""
    begin = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)


def map_texts(
    df: DataFrame, keys: list[str], text: str, make: Callable[[], Callable[[list[str | None], dict[str, list]], dict]], schema: str, most: int = 2_000_000
) -> DataFrame:
    """mapInArrow over (keys, text): make() builds, once per task, a function from texts and key lists to new columns.

    The function gets a slice of a batch and returns columns by name; pyarrow arrays, numpy arrays and lists are taken.
    """
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(schema)
    arrow = _arrow_schema(wanted)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            texts = batch.column(len(keys))
            lists = [batch.column(i) for i in range(len(keys))]
            for a, b in text_slices(texts, most):
                out = step(texts.slice(a, b - a).to_pylist(), {k: x.slice(a, b - a).to_pylist() for k, x in zip(keys, lists)})
                yield pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(*(df[k] for k in keys), df[text]).mapInArrow(run, wanted)


def _arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, type=kind)
