"""Parquet files with types, pages and codecs that Spark's own writer has no way to make, written by the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .files import arrow_file


def write_arrow(df: DataFrame, path: str, make: Callable[[pa.Table], pa.Table] | None = None, row_group_size: int = 1 << 17, **options) -> int:
    """One file per partition below path (a folder that executors reach); make: what becomes of a row group's table.

    A task holds one row group. options: those of pyarrow's Parquet writer. A task that runs again writes the same file.
    Returns the number of rows.
    """

    def run(batches):
        import pyarrow.parquet as pq

        writer, held, n = None, [], 0
        name = f"{path.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.parquet"
        try:
            for group in _groups(batches, row_group_size):
                table = make(group) if make else group
                if writer is None:
                    at, inside = arrow_file(name)
                    at.create_dir(inside.rsplit("/", 1)[0], recursive=True)
                    held.append(at.open_output_stream(inside))
                    writer = pq.ParquetWriter(held[0], table.schema, **options)
                writer.write_table(table, row_group_size)
                n += table.num_rows
        finally:
            for x in (writer, *held):
                if x is not None:
                    x.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return df.mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0


def _groups(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of so many rows, and one of the rest."""
    held, n = [], 0
    for b in batches:
        at = 0
        while b.num_rows - at >= size - n:
            held.append(b.slice(at, size - n))
            at += size - n
            yield pa.Table.from_batches(held)
            held, n = [], 0
        if at < b.num_rows:
            held.append(b.slice(at))
            n += b.num_rows - at
    if held:
        yield pa.Table.from_batches(held)
