"""A Spark data source with one partition per row group (or per file, if there are many), for what Spark's reader lacks.

It addresses row groups, reads BROTLI files and half floats, UUIDs and times natively, and gives INT96 exactly. PyArrow reads
each row group on an executor, batch by batch and only the wanted columns; paths have to be readable there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .files import arrow_file

NAME = "row_groups"
#: Of so many files the planner counts the row groups.
MOST_OPENED = 64
EPOCH_JULIAN = 2440588


def readable(kind: pa.DataType) -> pa.DataType:
    """The nearest type that Spark has; times and nanoseconds stay the integers that are stored."""
    if isinstance(kind, pa.BaseExtensionType):
        return readable(kind.storage_type)
    if pa.types.is_float16(kind):
        return pa.float32()
    if pa.types.is_unsigned_integer(kind):
        return {8: pa.int16(), 16: pa.int32(), 32: pa.int64(), 64: pa.decimal128(20, 0)}[kind.bit_width]
    if pa.types.is_time(kind):
        return pa.int32() if pa.types.is_time32(kind) else pa.int64()
    if pa.types.is_timestamp(kind):
        return pa.int64() if kind.unit == "ns" else pa.timestamp("us", "UTC" if kind.tz else None)
    if pa.types.is_fixed_size_binary(kind):
        return pa.binary()
    if pa.types.is_dictionary(kind):
        return readable(kind.value_type)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind) or pa.types.is_fixed_size_list(kind):
        return pa.list_(pa.field("element", readable(kind.value_type), True))
    if pa.types.is_map(kind):
        return pa.map_(readable(kind.key_type), readable(kind.item_type))
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, readable(f.type), True) for f in kind])
    return kind


def _plain(column: pa.Array, to: pa.DataType) -> pa.Array:
    if isinstance(column, pa.ExtensionArray):
        column = column.storage
    if pa.types.is_time(column.type):
        column = column.cast(pa.int32() if column.type.bit_width == 32 else pa.int64())
    return column if column.type == to else column.cast(to)


def _raw_int96(column: pa.Array) -> pa.Array:
    """Julian day * 2^64 + nanoseconds of the day, of nanoseconds since the epoch."""
    day = 86_400_000_000_000
    raw = [None if v is None else (v // day + EPOCH_JULIAN) * 2**64 + v % day for v in column.cast(pa.int64()).to_pylist()]
    return pa.array(raw, pa.decimal128(29, 0))


@dataclass
class RowGroup(InputPartition):
    path: str
    index: int | None


class RowGroups(DataSource):
    """Options: path (a file or folder), row_group (one index, or all), int96 (names of columns to give raw, by commas)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def files(self) -> list[str]:
        from pyarrow import fs

        at, path = arrow_file(self.options["path"])
        info = at.get_file_info(path)
        if info.type == fs.FileType.File:
            return [self.options["path"]]
        found = at.get_file_info(fs.FileSelector(path, recursive=True))
        scheme = urlsplit(self.options["path"]).scheme
        lead = f"{scheme}://" if len(scheme) > 1 and scheme != "file" else ""
        return sorted(lead + f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))

    def raw(self) -> set[str]:
        return {x for x in self.options.get("int96", "").split(",") if x}

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        found = _open(self.files()[0]).schema_arrow
        return from_arrow_schema(pa.schema([pa.field(f.name, pa.decimal128(29, 0) if f.name in self.raw() else readable(f.type), True) for f in found]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.files(), schema.fieldNames(), self.options.get("row_group"), self.raw())


def _open(path: str):
    import pyarrow.parquet as pq

    at, inside = arrow_file(path)
    return pq.ParquetFile(at.open_input_file(inside))


class Reader(DataSourceReader):
    def __init__(self, files: list[str], columns: list[str], index: str | None, raw: set[str]):
        self.all, self.columns, self.index, self.raw = files, columns, index, raw

    def partitions(self) -> list[RowGroup]:
        """One for each row group; of many files, one for each file, so that the planner opens none of them."""
        if self.index is not None or len(self.all) > MOST_OPENED:
            return [RowGroup(f, None if self.index is None else int(self.index)) for f in self.all]
        return [RowGroup(f, i) for f in self.all for i in range(_open(f).num_row_groups)]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        file = _open(partition.path)
        wanted = range(file.num_row_groups) if partition.index is None else [partition.index] if partition.index < file.num_row_groups else []
        for batch in file.iter_batches(10_000, row_groups=list(wanted), columns=self.columns) if wanted else ():
            columns = [_raw_int96(c) if n in self.raw else _plain(c, readable(c.type)) for n, c in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, self.columns)


def register(spark) -> None:
    spark.dataSource.register(RowGroups)


def scan_row_groups(spark, path: str, row_group: int | None = None, int96: list[str] = ()):
    register(spark)
    reader = spark.read.format(NAME).option("path", path)
    if row_group is not None:
        reader = reader.option("row_group", str(row_group))
    return (reader.option("int96", ",".join(int96)) if int96 else reader).load()
