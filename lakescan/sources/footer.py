"""Footers: checked, decoded, and as DataFrames of files, schema elements, leaves, row groups and column chunks.

Only magic bytes and footers are read. Footers of many files are read by the executors, file by file, and become rows
there; where PyArrow has no file system for the paths, the driver reads them through Hadoop's, so every path that Spark
can read works. Statistics and index offsets are reported as they stand in the file; nothing follows them, and row
counts are the footer's claim. A field whose value has another type than the format gives it is skipped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakescan.errors import CorruptFooter, IncorrectFile, MissingColumnMetadata, MissingMagicFooter, MissingMagicHeader, UnknownField

from .files import arrow_file, arrow_reads
from .thrift import Reader, fitted

MAGIC = b"PAR1"

# Enums of the Parquet format by number.
PHYSICAL = ("BOOLEAN", "INT32", "INT64", "INT96", "FLOAT", "DOUBLE", "BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY")
REPETITION = ("REQUIRED", "OPTIONAL", "REPEATED")
CONVERTED = (
    "UTF8 MAP MAP_KEY_VALUE LIST ENUM DECIMAL DATE TIME_MILLIS TIME_MICROS TIMESTAMP_MILLIS TIMESTAMP_MICROS "
    "UINT_8 UINT_16 UINT_32 UINT_64 INT_8 INT_16 INT_32 INT_64 JSON BSON INTERVAL"
).split()
ENCODINGS = {0: "PLAIN", 2: "PLAIN_DICTIONARY", 3: "RLE", 4: "BIT_PACKED", 5: "DELTA_BINARY_PACKED", 6: "DELTA_LENGTH_BYTE_ARRAY", 7: "DELTA_BYTE_ARRAY", 8: "RLE_DICTIONARY", 9: "BYTE_STREAM_SPLIT"}
CODECS = ("UNCOMPRESSED", "SNAPPY", "GZIP", "LZO", "BROTLI", "LZ4", "ZSTD", "LZ4_RAW")
#: Codecs that Spark has not.
REFUSED = frozenset(("BROTLI", "LZO"))
PAGES = ("DATA_PAGE", "INDEX_PAGE", "DICTIONARY_PAGE", "DATA_PAGE_V2")
LOGICAL = {1: "STRING", 2: "MAP", 3: "LIST", 4: "ENUM", 5: "DECIMAL", 6: "DATE", 7: "TIME", 8: "TIMESTAMP", 10: "INTEGER", 11: "UNKNOWN", 12: "JSON", 13: "BSON", 14: "UUID", 15: "FLOAT16", 16: "VARIANT", 17: "GEOMETRY", 18: "GEOGRAPHY"}
UNITS = {1: "MILLIS", 2: "MICROS", 3: "NANOS"}


# The footer's structs, fields by number with the type of their value; a list has the type of its entries.
_PAIR = {1: bytes, 2: bytes}
_LOGICAL = {5: {1: int, 2: int}, 7: {1: bool, 2: {}}, 8: {1: bool, 2: {}}, 10: {1: int, 2: bool}} | {n: {} for n in (1, 2, 3, 4, 6, 11, 12, 13, 14, 15, 16, 17, 18)}
_SCHEMA = {1: int, 2: int, 3: int, 4: bytes, 5: int, 6: int, 7: int, 8: int, 9: int, 10: _LOGICAL}
_STATISTICS = {1: bytes, 2: bytes, 3: int, 4: int, 5: bytes, 6: bytes, 7: bool, 8: bool}
_COLUMN = {
    1: int, 2: [int], 3: [bytes], 4: int, 5: int, 6: int, 7: int, 8: [_PAIR], 9: int, 10: int, 11: int, 12: _STATISTICS, 13: [{1: int, 2: int, 3: int}], 14: int, 15: int,
}
_CHUNK = {1: bytes, 2: int, 3: _COLUMN, 4: int, 5: int, 6: int, 7: int, 8: {}, 9: bytes}
_GROUP = {1: [_CHUNK], 2: int, 3: int, 4: [{1: int, 2: bool, 3: bool}], 5: int, 6: int, 7: int}
_FILE = {1: int, 2: [_SCHEMA], 3: int, 4: [_GROUP], 5: [_PAIR], 6: bytes, 7: [{}], 8: {}, 9: bytes}


def _name(names, number):
    if number is None:
        return None
    if isinstance(names, dict):
        return names.get(number, str(number))
    return names[number] if 0 <= number < len(names) else str(number)


def _text(value: bytes | None) -> str | None:
    return None if value is None else value.decode("utf-8", "replace")


@dataclass
class Element:
    """A node of the schema tree. Levels are the greatest definition and repetition level below its path."""

    name: str
    path: tuple[str, ...]
    physical: str | None
    length: int | None
    repetition: str | None
    converted: str | None
    logical: str | None
    details: dict
    scale: int | None
    precision: int | None
    field_id: int | None
    max_def: int
    max_rep: int
    column: int | None = None
    children: list[Element] = field(default_factory=list)

    @property
    def annotation(self) -> str | None:
        """One name for the logical type, whichever way it is written down: INT_8, TIMESTAMP_NANOS, DECIMAL ..."""
        if self.logical in ("TIME", "TIMESTAMP"):
            return f"{self.logical}_{self.details['unit']}"
        if self.logical == "INTEGER":
            return f"{'INT' if self.details['signed'] else 'UINT'}_{self.details['bits']}"
        if self.logical:
            return self.logical
        return "STRING" if self.converted == "UTF8" else self.converted


@dataclass
class Footer:
    path: str
    size: int
    raw: dict[int, object]
    elements: list[Element]

    @property
    def root(self) -> Element:
        return self.elements[0]

    @property
    def leaves(self) -> list[Element]:
        return [e for e in self.elements if e.column is not None]

    @property
    def row_groups(self) -> list[dict]:
        return self.raw.get(4) or []

    @property
    def encodings(self) -> set[str]:
        chunks = [c.get(3) or {} for g in self.row_groups for c in g.get(1) or []]
        return {_name(ENCODINGS, e) for m in chunks for e in m.get(2) or []}

    @property
    def codecs(self) -> set[str]:
        return {_name(CODECS, (c.get(3) or {}).get(4)) for g in self.row_groups for c in g.get(1) or []}

    def find(self, path: list[str] | tuple[str, ...] | str) -> Element | None:
        """The element at a path; only an element's own children are looked through. None if there is none."""
        parts = path.split(".") if isinstance(path, str) else list(path)
        at = self.root
        for name in parts:
            at = next((c for c in at.children if c.name == name), None)
            if at is None:
                return None
        return at if parts else None

    def must_find(self, path) -> Element:
        found = self.find(path)
        if found is None:
            raise UnknownField(f"{self.path}: {path}")
        return found


def _element(raw: dict, path: tuple[str, ...], above: Element | None) -> Element:
    logical, details = None, {}
    if raw.get(10):
        number, value = next(iter(raw[10].items()))
        logical = LOGICAL.get(number, str(number))
        if logical in ("TIME", "TIMESTAMP"):
            details = {"utc": value.get(1), "unit": UNITS.get(next(iter(value.get(2) or {}), None))}
        elif logical == "INTEGER":
            details = {"bits": value.get(1), "signed": value.get(2)}
        elif logical == "DECIMAL":
            details = {"scale": value.get(1), "precision": value.get(2)}
    repetition = _name(REPETITION, raw.get(3)) if above is not None else None
    deeper = (repetition in ("OPTIONAL", "REPEATED")) * 1
    return Element(
        _text(raw.get(4)) or "", path, _name(PHYSICAL, raw.get(1)) if not raw.get(5) else None, raw.get(2), repetition, _name(CONVERTED, raw.get(6)), logical, details,
        raw.get(7, details.get("scale")), raw.get(8, details.get("precision")), raw.get(9),
        (above.max_def if above else 0) + deeper, (above.max_rep if above else 0) + (repetition == "REPEATED"),
    )


def _tree(raw: list[dict]) -> list[Element]:
    """Elements in the file's order, depth first, with their places and children set."""
    if not raw:
        raise CorruptFooter("no schema")
    out, columns = [], 0
    open_: list[tuple[Element, int]] = []
    for r in raw:
        above = open_[-1][0] if open_ else None
        path = (*above.path, _text(r.get(4)) or "") if above is not None else ()
        e = _element(r, path, above)
        out.append(e)
        if above is not None:
            above.children.append(e)
            open_[-1] = (above, open_[-1][1] - 1)
        if r.get(5):
            open_.append((e, r[5]))
        elif above is not None:
            e.column, columns = columns, columns + 1
        while open_ and open_[-1][1] == 0:
            open_.pop()
    return out


def parse(data: bytes, path: str = "", size: int = 0) -> Footer:
    raw = fitted(Reader(data).struct(), _FILE)
    try:
        return Footer(path, size, raw, _tree(raw.get(2) or []))
    except (AttributeError, TypeError, StopIteration) as e:
        raise CorruptFooter(f"{path}: {e}") from e


def _framed(path: str, size: int, some: Callable[[int, int], bytes]) -> Footer:
    """Check a file's frame and decode its footer; some: n bytes from a place on."""
    if size < 12:
        raise IncorrectFile(f"{path}: {size} bytes")
    if some(0, 4) != MAGIC:
        raise MissingMagicHeader(path)
    tail = some(size - 8, 8)
    if tail[4:] != MAGIC:
        raise MissingMagicFooter(path)
    length = int.from_bytes(tail[:4], "little")
    if length > size - 12:
        raise IncorrectFile(f"{path}: a footer of {length} bytes in a file of {size}")
    return parse(some(size - 8 - length, length), path, size)


def read_footer(spark: SparkSession, path: str) -> Footer:
    """Check a file's frame and decode its footer, on the driver."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = fs.getFileStatus(at).getLen()
    if size < 12:
        raise IncorrectFile(f"{path}: {size} bytes")
    stream = fs.open(at)

    def some(begin: int, n: int) -> bytes:
        stream.seek(begin)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))

    try:
        return _framed(path, size, some)
    finally:
        stream.close()


def _read_here(path: str, size: int) -> Footer:
    """The same where PyArrow has the file system: on an executor."""
    at, inside = arrow_file(path)
    with at.open_input_file(inside) as f:
        return _framed(path, size, lambda begin, n: f.read_at(n, begin))


def _listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, length of the data files below paths, as Spark lists them (nothing is opened)."""
    paths = [paths] if isinstance(paths, str) else paths
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length")


def _per_file(spark: SparkSession, paths: str | list[str], rows: Callable[[Footer], Iterator[tuple]], ddl: str) -> DataFrame:
    """What rows() makes of each footer, as a DataFrame: read and made by the executors, if they can open the files."""
    if not arrow_reads(spark, [paths] if isinstance(paths, str) else paths):
        with ThreadPoolExecutor(16) as pool:
            footers = pool.map(lambda f: read_footer(spark, f), files_of(spark, paths))
            return spark.createDataFrame([r for f in footers for r in rows(f)], ddl)
    schema = StructType.fromDDL(ddl)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for path, size in zip(*(c.to_pylist() for c in batch.columns)):
                columns = list(zip(*rows(_read_here(path, size)))) or [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([_column(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return _listed(spark, paths).mapInArrow(run, schema)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_map(kind):
        values = [None if v is None else list(v.items()) for v in values]
    return pa.array(values, kind)


def _kind(f: Footer) -> tuple[str, bool, list[str]]:
    """A digest of a file's schema, whether it has pages that the vectorized reader refuses, and codecs that Spark lacks."""
    elements = [(e.path, e.physical, e.length, e.repetition, e.annotation, e.precision, e.scale, sorted(e.details.items()), len(e.children)) for e in f.elements]
    return hashlib.md5(repr(elements).encode()).hexdigest(), "BYTE_STREAM_SPLIT" in f.encodings, sorted(f.codecs & REFUSED)


def kinds_of(spark: SparkSession, paths: str | list[str]) -> list[Footer]:
    """One footer for each kind of file below paths (schema, pages, codecs), by path: all footers are looked at, by the
    executors, and the driver gets one path a kind."""
    files = _listed(spark, paths)._jdf.inputFiles()
    if len(files) == 1:  # needs no job
        return [read_footer(spark, unquote(files[0]))]
    kinds = _per_file(spark, paths, lambda f: iter([(f.path, *_kind(f))]), "path string, schema string, split boolean, refused array<string>")
    first = kinds.groupBy("schema", "split", "refused").agg(F.min("path").alias("path")).collect()
    return [read_footer(spark, p) for p in sorted(r.path for r in first)]


def files_of(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The data files below paths, as Spark lists them (nothing is opened)."""
    return sorted(map(unquote, _listed(spark, paths).inputFiles()))


def _pairs(raw: list[dict] | None) -> dict[str, str | None] | None:
    return None if raw is None else {_text(x.get(1)): _text(x.get(2)) for x in raw}


def _file_rows(f: Footer) -> Iterator[tuple]:
    yield (
        f.path, f.size, f.raw.get(1), f.raw.get(3), len(f.row_groups), len(f.elements) - 1, len(f.leaves), sum(g.get(2) or 0 for g in f.row_groups),
        _text(f.raw.get(6)), _pairs(f.raw.get(5)), len(f.raw[7]) if f.raw.get(7) is not None else None, 8 in f.raw, 9 in f.raw,
    )


def file_metadata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _per_file(
        spark, paths, _file_rows,
        "path string, file_size long, version int, num_rows long, num_row_groups int, num_schema_elements int, num_leaves int, total_byte_size long, "
        "created_by string, key_value_metadata map<string,string>, num_column_orders int, encrypted boolean, signed boolean",
    )


def _element_rows(f: Footer) -> Iterator[tuple]:
    for i, e in enumerate(f.elements[1:], 1):
        yield (
            f.path, i, ".".join(e.path), e.name, e.physical, e.length, e.repetition, len(e.children), e.converted, e.logical, e.annotation, e.precision, e.scale, e.field_id,
            e.column, e.max_def, e.max_rep,
        )


def schema_elements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All elements but the root, groups too, in the file's order."""
    return _per_file(
        spark, paths, _element_rows,
        "file string, position int, path string, name string, physical_type string, type_length int, repetition string, num_children int, converted_type string, "
        "logical_type string, annotation string, precision int, scale int, field_id int, column_index int, max_definition_level int, max_repetition_level int",
    )


def schema_leaves(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return schema_elements(spark, paths).where("column_index IS NOT NULL").drop("num_children")


def _group_rows(f: Footer) -> Iterator[tuple]:
    first = 0
    for i, g in enumerate(f.row_groups):
        sorting = [(s.get(1), s.get(2), s.get(3)) for s in g.get(4) or []]
        yield f.path, i, first, g.get(3), g.get(2), g.get(6), g.get(5), g.get(7), len(g.get(1) or []), sorting
        first += g.get(3) or 0


def row_groups(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _per_file(
        spark, paths, _group_rows,
        "path string, row_group int, first_row long, num_rows long, total_byte_size long, total_compressed_size long, file_offset long, ordinal int, num_columns int, "
        "sorting_columns array<struct<column_idx:int,descending:boolean,nulls_first:boolean>>",
    )


def _chunk_rows(f: Footer) -> Iterator[tuple]:
    for i, g in enumerate(f.row_groups):
        for c, chunk in enumerate(g.get(1) or []):
            m = chunk.get(3)
            if m is None:
                raise MissingColumnMetadata(f"{f.path}: row group {i}, column {c}")
            s = m.get(12) or {}
            yield (
                f.path, i, c, ".".join(_text(x) for x in m.get(3) or []), _name(PHYSICAL, m.get(1)), _name(CODECS, m.get(4)), [_name(ENCODINGS, e) for e in m.get(2) or []],
                m.get(5), m.get(6), m.get(7), m.get(9), m.get(10), m.get(11), _pairs(m.get(8)), s.get(6, s.get(2)), s.get(5, s.get(1)), s.get(3), s.get(4),
                [(_name(PAGES, x.get(1)), _name(ENCODINGS, x.get(2)), x.get(3)) for x in m.get(13) or []], m.get(14), m.get(15),
                chunk.get(4), chunk.get(5), chunk.get(6), chunk.get(7), 8 in chunk or 9 in chunk,
            )


def column_chunks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _per_file(
        spark, paths, _chunk_rows,
        "path string, row_group int, column int, column_path string, physical_type string, codec string, encodings array<string>, num_values long, "
        "total_uncompressed_size long, total_compressed_size long, data_page_offset long, index_page_offset long, dictionary_page_offset long, "
        "key_value_metadata map<string,string>, min_value binary, max_value binary, null_count long, distinct_count long, "
        "encoding_stats array<struct<page:string,encoding:string,count:int>>, bloom_filter_offset long, bloom_filter_length int, "
        "offset_index_offset long, offset_index_length int, column_index_offset long, column_index_length int, encrypted boolean",
    )
