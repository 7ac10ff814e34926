"""Files as objects: open, look at the footer, pick row groups, read columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakescan.errors import UnsupportedCodec
from lakescan.operators import columns as C
from lakescan.session import hadoop, scalar_session
from lakescan.sources import footer as FT
from lakescan.sources import resolver as R


def scan(spark: SparkSession, paths: str | list[str], physical: bool = False, columns: list[str] | None = None) -> DataFrame:
    """All files as one DataFrame, with the schema resolved from their footers: types that inference refuses included.

    A column that some files lack is null there; one that has different types in them is refused (UnexpectedType).
    physical: stored values instead of logical ones (flat columns; nested ones keep the read types).
    """
    return _scan(spark, paths, FT.kinds_of(spark, paths), physical, columns)


def _scan(spark: SparkSession, paths: str | list[str], footers: list[FT.Footer], physical: bool = False, columns: list[str] | None = None) -> DataFrame:
    """footers: of each kind of file that is there."""
    for f in footers:
        if refused := f.codecs & FT.REFUSED:
            raise UnsupportedCodec(f"{f.path}: {', '.join(sorted(refused))}")
    if any("BYTE_STREAM_SPLIT" in f.encodings for f in footers):
        spark = scalar_session(spark)
    schema = R.merged([R.read_schema(f, physical, columns) for f in footers])
    df = spark.read.schema(schema).parquet(*([paths] if isinstance(paths, str) else paths))
    if not physical:
        return df
    flat = R.flat_leaves(footers)
    return df.select(*(R.physical_value(flat[c], R.path_column([c])).alias(c) if c in flat else F.col(f"`{c}`") for c in df.columns))


class ParquetFile:
    """One file. Opening checks it and decodes the footer; reads are lazy DataFrames."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.footer = spark, path, FT.read_footer(spark, path)

    def find(self, path) -> FT.Element | None:
        return self.footer.find(path)

    @property
    def encodings(self) -> set[str]:
        return self.footer.encodings

    @property
    def codecs(self) -> set[str]:
        return self.footer.codecs

    def read(self, physical: bool = False) -> DataFrame:
        """The whole file. Pages in BYTE_STREAM_SPLIT are read by a session without the vectorized reader."""
        return _scan(self.spark, self.path, [self.footer], physical)

    def row_group(self, i: int, physical: bool = False) -> DataFrame:
        """The rows of a row group, by their range of row indexes: Spark's own reader, with all its pruning."""
        before = sum(g.get(3) or 0 for g in self.footer.row_groups[:i])
        n = self.footer.row_groups[i].get(3) or 0
        df = self.read()
        rows = df.where(F.col("_metadata.row_index").between(before, before + n - 1))
        if not physical:
            return rows
        schema = R.read_schema(self.footer, True)
        rows = df.sparkSession.read.schema(schema).parquet(self.path).where(F.col("_metadata.row_index").between(before, before + n - 1))
        flat = R.flat_leaves([self.footer])
        return rows.select(*(R.physical_value(flat[c], R.path_column([c])).alias(c) if c in flat else F.col(f"`{c}`") for c in rows.columns))

    def column(self, path, physical: str | None = None, nullable: bool = True, view=None) -> DataFrame:
        """A leaf; physical: the stored type that it must have; nullable=False drops nulls."""
        e = self.footer.must_find(path)
        if physical is not None:
            R.expect(e, physical)
        return (C.nullable if nullable else C.required)(self.read(), path, view)

    def dynamic(self, column: int) -> DataFrame:
        """The stored values of the column with that index; a repeated column gives its entries."""
        e = self.footer.leaves[column]
        top = self.read(physical=True)
        if e.max_rep:
            return C.flattened(top, [e.path[0]])
        return C.nullable(top, e.path)

    def levels(self, path) -> DataFrame:
        """value, def_level and rep_level of a leaf, as the file has them; path as for columns.levels."""
        return C.levels(self.read(), path, R.read_schema(self.footer))

    def list_column(self, path, null_as_empty: bool = False) -> DataFrame:
        R.expect_list(self.footer.must_find(path))
        return C.list_column(self.read(), path, null_as_empty=null_as_empty)

    def map_column(self, path) -> DataFrame:
        R.expect_map(self.footer.must_find(path))
        return C.map_column(self.read(), path)

    def struct_column(self, name: str, leaves: list[str]) -> DataFrame:
        for p in leaves:
            self.footer.must_find(p)
        return C.struct_column(self.read(), name, leaves)


def strict_count(spark: SparkSession, path: str) -> int:
    """Decode every value with page checksums verified; raises where a page is corrupt."""
    with hadoop(spark, {"parquet.page.verify-checksum.enabled": "true"}):
        df = spark.read.parquet(path)
        return df.agg(F.count("*"), F.max(F.hash(*(f"`{c}`" for c in df.columns)))).first()[0]  # a hash needs every value


def lenient(spark: SparkSession, paths: str | list[str], schema=None) -> DataFrame:
    """A scan that skips corrupt files."""
    reader = spark.read.option("ignoreCorruptFiles", "true")
    return (reader.schema(schema) if schema is not None else reader).parquet(*([paths] if isinstance(paths, str) else paths))
