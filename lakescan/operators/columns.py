"""Column reads as projections. All are lazy, prune what they do not name, and return plain DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructField, StructType

from lakescan.errors import UnknownField
from lakescan.sources.resolver import path_column


def _named(path) -> str:
    return (path if isinstance(path, str) else ".".join(path)).rsplit(".", 1)[-1]


def nullable(df: DataFrame, path, view=None) -> DataFrame:
    """One row per row, null where the value or a group above it is; view: a function of lakescan.functions.views."""
    c = path_column(path)
    return df.select((view(c) if view else c).alias(_named(path)))


def required(df: DataFrame, path, view=None) -> DataFrame:
    """Values only: rows without one are dropped, so the result is not aligned with the rows."""
    c = path_column(path)
    return df.where(c.isNotNull()).select((view(c) if view else c).alias(_named(path)))


def flattened(df: DataFrame, path, keep: list[str] = (), positions: bool = False) -> DataFrame:
    """The entries of a list column; a null or empty list gives one null entry."""
    c = path_column(path)
    keys = [F.col(k) for k in keep]
    return df.select(*keys, F.posexplode_outer(c).alias("position", _named(path)) if positions else F.explode_outer(c).alias(_named(path)))


def list_column(df: DataFrame, path, keep: list[str] = (), null_as_empty: bool = False) -> DataFrame:
    """One list per row; null_as_empty: a null list becomes an empty one."""
    c = path_column(path)
    return df.select(*keep, (F.coalesce(c, F.array()) if null_as_empty else c).alias(_named(path)))


def map_column(df: DataFrame, path, keep: list[str] = ()) -> DataFrame:
    """One list of (key, value) per row, in the file's order."""
    return df.select(*keep, F.map_entries(path_column(path)).alias(_named(path)))


def struct_column(df: DataFrame, name: str, leaves: list[str]) -> DataFrame:
    """Leaves side by side as one struct per row."""
    return df.select(F.struct(*(path_column(p).alias(_named(p)) for p in leaves)).alias(name))


def leaf(df: DataFrame, path) -> DataFrame:
    """A leaf of nested structs; only it is read."""
    return nullable(df, path)


def levels(df: DataFrame, path, schema: StructType | None = None) -> DataFrame:
    """value, def_level and rep_level of each entry of a leaf, through structs, lists and maps at any depth.

    path: names of columns and fields, and ``key`` or ``value`` behind a map; lists need no name. schema: tells what is
    required (R.read_schema of a footer); without it all is optional, as in the DataFrame. An entry that isn't there
    (a null or an empty list above it) has a null value and the level down to which there is something.
    """
    name, *rest = path.split(".") if isinstance(path, str) else list(path)
    field = (schema or df.schema)[name]
    kind, optional, depth = field.dataType, field.nullable, 0
    now = df.select(F.col(f"`{name}`").alias("value"), F.lit(0).alias("def_level"), F.lit(0).alias("rep_level"), F.lit(True).alias("_there"))
    value, def_level, rep_level, there = (F.col(c) for c in now.columns)
    while True:
        if optional:
            some = there & value.isNotNull()
            now = now.withColumns({"def_level": def_level + some.cast("int"), "_there": some})
        if isinstance(kind, StructType):
            field, now = kind[rest[0]], now.withColumn("value", value.getField(rest.pop(0)))
            kind, optional = field.dataType, field.nullable
            continue
        if isinstance(kind, MapType):
            now = now.withColumn("value", F.map_entries("value"))
            kind = ArrayType(StructType([StructField("key", kind.keyType, False), StructField("value", kind.valueType, kind.valueContainsNull)]), False)
        if not isinstance(kind, ArrayType):
            break
        depth += 1
        now = now.select(F.posexplode_outer("value").alias("_at", "value"), "def_level", "rep_level", "_there")
        entry = F.col("_at").isNotNull()
        rep = F.when(F.col("_at") > 0, depth).otherwise(rep_level)
        now = now.withColumns({"def_level": def_level + entry.cast("int"), "rep_level": rep, "_there": there & entry}).drop("_at")
        kind, optional = kind.elementType, kind.containsNull
    if rest:
        raise UnknownField(f"{path}: nothing is below {name}")
    return now.select("value", "def_level", "rep_level")
