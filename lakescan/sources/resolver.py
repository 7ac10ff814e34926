"""From a footer to the schema that Spark reads it with, and to the expressions that give physical values.

Inference fails for a whole file as soon as one leaf is FLOAT16, UUID, TIME or TIMESTAMP in nanoseconds, so the read schema
is always given: such leaves are read as what they are stored as. Nothing here reads data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescan.errors import MissingDecimalScale, NotAListColumn, NotAMapColumn, UnexpectedType, UnsupportedDecimal
from lakescan.functions import views

from .footer import Element, Footer

# How a leaf is read, by physical type and annotation; a missing annotation gives the entry under None.
LOGICAL = {
    "BOOLEAN": {None: "boolean"},
    "INT32": {None: "int", "DATE": "date", "INT_8": "tinyint", "INT_16": "smallint", "UINT_8": "smallint", "UINT_16": "int", "UINT_32": "bigint"},
    "INT64": {None: "bigint", "TIMESTAMP_MILLIS": "timestamp", "TIMESTAMP_MICROS": "timestamp", "UINT_64": "decimal(20,0)"},
    "INT96": {None: "timestamp"},
    "FLOAT": {None: "float"},
    "DOUBLE": {None: "double"},
    "BYTE_ARRAY": {None: "binary", "STRING": "string", "ENUM": "string", "JSON": "string"},
    "FIXED_LEN_BYTE_ARRAY": {None: "binary"},
}
#: Spark refuses the stored type for these two; they are read as the next larger one and put back.
WIDENED = {"UINT_32": views.uint32_as_int, "UINT_64": views.uint64_as_long}


def decimal_type(e: Element) -> T.DecimalType:
    if e.scale is None:
        raise MissingDecimalScale(".".join(e.path))
    if e.physical not in ("INT32", "INT64", "BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY") or (e.precision or 0) > 38:
        raise UnsupportedDecimal(f"{'.'.join(e.path)}: {e.physical}({e.precision})")
    return T.DecimalType(e.precision or 38, e.scale)


def leaf_type(e: Element, physical: bool = False) -> T.DataType:
    """The type that Spark reads a leaf as: its logical one, or the stored one."""
    if e.annotation == "DECIMAL" and not physical:
        return decimal_type(e)
    by = LOGICAL[e.physical]
    name = by.get(e.annotation, by[None])
    if physical and e.annotation not in WIDENED:
        name = by[None]
    if name == "timestamp" and e.physical == "INT64" and e.logical == "TIMESTAMP" and not e.details.get("utc"):
        name = "timestamp_ntz"
    return T.StructType.fromDDL(f"x {name}")[0].dataType


def _repeated_content(e: Element) -> Element | None:
    """The element of a list group; None if the repeated child is the element itself (two-level lists)."""
    (middle,) = e.children
    if not middle.children or len(middle.children) > 1 or middle.name == "array" or middle.name == f"{e.name}_tuple":
        return None
    return middle.children[0]


def is_list(e: Element) -> bool:
    return e.annotation == "LIST" and len(e.children) == 1 and e.children[0].repetition == "REPEATED"


def is_map(e: Element) -> bool:
    return e.annotation in ("MAP", "MAP_KEY_VALUE") and len(e.children) == 1 and len(e.children[0].children) == 2


def type_of(e: Element, physical: bool = False, repeated: bool = True) -> T.DataType:
    if repeated and e.repetition == "REPEATED":
        return T.ArrayType(type_of(e, physical, False), False)
    if e.physical is not None and e.column is not None:
        return leaf_type(e, physical)
    if is_list(e):
        content = _repeated_content(e)
        if content is None:
            return T.ArrayType(type_of(e.children[0], physical, False), False)
        return T.ArrayType(type_of(content, physical), content.repetition != "REQUIRED")
    if is_map(e):
        key, value = e.children[0].children
        return T.MapType(type_of(key, physical), type_of(value, physical), value.repetition != "REQUIRED")
    return T.StructType([T.StructField(c.name, type_of(c, physical), c.repetition != "REQUIRED") for c in e.children])


def read_schema(footer: Footer, physical: bool = False, columns: list[str] | None = None) -> T.StructType:
    wanted = [c for c in footer.root.children if columns is None or c.name in columns]
    return T.StructType([T.StructField(c.name, type_of(c, physical), c.repetition != "REQUIRED") for c in wanted])


def merged(schemas: list[T.StructType]) -> T.StructType:
    """All fields of the schemas, in the order in which they are met; a field that one lacks is nullable."""
    found: dict[str, T.StructField] = {}
    for schema in schemas:
        for f in schema:
            if f.name not in found:
                found[f.name] = f
                continue
            before = found[f.name]
            kind = before.dataType
            if isinstance(kind, T.StructType) and isinstance(f.dataType, T.StructType):
                kind = merged([kind, f.dataType])
            elif _nullable(kind) != _nullable(f.dataType):
                raise UnexpectedType(f"{f.name} is {kind.simpleString()} in a file and {f.dataType.simpleString()} in another")
            elif kind != f.dataType:
                kind = _nullable(kind)
            found[f.name] = T.StructField(f.name, kind, before.nullable or f.nullable)
    lacking = {n for n in found for s in schemas if n not in s.fieldNames()}
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable or f.name in lacking) for f in found.values()])


def _nullable(kind: T.DataType) -> T.DataType:
    """The type with everything in it nullable."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(_nullable(kind.keyType), _nullable(kind.valueType), True)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType), True) for f in kind])
    return kind


def flat_leaves(footers: list[Footer]) -> dict[str, Element]:
    """Top-level columns that are no groups and do not repeat, by name; the same one may not be stored in two ways."""
    found: dict[str, Element] = {}
    for f in footers:
        for e in f.root.children:
            if e.column is not None and e.repetition != "REPEATED":
                before = found.setdefault(e.name, e)
                if (before.physical, before.annotation) != (e.physical, e.annotation):
                    raise UnexpectedType(f"{e.name} is {before.physical} ({before.annotation}) in a file and {e.physical} ({e.annotation}) in another")
    return found


def physical_value(e: Element, column: Column) -> Column:
    """The stored value of a flat leaf that was read with leaf_type(e, physical=True)."""
    if e.physical == "INT96":
        return views.int96(column)
    return WIDENED[e.annotation](column) if e.annotation in WIDENED else column


def expect(e: Element, physical: str) -> Element:
    if e.physical != physical:
        raise UnexpectedType(f"{'.'.join(e.path)} is {e.physical}, not {physical}")
    return e


def expect_list(e: Element) -> Element:
    if e.max_rep == 0 and not is_list(e):
        raise NotAListColumn(".".join(e.path))
    return e


def expect_map(e: Element) -> Element:
    if not is_map(e):
        raise NotAMapColumn(".".join(e.path))
    return e


def path_column(path) -> Column:
    parts = path.split(".") if isinstance(path, str) else list(path)
    return F.col(".".join(f"`{p}`" for p in parts))
