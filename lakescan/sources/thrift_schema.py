"""Interface files made usable: Spark schemas of their structs, and readers of such structs from Thrift's compact protocol.

Enums are their numbers (the names are in the field's metadata), sets are arrays, unions are structs of which one field is
there. Field ids, requirements and defaults are metadata. A struct that holds itself has no schema, and is refused.
"""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lakescan.errors import CorruptFooter

from .thrift import Reader
from .thrift_idl import BASES, Field, IdlError, Parser, Type

# Spark's types of the base types.
SPARK = {
    "bool": T.BooleanType(), "byte": T.ByteType(), "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(),
    "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "uuid": T.BinaryType(),
}


def _inner(name: str) -> list[str]:
    """The types between the outer < and >."""
    depth, start, out = 0, name.index("<") + 1, []
    for i, c in enumerate(name):
        depth += (c == "<") - (c == ">")
        if (c == "," and depth == 1) or i == len(name) - 1:
            out.append(name[start:i])
            start = i + 1
    return out


class Interface:
    """The types of an interface file, by name."""

    def __init__(self, text: str):
        self.types = {t.name: t for t in Parser(text).parse().types}

    def _type(self, name: str) -> Type:
        found = self.types.get(name)
        if found is None:
            raise IdlError(f"no type {name}")
        return found

    def spark_type(self, name: str, inside: tuple[str, ...] = ()) -> T.DataType:
        if name in BASES:
            return SPARK[name]
        if name.startswith(("list<", "set<")):
            return T.ArrayType(self.spark_type(_inner(name)[0], inside), False)
        if name.startswith("map<"):
            key, value = _inner(name)
            return T.MapType(self.spark_type(key, inside), self.spark_type(value, inside), False)
        found = self._type(name)
        if found.kind == "enum":
            return SPARK["i32"]
        if name in inside:
            raise IdlError(f"{name} holds itself")
        return T.StructType([self._field(f, (*inside, name)) for f in found.fields])

    def _field(self, f: Field, inside: tuple[str, ...]) -> T.StructField:
        notes: dict = {"id": f.id, "requirement": f.requirement} | ({"default": f.default} if f.default is not None else {})
        enum = self.types.get(f.type)
        if enum is not None and enum.kind == "enum":
            notes["values"] = {str(v.id): v.name for v in enum.fields}
        return T.StructField(f.name, self.spark_type(f.type, inside), f.requirement != "required", notes)

    def schema(self, name: str) -> T.StructType:
        found = self.spark_type(name)
        if not isinstance(found, T.StructType):
            raise IdlError(f"{name} is no struct")
        return found

    def read(self, name: str, data: bytes) -> dict:
        """The struct that the bytes hold, as a dict by field names; unknown and mistyped fields are skipped."""
        return self._named(self._type(name), Reader(data).struct())

    def _named(self, of: Type, raw: dict) -> dict:
        out = {}
        for f in of.fields:
            value = self._value(f.type, raw.get(f.id)) if f.id in raw else None
            if value is None and f.default is not None:
                value = self._default(f)
            if value is None and f.requirement == "required":
                raise CorruptFooter(f"{of.name}.{f.name} is missing")
            out[f.name] = value
        if of.kind == "union" and sum(v is not None for v in out.values()) != 1:
            raise CorruptFooter(f"{of.name} holds not one field")
        return out

    def _value(self, kind: str, value):
        """None if the value has another type."""
        if kind in BASES:
            wanted = bool if kind == "bool" else float if kind == "double" else bytes if kind in ("string", "binary", "uuid") else int
            if type(value) is not wanted:
                return None
            return value.decode("utf-8", "replace") if kind == "string" else value
        if kind.startswith("map<"):
            if not isinstance(value, list):
                return None
            of = _inner(kind)
            return {self._value(of[0], k): self._value(of[1], v) for k, v in value}
        if kind.startswith(("list<", "set<")):
            found = [self._value(_inner(kind)[0], v) for v in value] if isinstance(value, list) else [None]
            return None if any(v is None for v in found) else found
        of = self._type(kind)
        if of.kind == "enum":
            return value if type(value) is int else None
        return self._named(of, value) if isinstance(value, dict) else None

    def _default(self, f: Field):
        if f.type == "string":
            return f.default
        if f.type == "bool":
            return f.default == "true"
        enum = self.types.get(f.type)
        if enum is not None and enum.kind == "enum":
            return next((v.id for v in enum.fields if v.name == f.default.rsplit(".", 1)[-1]), None)
        value = ast.literal_eval(f.default)
        return float(value) if f.type == "double" else value


def idl_schemas(spark: SparkSession, path: str) -> DataFrame:
    """type_name, field_id, name, spark_type, nullable: a row per field of the structs and unions of an interface file."""
    found = Interface(spark.read.text(path, wholetext=True).first()[0])
    rows = [
        (name, f.metadata["id"], f.name, f.dataType.simpleString(), f.nullable)
        for name, t in found.types.items()
        if t.kind != "enum"
        for f in found.schema(name)
    ]
    return spark.createDataFrame(rows, "type_name string, field_id int, name string, spark_type string, nullable boolean")


def source(text: str) -> str:
    """Python text that defines the schema of every struct and union of an interface file, and the numbers of its enums."""
    found, out = Interface(text), ["from pyspark.sql.types import StructType"]
    for name, t in found.types.items():
        if t.kind == "enum":
            out.append(f"{name} = {({v.name: v.id for v in t.fields})!r}")
        else:
            out.append(f"{name} = StructType.fromJson({found.schema(name).jsonValue()!r})")
    return "\n".join(out) + "\n"
