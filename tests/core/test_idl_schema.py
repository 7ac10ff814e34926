import pytest

from lakescan import errors as E
from lakescan import generate
from lakescan.sources.thrift_idl import IdlError
from lakescan.sources.thrift_schema import Interface, idl_schemas, source

TEXT = """
enum Colour { RED; GREEN = 5 }
struct Point { 1: required i32 x, 2: optional double y = 0.5 }
union Shape { 1: Point point; 2: string name }
struct All {
  1: required list<Point> points
  2: optional map<string, list<i64>> counts
  3: Colour colour = Colour.GREEN
  4: set<binary> raw
  5: bool flag = true
  6: optional Shape shape
}
"""
#: All: 1 list of one struct {1: 7}; 5 false; 6 struct {2: "ab"}; 9 an unknown number.
BYTES = b"\x19\x1c\x15\x0e\x00" + b"\x42" + b"\x1c\x28\x02ab\x00" + b"\x35\x02" + b"\x00"


def test_schemas():
    found = Interface(TEXT).schema("All")
    assert found.simpleString() == "struct<points:array<struct<x:int,y:double>>,counts:map<string,array<bigint>>,colour:int,raw:array<binary>,flag:boolean,shape:struct<point:struct<x:int,y:double>,name:string>>"
    assert not found["points"].nullable and found["counts"].nullable
    assert found["colour"].metadata == {"id": 3, "requirement": "default", "default": "Colour.GREEN", "values": {"0": "RED", "5": "GREEN"}}


def test_structs_are_read_by_name(spark):
    got = Interface(TEXT).read("All", BYTES)
    assert got == {"points": [{"x": 7, "y": 0.5}], "counts": None, "colour": 5, "raw": None, "flag": False, "shape": {"point": None, "name": "ab"}}
    assert spark.createDataFrame([got], Interface(TEXT).schema("All")).first().points[0].x == 7
    with pytest.raises(E.CorruptFooter):
        Interface(TEXT).read("All", b"\x00")  # a required field is missing
    with pytest.raises(E.CorruptFooter):
        Interface(TEXT).read("Shape", b"\x00")
    assert Interface("struct S { 1: i32 a, 2: string b }").read("S", b"\x18\x01x\x18\x01y\x00") == {"a": None, "b": "y"}  # 1 is mistyped


def test_what_has_no_schema():
    with pytest.raises(IdlError):
        Interface("struct S { 1: list<S> own }").schema("S")
    with pytest.raises(IdlError):
        Interface("struct S { 1: Other o }").schema("S")
    with pytest.raises(IdlError):
        Interface("enum E { A }").schema("E")


def test_generated_text_gives_the_schemas(spark, tmp_path, capsys):
    (tmp_path / "x.thrift").write_text(TEXT)
    made: dict = {}
    exec(source(TEXT), made)
    assert made["All"] == Interface(TEXT).schema("All") and made["Colour"] == {"RED": 0, "GREEN": 5}
    assert generate.main([str(tmp_path / "x.thrift"), str(tmp_path / "out.py")]) == 0 and (tmp_path / "out.py").read_text() == source(TEXT)
    assert generate.main([str(tmp_path / "x.thrift")]) == 0 and capsys.readouterr().out == source(TEXT)
    assert generate.main([]) == 2 and generate.main([str(tmp_path / "none")]) == 1
    assert idl_schemas(spark, str(tmp_path / "x.thrift")).where("NOT nullable").count() == 2
