import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakescan import errors as E
from lakescan.sources import footer as FT
from lakescan.sources.thrift import Reader

from .files import save


@pytest.mark.parametrize(
    ("content", "error"),
    [
        (b"PAR1aPAR1", E.IncorrectFile), (b"", E.IncorrectFile), (b"noheadernoheader", E.MissingMagicHeader), (b"PAR1nofooterPAR1nofooter", E.MissingMagicFooter),
        (b"PAR1" + b"\xff\xff\xff\x7f" + b"PAR1", E.IncorrectFile), (b"PAR1" + b"\x1c" * 8 + b"\x08\0\0\0PAR1", E.CorruptFooter), (b"PAR1\0\x01\0\0\0PAR1", E.CorruptFooter),
    ],
)
def test_broken_frames(spark, tmp_path, content, error):
    (tmp_path / "x.parquet").write_bytes(content)
    with pytest.raises(error):
        FT.read_footer(spark, str(tmp_path / "x.parquet"))


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200))
def test_any_bytes_are_decoded_or_refused(data):
    try:
        FT.parse(data)
    except E.CorruptFooter:
        pass


def test_zigzag_ranges():
    assert [Reader(bytes([b])).zigzag(32) for b in (0, 1, 2, 3)] == [0, -1, 1, -2]
    with pytest.raises(E.CorruptFooter):
        Reader(b"\xff\xff\xff\xff\x7f").zigzag(32)


@pytest.fixture(scope="module")
def nested(tmp_path_factory):
    path = tmp_path_factory.mktemp("f") / "n.parquet"
    inner = pa.struct([("b", pa.int32()), ("bar", pa.string())])
    t = pa.table(
        {
            "a": pa.array([{"b": 1, "bar": "x"}, None], inner),
            "bar": pa.array([1, 2], pa.int64()),
            "l": pa.array([[1], None], pa.list_(pa.int64())),
            "m": pa.array([[("k", 1)], []], pa.map_(pa.string(), pa.int32())),
        }
    ).replace_schema_metadata({"who": "me"})
    pq.write_table(t, path, row_group_size=1, write_page_index=True)
    return str(path)


def test_lookup_stays_below_its_parent(spark, nested):
    f = FT.read_footer(spark, nested)
    assert (f.find("a.bar").column, f.find("bar").column, f.find("a").column) == (1, 2, None)
    assert f.find("a.l") is None and f.find(["bar", "b"]) is None and f.find([]) is None and f.find("no") is None
    assert [(e.max_def, e.max_rep) for e in f.leaves] == [(2, 0), (2, 0), (1, 0), (3, 1), (2, 1), (3, 1)]
    with pytest.raises(E.UnknownField):
        f.must_find("a.l")


def test_frames_agree_with_another_reader(spark, nested):
    m = pq.ParquetFile(nested).metadata
    file = FT.file_metadata(spark, nested).first()
    assert (file.num_rows, file.num_row_groups, file.num_leaves, file.created_by) == (m.num_rows, m.num_row_groups, m.num_columns, m.created_by)
    assert file.key_value_metadata["who"] == "me" and not file.encrypted
    assert file.num_schema_elements == 11
    groups = FT.row_groups(spark, nested).orderBy("row_group").collect()
    assert [(g.num_rows, g.total_byte_size, g.first_row) for g in groups] == [(m.row_group(i).num_rows, m.row_group(i).total_byte_size, i) for i in range(2)]
    for r in FT.column_chunks(spark, nested).collect():
        c = m.row_group(r.row_group).column(r.column)
        assert (r.column_path, r.physical_type, r.codec, r.num_values) == (c.path_in_schema, c.physical_type, c.compression, c.num_values)
        assert (r.total_compressed_size, r.data_page_offset, r.dictionary_page_offset) == (c.total_compressed_size, c.data_page_offset, c.dictionary_page_offset)
        assert set(r.encodings) == set(c.encodings) and r.null_count == c.statistics.null_count
        assert r.offset_index_offset and r.column_index_offset and not r.encrypted
    leaves = FT.schema_leaves(spark, nested).orderBy("column_index").collect()
    assert [r.path for r in leaves] == [m.schema.column(i).path for i in range(6)]
    assert [(r.max_definition_level, r.max_repetition_level) for r in leaves] == [(m.schema.column(i).max_definition_level, m.schema.column(i).max_repetition_level) for i in range(6)]


def test_sorting_columns_and_statistics(spark, tmp_path):
    path = save(tmp_path / "s.parquet", {"a": ([1, 2, None], pa.int64())}, sorting_columns=[pq.SortingColumn(0, True, False)])
    (g,) = FT.row_groups(spark, path).collect()
    assert [tuple(s) for s in g.sorting_columns] == [(0, True, False)]
    (c,) = FT.column_chunks(spark, path).collect()
    assert (int.from_bytes(c.min_value, "little"), int.from_bytes(c.max_value, "little"), c.null_count) == (1, 2, 1)


def test_driver_tables(spark, small):
    got = {r.name: r.annotation for r in FT.schema_leaves(spark, f"{small}/events.parquet").collect()}
    assert got["ts"] == "TIMESTAMP_MICROS" and got["props"] == "STRING" and got["value"] is None


def test_fields_of_another_type_are_skipped():
    """A footer whose version is text, whose row count is a list, and whose element has a repetition of another type."""
    root = b"\x48\x04root" + b"\x15\x02" + b"\0"  # 4: name, 5: one child
    leaf = b"\x15\x04" + b"\x28\x01x" + b"\x18\x01n" + b"\0"  # 1: INT64, 3: text for a number, 4: name
    f = FT.parse(b"\x18\x03abc" + b"\x19\x2c" + root + leaf + b"\x19\x15\x02" + b"\0")  # 1: text, 2: schema, 3: list
    assert 1 not in f.raw and 3 not in f.raw
    assert [(e.name, e.physical, e.repetition) for e in f.elements[1:]] == [("n", "INT64", None)]
    assert FT.fitted({1: "no", 3: 7, 5: [{1: b"k", 2: 3}], 99: "kept"}, FT._FILE) == {3: 7, 5: [{1: b"k"}], 99: "kept"}
    assert FT.fitted({2: [1, 2], 4: [{2: True, 3: 5}]}, FT._FILE) == {4: [{3: 5}]}


def test_encryption_and_signatures_are_reported():
    f = FT.Footer("p", 100, {1: 2, 3: 0, 8: {1: {}}, 9: b"key"}, [FT.Element("", (), None, None, None, None, None, {}, None, None, None, 0, 0)])
    (row,) = FT._file_rows(f)
    assert row[-2:] == (True, True)


def test_footers_by_executors_and_by_the_driver_are_the_same(spark, nested, monkeypatch):
    def rows(df):
        plain = (json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in df.collect())
        return sorted(x.replace("file:///", "file:/") for x in plain)  # either way to name a file

    reads = (FT.file_metadata, FT.schema_elements, FT.row_groups, FT.column_chunks)
    by_executors = [rows(r(spark, nested)) for r in reads]
    monkeypatch.setattr(FT, "arrow_reads", lambda *_: False)
    assert by_executors == [rows(r(spark, nested)) for r in reads] and all(by_executors)
