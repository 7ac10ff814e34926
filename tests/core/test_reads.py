import datetime as dt
import decimal
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lakescan import cli
from lakescan import errors as E
from lakescan.functions import views as V
from lakescan.operators import columns as C
from lakescan.plans import summaries as S
from lakescan.scan import ParquetFile, lenient, scan, strict_count
from lakescan.sources import footer as FT
from lakescan.sources import row_groups as RG
from lakescan.sources.arrow_files import write_arrow
from lakescan.sources.row_groups import scan_row_groups
from lakescan.streaming.scan import read_stream

from .files import save


def values(df):
    return [r[0] for r in df.collect()]


UUIDS = [bytes(16), bytes.fromhex("550e8400e29b41d4a716446655440000"), bytes.fromhex("6ba7b8109dad11d180b400c04fd430c8")]
SHORT = bytes.fromhex
#: name: (values, Arrow type, stored values as read with physical=True)
LOGICAL = {
    "date": ([0, 19737, 18321, 5679], pa.date32(), [0, 19737, 18321, 5679]),
    "ts_ms": ([0, 1705321845000, 1584692130000, 489869100000], pa.timestamp("ms"), [0, 1705321845000, 1584692130000, 489869100000]),
    "ts_us": ([0, 1705321845123456, 1584692130987654], pa.timestamp("us"), [0, 1705321845123456, 1584692130987654]),
    "ts_us_utc": ([0, 1705321845123456], pa.timestamp("us", "UTC"), [0, 1705321845123456]),
    "ts_ns": ([0, 1705321845123456789], pa.timestamp("ns"), [0, 1705321845123456789]),
    "t_ms": ([0, 45045000, 67500000], pa.time32("ms"), [0, 45045000, 67500000]),
    "t_us": ([0, 45045123456], pa.time64("us"), [0, 45045123456]),
    "t_ns": ([0, 45045123456789], pa.time64("ns"), [0, 45045123456789]),
    "i8": ([-128, -10, 0, 127], pa.int8(), [-128, -10, 0, 127]),
    "u8": ([0, 100, 255], pa.uint8(), [0, 100, 255]),
    "i16": ([-32768, 0, 32767], pa.int16(), [-32768, 0, 32767]),
    "u16": ([0, 32768, 65535], pa.uint16(), [0, 32768, 65535]),
    "u32": ([0, 2147483648, 4294967295], pa.uint32(), [0, -2147483648, -1]),
    "u64": ([0, 9223372036854775808, 18446744073709551615], pa.uint64(), [0, -9223372036854775808, -1]),
    "bool": ([True, False, True], pa.bool_(), [True, False, True]),
    "f32": ([1.5, -2.25], pa.float32(), [1.5, -2.25]),
    "text": (["", "hello", "Café \U0001f642"], pa.string(), [b"", b"hello", "Café \U0001f642".encode()]),
    "flba": ([b"abcde", b"\0\1\2\3\4"], pa.binary(5), [b"abcde", b"\0\1\2\3\4"]),
}


@pytest.mark.parametrize("name", LOGICAL)
@pytest.mark.parametrize("nulls", [False, True])
def test_stored_values(spark, tmp_path, name, nulls):
    given, kind, stored = LOGICAL[name]
    given, stored = (given + [None], stored + [None]) if nulls else (given, stored)
    array = pa.array(given, kind) if not pa.types.is_temporal(kind) else pa.array(given, pa.int32() if kind.bit_width == 32 else pa.int64()).cast(kind)
    pq.write_table(pa.table({"x": array, "other": array}), tmp_path / "x.parquet", version="2.6")
    f = ParquetFile(spark, str(tmp_path / "x.parquet"))
    assert values(f.dynamic(0)) == stored
    assert values(f.column("x", nullable=False)) == [v for v in values(f.column("x")) if v is not None]
    assert len(values(f.column("x"))) == len(given)


@pytest.mark.parametrize(("name", "view"), [("i8", V.int8), ("u8", V.uint8), ("i16", V.int16), ("u16", V.uint16), ("u32", V.uint32), ("u64", V.uint64)])
def test_integer_views_of_stored_values(spark, tmp_path, name, view):
    given, kind, _ = LOGICAL[name]
    path = save(tmp_path / "x.parquet", {"x": (given + [None], kind)})
    assert [None if v is None else int(v) for v in values(scan(spark, path, physical=True).select(view("x")))] == given + [None]


def test_narrow_views_are_checked(spark):
    df = spark.createDataFrame([(300,)], "x int")
    for view in (V.int8, V.uint8):
        with pytest.raises(PySparkException):
            df.select(view("x")).collect()


def test_temporal_views(spark, tmp_path):
    t = {"d": ([19737, None], pa.date32()), "a": ([1705321845123, None], pa.timestamp("ms")), "b": ([1705321845123456, None], pa.timestamp("us"))}
    path = save(tmp_path / "x.parquet", t)
    got = scan(spark, path).select(V.date_days("d"), V.timestamp_millis("a"), V.timestamp_micros("b")).collect()
    assert [tuple(r) for r in got] == [(19737, 1705321845123, 1705321845123456), (None, None, None)]
    assert scan(spark, path).first().d == dt.date(2024, 1, 15)
    nanos = spark.createDataFrame([(-1,), (1705321845123456789,)], "x long").select(V.nanos_as_timestamp("x"))
    assert values(nanos) == [dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(2024, 1, 15, 12, 30, 45, 123456)]


def test_half_floats(spark, tmp_path):
    given = [None, 1.0, -2.0, float("nan"), 0.0, -0.0, 2.0, 3.140625, 6e-8, 65504.0, float("inf"), -float("inf")]
    path = save(tmp_path / "x.parquet", {"x": ([None if v is None else np.float16(v) for v in given], pa.float16())})
    want = [None if v is None else float(np.float16(v)) for v in given]
    for got in (values(scan(spark, path).select(V.float16("x"))), values(scan_row_groups(spark, path))):
        assert [repr(v) for v in got] == [repr(v) for v in want]


def test_uuids(spark, tmp_path):
    path = save(tmp_path / "x.parquet", {"x": (UUIDS + [None], pa.uuid())})
    assert values(scan(spark, path)) == UUIDS + [None]
    assert values(scan(spark, path).select(V.uuid_text("x")))[1:] == ["550e8400-e29b-41d4-a716-446655440000", "6ba7b810-9dad-11d1-80b4-00c04fd430c8", None]


@pytest.mark.parametrize(("precision", "as_integer"), [(9, True), (18, True), (9, False), (15, False), (38, False)])
def test_decimals(spark, tmp_path, precision, as_integer):
    given = [decimal.Decimal(f"{i}.00") for i in range(-3, 25)] + [None]
    path = save(tmp_path / "x.parquet", {"x": (given, pa.decimal128(precision, 2))}, store_decimal_as_integer=as_integer)
    f = ParquetFile(spark, path)
    assert values(f.column("x")) == given
    if as_integer:
        assert values(f.dynamic(0)) == [None if v is None else int(v * 100) for v in given]
        raw = scan(spark, path, physical=True).select(V.decimal_of_int("x", precision, 2))
    else:
        raw = scan(spark, path, physical=True).select(V.decimal_of_bytes("x", precision, 2))
    assert values(raw) == given


def test_decimals_of_bytes(spark):
    given = [b"", b"\x01", b"\xff", b"\x80", b"\x00\xff", b"\x7f" + b"\xff" * 7, b"\x80" + b"\0" * 7, b"\x80" + b"\0" * 8, b"\xff" * 16, None]
    got = values(spark.createDataFrame([(g,) for g in given], "x binary").select(V.decimal_of_bytes("x", 38, 2)))
    assert got == [None if g is None else decimal.Decimal(int.from_bytes(g, "big", signed=True)).scaleb(-2) for g in given]


def test_int96(spark, tmp_path):
    given = [0, 1705321845123456789, -1, None]
    pq.write_table(pa.table({"x": pa.array(given, pa.timestamp("ns"))}), tmp_path / "x.parquet", use_deprecated_int96_timestamps=True)
    day = 86_400_000_000_000
    want = [None if v is None else (v // day + 2440588) * 2**64 + v % day for v in given]
    path = str(tmp_path / "x.parquet")
    assert [None if v is None else int(v) for v in values(scan_row_groups(spark, path, int96=["x"]))] == want
    cut = [None if v is None else (v // day + 2440588) * 2**64 + v % day // 1000 * 1000 for v in given]
    assert [None if v is None else int(v) for v in values(ParquetFile(spark, path).dynamic(0))] == cut


def test_simple_reads_and_errors(spark, tmp_path):
    path = save(tmp_path / "x.parquet", {"foo": ([1, 2, 3, 4, 5], pa.int64()), "bar": ([6, 7, None, 9, 10], pa.int64()), "ham": (list("abcde"), pa.string())})
    f = ParquetFile(spark, path)
    assert values(f.column("foo", "INT64")) == [1, 2, 3, 4, 5]
    assert values(f.column("bar")) == [6, 7, None, 9, 10] and values(f.column("bar", nullable=False)) == [6, 7, 9, 10]
    for error, read in [
        (E.UnexpectedType, lambda: f.column("foo", "INT32")), (E.UnknownField, lambda: f.column("nope")),
        (E.NotAListColumn, lambda: f.list_column("foo")), (E.NotAMapColumn, lambda: f.map_column("foo")),
    ]:
        with pytest.raises(error):
            read()


def test_nested(spark, tmp_path):
    path = tmp_path / "x.parquet"
    pq.write_table(
        pa.table(
            {
                "l": pa.array([[1, 2, None], None, [], [4]], pa.list_(pa.int64())),
                "m": pa.array([[("a", 1), ("b", None)], None, [], [("a", 2)]], pa.map_(pa.string(), pa.int32())),
                "s": pa.array([{"x": 1, "y": {"z": "q"}}, None, {"x": None, "y": None}, {"x": 4, "y": {"z": None}}]),
                "ll": pa.array([[[["a"]], []], None, [[None]], []], pa.list_(pa.list_(pa.list_(pa.string())))),
                "mm": pa.array([[("k", [(1, True)])], None, [], []], pa.map_(pa.string(), pa.map_(pa.int32(), pa.bool_()))),
                "h": pa.array([[np.float16(1.5)], None, [], [None]], pa.list_(pa.float16())),
            }
        ),
        path,
    )
    f = ParquetFile(spark, str(path))
    assert values(f.list_column("l")) == [[1, 2, None], None, [], [4]]
    assert values(f.list_column("l", null_as_empty=True)) == [[1, 2, None], [], [], [4]]
    assert values(f.dynamic(0)) == [1, 2, None, None, None, 4]
    assert [None if v is None else [tuple(e) for e in v] for v in values(f.map_column("m"))] == [[("a", 1), ("b", None)], None, [], [("a", 2)]]
    assert values(f.column("s.y.z")) == ["q", None, None, None]
    assert [tuple(v) for v in values(f.struct_column("t", ["s.x", "s.y.z"]))] == [(1, "q"), (None, None), (None, None), (4, None)]
    assert values(f.list_column("ll")) == [[[["a"]], []], None, [[None]], []]
    assert values(f.map_column("mm"))[0][0].value == {1: True}
    assert values(f.read().select(F.transform("h", V.float16))) == [[1.5], None, [], [None]]
    got = [tuple(r) for r in C.levels(f.read(), "l").collect()]
    assert got == [(1, 3, 0), (2, 3, 1), (None, 2, 1), (None, 0, 0), (None, 1, 0), (4, 3, 0)]
    assert [tuple(r) for r in f.levels("s.x").collect()] == [(1, 2, 0), (None, 0, 0), (None, 1, 0), (4, 2, 0)]  # the struct is a level too
    assert [tuple(r) for r in f.levels("ll").collect()] == [("a", 7, 0), (None, 3, 1), (None, 0, 0), (None, 4, 0), (None, 1, 0)]
    assert [tuple(r) for r in f.levels("mm.value.value").collect()] == [(True, 5, 0), (None, 0, 0), (None, 1, 0), (None, 1, 0)]
    assert [tuple(r) for r in f.levels("mm.key").collect()] == [("k", 2, 0), (None, 0, 0), (None, 1, 0), (None, 1, 0)]
    for path in ("l", "s.x", "s.y.z", "ll", "mm.key", "mm.value.value", "m.value"):
        leaf = next(e for e in f.footer.leaves if e.path[0] == path.split(".")[0] and (path == e.path[0] or e.path[-1] == path.split(".")[-1]))
        assert f.levels(path).agg(F.max("rep_level")).first()[0] <= leaf.max_rep and f.levels(path).agg(F.max("def_level")).first()[0] <= leaf.max_def
    with pytest.raises(E.UnknownField):
        f.levels("l.x")


def test_legacy_lists(spark, tmp_path):
    path = str(tmp_path / "x")
    rows = spark.createDataFrame([([1, 2], {"k": 1}), ([], {}), (None, None)], "l array<int>, m map<string,int>").coalesce(1)
    spark.conf.set("spark.sql.parquet.writeLegacyFormat", "true")
    try:
        rows.write.parquet(path)
    finally:
        spark.conf.unset("spark.sql.parquet.writeLegacyFormat")
    assert [tuple(r) for r in scan(spark, path).collect()] == [([1, 2], {"k": 1}), ([], {}), (None, None)]


@pytest.mark.parametrize("codec", ["none", "snappy", "gzip", "zstd", "lz4", "brotli"])
def test_codecs(spark, tmp_path, codec):
    given = [f"value {i % 50}" for i in range(5000)]
    path = save(tmp_path / "x.parquet", {"x": (given, pa.string())}, compression=codec)
    f = ParquetFile(spark, path)
    if codec == "brotli":
        with pytest.raises(E.UnsupportedCodec):
            f.read()
        assert values(scan_row_groups(spark, path)) == given
    else:
        assert values(f.column("x")) == given


ENCODINGS = [("PLAIN", pa.int64()), ("DELTA_BINARY_PACKED", pa.int64()), ("DELTA_BINARY_PACKED", pa.int32()), ("DELTA_LENGTH_BYTE_ARRAY", pa.string()), ("DELTA_BYTE_ARRAY", pa.string()), ("RLE", pa.bool_()), ("BYTE_STREAM_SPLIT", pa.float64()), ("BYTE_STREAM_SPLIT", pa.float32())]


@pytest.mark.parametrize(("encoding", "kind"), ENCODINGS)
@pytest.mark.parametrize("page", ["1.0", "2.0"])
def test_encodings(spark, tmp_path, encoding, kind, page):
    raw = [None if i % 7 == 0 else i * i % 97 for i in range(3000)]
    given = [None if v is None else f"s{v}" if kind == pa.string() else v % 2 == 0 if kind == pa.bool_() else v for v in raw]
    path = save(tmp_path / "x.parquet", {"x": (given, kind)}, use_dictionary=False, column_encoding={"x": encoding}, data_page_version=page, data_page_size=1000)
    f = ParquetFile(spark, path)
    assert encoding in f.encodings
    assert values(f.column("x")) == given


def test_dictionary_pages_and_many_pages(spark, tmp_path):
    given = [i % 3 == 0 for i in range(40000)]
    path = save(tmp_path / "x.parquet", {"x": (given, pa.bool_()), "d": ([i % 11 for i in range(40000)], pa.int32())}, data_page_size=100, row_group_size=7000)
    f = ParquetFile(spark, path)
    assert "RLE_DICTIONARY" in f.encodings
    assert values(f.column("d").limit(12)) == [i % 11 for i in range(12)]
    assert f.read().agg(F.count_if("x")).first()[0] == sum(given)


def test_row_groups(spark, tmp_path):
    path = save(tmp_path / "x.parquet", {"x": (list(range(1000)), pa.int64())}, row_group_size=300)
    f = ParquetFile(spark, path)
    for i, want in enumerate([range(300), range(300, 600), range(600, 900), range(900, 1000)]):
        assert values(f.row_group(i)) == list(want) == values(scan_row_groups(spark, path, row_group=i))
        assert values(f.row_group(i, physical=True)) == list(want)
    assert scan_row_groups(spark, path).rdd.getNumPartitions() == 4


def test_checksums(spark, tmp_path):
    path = save(tmp_path / "x.parquet", {"x": (list(range(5000)), pa.int64())}, write_page_checksum=True, use_dictionary=False, compression="none")
    assert strict_count(spark, path) == 5000
    data = bytearray((tmp_path / "x.parquet").read_bytes())
    data[20000] ^= 1
    bad = tmp_path / "bad.parquet"
    bad.write_bytes(data)
    assert scan(spark, str(bad)).count() == 5000
    with pytest.raises(Exception, match="(?i)crc|checksum"):
        strict_count(spark, str(bad))


def test_corrupt_files_can_be_skipped(spark, tmp_path):
    save(tmp_path / "a.parquet", {"x": ([1, 2], pa.int64())})
    (tmp_path / "b.parquet").write_bytes(b"PAR1 no parquet at all PAR1")
    assert values(lenient(spark, str(tmp_path), "x long")) == [1, 2]


def test_many_files(spark, tmp_path):
    paths = [save(tmp_path / f"{i}.parquet", {"x": ([i], pa.int32())}) for i in range(3)]
    assert sorted(values(scan(spark, paths))) == [0, 1, 2] == sorted(values(scan(spark, str(tmp_path))))


def test_empty_files(spark, tmp_path):
    path = save(tmp_path / "x.parquet", {"x": ([], pa.int64())})
    f = ParquetFile(spark, path)
    assert values(f.column("x")) == values(f.dynamic(0)) == []


def test_summaries(spark, small):
    df = scan(spark, f"{small}/lineitem.parquet")
    t = S.column_totals(df, ["l_quantity"]).first()
    assert t.n_rows == df.count()
    assert S.full_scan(df.select("l_tax")).first().n_l_tax == t.n_rows
    plan = S.footer_summary(spark, f"{small}/orders.parquet", "o_orderkey")
    assert "PushedAggregation: [COUNT(*)" in plan._jdf.queryExecution().executedPlan().toString()
    p = S.preview(df, "l_orderkey").orderBy("row_index").collect()
    assert len(p) == 10 and p[0].more == t.n_rows - 10
    first = S.first_values(df, ["l_orderkey"]).first()
    assert first.l_orderkey == p[0].l_orderkey


def test_pruning_reaches_the_scan(spark, small):
    plan = C.required(scan(spark, f"{small}/orders.parquet"), "o_totalprice")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_totalprice:double>" in plan and "PushedFilters: [IsNotNull(o_totalprice)]" in plan
    assert "Exchange" not in plan


def test_stream(spark, tmp_path):
    save(tmp_path / "a.parquet", {"x": ([1, 2], pa.uint32()), "h": ([1, None], pa.float16())})
    q = read_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("seen").start()
    try:
        q.processAllAvailable()
        save(tmp_path / "b.parquet", {"x": ([3], pa.uint32()), "h": ([2], pa.float16())})
        q.processAllAvailable()
        assert sorted(values(spark.table("seen").select("x"))) == [1, 2, 3]
    finally:
        q.stop()


def test_dump(spark, tmp_path):
    pq.write_table(pa.table({"a": pa.array([None] + list(range(14)), pa.int64()), "l": pa.array([["x", "y"]] * 15)}), tmp_path / "x.parquet", row_group_size=12)
    lines = list(cli.dump(spark, str(tmp_path / "x.parquet")))
    assert lines[1:5] == ["Version: 2", "Rows: 15", "Row groups: 2", "Columns: 4"] and lines[5].startswith("Total byte size: ")
    text = "\n".join(lines)
    assert "  a (INT64)\n    null\n    0\n" in text and "    ... 2 more\n  l.list.element (BYTE_ARRAY)\n    \"x\"\n" in text and "    ... 14 more" in text
    assert "Row group 1: 3 rows" in text


@pytest.mark.parametrize("page", ["1.0", "2.0"])
def test_null_pages(spark, tmp_path, page):
    given = [None] * 1000 + list(range(1000))
    path = save(tmp_path / "x.parquet", {"x": (given, pa.int32())}, data_page_size=64, data_page_version=page)
    assert values(ParquetFile(spark, path).column("x")) == given


def test_nan_is_a_value(spark, tmp_path):
    path = save(tmp_path / "x.parquet", {"x": ([1.0, float("nan"), None], pa.float64())})
    got = values(ParquetFile(spark, path).column("x", nullable=False))
    assert got[0] == 1.0 and np.isnan(got[1]) and len(got) == 2


def test_concatenated_gzip_and_paths(spark, tmp_path):
    os.makedirs(tmp_path / "with space")
    path = save(tmp_path / "with space" / "x.parquet", {"a.b": ([1], pa.int32()), "c d": (["x"], pa.string())}, compression="gzip")
    f = ParquetFile(spark, path)
    assert values(f.dynamic(0)) == [1] and values(f.dynamic(1)) == [b"x"]


def test_schemas_of_all_files_are_merged(spark, tmp_path):
    a = save(tmp_path / "a.parquet", {"x": ([1], pa.int32()), "h": ([np.float16(1.5)], pa.float16())})
    b = save(tmp_path / "b.parquet", {"x": ([2], pa.int32()), "y": (["q"], pa.string())})
    assert sorted(tuple(r) for r in scan(spark, str(tmp_path)).select("x", V.float16("h"), "y").collect()) == [(1, 1.5, None), (2, None, "q")]
    assert scan(spark, [a, b], physical=True).columns == ["x", "h", "y"]
    save(tmp_path / "c.parquet", {"x": (["3"], pa.string())})
    with pytest.raises(E.UnexpectedType):
        scan(spark, str(tmp_path))


def test_structs_are_merged_field_by_field(spark, tmp_path):
    pq.write_table(pa.table({"s": pa.array([{"a": 1}])}), tmp_path / "a.parquet")
    pq.write_table(pa.table({"s": pa.array([{"a": 2, "b": "x"}])}), tmp_path / "b.parquet")
    assert sorted(tuple(r.s) for r in scan(spark, str(tmp_path)).collect()) == [(1, None), (2, "x")]


def test_scan_picks_the_reader_for_all_files(spark, tmp_path):
    save(tmp_path / "a.parquet", {"x": ([1.5, 2.5], pa.float64())})
    save(tmp_path / "b.parquet", {"x": ([3.5], pa.float64())}, use_dictionary=False, column_encoding={"x": "BYTE_STREAM_SPLIT"})
    assert sorted(values(scan(spark, str(tmp_path)))) == [1.5, 2.5, 3.5]
    save(tmp_path / "c.parquet", {"x": ([4.5], pa.float64())}, compression="brotli")
    with pytest.raises(E.UnsupportedCodec):
        scan(spark, str(tmp_path))


def test_lzo_is_refused(spark, tmp_path):
    f = ParquetFile(spark, save(tmp_path / "x.parquet", {"x": ([1], pa.int64())}))
    f.footer.row_groups[0][1][0][3][4] = 3
    with pytest.raises(E.UnsupportedCodec):
        f.read()


def test_many_files_are_a_partition_each(spark, tmp_path, monkeypatch):
    for i in range(3):
        save(tmp_path / f"{i}.parquet", {"x": ([3 * i, 3 * i + 1, 3 * i + 2], pa.int64())}, row_group_size=1)
    reader = RG.Reader([str(tmp_path / f"{i}.parquet") for i in range(3)], ["x"], None, set())
    assert len(reader.partitions()) == 9
    monkeypatch.setattr(RG, "MOST_OPENED", 2)
    assert len(reader.partitions()) == 3
    assert sorted(v for p in reader.partitions() for b in reader.read(p) for v in b.column(0).to_pylist()) == list(range(9))
    assert sorted(values(scan_row_groups(spark, str(tmp_path), row_group=1))) == [1, 4, 7]


def test_row_groups_are_cut_over_batches(spark, tmp_path):
    n = write_arrow(spark.range(0, 1050, 1, 1), f"{tmp_path}/x", row_group_size=100)
    sizes = [g.num_rows for g in FT.row_groups(spark, f"{tmp_path}/x").orderBy("row_group").collect()]
    assert n == 1050 and sizes == [100] * 10 + [50]
    assert write_arrow(spark.range(0), f"{tmp_path}/none") == 0


def test_broken_pages_fail_and_do_not_give_rows(spark, tmp_path):
    """Malformed dictionaries, lengths and deltas: bytes behind the header overwritten, the footer intact."""
    given = {"x": ([f"v{i % 9}" for i in range(2000)], pa.string()), "d": (list(range(2000)), pa.int64())}
    path = save(tmp_path / "x.parquet", given, compression="none", use_dictionary=["x"], column_encoding={"d": "DELTA_BINARY_PACKED"}, write_page_checksum=True)
    data = bytearray((tmp_path / "x.parquet").read_bytes())
    for r in FT.column_chunks(spark, path).collect():
        bad, at = bytearray(data), r.dictionary_page_offset or r.data_page_offset
        bad[at + 30 : at + 60] = b"\xff" * 30
        (tmp_path / "bad.parquet").write_bytes(bad)
        with pytest.raises(Exception, match="(?i)FAILED_READ_FILE|crc|checksum|corrupt"):
            strict_count(spark, str(tmp_path / "bad.parquet"))


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    from unittest.mock import MagicMock

    from lakescan.session import shared_folder

    spark = MagicMock()
    spark.conf.get.return_value = None
    spark.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    spark.sparkContext.master = "spark://host:7077"
    with pytest.raises(RuntimeError):
        shared_folder(spark)
    spark.conf.get.return_value = "hdfs://x/y/"
    assert shared_folder(spark) == "hdfs://x/y"
