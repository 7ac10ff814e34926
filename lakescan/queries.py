"""One query per operator over the driver's tables, and the same in DuckDB SQL.

Types, codecs and encodings that the tables lack are made from them first: written to the shared folder and read back
through the engine, while the SQL computes from the table itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakescan import cli
from lakescan.functions import views as V
from lakescan.operators import columns as C
from lakescan.plans import summaries as S
from lakescan.scan import ParquetFile, scan, strict_count
from lakescan.session import shared_folder
from lakescan.sources import footer as FT
from lakescan.sources.arrow_files import write_arrow
from lakescan.sources.row_groups import scan_row_groups
from lakescan.sources.thrift_idl import idl_fields
from lakescan.sources.thrift_schema import idl_schemas

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return scan(spark, f"{sf}/{name}.parquet")


def new_folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share."""
    return f"{shared_folder(spark)}/lakescan-{uuid.uuid4().hex}"


# Aggregates and previews


@query("SELECT count(*) AS n_rows, round(sum(l_extendedprice), 2) AS sum_l_extendedprice, round(sum(l_tax), 2) AS sum_l_tax, round(sum(l_quantity), 2) AS sum_l_quantity FROM lineitem")
def column_totals(spark, sf):
    return S.column_totals(table(spark, sf, "lineitem"), ["l_extendedprice", "l_tax", "l_quantity"])


@query("SELECT count(*) AS n_rows, min(o_orderkey) AS least, max(o_orderkey) AS largest FROM orders")
def footer_count(spark, sf):
    return S.footer_summary(spark, f"{sf}/orders.parquet", "o_orderkey")


@query("SELECT l_orderkey, l_extendedprice, l_returnflag FROM lineitem LIMIT 1")
def first_value(spark, sf):
    return S.first_values(table(spark, sf, "lineitem"), ["l_orderkey", "l_extendedprice", "l_returnflag"])


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 10")
def preview_10(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name").orderBy("p_partkey").limit(10)


@query("SELECT count(*) AS n_rows, " + ", ".join(f"count({c}) AS n_{c}" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")) + " FROM events")
def full_scan(spark, sf):
    return S.full_scan(table(spark, sf, "events"))


# Projections


@query("SELECT o_totalprice FROM orders WHERE o_totalprice IS NOT NULL")
def required_column(spark, sf):
    return C.required(table(spark, sf, "orders"), "o_totalprice")


@query("SELECT o_custkey FROM orders")
def nullable_column(spark, sf):
    return C.nullable(table(spark, sf, "orders"), "o_custkey")


@query("SELECT c_acctbal FROM customer")
def dynamic_column(spark, sf):
    return scan(spark, f"{sf}/customer.parquet", physical=True).select("c_acctbal")  # ParquetFile.dynamic is of one file


@query("SELECT vec_id, len(embedding) AS n, embedding[1] AS first, embedding[len(embedding)] AS last FROM embeddings")
def list_column(spark, sf):
    rows = C.list_column(table(spark, sf, "embeddings"), "embedding", keep=["vec_id"], null_as_empty=True)
    return rows.select("vec_id", F.size("embedding").cast("long").alias("n"), F.get("embedding", F.lit(0)).alias("first"), F.get("embedding", F.size("embedding") - 1).alias("last"))


@query("SELECT vec_id, unnest(embedding) AS embedding FROM embeddings")
def list_flatten(spark, sf):
    return C.flattened(table(spark, sf, "embeddings"), "embedding", keep=["vec_id"])


@query("SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS position, unnest(embedding) AS embedding FROM embeddings")
def list_positions(spark, sf):
    rows = C.flattened(table(spark, sf, "embeddings"), "embedding", keep=["vec_id"], positions=True)
    return rows.withColumn("position", F.col("position").cast("long"))


@query("SELECT embedding AS value, 3 AS def_level, CASE WHEN i > 1 THEN 1 ELSE 0 END AS rep_level FROM (SELECT unnest(embedding) AS embedding, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def column_levels(spark, sf):
    return C.levels(table(spark, sf, "embeddings"), "embedding")


@query(
    "SELECT o_orderkey AS value, 5 AS def_level, 0 AS rep_level FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_custkey, 5, 2 FROM orders WHERE o_orderkey % 3 = 0 "
    "UNION ALL SELECT NULL, unnest([3, 2, 4]), 1 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT NULL, o_orderkey % 3 - 1, 0 FROM orders WHERE o_orderkey % 3 > 0"
)
def nested_list_levels(spark, sf):
    """Lists of lists: full ones, empty ones, null ones and null entries."""
    path = new_folder(spark)
    lists = "array(array(o_orderkey, o_custkey), cast(array() AS array<bigint>), null, array(cast(null AS bigint)))"
    table(spark, sf, "orders").selectExpr(f"CASE o_orderkey % 3 WHEN 0 THEN {lists} WHEN 2 THEN cast(array() AS array<array<bigint>>) END AS ll").write.parquet(path)
    return C.levels(scan(spark, path), "ll")


@query(
    "SELECT o_totalprice AS value, 5 AS def_level, 0 AS rep_level FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT NULL, 4, 2 FROM orders WHERE o_orderkey % 3 = 0 "
    "UNION ALL SELECT NULL, 3, 1 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT NULL, o_orderkey % 3 - 1, 0 FROM orders WHERE o_orderkey % 3 > 0"
)
def nested_map_levels(spark, sf):
    """Maps of maps; keys are required, so they add no level."""
    path = new_folder(spark)
    maps = "map('a', map(o_orderkey, o_totalprice, o_orderkey + 1, null), 'b', cast(map() AS map<bigint, double>))"
    table(spark, sf, "orders").selectExpr(f"CASE o_orderkey % 3 WHEN 0 THEN {maps} WHEN 2 THEN cast(map() AS map<string, map<bigint, double>>) END AS mm").write.parquet(path)
    return C.levels(scan(spark, path), "mm.value.value")


@query("SELECT CASE WHEN n_regionkey > 0 THEN n_name END AS value, CASE WHEN n_regionkey > 0 THEN 3 ELSE 1 END AS def_level, 0 AS rep_level FROM nation")
def struct_leaf_levels(spark, sf):
    """A leaf below two structs, of which the inner one may be null."""
    path = new_folder(spark)
    table(spark, sf, "nation").selectExpr("struct(CASE WHEN n_regionkey > 0 THEN struct(n_name AS name) END AS inner) AS s").write.parquet(path)
    return C.levels(scan(spark, path), "s.inner.name")


def _nested(spark, sf) -> DataFrame:
    """nation as a map, a list of structs and nested structs, written and read back."""
    path = new_folder(spark)
    n = table(spark, sf, "nation")
    n.select(
        F.create_map("n_nationkey", "n_name").alias("m"),
        F.struct("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("inner")).alias("s"),
    ).write.parquet(path)
    return scan(spark, path)


@query("SELECT n_nationkey AS key, n_name AS value FROM nation")
def map_entries(spark, sf):
    return C.map_column(_nested(spark, sf), "m").select(F.explode("m").alias("e")).select("e.key", "e.value")


@query("SELECT n_nationkey, n_name AS name FROM nation")
def struct_column(spark, sf):
    return C.struct_column(_nested(spark, sf), "x", ["s.n_nationkey", "s.inner.name"]).select("x.*")


@query("SELECT n_regionkey AS region FROM nation")
def struct_leaf(spark, sf):
    return C.leaf(_nested(spark, sf), "s.inner.region")


@query("SELECT event_id, props FROM events")
def json_string(spark, sf):
    return table(spark, sf, "events").select("event_id", V.text("props").alias("props"))


# Logical views


@query("SELECT event_id, epoch_us(ts) AS us FROM events")
def ts_micros(spark, sf):
    return table(spark, sf, "events").select("event_id", V.timestamp_micros("ts").alias("us"))


@query("SELECT event_id, epoch_us(ts) AS us FROM events", name="ts_micros_stored")
def ts_micros_stored(spark, sf):
    """The stored integers, read without any conversion."""
    rows = scan(spark, f"{sf}/events.parquet", physical=True)
    return rows.select("event_id", F.col("ts").alias("us"))


@query("SELECT event_id, (epoch_us(ts) - (epoch_us(ts) % 1000 + 1000) % 1000) // 1000 AS ms FROM events")
def ts_millis(spark, sf):
    return table(spark, sf, "events").select("event_id", V.timestamp_millis("ts").alias("ms"))


@query("SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS days FROM orders")
def date_days(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", V.date_days(F.col("o_orderdate").cast("date")).cast("long").alias("days"))


def _as(spark, sf, name: str, columns: dict[str, str], make, **options) -> str:
    """Columns of a table (by new name) made into an Arrow table by ``make`` and written by the executors; the path."""
    path = new_folder(spark)
    write_arrow(table(spark, sf, name).selectExpr(*(f"{e} AS {c}" for c, e in columns.items())), path, make, **options)
    return path


def _cast(**kinds):
    """Casts columns of an Arrow table, by way of integers where it has to."""

    def make(t: pa.Table) -> pa.Table:
        for name, kind in kinds.items():
            t = t.set_column(t.schema.get_field_index(name), name, t.column(name).cast(kind))
        return t

    return make


_US_OF_DAY = "pmod(unix_micros(cast(ts AS timestamp)), 86400000000)"
_US_SQL = "((epoch_us(ts) % 86400000000) + 86400000000) % 86400000000"


@query("SELECT event_id, epoch_us(ts) * 1000 AS ns FROM events")
def ts_nanos(spark, sf):
    path = _as(spark, sf, "events", {"event_id": "event_id", "ts": "unix_micros(cast(ts AS timestamp)) * 1000"}, _cast(ts=pa.timestamp("ns")), version="2.6")
    return scan(spark, path).select("event_id", V.timestamp_nanos("ts").alias("ns"))


@query(f"SELECT event_id, ({_US_SQL} // 1000)::INT AS ms FROM events")
def time_millis(spark, sf):
    path = _as(spark, sf, "events", {"event_id": "event_id", "t": f"cast({_US_OF_DAY} div 1000 AS int)"}, _cast(t=pa.time32("ms")))
    return scan(spark, path).select("event_id", V.time_millis("t").alias("ms"))


@query(f"SELECT event_id, {_US_SQL} AS us FROM events")
def time_micros(spark, sf):
    path = _as(spark, sf, "events", {"event_id": "event_id", "t": _US_OF_DAY}, _cast(t=pa.time64("us")))
    return scan(spark, path).select("event_id", V.time_micros("t").alias("us"))


@query(f"SELECT event_id, {_US_SQL} * 1000 AS ns FROM events")
def time_nanos(spark, sf):
    path = _as(spark, sf, "events", {"event_id": "event_id", "t": f"{_US_OF_DAY} * 1000"}, _cast(t=pa.time64("ns")))
    return scan(spark, path).select("event_id", V.time_nanos("t").alias("ns"))


def _narrow(name: str, kind: pa.DataType, value: str, sql: str, view) -> None:
    @query(f"SELECT l_orderkey, l_linenumber, {sql} AS v FROM lineitem", name=name)
    def run(spark, sf):
        path = _as(spark, sf, "lineitem", {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "v": value}, _cast(v=kind))
        return scan(spark, path).select("l_orderkey", "l_linenumber", view("v").cast("long").alias("v"))


_narrow("int8_view", pa.int8(), "cast(pmod(l_partkey, 256) - 128 AS int)", "l_partkey % 256 - 128", V.int8)
_narrow("uint8_view", pa.uint8(), "cast(pmod(l_partkey, 256) AS int)", "l_partkey % 256", V.uint8)
_narrow("int16_view", pa.int16(), "cast(pmod(l_partkey * 331, 65536) - 32768 AS int)", "(l_partkey * 331) % 65536 - 32768", V.int16)
_narrow("uint16_view", pa.uint16(), "cast(pmod(l_partkey * 331, 65536) AS int)", "(l_partkey * 331) % 65536", V.uint16)
_narrow("uint32_view", pa.uint32(), "pmod(l_partkey * 2147483659, 4294967296)", "(l_partkey * 2147483659) % 4294967296", lambda c: V.uint32(V.uint32_as_int(c)))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN v > 2147483647 THEN v - 4294967296 ELSE v END AS v FROM (SELECT *, (l_partkey * 2147483659) % 4294967296 AS v FROM lineitem)")
def uint32_stored(spark, sf):
    """The signed integers that unsigned ones are stored as, and back again in the view's test."""
    path = _as(spark, sf, "lineitem", {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "v": "pmod(l_partkey * 2147483659, 4294967296)"}, _cast(v=pa.uint32()))
    return scan(spark, path, physical=True).select("l_orderkey", "l_linenumber", F.col("v").cast("long").alias("v"))


@query("SELECT o_orderkey, (18446744073709551615::HUGEINT - o_orderkey)::VARCHAR AS v, -1 - o_orderkey AS stored FROM orders")
def uint64_view(spark, sf):
    def make(t: pa.Table) -> pa.Table:
        return t.set_column(1, "v", t.column("v").combine_chunks().view(pa.uint64()))

    path = _as(spark, sf, "orders", {"o_orderkey": "o_orderkey", "v": "-1 - o_orderkey"}, make)
    rows = scan(spark, path)
    return rows.select("o_orderkey", V.uint64(V.uint64_as_long("v")).cast("string").alias("v"), V.uint64_as_long("v").alias("stored"))


@query("SELECT p_partkey, ((p_size - 25) / 4.0)::DOUBLE AS v FROM part")
def float16_view(spark, sf):
    path = _as(spark, sf, "part", {"p_partkey": "p_partkey", "v": "cast((p_size - 25) / 4.0 AS float)"}, _cast(v=pa.float16()))
    return scan(spark, path).select("p_partkey", V.float16("v").cast("double").alias("v"))


@query("SELECT s_suppkey, lower(md5(s_name)) AS id FROM supplier")
def uuid_bytes(spark, sf):
    path = _as(spark, sf, "supplier", {"s_suppkey": "s_suppkey", "id": "unhex(md5(s_name))"}, _cast(id=pa.binary(16)))
    return scan(spark, path).select("s_suppkey", F.regexp_replace(V.uuid_text("id"), "-", "").alias("id"))


def _decimal(name: str, kind: pa.DataType, stored_as: str, **options) -> None:
    sql = "SELECT s_suppkey, s_acctbal::DECIMAL(15,2)::VARCHAR AS v FROM supplier"

    @query(sql, name=name)
    def run(spark, sf):
        path = _as(spark, sf, "supplier", {"s_suppkey": "s_suppkey", "v": f"cast(round(s_acctbal, 2) AS decimal({kind.precision},2))"}, _cast(v=kind), **options)
        assert FT.kinds_of(spark, path)[0].find("v").physical == stored_as
        return scan(spark, path).select("s_suppkey", F.col("v").cast("decimal(15,2)").cast("string").alias("v"))


_decimal("decimal_int32", pa.decimal128(9, 2), "INT32", store_decimal_as_integer=True)
_decimal("decimal_int64", pa.decimal128(15, 2), "INT64", store_decimal_as_integer=True)
_decimal("decimal_flba", pa.decimal128(30, 2), "FIXED_LEN_BYTE_ARRAY")


@query("SELECT s_suppkey, round(s_acctbal * 100)::BIGINT AS v FROM supplier")
def decimal_unscaled(spark, sf):
    path = _as(spark, sf, "supplier", {"s_suppkey": "s_suppkey", "v": "cast(round(s_acctbal, 2) AS decimal(15,2))"}, None, store_decimal_as_integer=True)
    return scan(spark, path, physical=True).select("s_suppkey", "v")


@query("SELECT event_id, (((epoch_us(ts) - us) // 86400000000 + 2440588)::HUGEINT * 18446744073709551616 + us * 1000)::VARCHAR AS raw FROM (SELECT *, " + _US_SQL + " AS us FROM events)")
def int96_raw(spark, sf):
    path = new_folder(spark)
    rows = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    write_arrow(rows, path, _cast(ts=pa.timestamp("us")), use_deprecated_int96_timestamps=True)
    return scan_row_groups(spark, path, int96=["ts"]).select("event_id", F.col("ts").cast("string").alias("raw"))


# Codecs, encodings and pages: written by Spark with the given settings, read back through the engine

_ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"
_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _round_trip(name: str, **options: str) -> None:
    @query(_ORDERS_SQL, name=name)
    def run(spark, sf):
        path = new_folder(spark)
        table(spark, sf, "orders").select(*_ORDERS).write.options(**options).parquet(path)
        return scan(spark, path)


for _codec in ("none", "snappy", "gzip", "zstd", "lz4", "lz4_raw"):
    _round_trip(f"codec_{_codec}", compression=_codec)
_V2 = {"parquet.writer.version": "PARQUET_2_0"}
_round_trip("enc_dictionary", **{"parquet.enable.dictionary": "true"})
_round_trip("enc_plain", **{"parquet.enable.dictionary": "false"})
_round_trip("enc_delta", **{"parquet.enable.dictionary": "false"}, **_V2)
_round_trip("page_v1", **{"parquet.writer.version": "PARQUET_1_0", "parquet.page.size": "4096"})
_round_trip("page_v2", **{"parquet.page.size": "4096"}, **_V2)


def _encoded(name: str, sql: str, columns: dict[str, str], encodings: dict[str, str], **options) -> None:
    @query(sql, name=name)
    def run(spark, sf):
        path = _as(spark, sf, "orders", columns, None, use_dictionary=False, column_encoding=encodings, **options)
        return scan(spark, path)


_KEYS = {"k": "o_orderkey", "c": "cast(o_custkey AS int)"}
_encoded("enc_delta_binary_packed", "SELECT o_orderkey AS k, o_custkey::INT AS c FROM orders", _KEYS, {"k": "DELTA_BINARY_PACKED", "c": "DELTA_BINARY_PACKED"}, data_page_version="2.0")
_encoded("enc_delta_length_byte_array", "SELECT o_orderkey AS k, o_orderpriority AS s FROM orders", {"k": "o_orderkey", "s": "o_orderpriority"}, {"s": "DELTA_LENGTH_BYTE_ARRAY"}, data_page_version="2.0")
_encoded("enc_delta_byte_array", "SELECT o_orderkey AS k, o_orderpriority AS s FROM orders", {"k": "o_orderkey", "s": "o_orderpriority"}, {"s": "DELTA_BYTE_ARRAY"}, data_page_version="2.0")
_encoded("enc_byte_stream_split", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders", {"k": "o_orderkey", "p": "o_totalprice"}, {"p": "BYTE_STREAM_SPLIT"})
_encoded("enc_rle_boolean", "SELECT o_orderkey AS k, o_orderstatus = 'F' AS b FROM orders", {"k": "o_orderkey", "b": "o_orderstatus = 'F'"}, {"b": "RLE"}, data_page_version="2.0")


@query(_ORDERS_SQL, name="codec_brotli")
def codec_brotli(spark, sf):
    """Spark has no BROTLI codec: the row-group source reads it."""
    path = new_folder(spark)
    write_arrow(table(spark, sf, "orders").select(*_ORDERS), path, compression="brotli")
    return scan_row_groups(spark, path)


# Row groups and metadata


def _blocks(spark, sf) -> str:
    """events in row groups of 100 rows, a hundred of event_id each, dealt over files; the path."""
    path = new_folder(spark)
    rows = table(spark, sf, "events").select("event_id", "user_id").repartition(F.expr("event_id div 100")).sortWithinPartitions("event_id")
    write_arrow(rows, path, row_group_size=100)
    return path


def _unsigned(column: str) -> Column:
    """A number of seven bytes at most from the little-endian bytes of a statistic, of four bytes or eight."""
    padded = F.rpad(F.hex(column), 16, "0")
    parts = [F.conv(F.substring(padded, 2 * i + 1, 2), 16, 10).cast("bigint") * F.lit(256**i) for i in range(7)]
    return sum(parts[1:], parts[0])


def _second_block(spark, path: str):
    """Where the row group of the second hundred is: by its statistics, no page is read."""
    return FT.column_chunks(spark, path).where("column_path = 'event_id'").where(_unsigned("min_value") == 100).select("path", "row_group").first()


_SECOND_SQL = "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE i BETWEEN 100 AND 199"


@query(_SECOND_SQL)
def row_group_select(spark, sf):
    """The second hundred, by Spark's reader."""
    at = _second_block(spark, _blocks(spark, sf))
    return ParquetFile(spark, at.path).row_group(at.row_group)


@query(_SECOND_SQL)
def row_group_source(spark, sf):
    """The same by the row-group source."""
    at = _second_block(spark, _blocks(spark, sf))
    return scan_row_groups(spark, at.path, row_group=at.row_group)


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey AS r_regionkey, n_name AS r_name FROM nation")
def multi_file(spark, sf):
    path = new_folder(spark)
    table(spark, sf, "region").write.parquet(f"{path}/a")
    table(spark, sf, "nation").selectExpr("n_nationkey AS r_regionkey", "n_name AS r_name").write.parquet(f"{path}/b")
    return scan(spark, [f"{path}/a", f"{path}/b"])


_NAMES = "region nation customer supplier part orders lineitem events embeddings".split()


def _count_sql(of: str) -> str:
    """Rows by table, from the tables themselves: footers have to agree."""
    return " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS num_rows{of} FROM {n}" for n in _NAMES)


@query(_count_sql(""))
def file_metadata(spark, sf):
    rows = FT.file_metadata(spark, [f"{sf}/{n}.parquet" for n in _NAMES])
    return rows.withColumn("name", F.regexp_extract("path", r"/([a-z]+)\.parquet", 1)).groupBy("name").agg(F.sum("num_rows").alias("num_rows"))


@query(_count_sql(""))
def row_groups(spark, sf):
    rows = FT.row_groups(spark, [f"{sf}/{n}.parquet" for n in _NAMES])
    return rows.withColumn("name", F.regexp_extract("path", r"/([a-z]+)\.parquet", 1)).groupBy("name").agg(F.sum("num_rows").alias("num_rows"))


@query(
    "SELECT 'o_custkey' AS column_path, count(*) AS num_values, count(*) - count(o_custkey) AS nulls FROM orders UNION ALL "
    "SELECT 'o_orderkey', count(*), count(*) - count(o_orderkey) FROM orders UNION ALL SELECT 'o_totalprice', count(*), count(*) - count(o_totalprice) FROM orders"
)
def column_chunks(spark, sf):
    rows = FT.column_chunks(spark, f"{sf}/orders.parquet").where("column_path IN ('o_custkey', 'o_orderkey', 'o_totalprice')")
    return rows.groupBy("column_path").agg(F.sum("num_values").alias("num_values"), F.sum("null_count").alias("nulls"))


@query("SELECT min(o_orderkey) AS least, max(o_orderkey) AS largest FROM orders")
def chunk_statistics(spark, sf):
    """Least and largest key, decoded from the statistics' little-endian bytes."""
    rows = FT.column_chunks(spark, f"{sf}/orders.parquet").where("column_path = 'o_orderkey'")
    return rows.agg(F.min(_unsigned("min_value")).alias("least"), F.max(_unsigned("max_value")).alias("largest"))


@query(
    "SELECT column_name AS name, (row_number() OVER (ORDER BY column_index) - 1)::INT AS column_index FROM duckdb_columns() "
    "WHERE table_name = 'lineitem'"
)
def schema_listing(spark, sf):
    leaves = FT.schema_leaves(spark, FT.files_of(spark, f"{sf}/lineitem.parquet")[:1])
    return leaves.select("name", "column_index")


@query("SELECT 'embeddings' AS name, 'embedding.list.element' AS path, 1 AS column_index, 3 AS def_level, 1 AS rep_level")
def schema_lookup(spark, sf):
    """A leaf by its path, with its levels."""
    f = ParquetFile(spark, FT.files_of(spark, f"{sf}/embeddings.parquet")[0])
    name = next(e.path for e in f.footer.leaves if e.path[0] == "embedding")
    e = f.find(name)
    return spark.createDataFrame([("embeddings", "embedding.list.element", e.column, e.max_def, e.max_rep)], "name string, path string, column_index int, def_level int, rep_level int")


# Metadata of files whose every property is known


def _known(spark, sf) -> str:
    """orders in row groups of 500 rows, written with known properties; the path."""
    path = new_folder(spark)
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS k", "CASE WHEN o_orderkey % 3 > 0 THEN cast(o_custkey AS int) END AS c", "o_orderpriority AS s")
    make = _cast(k=pa.int64())
    write_arrow(rows.coalesce(4), path, lambda t: make(t).replace_schema_metadata({"who": "me"}), 500, compression="zstd", use_dictionary=["s"], column_encoding={"k": "DELTA_BINARY_PACKED", "c": "PLAIN"}, write_page_index=True, write_page_checksum=True)
    return path


@query("SELECT (SELECT count(*) FROM orders) AS num_rows, 2 AS version, 3 AS num_schema_elements, 3 AS num_leaves, 'me' AS who, 3 AS num_column_orders, true AS by_arrow, false AS encrypted, false AS signed")
def file_properties(spark, sf):
    rows = FT.file_metadata(spark, _known(spark, sf))
    same = [F.max(c).alias(c) for c in ("version", "num_schema_elements", "num_leaves")]
    who, orders = F.max(F.col("key_value_metadata")["who"]).alias("who"), F.max("num_column_orders").alias("num_column_orders")
    by = F.bool_and(F.col("created_by").startswith("parquet-cpp-arrow")).alias("by_arrow")
    return rows.agg(F.sum("num_rows").alias("num_rows"), *same, who, orders, by, F.bool_or("encrypted").alias("encrypted"), F.bool_or("signed").alias("signed"))


@query(
    "SELECT * FROM (VALUES (0, 'k', 'INT64', 'OPTIONAL', 0, NULL, NULL, NULL, 1, 0), (1, 'c', 'INT32', 'OPTIONAL', 0, NULL, NULL, NULL, 1, 0), (2, 's', 'BYTE_ARRAY', 'OPTIONAL', 0, 'UTF8', 'STRING', 'STRING', 1, 0)) "
    "AS t(column_index, path, physical_type, repetition, num_children, converted_type, logical_type, annotation, max_definition_level, max_repetition_level)"
)
def schema_properties(spark, sf):
    rows = FT.schema_elements(spark, _known(spark, sf))
    return rows.select("column_index", "path", "physical_type", "repetition", "num_children", "converted_type", "logical_type", "annotation", "max_definition_level", "max_repetition_level").distinct()


@query("SELECT 100 AS num_rows, 2 AS num_columns, (count(*) // 100)::BIGINT AS groups, true AS sizes FROM events")
def row_group_properties(spark, sf):
    rows = FT.row_groups(spark, _blocks(spark, sf)).where("num_rows = 100")
    sizes = F.bool_and(F.expr("total_byte_size > 0 AND coalesce(total_compressed_size, 1) > 0 AND first_row = 100 * row_group AND coalesce(ordinal, row_group) = row_group")).alias("sizes")
    return rows.groupBy("num_rows", "num_columns").agg(F.count("*").alias("groups"), sizes).withColumn("num_rows", F.col("num_rows").cast("int"))


@query(
    "SELECT 'k' AS column_path, 'INT64' AS physical_type, 'ZSTD' AS codec, 'DELTA_BINARY_PACKED,RLE' AS encodings, false AS dictionary, true AS indexed, false AS encrypted, count(*) AS num_values, count(*) - count(o_orderkey) AS nulls, min(o_orderkey) AS least, max(o_orderkey) AS largest FROM orders "
    "UNION ALL SELECT 'c', 'INT32', 'ZSTD', 'PLAIN,RLE', false, true, false, count(*), count(*) - count(CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END), min(CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END), max(CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END) FROM orders "
    "UNION ALL SELECT 's', 'BYTE_ARRAY', 'ZSTD', 'PLAIN,RLE,RLE_DICTIONARY', true, true, false, count(*), count(*) - count(o_orderpriority), NULL, NULL FROM orders"
)
def column_chunk_properties(spark, sf):
    rows = FT.column_chunks(spark, _known(spark, sf))
    encodings, indexed = F.array_join(F.array_sort(F.array_distinct("encodings")), ",").alias("encodings"), F.expr("offset_index_offset > 0 AND offset_index_length > 0 AND column_index_offset > 0 AND column_index_length > 0").alias("indexed")
    number = F.col("physical_type") != "BYTE_ARRAY"
    return rows.groupBy("column_path", "physical_type", "codec", encodings, F.col("dictionary_page_offset").isNotNull().alias("dictionary"), indexed, "encrypted").agg(
        F.sum("num_values").alias("num_values"), F.sum("null_count").alias("nulls"),
        F.min(F.when(number, _unsigned("min_value"))).alias("least"), F.max(F.when(number, _unsigned("max_value"))).alias("largest"),
    )


@query("SELECT * FROM (VALUES ('o_custkey', false, true, false, false), ('o_orderkey', true, true, false, false)) AS t(column_path, bloom, indexed, key_values, encrypted)")
def chunk_indexes(spark, sf):
    """Pointers to bloom filters and page indexes, and key/value metadata of chunks, of a file by Spark's writer."""
    path = new_folder(spark)
    bloom = {"parquet.bloom.filter.enabled#o_orderkey": "true", "parquet.bloom.filter.expected.ndv#o_orderkey": "1000"}
    # Keys that a dictionary holds get no filter: the writer keeps the dictionary.
    table(spark, sf, "orders").select("o_orderkey", "o_custkey").write.options(**bloom, **{"parquet.enable.dictionary": "false"}).parquet(path)
    rows = FT.column_chunks(spark, path)
    flags = {"bloom": "bloom_filter_offset > 0", "indexed": "offset_index_offset > 0 AND column_index_offset > 0", "key_values": "key_value_metadata IS NOT NULL", "encrypted": "encrypted"}
    return rows.groupBy("column_path").agg(*(F.bool_and(F.coalesce(F.expr(e), F.lit(False))).alias(n) for n, e in flags.items()))


@query("SELECT count(*) AS num_rows, true AS bytes FROM orders")
def total_bytes(spark, sf):
    """Sums of row groups; each holds at least the bytes of its numbers."""
    path = new_folder(spark)
    table(spark, sf, "orders").select("o_orderkey").write.options(**{"parquet.enable.dictionary": "false"}).parquet(path)
    rows = S.total_bytes(FT.row_groups(spark, path))
    return rows.agg(F.sum("num_rows").alias("num_rows"), F.bool_and(F.col("total_byte_size") >= 8 * F.col("num_rows")).alias("bytes"))


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_index, p_partkey, (SELECT count(*) - 10 FROM part) AS more FROM part ORDER BY p_partkey LIMIT 10")
def preview_and_rest(spark, sf):
    return S.preview(table(spark, sf, "part"), "p_partkey")


@query(
    "SELECT 'Rows: ' || count(*) AS line FROM region UNION ALL SELECT 'Columns: 2' UNION ALL SELECT '  r_regionkey (INT64)' UNION ALL SELECT '  r_name (BYTE_ARRAY)' "
    "UNION ALL SELECT '    ' || r_regionkey FROM region UNION ALL SELECT '    \"' || r_name || '\"' FROM region"
)
def dump_lines(spark, sf):
    """The dump of a small table, but for lines on the file itself."""
    path = new_folder(spark)
    table(spark, sf, "region").selectExpr("cast(r_regionkey AS bigint) AS r_regionkey", "r_name").coalesce(1).write.parquet(path)
    lines = [line for line in cli.dump(spark, FT.files_of(spark, path)[0]) if line.startswith(("Rows: ", "Columns: ", "  "))]
    return spark.createDataFrame([(line,) for line in lines], "line string")


# Nulls, empty chunks, checksums, more stored forms


_KEPT = "o_orderkey % 3 > 0"


@query(
    "SELECT o_orderkey, CASE WHEN n THEN date_diff('day', DATE '1970-01-01', o_orderdate::DATE) END AS d, CASE WHEN n THEN epoch_ms(o_orderdate) END AS ms, CASE WHEN n THEN epoch_us(o_orderdate) END AS us, "
    "CASE WHEN n THEN o_custkey % 256 - 128 END AS i8, CASE WHEN n THEN o_custkey % 65536 END AS u16, CASE WHEN n THEN 4294967295 - o_custkey END AS u32, CASE WHEN n THEN (18446744073709551615::HUGEINT - o_custkey)::VARCHAR END AS u64, "
    "CASE WHEN n THEN (o_custkey % 64 / 4.0)::DOUBLE END AS f16, CASE WHEN n THEN (round(o_totalprice, 2)::DECIMAL(15,2))::VARCHAR END AS dec, CASE WHEN n THEN lower(md5(o_orderpriority)) END AS id, CASE WHEN n THEN o_orderpriority END AS s, CASE WHEN n THEN o_orderstatus = 'F' END AS b "
    f"FROM (SELECT *, {_KEPT} AS n FROM orders)"
)
def null_views(spark, sf):
    """Every logical view over a column with nulls: a third of the rows."""
    of = {
        "d": "cast(o_orderdate AS date)", "ms": "unix_micros(cast(o_orderdate AS timestamp)) div 1000", "us": "unix_micros(cast(o_orderdate AS timestamp))", "i8": "cast(o_custkey % 256 - 128 AS int)", "u16": "cast(o_custkey % 65536 AS int)",
        "u32": "4294967295 - o_custkey", "u64": "-1 - o_custkey", "f16": "cast(o_custkey % 64 / 4.0 AS float)", "dec": "cast(round(o_totalprice, 2) AS decimal(15,2))", "id": "unhex(md5(o_orderpriority))", "s": "o_orderpriority", "b": "o_orderstatus = 'F'",
    }
    cast = _cast(ms=pa.timestamp("ms"), us=pa.timestamp("us"), i8=pa.int8(), u16=pa.uint16(), u32=pa.uint32(), f16=pa.float16(), id=pa.binary(16))

    def make(t: pa.Table) -> pa.Table:
        t = cast(t)
        return t.set_column(t.schema.get_field_index("u64"), "u64", t.column("u64").combine_chunks().view(pa.uint64()))

    path = _as(spark, sf, "orders", {"o_orderkey": "o_orderkey"} | {c: f"CASE WHEN {_KEPT} THEN {e} END" for c, e in of.items()}, make, store_decimal_as_integer=True)
    views = {
        "d": V.date_days("d").cast("long"), "ms": V.timestamp_millis("ms"), "us": V.timestamp_micros("us"), "i8": V.int8("i8").cast("long"), "u16": V.uint16("u16").cast("long"), "u32": V.uint32(V.uint32_as_int("u32")),
        "u64": V.uint64(V.uint64_as_long("u64")).cast("string"), "f16": V.float16("f16").cast("double"), "dec": F.col("dec").cast("string"), "id": F.regexp_replace(V.uuid_text("id"), "-", ""), "s": V.text("s"), "b": F.col("b"),
    }
    return scan(spark, path).select("o_orderkey", *(e.alias(c) for c, e in views.items()))


def _nulls(name: str, page: str) -> None:
    @query(f"SELECT o_orderkey, CASE WHEN {_KEPT} THEN o_custkey END AS c, CASE WHEN o_orderkey % 1000 > 500 THEN o_orderpriority END AS s FROM orders", name=name)
    def run(spark, sf):
        columns = {"o_orderkey": "o_orderkey", "c": f"CASE WHEN {_KEPT} THEN o_custkey END", "s": "CASE WHEN o_orderkey % 1000 > 500 THEN o_orderpriority END"}
        return scan(spark, _as(spark, sf, "orders", columns, None, data_page_version=page, data_page_size=256))


_nulls("null_expansion_v1", "1.0")
_nulls("null_expansion_v2", "2.0")


@query("SELECT o_custkey FROM orders WHERE o_orderkey % 3 > 0")
def required_of_nulls(spark, sf):
    path = _as(spark, sf, "orders", {"o_custkey": f"CASE WHEN {_KEPT} THEN o_custkey END"}, None)
    return C.required(scan(spark, path), "o_custkey")


@query("SELECT count(*) AS n_rows, round(sum(CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END), 2) AS sum_p FROM orders")
def totals_of_nulls(spark, sf):
    path = _as(spark, sf, "orders", {"p": f"CASE WHEN {_KEPT} THEN o_totalprice END"}, None)
    return S.column_totals(scan(spark, path), ["p"])


@query("SELECT o_orderkey, o_custkey FROM orders")
def empty_files(spark, sf):
    """Files without rows beside others."""
    path, rows = new_folder(spark), table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    rows.where("o_orderkey < 0").write.parquet(f"{path}/a")
    rows.write.parquet(f"{path}/b")
    rows.where("o_orderkey < 0").write.parquet(f"{path}/c")
    return scan(spark, [f"{path}/{x}" for x in "abc"])


@query("SELECT count(*) AS n_rows FROM orders")
def checksums(spark, sf):
    """All pages decoded with their checksums verified."""
    return spark.createDataFrame([(strict_count(spark, _known(spark, sf)),)], "n_rows long")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END AS o_totalprice FROM orders")
def merged_schemas(spark, sf):
    """Files that lack a column of the others."""
    path, rows = new_folder(spark), table(spark, sf, "orders")
    rows.where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey").write.parquet(f"{path}/a")
    rows.where("o_orderkey % 2 = 1").select("o_orderkey", "o_totalprice").write.parquet(f"{path}/b")
    return scan(spark, [f"{path}/a", f"{path}/b"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT s_suppkey, s_acctbal::DECIMAL(15,2)::VARCHAR AS v FROM supplier")
def decimal_byte_array(spark, sf):
    """Unscaled values in byte arrays of as many bytes as each needs."""

    def make(t: pa.Table) -> pa.Table:
        def least(v: int) -> bytes:
            return v.to_bytes((v if v >= 0 else -v - 1).bit_length() // 8 + 1, "big", signed=True)

        return t.set_column(1, "v", pa.array([None if v is None else least(v) for v in t.column("v").to_pylist()], pa.binary()))

    path = _as(spark, sf, "supplier", {"s_suppkey": "s_suppkey", "v": "cast(round(s_acctbal * 100) AS bigint)"}, make)
    return scan(spark, path).select("s_suppkey", V.decimal_of_bytes("v", 15, 2).cast("string").alias("v"))


@query("SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS days, epoch_ms(o_orderdate) AS ms FROM orders")
def date_and_millis_stored(spark, sf):
    """DATE and TIMESTAMP(MILLIS) columns, as stored."""
    columns = {"o_orderkey": "o_orderkey", "d": "cast(o_orderdate AS date)", "ms": "unix_micros(cast(o_orderdate AS timestamp)) div 1000"}
    path = _as(spark, sf, "orders", columns, _cast(ms=pa.timestamp("ms")))
    return scan(spark, path, physical=True).select("o_orderkey", F.col("d").cast("long").alias("days"), "ms")


# Interface files

_IDL = """
/* A small one, */ namespace java some.where  // with comments of all kinds
enum Colour { RED, GREEN = 5 }  # and an enum
struct Point { 1: required i32 x, 2: optional double y = 0.5 }
union Shape { 1: Point point; 2: string name }
struct All { 1: required list<Point> points; 2: map<string, set<i64>> counts 3: Colour colour = Colour.GREEN }
"""


def _idl(spark) -> str:
    path = new_folder(spark)
    spark.createDataFrame([(_IDL,)], "value string").coalesce(1).write.text(path)
    return path


@query(
    "SELECT * FROM (VALUES ('enum', 'Colour', 0, 'RED', 'i32', 'value', NULL), ('enum', 'Colour', 5, 'GREEN', 'i32', 'value', NULL), ('struct', 'Point', 1, 'x', 'i32', 'required', NULL), ('struct', 'Point', 2, 'y', 'double', 'optional', '0.5'), "
    "('union', 'Shape', 1, 'point', 'Point', 'optional', NULL), ('union', 'Shape', 2, 'name', 'string', 'optional', NULL), ('struct', 'All', 1, 'points', 'list<Point>', 'required', NULL), "
    "('struct', 'All', 2, 'counts', 'map<string,set<i64>>', 'default', NULL), ('struct', 'All', 3, 'colour', 'Colour', 'default', 'Colour.GREEN')) AS t(kind, type_name, field_id, name, type, requirement, \"default\")"
)
def interface_fields(spark, sf):
    return idl_fields(spark, _idl(spark))


@query(
    "SELECT * FROM (VALUES ('Point', 1, 'x', 'int', false), ('Point', 2, 'y', 'double', true), ('Shape', 1, 'point', 'struct<x:int,y:double>', true), ('Shape', 2, 'name', 'string', true), "
    "('All', 1, 'points', 'array<struct<x:int,y:double>>', false), ('All', 2, 'counts', 'map<string,array<bigint>>', true), ('All', 3, 'colour', 'int', true)) AS t(type_name, field_id, name, spark_type, nullable)"
)
def interface_schemas(spark, sf):
    return idl_schemas(spark, _idl(spark))
