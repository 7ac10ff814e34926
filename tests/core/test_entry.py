import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from lakescan import queries as Q

from ..conftest import ROOT

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def ordered(columns, rows):
    place = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(r[i] for i in place) for r in rows), key=str)


@pytest.mark.parametrize("name", Q.QUERIES)
def test_query_equals_sql(spark, small, duck, name):
    got, want = Q.QUERIES[name](spark, small), duck.sql(Q.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert ordered(got.columns, got.collect()) == ordered(want.columns, want.fetchall())


def test_dynamic_column_reads_every_file_of_a_folder(spark, small, tmp_path):
    whole = spark.read.parquet(f"{small}/customer.parquet")
    whole.repartition(3).write.parquet(f"{tmp_path}/customer.parquet")
    got = Q.dynamic_column(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted((r.c_acctbal,) for r in whole.select("c_acctbal").collect())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_needs_the_training_operators():
    code = "import sys; sys.modules['lakescan.llm'] = None; import lakescan.queries, lakescan.cli, lakescan.streaming.scan, lakescan.sources.thrift_idl"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0
