"""Small Parquet files for tests, made with PyArrow."""

import pyarrow as pa
import pyarrow.parquet as pq


def save(path, columns, **options) -> str:
    """columns: name -> (values, type)."""
    fields = [pa.field(n, k, True) for n, (_, k) in columns.items()]
    table = pa.Table.from_arrays([pa.array(v, k) for v, k in columns.values()], schema=pa.schema(fields))
    pq.write_table(table, path, **options)
    return str(path)
