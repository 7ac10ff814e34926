"""python -m lakescan.cli FILE: a header, then the first values of every column of every row group."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lakescan.errors import ScanError
from lakescan.scan import ParquetFile
from lakescan.session import get_or_create

FIRST = 10


def dump(spark: SparkSession, path: str):
    """The lines of the dump. Group nodes count as columns in the header, as they do in the schema."""
    file = ParquetFile(spark, path)
    f = file.footer
    yield f"File: {path}"
    yield f"Version: {f.raw.get(1)}"
    yield f"Rows: {f.raw.get(3)}"
    yield f"Row groups: {len(f.row_groups)}"
    yield f"Columns: {len(f.elements) - 1}"
    yield f"Total byte size: {sum(g.get(2) or 0 for g in f.row_groups)}"
    if f.raw.get(6) is not None:
        yield f"Created by: {f.raw[6].decode('utf-8', 'replace')}"
    for i, g in enumerate(f.row_groups):
        yield f"\nRow group {i}: {g.get(3)} rows"
        rows = file.row_group(i, physical=True)
        for e in f.leaves:
            yield f"  {'.'.join(e.path)} ({e.physical})"
            if e.max_rep:  # each row has an entry at least, so the first rows hold the first entries
                some = rows.select(F.col(f"`{e.path[0]}`").alias("x")).limit(FIRST).select(F.explode_outer("x"))
            else:
                some = rows.select(F.col(".".join(f"`{p}`" for p in e.path)))
            values = [r[0] for r in some.limit(FIRST).collect()]
            total = (g[1][e.column].get(3) or {}).get(5) or 0
            for v in values:
                yield f"    {show(v)}"
            if total > len(values):
                yield f"    ... {total - len(values)} more"


def show(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, (bytes, bytearray)):
        try:
            return f'"{bytes(value).decode()}"'
        except UnicodeDecodeError:
            return bytes(value).hex()
    return str(value)


def main(args: list[str]) -> int:
    if len(args) != 1:
        print("usage: python -m lakescan.cli FILE", file=sys.stderr)
        return 2
    spark = get_or_create()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        for line in dump(spark, args[0]):
            print(line)
    except ScanError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
