"""Sessions with the settings that the value semantics rest on."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Raw timestamps have no zone, TIME columns are readable, and counts come from footers where a source can do that.
DEFAULTS = {"spark.sql.session.timeZone": "UTC", "spark.sql.timeType.enabled": "true", "spark.sql.parquet.aggregatePushdown": "true"}


def get_or_create(**more: str) -> SparkSession:
    return SparkSession.builder.config(map=DEFAULTS | more).getOrCreate()


def scalar_session(spark: SparkSession) -> SparkSession:
    """A session beside the given one whose Parquet reader is not vectorized: it reads BYTE_STREAM_SPLIT pages.

    The vectorized reader is a setting of a whole session and plans are lazy, so switching it for one scan would race.
    """
    other = spark.newSession()
    for key, value in DEFAULTS.items():
        other.conf.set(key, value)
    other.conf.set("spark.sql.parquet.enableVectorizedReader", "false")
    return other


@contextmanager
def hadoop(spark: SparkSession, settings: dict[str, str]):
    """Hadoop settings for the block, put back afterwards."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = {k: conf.get(k) for k in settings}
    for k, v in settings.items():
        conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir names, or the checkpoint folder that was set.

    A local session may do without: driver and executors are one machine then. Anywhere else its absence is an error.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if (found := context._jsc.sc().getCheckpointDir()).isDefined():
        return found.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lakescan-')}")
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")
