"""Files through PyArrow's file systems, for what executors read themselves."""

from __future__ import annotations

from urllib.parse import quote, urlsplit


def arrow_file(path: str):
    """(file system, path in it) of a path or URI as Spark names files; raises where PyArrow has no such file system."""
    from pyarrow import fs

    parts = urlsplit(path)
    if len(parts.scheme) < 2 or parts.scheme == "file":  # no scheme, or a drive letter
        return fs.LocalFileSystem(), path.removeprefix("file:").replace("///", "/", 1) if parts.scheme == "file" else path
    return fs.FileSystem.from_uri(quote(path, safe="/:@+=,"))


def arrow_reads(spark, paths: list[str]) -> bool:
    """Whether executors can open such paths with PyArrow: by the scheme of the file system that Hadoop finds for them."""
    from pyarrow import fs

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for scheme in {jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).getUri().getScheme() for p in paths}:
        if scheme != "file":
            try:
                fs.FileSystem.from_uri(f"{scheme}://x/y")
            except Exception:  # no such file system here, or its library is missing
                return False
    return True
