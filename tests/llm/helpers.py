"""Documents that hold what operators must stand: nulls, empty texts, ties, repeated rows, clashing columns."""

ODD = [
    (5, "One two three four five six seven eight.\nnine  ten\t eleven", "en", "src0", 10),
    (3, None, None, None, None),
    (4, "", "de", "src1", 0),
    (5, "One two three four five six seven eight.\nnine  ten\t eleven", "en", "src0", 10),
    (7, "*** ### 123 456", "en", "src0", 1),
    (None, "a text without an id, which is kept as it is", "en", "src2", 3),
    (9, "\x01 odd \x1c chars   \U0001f642 Ünïcödé <|endoftext|> it's", "fr", "src1", 2),
    (8, "word " * 6000, "fr", "src0", 30000),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("size", "score", "start", "n_tokens", "key", "label", "band", "hash", "part")


def odd(spark, rows=None):
    """The rows with more columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD if rows is None else rows, COLUMNS)
    return df.withColumns({c: F.lit(c) for c in CLASHING})


def at(spark, tmp_path, **tables):
    """A folder with the given tables, as a query takes it."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
