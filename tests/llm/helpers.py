"""What several test modules use."""

SF = "/root/testdata/sf0.001"

#: texts that each operator must take: NULL, empty, blank, very long, repeated
CASES = [
    (7, None), (3, ""), (5, " \n\t"), (9, "One line only here"), (2, "One line only here"), (2, "One line only here"), (None, "One line only here"),
    (11, "word " * 40_000), (12, "x" * 60_000), (13, "naïve Ünïcode 東京都\n東京都 ends"),
]


def texts(spark, rows, **extra):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def as_set(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))
