"""Shared rows: texts with the odd cases that every text operator meets."""

ODD = [(900, None), (901, ""), (902, "   \n\t "), (903, "word " * 60000), (None, "no id"), (904, "twice " * 50), (904, "twice " * 50), (905, "é漢😀\x00")]
SCHEMA = "doc_id bigint, text string"


def odd_docs(spark, more=()):
    """Odd rows with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([*ODD, *more], SCHEMA).repartition(3)
    for name in ("key", "seed", "context", "n", "score", "rep", "fp", "component", "length", "task", "spans", "found", "check", "first"):
        df = df.withColumn(name, F.lit("x"))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
