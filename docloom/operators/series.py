"""Window-shaped computations over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moving_average(df: DataFrame, group: list[str], order: str, value: str, radius: int) -> DataFrame:
    """Centred mean over radius rows each way, shorter at the ends."""
    frame = Window.partitionBy(*group).orderBy(order).rowsBetween(-radius, radius)
    return df.withColumn("smoothed", F.avg(value).over(frame))


def runs(df: DataFrame, group: list[str], order: str, flag: Column, least: int) -> DataFrame:
    """Maximal runs of consecutive flagged rows with at least `least` rows: first, last and length."""
    by = Window.partitionBy(*group).orderBy(order)
    numbered = df.withColumn("__row", F.row_number().over(by)).withColumn("__flag", flag)
    inner = Window.partitionBy(*group).orderBy("__row")
    flagged = numbered.where("__flag").withColumn("__island", F.col("__row") - F.row_number().over(inner))
    islands = flagged.groupBy(*group, "__island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length"))
    return islands.where(F.col("length") >= least).drop("__island")


def run_edges(df: DataFrame, group: list[str], order: str, flag: Column, least: int) -> DataFrame:
    """Start of the first and end of the last such run of each group."""
    return runs(df, group, order, flag, least).groupBy(*group).agg(F.min("first").alias("first_start"), F.max("last").alias("last_end"))


def all_of_next(df: DataFrame, group: list[str], order: str, flag: Column, n: int) -> DataFrame:
    """Whether the flag holds for a row and the n - 1 after it."""
    frame = Window.partitionBy(*group).orderBy(order).rowsBetween(0, n - 1)
    whole = F.count(F.lit(1)).over(frame) == n
    return df.withColumn("all_of_next", whole & (F.min(flag.cast("int")).over(frame) == 1))


def mode_first_seen(df: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group, the first seen of equally frequent ones."""
    counted = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = F.max_by(value, F.struct(F.col("n"), -F.col("first")))
    return counted.groupBy(*group).agg(best.alias(value), F.max("n").alias("n"))
