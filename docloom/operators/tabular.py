"""Spreadsheet-like tables: column kinds, chart series, pies, pipe tables and imports."""

from __future__ import annotations

from functools import reduce

from docloom.functions.text import normalize_key
from docloom.functions.values import first_filled, is_numeric_text, priority_of, to_date_string, to_number
from docloom.operators.changes import validated
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Column names under which a planner sheet may hold each field, the first filled one counts.
SHEET_ALIASES = {
    "text": ["tache", "titre", "task", "nom", "description"],
    "start_date": ["date_debut", "debut", "start_date"],
    "end_date": ["date_fin", "fin", "end_date", "deadline", "echeance"],
}
PIE_GROUPS = 20


def numeric_columns(df: DataFrame) -> DataFrame:
    """(column, is_numeric): a column is numeric if any of its values is; one pass over the table."""
    kinds = dict(df.dtypes)
    numbers = ("int", "bigint", "smallint", "tinyint", "double", "float")

    def numeric(c: str) -> Column:
        whole = kinds[c] in numbers or kinds[c].startswith("decimal")
        return F.col(c).isNotNull() if whole else is_numeric_text(F.col(c).cast("string"))

    flags = df.agg(*[F.coalesce(F.max(numeric(c).cast("int")), F.lit(0)).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), (F.col(c) == 1).alias("is_numeric")) for i, c in enumerate(df.columns)])
    return flags.select(F.inline(pairs))


def default_axes(kinds: DataFrame) -> DataFrame:
    """x: the first column that is not numeric; y: the first numeric one; the first column where there is none."""
    first = lambda c: F.min_by("column", F.when(c, F.col("position")))
    head = F.min_by("column", "position")
    return kinds.agg(F.coalesce(first(~F.col("is_numeric")), head).alias("x"), F.coalesce(first(F.col("is_numeric")), head).alias("y"))


def chart_series(df: DataFrame, x: str, y: str) -> DataFrame:
    """Points of a chart: rows with an x, y as a number with blanks as 0, what is no number left out."""
    return df.select(F.col(x).alias("x"), to_number(F.col(y).cast("string")).alias("y")).where("x is not null and cast(x as string) <> '' and y is not null")


def pie(df: DataFrame, x: str, y: str, order: str) -> DataFrame:
    """Sums of y by x, the first groups as they appear."""
    rows = df.select(F.col(x).alias("x"), to_number(F.col(y).cast("string")).alias("y"), F.col(order).alias("o")).where("x is not null and y is not null")
    sums = rows.groupBy("x").agg(F.sum("y").alias("total"), F.min("o").alias("first_row"))
    return sums.orderBy("first_row", "x").limit(PIE_GROUPS)


def pipe_rows(lines: DataFrame, group: str, order: str, line: str) -> DataFrame:
    """Rows of pipe tables: a numbered line with pipes begins a row, other lines continue the one before.

    Returns (group, row_no, cells, continuation): the cells of the first line and the joined rest.
    """
    text = F.trim(F.col(line))
    head = F.trim(F.element_at(F.split(text, r"\|"), 1))
    starts = F.contains(text, F.lit("|")) & (head.rlike(r"^\d+") | head.rlike(r"(?i)^n[°º]?\s*\d+"))
    by = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.where(text != "").withColumn("__starts", starts).withColumn("row_no", F.sum(starts.cast("int")).over(by)).where("row_no > 0")
    cells = F.filter(F.transform(F.split(text, r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    rest = F.array_sort(F.collect_list(F.when(~F.col("__starts"), F.struct(F.col(order).alias("o"), text.alias("t")))))
    grouped = numbered.groupBy(group, "row_no").agg(F.min_by(cells, order).alias("cells"), rest.alias("rest"))
    return grouped.select(group, F.col("row_no").cast("bigint").alias("row_no"), "cells", F.array_join(F.col("rest.t"), "\n").alias("continuation")).where(F.size("cells") >= 2)


_PRICE = r"(?i)^\d[\d\s.,]*\s*(?:(?:tnd|dt|dinar|€|\$|usd|eur)(?![A-Za-z0-9_])|$)"


def pipe_tables(lines: DataFrame, group: str, order: str, line: str) -> DataFrame:
    """Pipe tables with their header: (group, row_no, headers, cells).

    The first line with a pipe names the columns, two at least. A numbered line with pipes
    begins a row; another one continues the row before it: what looks like a price goes to the
    price column, if there is one, and all else to the column of descriptions, or the last one.
    """
    parts = lambda c: F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    named = lambda *words: reduce(lambda a, b: a | b, [F.contains(F.col("__h"), F.lit(w)) for w in words])
    rows = lines.select(group, F.col(order).alias("__o"), F.trim(F.col(line)).alias("__t")).where("__t <> ''")
    piped = F.contains("__t", F.lit("|"))
    heads = rows.where(piped).groupBy(group).agg(F.min_by("__t", "__o").alias("__head"), F.min("__o").alias("__first"))
    heads = heads.select(group, "__first", parts(F.col("__head")).alias("headers")).where(F.size("headers") >= 2)
    at = heads.select(group, F.posexplode("headers").alias("__i", "__name")).withColumn("__h", F.lower("__name"))
    found = at.groupBy(group).agg(
        F.coalesce(F.min(F.when(named("desc"), F.col("__i"))), F.max("__i")).alias("__desc"),
        F.min(F.when(named("price", "prix", "cost", "coût"), F.col("__i"))).alias("__price"),
    )
    body = rows.join(heads, group).where("__o > __first").join(found, group).withColumn("__p", parts(F.col("__t")))
    head = F.trim(F.element_at(F.split("__t", r"\|"), 1))
    starts = piped & (head.rlike(r"^\d+") | head.rlike(r"(?i)^n[°º]?\s*\d+"))
    by = Window.partitionBy(group).orderBy("__o").rowsBetween(Window.unboundedPreceding, 0)
    body = body.withColumn("__starts", starts).where(~F.col("__starts") | (F.size("__p") >= 2))
    body = body.withColumn("row_no", F.sum(F.col("__starts").cast("int")).over(by)).where("row_no > 0")
    last, rest = F.element_at("__p", -1), F.array_join(F.slice("__p", 1, F.size("__p") - 1), " | ")
    several = piped & (F.size("__p") >= 2)
    to = lambda i, t: F.struct(i.alias("i"), t.alias("t"))
    price = F.col("__price").isNotNull()
    more = (
        F.when(F.col("__starts"), F.array().cast("array<struct<i:int,t:string>>"))
        .when(several & price & last.rlike(_PRICE), F.array(to(F.col("__desc"), rest), to(F.col("__price"), last)))
        .when(several, F.array(to(F.col("__desc"), F.array_join("__p", " | "))))
        .when(price & F.col("__t").rlike(_PRICE), F.array(to(F.col("__price"), F.col("__t"))))
        .otherwise(F.array(to(F.col("__desc"), F.col("__t"))))
    )
    grouped = body.withColumn("__more", more).groupBy(group, "row_no").agg(
        F.first("headers").alias("headers"), F.min_by("__p", "__o").alias("__cells"), F.flatten(F.array_sort(F.collect_list(F.struct("__o", "__more")))["__more"]).alias("__all")
    )
    width = F.greatest(F.size("__cells"), F.coalesce(F.array_max(F.transform("__all", lambda x: x["i"])), F.lit(0)) + 1)
    cell = lambda i: F.array_join(
        F.concat(F.filter(F.array(F.get("__cells", i)), lambda x: x != ""), F.transform(F.filter("__all", lambda x: x["i"] == i), lambda x: x["t"])), "\n"
    )
    cells = F.transform(F.sequence(F.lit(0), width - 1), cell)
    return grouped.select(group, F.col("row_no").cast("bigint").alias("row_no"), "headers", cells.alias("cells"))


#: What a pixel of paper has at least of brightness and less of colour, and when it counts as green or blue.
PAPER_LUMA, PAPER_COLOUR, GREEN, BLUE = 125, 50, (1.1, 1.1, 80), (1.08, 1.05, 75)


def is_paper(red: Column, green: Column, blue: Column) -> Column:
    """Whether a pixel looks like paper."""
    luma = 0.299 * red + 0.587 * green + 0.114 * blue
    colour = F.greatest(red, green, blue) - F.least(red, green, blue)
    is_green = (green > red * GREEN[0]) & (green > blue * GREEN[1]) & (green > GREEN[2])
    is_blue = (blue > red * BLUE[0]) & (blue > green * BLUE[1]) & (blue > BLUE[2])
    return (luma > PAPER_LUMA) & (colour < PAPER_COLOUR) & ~is_green & ~is_blue


def normalized_columns(df: DataFrame) -> DataFrame:
    """The table with its column names in key form."""
    spark = df.sparkSession
    names = spark.createDataFrame([(i, c) for i, c in enumerate(df.columns)], "i int, c string")  # a sheet's header
    keys = [r[0] for r in names.orderBy("i").select(normalize_key(F.col("c"))).collect()]
    return df.toDF(*keys)


def import_tasks(sheet: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(tasks, rejected rows): a planner sheet under any of its column names; order numbers its rows from 0, row_no counts the header."""
    pick = lambda field: first_filled(*[F.col(c) for c in SHEET_ALIASES[field] if c in sheet.columns])
    optional = lambda *names: first_filled(*[F.col(c) for c in names if c in sheet.columns])
    rows = sheet.select(
        (F.col(order) + 2).cast("bigint").alias("row_no"),
        F.trim(pick("text")).alias("text"),
        to_date_string(pick("start_date")).alias("start_date"),
        to_date_string(pick("end_date")).alias("end_date"),
        priority_of(optional("priorite", "priority")).alias("priority"),
        F.nullif(F.trim(optional("categorie", "category")), F.lit("")).alias("category"),
    )
    filled = (F.col("text") != "") & F.col("start_date").isNotNull() & F.col("end_date").isNotNull()
    return validated(
        rows,
        {
            "Tache, date_debut and date_fin are required": filled,
            "date_debut must be before or equal to date_fin": F.col("start_date") <= F.col("end_date"),
        },
    )
