"""Planner statistics, intervals, reminders and sheet imports."""

from __future__ import annotations

from docloom.functions.values import percent
from docloom.operators.tabular import import_tasks
from docloom.plans.base import TASKS_SQL, query, tasks
from docloom.session import read_table
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The day that the registered queries take as today; interval queries get it as a parameter.
TODAY = "1998-06-15"


def start_of() -> Column:
    """A task's start; an empty one counts as missing."""
    return F.coalesce(F.nullif("start_date", F.lit("")), F.col("end_date"))


def end_of() -> Column:
    return F.coalesce(F.nullif("end_date", F.lit("")), F.col("start_date"))


def active_on(day: Column) -> Column:
    """Whether a day lies in a task; days are texts and compare as such."""
    return (start_of() <= day) & (day <= end_of())


def planner_stats_of(t: DataFrame, today: str) -> DataFrame:
    """All planner counts in one pass."""
    month, done = today[:7], F.col("completed")
    return t.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(done).alias("completed"),
        F.count_if(active_on(F.lit(today))).alias("active_today"),
        F.count_if(F.startswith(start_of(), F.lit(month)) | F.startswith(end_of(), F.lit(month))).alias("monthly"),
        F.count_if(~done & (end_of() < today)).alias("overdue"),
        percent(F.count_if(done), F.count(F.lit(1))).alias("completion_rate"),
    )


def by_priority(t: DataFrame) -> DataFrame:
    """Counts of the three priorities, 0 included."""
    domain = t.sparkSession.createDataFrame([("low",), ("medium",), ("high",)], "priority string")
    return domain.join(t.groupBy("priority").count(), "priority", "left").select("priority", F.coalesce("count", F.lit(0)).alias("n"))


def by_category(t: DataFrame) -> DataFrame:
    """Counts by category, the missing one named, with the first task of each to order by."""
    name = F.coalesce(F.nullif("category", F.lit("")), F.lit("Non classee")).alias("category")
    return t.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.min("task_id").alias("first_task"))


def by_month(t: DataFrame) -> DataFrame:
    """Tasks and completed tasks by month of start."""
    return t.groupBy(F.substring(start_of(), 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_if("completed").alias("completed"))


def on_days(t: DataFrame) -> DataFrame:
    """Each task on each of its days, by unrolling its interval, so that a calendar is an equality join or a group."""
    days = F.sequence(F.to_date(start_of()), F.to_date(end_of()))
    unrolled = t.where(start_of() <= end_of()).withColumn("day", F.explode(days))
    return unrolled.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def marker() -> Column:
    """What a calendar shows of a task on a day: its start, its end or nothing."""
    return F.when(F.col("day") == start_of(), "Debut").when(F.col("day") == end_of(), "Fin").otherwise("")


def upcoming(t: DataFrame, today: str, n: int = 5) -> DataFrame:
    """The next tasks that are not completed."""
    return t.where(~F.col("completed") & (end_of() >= today)).orderBy(end_of(), "task_id").limit(n)


def reminders_due(t: DataFrame, users: DataFrame, now: Column, hour: int = 9) -> DataFrame:
    """Tasks to remind of: those whose own time has come and, at the given hour, those without one that start tomorrow.

    t has reminder_at and reminder_sent; only users with an address are kept.
    """
    open_ = t.where(~F.col("completed") & ~F.coalesce("reminder_sent", F.lit(False)))
    custom = open_.where(F.col("reminder_at") <= now).withColumn("kind", F.lit("custom"))
    tomorrow = F.date_format(F.date_add(now.cast("date"), 1), "yyyy-MM-dd")
    default = open_.where(F.col("reminder_at").isNull() & (F.hour(now) == hour) & (start_of() == tomorrow)).withColumn("kind", F.lit("default"))
    return custom.unionByName(default).join(users.where(F.col("email").isNotNull()), "user_id")


@query(f"""
    WITH t AS ({TASKS_SQL}) SELECT count(*) AS total, count_if(completed)::BIGINT AS completed,
      count_if(start_date <= '{TODAY}' AND '{TODAY}' <= end_date)::BIGINT AS active_today,
      count_if(start_date LIKE '{TODAY[:7]}%' OR end_date LIKE '{TODAY[:7]}%')::BIGINT AS monthly,
      count_if(NOT completed AND end_date < '{TODAY}')::BIGINT AS overdue, floor(100.0 * count_if(completed) / count(*) + 0.5)::BIGINT AS completion_rate FROM t""")
def planner_stats(spark, sf_dir):
    """Planner counts over all tasks."""
    return planner_stats_of(tasks(spark, sf_dir), TODAY)


@query(f"WITH t AS ({TASKS_SQL}) SELECT p.priority, count(t.task_id) AS n FROM (VALUES ('low'), ('medium'), ('high')) p(priority) LEFT JOIN t USING (priority) GROUP BY 1")
def tasks_by_priority(spark, sf_dir):
    """Tasks by priority."""
    return by_priority(tasks(spark, sf_dir))


@query(f"WITH t AS ({TASKS_SQL}) SELECT coalesce(nullif(category, ''), 'Non classee') AS category, count(*) AS n, min(task_id) AS first_task FROM t GROUP BY 1")
def tasks_by_category(spark, sf_dir):
    """Tasks by category."""
    return by_category(tasks(spark, sf_dir))


@query(f"WITH t AS ({TASKS_SQL}) SELECT substring(start_date, 1, 7) AS month, count(*) AS n, count_if(completed)::BIGINT AS completed FROM t GROUP BY 1")
def tasks_by_month(spark, sf_dir):
    """Tasks by month."""
    return by_month(tasks(spark, sf_dir))


@query(f"WITH t AS ({TASKS_SQL}) SELECT task_id, start_date, end_date FROM t WHERE start_date <= '{TODAY}' AND end_date >= '{TODAY}'")
def active_on_day(spark, sf_dir):
    """Tasks that are active on a day."""
    return tasks(spark, sf_dir).where(active_on(F.lit(TODAY))).select("task_id", "start_date", "end_date")


@query(f"""
    WITH t AS ({TASKS_SQL}), d AS (SELECT *, strftime(unnest(generate_series(start_date::DATE, end_date::DATE, INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM t)
    SELECT day, CASE WHEN day = start_date THEN 'Debut' WHEN day = end_date THEN 'Fin' ELSE '' END AS marker, count(*) AS n FROM d GROUP BY 1, 2""")
def calendar_markers(spark, sf_dir):
    """Tasks by day and calendar marker, for every day of every task."""
    return on_days(tasks(spark, sf_dir)).groupBy("day", marker().alias("marker")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH t AS ({TASKS_SQL}) SELECT task_id, end_date FROM t WHERE NOT completed AND end_date >= '{TODAY}' ORDER BY end_date, task_id LIMIT 5")
def upcoming_tasks(spark, sf_dir):
    """The five next open tasks."""
    return upcoming(tasks(spark, sf_dir), TODAY).select("task_id", "end_date")


@query(f"""
    WITH t AS ({TASKS_SQL}), r AS (SELECT *, CASE WHEN task_id % 3 = 0 THEN start_date::TIMESTAMP + INTERVAL 8 HOUR END AS reminder_at, task_id % 7 = 0 AS sent FROM t),
    due AS (SELECT *, 'custom' AS kind FROM r WHERE NOT completed AND NOT sent AND reminder_at <= TIMESTAMP '{TODAY} 09:00:00'
            UNION ALL SELECT *, 'default' FROM r WHERE NOT completed AND NOT sent AND reminder_at IS NULL AND start_date = '1998-06-16')
    SELECT task_id, kind, c.c_name || '@mail' AS email FROM due JOIN customer c ON c.c_custkey = due.user_id WHERE c.c_acctbal > 0""")
def reminders(spark, sf_dir):
    """Reminders that are due at nine o'clock of a day; users in debt have no address."""
    at = F.when(F.col("task_id") % 3 == 0, F.col("start_date").cast("timestamp") + F.expr("INTERVAL 8 HOURS"))
    t = tasks(spark, sf_dir).withColumn("reminder_at", at).withColumn("reminder_sent", F.col("task_id") % 7 == 0)
    users = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") > 0, F.concat("c_name", F.lit("@mail"))).alias("email")
    )
    return reminders_due(t, users, F.lit(f"{TODAY} 09:00:00").cast("timestamp")).select("task_id", "kind", "email")


def _sheet(spark, sf_dir):
    """Orders as an uploaded sheet: dates in three spellings, some texts and dates missing, some in the wrong order."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    start = F.when(k % 4 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k % 4 == 1, F.date_format("o_orderdate", "yyyy/M/d")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    end = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), (k % 11 - 1).cast("int")), "d-M-yyyy")
    text = F.when(k % 13 == 0, "  ").otherwise(F.concat(F.lit("task "), k.cast("string")))
    return o.select(k.alias("row"), text.alias("titre"), start.alias("debut"), F.when(k % 17 != 0, end).alias("date_fin"), F.when(k % 2 == 0, "Haute").otherwise("faible").alias("priorite"), F.col("o_orderstatus").alias("categorie"))


_SHEET = """
    WITH s AS (SELECT o_orderkey + 2 AS row_no, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'task ' || o_orderkey::VARCHAR END AS text,
        strftime(o_orderdate, '%Y-%m-%d') AS start_date,
        CASE WHEN o_orderkey % 17 <> 0 THEN strftime(o_orderdate + to_days((o_orderkey % 11 - 1)::INTEGER), '%Y-%m-%d') END AS end_date,
        CASE WHEN o_orderkey % 2 = 0 THEN 'high' ELSE 'low' END AS priority, o_orderstatus AS category FROM orders)"""


@query(f"{_SHEET} SELECT * FROM s WHERE text <> '' AND end_date IS NOT NULL AND start_date <= end_date")
def sheet_import_valid(spark, sf_dir):
    """Tasks of an imported sheet."""
    return import_tasks(_sheet(spark, sf_dir), "row")[0]


@query(f"""{_SHEET} SELECT row_no, CASE WHEN text = '' OR end_date IS NULL THEN 'Tache, date_debut and date_fin are required'
    ELSE 'date_debut must be before or equal to date_fin' END AS error FROM s WHERE text = '' OR end_date IS NULL OR start_date > end_date""")
def sheet_import_rejected(spark, sf_dir):
    """Rejected rows of an imported sheet."""
    return import_tasks(_sheet(spark, sf_dir), "row")[1].select("row_no", "error")
