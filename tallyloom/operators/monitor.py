"""Inspection monitoring: newest results, rates, daily trend, alerts.

Input: id, project_id, anomaly_score, decision, inference_ms and created_at (epoch seconds).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.exprs import even, exact_mean

ALERT_RATE = 20.0


def latest(results: DataFrame, n: int = 500, project: str | None = None) -> DataFrame:
    """The newest results (ties by id)."""
    rows = results if project is None else results.where(F.col("project_id") == project)
    return rows.orderBy(F.desc("created_at"), "id").limit(n)


def stats(results: DataFrame) -> DataFrame:
    """One row: counts and rates of decisions, mean score and latency; zeros if there is nothing."""
    nok = F.count_if(F.col("decision") == "NOK")
    rate = lambda c: F.coalesce(even(F.try_divide(c.cast("double"), F.count("*").cast("double")) * 100, 1), F.lit(0.0))
    return results.agg(F.count("*").alias("total"), (F.count("*") - nok).alias("ok"), nok.alias("nok"), rate(F.count("*") - nok).alias("ok_rate"), rate(nok).alias("nok_rate"), F.coalesce(even(exact_mean(F.col("anomaly_score"), 8), 3), F.lit(0.0)).alias("avg_score"), F.coalesce(even(exact_mean(F.col("inference_ms"), 6), 1), F.lit(0.0)).alias("avg_ms"))


def daily_trend(results: DataFrame, now: float, days: int = 7) -> DataFrame:
    """Counts of the last days of 24 hours before now, newest first; a moment belongs to one day, empty days are there."""
    spark = results.sparkSession
    age = F.floor((F.lit(float(now)) - F.col("created_at")) / 86_400).cast("int")
    counts = results.where(F.col("created_at") <= now).groupBy(age.alias("tag")).agg(F.count("*").alias("total"), F.count_if(F.col("decision") == "NOK").alias("nok"))
    grid = spark.range(days).select(F.col("id").cast("int").alias("tag"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return grid.join(counts, "tag", "left").select("tag", zero("total").alias("total"), zero("nok").alias("nok"), (zero("total") - zero("nok")).alias("ok"))


def alerts(results: DataFrame, above: float = ALERT_RATE) -> DataFrame:
    """Projects whose NOK rate is above a limit."""
    rate = even(F.count_if(F.col("decision") == "NOK") / F.count("*") * 100, 1)
    return results.groupBy("project_id").agg(F.count("*").alias("total"), rate.alias("nok_rate")).where(F.col("nok_rate") > above)


def running_rate(results: DataFrame, above: float = ALERT_RATE) -> DataFrame:
    """After each result: its project's results of that day so far, their NOK rate and whether it is above the limit.

    Windows hold a project's day, not all its history.
    """
    from pyspark.sql import Window

    day = F.floor(F.col("created_at") / 86_400)
    by = Window.partitionBy("project_id", day).orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    total = F.count("*").over(by)
    rate = even(F.sum((F.col("decision") == "NOK").cast("int")).over(by) / total.cast("double") * 100, 1)
    return results.select("id", "project_id", total.alias("total"), rate.alias("nok_rate")).withColumn("alarm", F.col("nok_rate") > above)


def report(results: DataFrame, n: int = 500) -> DataFrame:
    """The newest results with a readable time, for a CSV file."""
    return latest(results, n).withColumn("created_at", F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM-dd HH:mm:ss"))
