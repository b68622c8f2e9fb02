"""Sample ensembles: statistics of a step, daily bands, and the plan that follows.

Samples are rows (series, sample_id, ts or step, value). Two-level aggregation: sums of a sample's day, then
statistics over samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.exprs import exact_mean, exact_sum


def statistics(samples: DataFrame, *by: str) -> DataFrame:
    """Mean, median and the 10 % and 90 % quantiles of each group."""
    return samples.groupBy(*by).agg(exact_mean(F.col("value")).alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.percentile("value", F.lit(0.1)).alias("q10"), F.percentile("value", F.lit(0.9)).alias("q90"))


def daily(samples: DataFrame, ts: str = "ts") -> DataFrame:
    """Each day's band: values summed by sample and day, then statistics over samples."""
    sums = samples.groupBy(F.to_date(ts).alias("tag"), "sample_id").agg(exact_sum(F.col("value")).alias("value"))
    return statistics(sums, "tag").drop("median")


def plan(days: DataFrame, buffer: float = 0.1, unit_size: float = 50.0) -> DataFrame:
    """One row: totals of the band, the safe total, mean spread in per cent, best and weakest day, units to order."""
    return days.withColumn("_s", (F.col("q90") - F.col("q10")) / (F.col("mean") + 1e-8) * 100).agg(
        exact_sum(F.col("mean")).alias("summe"),
        exact_sum(F.col("q10")).alias("summe_q10"),
        exact_sum(F.col("q90")).alias("summe_q90"),
        (exact_sum(F.col("q90")) * (1 + buffer)).alias("sicher"),
        exact_mean(F.col("_s")).alias("spanne_pct"),
        F.max_by("tag", F.struct("mean", "tag")).alias("bester_tag"),
        F.min_by("tag", F.struct("mean", "tag")).alias("schwaechster_tag"),
        F.ceil(exact_sum(F.col("mean")) / unit_size).cast("long").alias("gebinde"),
    )


def bootstrap(history: DataFrame, keys: list[str], steps: int, samples: int = 50, season: int = 7, ts: str = "datum", value: str = "menge", weeks: int = 8, seed: int = 7) -> DataFrame:
    """(keys, sample_id, step, value): each step's value is drawn from the same place of a recent season.

    Stands in for a generative forecaster. Draws are hashes of series, sample and step, so they can be repeated.
    """
    by = Window.partitionBy(*keys).orderBy(F.desc(ts))
    recent = history.withColumn("_age", F.row_number().over(by) - 1).where(F.col("_age") < season * weeks)
    recent = recent.select(*keys, (F.col("_age") % season).alias("_place"), F.floor(F.col("_age") / season).cast("int").alias("_season"), F.col(value).cast("double").alias("value"))
    seasons = recent.groupBy(*keys, "_place").agg(F.count("*").alias("_n"))
    grid = seasons.select(*keys).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample_id")).select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    grid = grid.withColumn("_place", F.pmod(F.lit(season) - F.pmod("step", F.lit(season)), F.lit(season))).join(seasons, [*keys, "_place"])
    drawn = grid.withColumn("_season", F.pmod(F.xxhash64(*keys, "sample_id", "step", F.lit(seed)), F.col("_n")).cast("int"))
    return drawn.join(recent, [*keys, "_place", "_season"]).select(*keys, "sample_id", "step", "value")
