"""Exact quantiles of groups of any size by refined histograms.

percentile() holds every distinct value of a group in one task. Here a group's values are first counted in bins by sign and magnitude, which are of the same
number for any group, so what is gathered of a group is bounded. The bins that hold the asked ranks are cut into equal parts and their values
counted again, and so on until a rank's bin holds one value. Only rows of such bins are kept from pass to pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.session import cut

#: Bins for each doubling of magnitude in the first pass, and parts of a bin in the others.
FINE, PARTS = 16, 1024
#: Bins of what has no magnitude to count with; NaN is the greatest value.
INFINITE, NOT_A_NUMBER = 1 << 20, 1 << 21


def magnitude(x: Column) -> Column:
    """A whole number that grows with x."""
    size = F.floor(F.log2(F.abs(x)) * FINE).cast("int") + 1200 * FINE
    size = F.when(x == 0, 0).when(F.abs(x) == float("inf"), INFINITE).otherwise(size)
    return F.when(F.isnan(x), NOT_A_NUMBER).when(x < 0, -size).otherwise(size)


def ranks_in(counts: DataFrame, by: list[str], places: DataFrame) -> DataFrame:
    """The bin of each asked place, and the place within it: by, place, rank, bin, low, high (its least and greatest value)."""
    before = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    running = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return running.join(places, by).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).select(*by, "place", (F.col("rank") - F.col("before")).alias("rank"), "bin", "low", "high")


def quantiles(rows: DataFrame, by: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """by and a column for each of shares (name to share): what percentile(column, share) gives, interpolated; nulls don't count.

    Groups of nulls alone give null. Without by there is one row.
    """
    keys = [f"_g{i}" for i in range(max(1, len(by)))]
    named = [F.coalesce(F.to_json(F.struct(F.col(c))), F.lit("")).alias(k) for c, k in zip(by, keys)] or [F.lit("").alias(keys[0])]
    source = rows.select(*named, F.col(column).cast("double").alias("x"))
    values = source.where("x IS NOT NULL").withColumn("bin", magnitude(F.col("x")))
    total = [F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")]
    counts = cut(values.groupBy(*keys, "bin").agg(*total))
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("n"))
    # the places beside each share's position, from 0
    ends = [F.struct(F.lit(f"{name}:{end}").alias("place"), f((F.col("n") - 1) * F.lit(float(share))).cast("long").alias("rank")) for name, share in shares.items() for end, f in (("a", F.floor), ("b", F.ceil))]
    places = sizes.select(*keys, F.explode(F.array(*ends)).alias("p")).select(*keys, "p.*")
    found, done = cut(ranks_in(counts, keys, places)), None
    settled = F.col("low").eqNullSafe(F.col("high"))
    while True:
        sure = found.where(settled).select(*keys, "place", F.col("low").alias("value"))
        done = sure if done is None else done.unionByName(sure)
        asked = found.where(~settled)
        if asked.isEmpty():
            break
        bins = cut(asked.select(*keys, "bin", "low", "high").distinct())
        values = values.join(bins, [*keys, "bin"]).where("x >= low AND x <= high")
        part = F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * PARTS), F.lit(PARTS - 1)).cast("int")
        values = cut(values.select(*keys, "x", F.col("bin").alias("old"), part.alias("bin")))
        counts = values.groupBy(*keys, "old", "bin").agg(*total)
        found = cut(ranks_in(counts, [*keys, "old"], asked.select(*keys, F.col("bin").alias("old"), "place", "rank")))
        # a bin's name grows by the part, so that bins of one group stay apart
        name = F.dense_rank().over(Window.partitionBy(*keys).orderBy("old", "bin"))
        found = cut(found.withColumn("name", name))
        names = found.select(*keys, "old", "bin", "name").distinct()
        values = values.join(names, [*keys, "old", "bin"]).select(*keys, "x", F.col("name").alias("bin"))
        found = found.drop("old", "bin").withColumnRenamed("name", "bin")
    wide = done.groupBy(*keys).agg(*[F.max(F.when(F.col("place") == f"{name}:{end}", F.col("value"))).alias(f"_{end}_{name}") for name in shares for end in "ab"])
    wide = wide.join(sizes, keys)
    groups = rows.select(*[F.col(c) for c in by], *named).distinct() if by else rows.sparkSession.range(1).select(F.lit("").alias(keys[0]))

    def between(name: str, share: float) -> Column:
        at, a, b = (F.col("n") - 1) * F.lit(float(share)), F.col(f"_a_{name}"), F.col(f"_b_{name}")
        return F.when(a.eqNullSafe(b), a).otherwise((F.ceil(at) - at) * a + (at - F.floor(at)) * b).alias(name)

    return groups.join(wide, keys, "left").select(*by, *[between(name, share) for name, share in shares.items()])
