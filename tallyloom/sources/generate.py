"""Seeded tables for tests and demonstrations, made in Spark: the same seed gives the same rows however they are spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *of: Column) -> Column:
    """A number of 0 to below 1 from the hash of some columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 40)).cast("double") / float(1 << 40)


def pick(seed: int, values: list, *of: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.floor(uniform(seed, *of) * len(values)).cast("int"))


def daily_sales(spark: SparkSession, shops: int, articles: int, days: int, start: str = "2024-01-01", seed: int = 1) -> DataFrame:
    """filiale, artikel, datum, menge: a level of its own for each series, a weekly pattern, a year's swing and noise."""
    grid = spark.range(shops * articles * days).select((F.col("id") % days).cast("int").alias("d"), F.floor(F.col("id") / days).alias("s"))
    shop, article = F.concat(F.lit("F"), (F.col("s") % shops).cast("string")), F.concat(F.lit("A"), F.floor(F.col("s") / shops).cast("string"))
    rows = grid.select(shop.alias("filiale"), article.alias("artikel"), F.date_add(F.lit(start).cast("date"), F.col("d")).alias("datum"))
    level = 20 + 80 * uniform(seed, F.col("filiale"), F.col("artikel"))
    week = F.get(F.array(*map(F.lit, (0.9, 0.85, 0.9, 1.0, 1.2, 1.5, 0.4))), F.weekday("datum"))
    year = 1 + 0.15 * F.sin(F.dayofyear("datum") / 365.0 * 2 * F.pi())
    noise = 0.9 + 0.2 * uniform(seed + 1, F.col("filiale"), F.col("artikel"), F.col("datum"))
    return rows.withColumn("menge", F.rint(level * week * year * noise))


def offers(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """angebot_id, produkt, kunde, vertriebsmitarbeiter, listenpreis, verkaufspreis, menge."""
    i = F.col("id")
    list_price = F.rint(100 + 4900 * uniform(seed, i))
    return spark.range(n).select(
        i.alias("angebot_id"), F.concat(F.lit("Produkt "), F.floor(uniform(seed + 1, i) * 12).cast("string")).alias("produkt"), F.concat(F.lit("Kunde "), F.floor(uniform(seed + 2, i) * 40).cast("string")).alias("kunde"),
        pick(seed + 3, ["Berg", "Hansen", "Kurz", "Lang"], i).alias("vertriebsmitarbeiter"), list_price.alias("listenpreis"),
        F.rint(list_price * (1 - 0.3 * uniform(seed + 4, i))).alias("verkaufspreis"), (1 + F.floor(uniform(seed + 5, i) * 20)).cast("int").alias("menge"),
    )


def companies(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """firma_id, firma_name, plz, ort, branche; each fifth company is another spelling of the one before."""
    base = F.when(F.col("id") % 5 == 4, F.col("id") - 1).otherwise(F.col("id"))
    rows = spark.range(n).select("id", base.alias("b"))
    stem = F.concat(pick(seed, ["Adler", "Birke", "Cedrus", "Delta", "Eiche", "Falke", "Granit", "Hafen"], F.col("b")), F.lit(" "), pick(seed + 1, ["Technik", "Bau", "Logistik", "Energie", "Chemie"], F.col("b")), F.lit(" "), F.col("b").cast("string"))
    other = F.when(F.col("id") == F.col("b"), F.concat(stem, F.lit(" GmbH"))).otherwise(F.concat(F.upper(stem), F.lit(" GmbH & Co. KG")))
    return rows.select(
        F.col("id").alias("firma_id"), other.alias("firma_name"), F.lpad(F.floor(uniform(seed + 2, F.col("b")) * 100_000).cast("string"), 5, "0").alias("plz"),
        pick(seed + 3, ["Dresden", "Köln", "Ulm", "Kiel"], F.col("b")).alias("ort"), pick(seed + 4, ["Bau", "Chemie", "Handel"], F.col("b")).alias("branche"),
    )
