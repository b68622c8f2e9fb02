"""Margin leakage: where discounts eat the margin.

Input: offers with angebot_id, produkt, kunde, vertriebsmitarbeiter, umsatz, rabatt_pct and
deckungsbeitrag_pct (normalise() derives what is missing). Sums are exact decimals, so results don't
depend on how rows are spread; every frame is one aggregation over one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.exprs import even, exact_mean, exact_sum
from tallyloom.sources.session import cut

MIN_MARGIN = 15.0
#: Costs as a share of the list price, where only prices are known.
COST_SHARE = 0.55


def margin_pct(sell: Column, list_price: Column, cost_share: float = COST_SHARE) -> Column:
    """Margin in per cent, one digit; NULL where nothing was charged."""
    return even(F.try_divide(sell - list_price * cost_share, sell) * 100, 1)


def discount_pct(sell: Column, list_price: Column) -> Column:
    """Discount in per cent, one digit, within 0 and 100; NULL without a list price."""
    raw = F.try_divide(list_price - sell, list_price) * 100
    return even(F.when(raw.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw))), 1)


def derive(offers: DataFrame) -> DataFrame:
    """Adds margin, discount and revenue where they are missing, from what there is."""
    has = set(offers.columns)
    if "deckungsbeitrag_pct" not in has:
        if {"listenpreis", "verkaufspreis"} <= has:
            margin = margin_pct(F.col("verkaufspreis"), F.col("listenpreis"))
        elif "rabatt_pct" in has:
            margin = 30.0 - F.col("rabatt_pct")
        else:
            margin = F.lit(25.0)
        offers = offers.withColumn("deckungsbeitrag_pct", margin)
    if "rabatt_pct" not in has:
        priced = {"listenpreis", "verkaufspreis"} <= has
        offers = offers.withColumn("rabatt_pct", discount_pct(F.col("verkaufspreis"), F.col("listenpreis")) if priced else F.lit(0.0))
    if "umsatz" not in has and {"verkaufspreis", "menge"} <= has:
        offers = offers.withColumn("umsatz", even(F.col("verkaufspreis") * F.col("menge"), 2))
    return offers


def recoverable(umsatz: Column, margin: Column, least: float = MIN_MARGIN) -> Column:
    """What raising one offer to the least margin would bring."""
    return F.greatest(F.lit(0.0), umsatz * (least / 100) - margin / 100 * umsatz)


def summary(offers: DataFrame, *by: str, least: float = MIN_MARGIN) -> DataFrame:
    """Per group: mean discount and margin (one digit), offers, share below the least margin, revenue."""
    return offers.groupBy(*by).agg(
        even(exact_mean(F.col("rabatt_pct")), 1).alias("avg_rabatt"),
        even(exact_mean(F.col("deckungsbeitrag_pct")), 1).alias("avg_marge"),
        F.count("*").alias("n"),
        even(F.avg(F.when(F.col("deckungsbeitrag_pct") < least, 1.0).otherwise(0.0)) * 100, 1).alias("leck_quote"),
        exact_sum(F.col("umsatz")).alias("umsatz"),
    )


def kpis(offers: DataFrame, least: float = MIN_MARGIN) -> DataFrame:
    """One row: mean discount and margin, leaks, their revenue and what they would bring, discount outliers.

    Offers are read once, into sums by discount; the percentile and what lies above it follow from these.
    """
    leak = F.col("deckungsbeitrag_pct") < least
    money = lambda x, scale=4: F.sum(x.cast(f"decimal(28,{scale})"))
    by_discount = offers.groupBy("rabatt_pct").agg(
        F.count("*").alias("n"), F.count("rabatt_pct").alias("nr"), F.count("deckungsbeitrag_pct").alias("nm"), F.count_if(leak).alias("leaks"),
        money(F.col("rabatt_pct")).alias("rabatt"), money(F.col("deckungsbeitrag_pct")).alias("marge"), money(F.when(leak, F.col("umsatz"))).alias("volumen"),
        money(F.when(leak, F.coalesce(recoverable(F.col("umsatz"), F.col("deckungsbeitrag_pct"), least), F.lit(0.0))), 8).alias("potenzial"),
    )
    by_discount = cut(by_discount)
    # one row wide, so the cross join is with a scalar
    limit = by_discount.agg(F.percentile("rabatt_pct", F.lit(0.9), F.col("n")).alias("_p90"))
    total = lambda c: F.sum(c).cast("double")
    return by_discount.crossJoin(F.broadcast(limit)).agg(
        even(total("rabatt") / F.sum("nr"), 1).alias("avg_rabatt"),
        even(total("marge") / F.sum("nm"), 1).alias("avg_marge"),
        even(F.coalesce(total("potenzial"), F.lit(0.0))).alias("potenzial"),
        F.coalesce(F.sum("leaks"), F.lit(0)).alias("leaks"),
        F.coalesce(total("volumen"), F.lit(0.0)).alias("leak_volumen"),
        F.coalesce(F.sum(F.when(F.col("rabatt_pct") > F.col("_p90"), F.col("n"))), F.lit(0)).alias("ausreisser"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    )


def top_leaks(offers: DataFrame, n: int = 5, least: float = MIN_MARGIN, tie: tuple[str, ...] = ("angebot_id",)) -> DataFrame:
    """The n offers of least margin, what each would bring and the price rise to ask for."""
    margin = F.col("deckungsbeitrag_pct")
    out = offers.where(margin < least).withColumns({"potenzial": recoverable(F.col("umsatz"), margin, least), "preis_plus_pct": even((least - margin) * 0.9, 1)})
    return out.orderBy("deckungsbeitrag_pct", *tie).limit(n)


def ordered(groups: DataFrame, name: str, n: int, by: str = "avg_rabatt") -> DataFrame:
    """The first n groups by greatest value with their rank (ties by name): only these rows are ever in one place."""
    from pyspark.sql import Window

    order = (F.desc(by), F.col(name))
    return groups.orderBy(*order).limit(n).withColumn("rang", F.row_number().over(Window.orderBy(*order)))


def spread(groups: DataFrame, name: str) -> DataFrame:
    """One row: the group of highest and of lowest mean discount, and what the margin between them is worth."""
    worst = F.max_by(F.struct(name, "avg_rabatt", "avg_marge", "umsatz"), F.struct("avg_rabatt", name))
    best = F.min_by(F.struct(name, "avg_rabatt", "avg_marge"), F.struct("avg_rabatt", name))
    pair = groups.agg(worst.alias("w"), best.alias("b"))
    return pair.select(
        F.col(f"w.{name}").alias("schlechtester"),
        F.col("w.avg_rabatt").alias("schlechtester_rabatt"),
        F.col(f"b.{name}").alias("bester"),
        F.col("b.avg_rabatt").alias("bester_rabatt"),
        F.greatest(F.lit(0.0), F.col("w.umsatz") * (F.col("b.avg_marge") - F.col("w.avg_marge")) / 100).alias("potenzial"),
    )
