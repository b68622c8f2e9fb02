"""Product configuration: compatible chains of components, their margin and chance of winning.

Input: components (komponente_id, komponente_name, kategorie, listenpreis, herstellkosten, kompatibel_mit as a
comma list) and past offers (angebot_id, gewonnen, konfiguration as a comma list). Chains come from
equi-joins along undirected edges; the set overlap with past offers is an equi-join on components and a
count. With given edges instead of a list, pass edges directly.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.exprs import even
from tallyloom.sources.session import cut

CHAIN = ("Basis", "Antrieb", "Steuerung", "Gehäuse")
ACCESSORY = "Zubehör"
FALLBACK_RATE = 0.45


def id_list(column: str):
    """A comma list as an array of trimmed ids."""
    return F.filter(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def edges(components: DataFrame) -> DataFrame:
    """Both directions of each compatibility whose other end exists."""
    known = components.select(F.col("komponente_id").alias("b")).distinct()
    one = components.select(F.col("komponente_id").alias("a"), F.explode(id_list("kompatibel_mit")).alias("b")).join(known, "b", "left_semi").select("a", "b")
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def chains(components: DataFrame, compatible: DataFrame, basis: str | None = None, chain: tuple[str, ...] = CHAIN) -> DataFrame:
    """All valid chains c1..c4: neighbours in turn are compatible and of the categories in order."""
    kind = components.select("komponente_id", "kategorie")
    out = kind.where(F.col("kategorie") == chain[0]).select(F.col("komponente_id").alias("c1"))
    if basis is not None:
        out = out.where(F.col("c1") == basis)
    for i, category in enumerate(chain[1:], 1):
        step = compatible.join(kind.where(F.col("kategorie") == category).select(F.col("komponente_id").alias("b")), "b", "left_semi")
        out = out.join(step.select(F.col("a").alias(f"c{i}"), F.col("b").alias(f"c{i + 1}")), f"c{i}")
    return out.select(*[f"c{i + 1}" for i in range(len(chain))])


def win_rates(chain: DataFrame, offers: DataFrame, least: int = 2, fallback: float = FALLBACK_RATE) -> DataFrame:
    """chain with win_prob: the share won of offers with at least so many of its components (three digits).

    Offers are counted by the sets of components they hold, one from each place of a chain at most; how many hold
    at least so many of a chain's follows from the counts of its subsets (inclusion and exclusion). So chains meet
    counts of sets, never offers.
    """
    chain = cut(chain)  # read for each place and in the end
    names = [c for c in chain.columns if c.startswith("c")]
    places = None
    for i, c in enumerate(names):
        one = chain.select(F.lit(i).alias("slot"), F.col(c).alias("teil")).distinct()
        places = one if places is None else places.unionByName(one)
    parts = offers.select("angebot_id", "gewonnen", F.explode(F.array_distinct(id_list("konfiguration"))).alias("teil"))
    item = F.struct("slot", F.concat_ws(":", F.col("slot").cast("string"), "teil").alias("menge"))
    held = parts.join(places, "teil").groupBy("angebot_id").agg(F.max("gewonnen").alias("won"), F.sort_array(F.collect_set(item)).alias("teile"))
    sets, subsets = F.col("teile"), []
    every = []
    for size in range(1, len(names) + 1):
        if size > 1:  # each set with each component of a later place
            longer = lambda x: F.transform(F.filter("teile", lambda y: y["slot"] > x["slot"]), lambda y: F.struct(y["slot"].alias("slot"), F.concat_ws("|", x["menge"], y["menge"]).alias("menge")))
            sets = F.flatten(F.transform(sets, longer))
        if size >= least:
            every.append(sets)
            sign = (-1) ** (size - least) * comb(size - 1, least - 1)
            for some in combinations(range(len(names)), size):
                key = F.concat_ws("|", *[F.concat_ws(":", F.lit(str(i)), F.col(names[i])) for i in some])
                subsets.append(F.struct(F.lit(sign).alias("sign"), key.alias("menge")))
    counts = held.select("won", F.explode(F.concat(*every)).alias("s")).groupBy(F.col("s.menge").alias("menge")).agg(F.count("*").alias("n"), F.sum("won").alias("w"))
    own = chain.select(*names, F.explode(F.array(*subsets)).alias("s")).select(*names, "s.sign", "s.menge").join(counts, "menge")
    sums = own.groupBy(*names).agg(F.sum(F.col("sign") * F.col("n")).alias("n"), F.sum(F.col("sign") * F.col("w")).alias("w"))
    rate = sums.where("n > 0").select(*names, even(F.col("w").cast("double") / F.col("n"), 3).alias("win_prob"))
    return chain.join(rate, names, "left").withColumn("win_prob", F.coalesce("win_prob", F.lit(fallback)))


def accessories(chain: DataFrame, components: DataFrame, compatible: DataFrame, most: int = 2) -> DataFrame:
    """For each chain the dearest accessories that fit basis, drive or control (not the housing)."""
    names = [c for c in chain.columns if c.startswith("c")]
    extra = components.where(F.col("kategorie") == ACCESSORY).select(F.col("komponente_id").alias("b"), F.col("listenpreis").alias("preis"), F.col("herstellkosten").alias("kosten"))
    fits = chain.select(*names, F.explode(F.array(*names[:3])).alias("a")).join(compatible, "a").join(extra, "b").select(*names, "b", "preis", "kosten").distinct()
    best = Window.partitionBy(*names).orderBy(F.desc("preis"), "b")
    return fits.withColumn("nr", F.row_number().over(best)).where(F.col("nr") <= most)


def scored(components: DataFrame, offers: DataFrame, compatible: DataFrame | None = None, basis: str | None = None) -> DataFrame:
    """Chains with price, cost, margin in per cent, win_prob and score = margin x win_prob (unrounded in the product)."""
    compatible = edges(components) if compatible is None else compatible
    chain = cut(chains(components, compatible, basis))
    names = chain.columns
    price = components.select("komponente_id", F.col("listenpreis").cast("decimal(20,2)").alias("preis"), F.col("herstellkosten").cast("decimal(20,2)").alias("kosten"))
    own = chain.select(*names, F.explode(F.array(*names)).alias("komponente_id")).join(price, "komponente_id").select(*names, "preis", "kosten")
    extra = accessories(chain, components, compatible)
    every = own.unionByName(extra.select(*names, F.col("preis").cast("decimal(20,2)").alias("preis"), F.col("kosten").cast("decimal(20,2)").alias("kosten")))
    sums = every.groupBy(*names).agg(F.sum("preis").cast("double").alias("preis"), F.sum("kosten").cast("double").alias("kosten"))
    margin = F.coalesce(F.try_divide(F.col("preis") - F.col("kosten"), F.col("preis")) * 100, F.lit(0.0))
    rated = win_rates(chain, offers).join(sums, names)
    return rated.withColumns({"marge_pct": even(margin, 1), "score": even(margin * F.col("win_prob"), 2)})


def top(scores: DataFrame, n: int = 5) -> DataFrame:
    return scores.orderBy(F.desc("score"), *[c for c in scores.columns if c.startswith("c")]).limit(n)
