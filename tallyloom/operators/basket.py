"""Cross-selling: which products are bought together and what to offer next.

Input: purchases with kunde_id, produkt_id and umsatz (and names). Ownership is kept as distinct
(customer, product) pairs. Product pairs come from an equi-join on the customer, never from all pairs;
the catalogue side of candidates is a product list, joined through products that were bought together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.exprs import even, exact_sum
from tallyloom.sources.session import cut, stored


def owned(purchases: DataFrame) -> DataFrame:
    """Distinct (customer, product) of positive revenue."""
    return purchases.groupBy("kunde_id", "produkt_id").agg(exact_sum(F.col("umsatz")).alias("umsatz")).where("umsatz > 0")


def kpis(purchases: DataFrame) -> DataFrame:
    return purchases.agg(F.count_distinct("kunde_id").alias("kunden"), F.count_distinct("produkt_id").alias("produkte"), F.count("*").alias("transaktionen"), exact_sum(F.col("umsatz")).alias("umsatz"))


def pairs(own: DataFrame) -> DataFrame:
    """For each pair a < b bought by one customer: customers, support, confidence a to b and lift (rounded as reported)."""
    a, b = own.select("kunde_id", F.col("produkt_id").alias("a")), own.select("kunde_id", F.col("produkt_id").alias("b"))
    both = a.join(b, "kunde_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return _rated(both, own.groupBy("produkt_id").agg(F.count("*").alias("n")), own.agg(F.count_distinct("kunde_id").alias("kunden")))


def _rated(both: DataFrame, single: DataFrame, total: DataFrame) -> DataFrame:
    """Support, confidence and lift of pairs (a, b, n), by the customers of single products (produkt_id, n) and of all (kunden)."""
    sa, sb = single.select(F.col("produkt_id").alias("a"), F.col("n").alias("na")), single.select(F.col("produkt_id").alias("b"), F.col("n").alias("nb"))
    n = F.col("kunden").cast("double")
    sup, pa, pb = F.col("n") / n, F.col("na") / n, F.col("nb") / n
    return (
        both.join(sa, "a").join(sb, "b").crossJoin(F.broadcast(total))
        .select("a", "b", "n", even(sup * 100, 1).alias("support_pct"), even(sup / pa * 100, 1).alias("konfidenz_pct"), even(sup / (pa * pb), 2).alias("lift"))
    )


def top_pairs(pair: DataFrame, n: int = 15) -> DataFrame:
    return pair.orderBy(F.desc("lift"), F.desc("n"), "a", "b").limit(n)


#: Products whose pairs are shipped to the tasks as a matrix (its square in doubles is 8 MB); a catalogue with more goes through joins.
MOST_PRODUCTS = 1_024


def recommend(own: DataFrame, pair: DataFrame, top: int = 3, most_products: int = MOST_PRODUCTS) -> DataFrame:
    """Per customer the top products not owned: the sum of customers times lift over what is owned, two digits.

    With at most most_products products each customer's products meet the pairs' matrix in the tasks (in hundredths, which doubles add up exactly), and only the best
    leave them. With more, products bought together come by a join, and nothing is shipped. Both give the same rows.
    """
    if own.select("produkt_id").distinct().limit(most_products + 1).count() > most_products:
        return _recommend_by_join(own, pair, top)
    return _recommend_by_matrix(own.groupBy("kunde_id").agg(F.collect_set("produkt_id").alias("mine")), dict(own.dtypes)["produkt_id"], pair.select("a", "b", "n", "lift").toPandas(), top)


def listed(purchases: DataFrame) -> DataFrame:
    """A row per customer, stored: mine (products of positive revenue in sum), teils (those with a line of positive revenue), kauft (whether any product, null too, has the first).

    Purchases are dealt by customer once; pairs, recommendations and evidence read the table. Lists have no order.
    """
    dealt = purchases.select("kunde_id", "produkt_id", "umsatz").repartition("kunde_id")
    each = dealt.groupBy("kunde_id", "produkt_id").agg((exact_sum(F.col("umsatz")) > 0).alias("_sum"), F.max(F.col("umsatz") > 0).alias("_any"))
    return stored(each.groupBy("kunde_id").agg(F.collect_list(F.when(F.col("_sum"), F.col("produkt_id"))).alias("mine"), F.collect_list(F.when(F.col("_any"), F.col("produkt_id"))).alias("teils"), F.coalesce(F.max("_sum"), F.lit(False)).alias("kauft")))


def products_of(lists: DataFrame, column: str, most: int) -> list | None:
    """The products in the lists in order, on the driver; none where there are more than most."""
    found = [r[0] for r in lists.select(F.explode(column).alias("p")).distinct().limit(most + 1).collect()]
    return sorted(found) if len(found) <= most else None


def recommend_listed(lists: DataFrame, top: int = 3, most_products: int = MOST_PRODUCTS) -> DataFrame:
    """recommend() of listed() purchases: pairs of products are counted where the lists are, a square for each task, and lists are not dealt again."""
    products = products_of(lists, "mine", most_products)
    if products is None:
        own = lists.select("kunde_id", F.explode("mine").alias("produkt_id"))
        return recommend(own, pairs(own), top, most_products)
    kind = dict(lists.dtypes)["mine"].removeprefix("array<").removesuffix(">")
    known = lists.where("kunde_id IS NOT NULL")
    at = {p: i for i, p in enumerate(products)}

    def count(batches):
        total = np.zeros((len(products), len(products)))
        for b in batches:
            for a in range(0, len(b), 1024):
                has = matrix(b.mine.iloc[a : a + 1024], at)
                total += has.T @ has
        i, j = np.nonzero(np.triu(total, 1))
        yield pd.DataFrame({"i": i, "j": j, "n": total[i, j].astype(np.int64)})

    names = lists.sparkSession.createDataFrame(list(zip(range(len(products)), products)), f"nr int, name {kind}")
    both = known.select("mine").mapInPandas(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    for place, name in (("i", "a"), ("j", "b")):
        both = both.join(F.broadcast(names.select(F.col("nr").alias(place), F.col("name").alias(name))), place).drop(place)
    single = lists.select(F.explode("mine").alias("produkt_id")).groupBy("produkt_id").agg(F.count("*").alias("n"))
    pair = _rated(both, single, known.where("kauft").agg(F.count("*").alias("kunden")))
    return _recommend_by_matrix(lists.select("kunde_id", "mine"), kind, pair.select("a", "b", "n", "lift").toPandas(), top)


def matrix(lists: pd.Series, at: dict) -> np.ndarray:
    """A row of ones and zeros for each list, a column for each product of at; others are left out."""
    has = np.zeros((len(lists), len(at)))
    for k, mine in enumerate(lists):
        has[k, [at[p] for p in mine if p in at]] = 1
    return has


def _recommend_by_matrix(lists: DataFrame, kind: str, rows: pd.DataFrame, top: int) -> DataFrame:
    products = sorted({*rows.a, *rows.b})
    at = {p: i for i, p in enumerate(products)}
    gain = np.zeros((len(products), len(products)))
    i, j = rows.a.map(at).to_numpy(np.int64), rows.b.map(at).to_numpy(np.int64)
    gain[i, j] = gain[j, i] = np.rint(rows.n.to_numpy(np.float64) * rows.lift.to_numpy(np.float64) * 100)

    def run(batches):
        for b in batches:
            for a in range(0, len(b), 1024):
                part = b.iloc[a : a + 1024]
                has = matrix(part.mine, at)
                score = np.where(has > 0, 0, has @ gain)
                best = np.argsort(-score, axis=1, kind="stable")[:, :top]  # equal scores: the product that sorts first
                value = np.take_along_axis(score, best, axis=1)
                who, rank = np.nonzero(value > 0)
                yield pd.DataFrame({"kunde_id": part.kunde_id.to_numpy()[who], "produkt_id": [products[p] for p in best[who, rank]], "score": value[who, rank] / 100, "rang": rank + 1})

    return lists.mapInPandas(run, f"kunde_id {dict(lists.dtypes)['kunde_id']}, produkt_id {kind}, score double, rang int")


def _recommend_by_join(own: DataFrame, pair: DataFrame, top: int) -> DataFrame:
    both = pair.select("a", "b", "n", "lift").unionByName(pair.select(F.col("b").alias("a"), F.col("a").alias("b"), "n", "lift"))
    gain = own.select("kunde_id", F.col("produkt_id").alias("a")).join(both, "a")
    score = gain.groupBy("kunde_id", F.col("b").alias("produkt_id")).agg(even(exact_sum(F.col("n") * F.col("lift"), 2), 2).alias("score"))
    fresh = score.join(own.select("kunde_id", "produkt_id"), ["kunde_id", "produkt_id"], "left_anti").where("score > 0")
    rank = Window.partitionBy("kunde_id").orderBy(F.desc("score"), "produkt_id")
    return fresh.withColumn("rang", F.row_number().over(rank)).where(F.col("rang") <= top)


def evidence(own: DataFrame, recommended: DataFrame, most: int = 3, first: int = 16) -> DataFrame:
    """For each recommendation the first buyers of it who share a product with the customer, and how many they share.

    The first buyers by id of each product are looked at first, which is enough nearly always; recommendations that find too few among them
    go on to all buyers.
    """
    wanted = cut(recommended.select("kunde_id", "produkt_id"))
    numbers = cut(own.select("produkt_id").distinct().withColumn("_nr", F.monotonically_increasing_id()))
    lists = cut(own.join(numbers, "produkt_id").groupBy("kunde_id").agg(F.collect_list("_nr").alias("liste")))
    buyers = own.select(F.col("kunde_id").alias("anderer"), "produkt_id")
    theirs = lists.select(F.col("kunde_id").alias("anderer"), F.col("liste").alias("deren"))
    order = Window.partitionBy("kunde_id", "produkt_id").orderBy("anderer")

    def among(asked: DataFrame, some: DataFrame) -> DataFrame:
        near = asked.join(some, "produkt_id").where("anderer <> kunde_id").join(lists, "kunde_id").join(theirs, "anderer")
        shared = near.select("kunde_id", "produkt_id", "anderer", F.size(F.array_intersect("liste", "deren")).cast("long").alias("gemeinsam")).where("gemeinsam > 0")
        return shared.withColumn("nr", F.row_number().over(order)).where(F.col("nr") <= most)

    by_id = Window.partitionBy("produkt_id").orderBy("anderer")
    few = cut(among(wanted, buyers.withColumn("_r", F.row_number().over(by_id)).where(F.col("_r") <= first).drop("_r")))
    many = buyers.groupBy("produkt_id").agg(F.count("*").alias("_n")).where(F.col("_n") > first).select("produkt_id")
    done = few.groupBy("kunde_id", "produkt_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= most)
    rest = cut(wanted.join(done, ["kunde_id", "produkt_id"], "left_anti").join(many, "produkt_id", "left_semi"))
    if rest.isEmpty():
        return few
    return few.join(rest, ["kunde_id", "produkt_id"], "left_anti").unionByName(among(rest, buyers))


def customers(purchases: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Customers with their sorted products and revenue, and the columns carried: attributes of the customer, the least of each where rows differ."""
    own = [F.min(c).alias(c) for c in carried]
    return purchases.groupBy("kunde_id").agg(*own, F.concat_ws(", ", F.sort_array(F.collect_set("produkt_id"))).alias("produkte"), F.count_distinct("produkt_id").alias("n_produkte"), exact_sum(F.col("umsatz")).alias("umsatz"))


def purchases_of(purchases: DataFrame) -> DataFrame:
    """Customer, product, category: purchases and revenue."""
    return purchases.groupBy("kunde_id", "produkt_id", "kategorie").agg(F.count("*").alias("n"), exact_sum(F.col("umsatz")).alias("umsatz"))
