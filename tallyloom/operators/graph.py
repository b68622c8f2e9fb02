"""Graph operators over edge frames: personalised PageRank, communities."""

from __future__ import annotations

import heapq
from math import ceil, log

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.session import cut

ALPHA = 0.85


def purchase_edges(purchases: DataFrame) -> DataFrame:
    """Undirected weighted edges customer - product: the share of the customer's revenue, both directions.

    Customers without positive revenue and purchases without it have none.
    """
    own = purchases.groupBy("kunde_id", "produkt_id").agg(F.sum(F.col("umsatz").cast("decimal(28,4)")).alias("u"))
    total = own.groupBy("kunde_id").agg(F.sum("u").alias("t"))
    one = own.join(total, "kunde_id").where("t > 0 AND u > 0").select(F.concat(F.lit("k:"), F.col("kunde_id").cast("string")).alias("src"), F.concat(F.lit("p:"), F.col("produkt_id").cast("string")).alias("dst"), (F.col("u").cast("double") / F.col("t").cast("double")).alias("weight"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def steps_for(tolerance: float, alpha: float = ALPHA) -> int:
    """Steps after which the ranks are within tolerance (in sum) of where they settle, whatever the graph."""
    return max(1, ceil(log(tolerance / 2) / log(alpha)))


def personalised_pagerank(edges: DataFrame, starts: DataFrame, iterations: int | None = None, alpha: float = ALPHA, cut_every: int = 4, tolerance: float = 1e-6, back: float | None = None) -> DataFrame:
    """(start, node, score) for each start node (column start), within tolerance of the limit or after so many iterations.

    All starts advance together. Mass follows edges by weight; the rest, and what stands on nodes without edges, returns to the start. Each step
    is one equi-join with the edges and one sum; lineage is cut every few steps. back: the share that returns each step (1 - alpha), where edges
    stand for more than one step of a walk.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    moves = cut(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))  # read by every step
    starts = cut(starts.select("start").distinct())
    home = starts.select("start", F.col("start").alias("node"), F.lit(1.0 - alpha if back is None else back).alias("score"))
    stray = cut(starts.join(moves.select(F.col("src").alias("start")).distinct(), "start", "left_anti"))  # the only nodes without edges that mass can stand on
    mass = starts.select("start", F.col("start").alias("node"), F.lit(1.0).alias("score"))
    for i in range(steps_for(tolerance, alpha) if iterations is None else iterations):
        moved = mass.join(moves, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), (F.col("score") * F.col("p") * alpha).alias("score"))
        stuck = stray.select("start", F.col("start").alias("node"), F.lit(alpha).alias("score"))
        mass = moved.unionByName(stuck).unionByName(home).groupBy("start", "node").agg(F.sum("score").alias("score"))
        if (i + 1) % cut_every == 0:
            mass = cut(mass)
    return mass


def pushed_pagerank(edges: DataFrame, starts: DataFrame, tolerance: float = 1e-3, alpha: float = ALPHA, back: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(start, node, score) and (start, rest): personalised PageRank by forward push, and the mass of each start that wasn't pushed on.

    Each start's mass begins on its own node. A push leaves a share of a node's mass there as score and sends the rest on by weight. In each round only those nodes
    push whose mass is above an even share of the tolerance over all nodes of their start, and starts whose whole mass is below the
    tolerance are done: small masses wait and add up instead of spreading over the graph. The scores of a start are below the
    limit, in sum by the rest times back / (1 - alpha) exactly (mass on nodes without edges ends there).
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    moves = cut(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    share = 1.0 - alpha if back is None else back
    linked = moves.select(F.col("src").alias("start")).distinct().withColumn("linked", F.lit(True))
    # a start without edges keeps its mass
    begun = starts.select("start").distinct().join(linked, "start", "left").select("start", F.col("start").alias("node"), F.when(F.col("linked"), 1.0).otherwise(0.0).alias("mass"), F.when(F.col("linked"), 0.0).otherwise(share / (1.0 - alpha)).alias("score"))
    # dealt by start, as its sums want it; a start has a row for each node that its mass has reached
    state, of_start = begun.repartition("start"), Window.partitionBy("start")

    def marked(state: DataFrame) -> DataFrame:
        left, reached = F.sum("mass").over(of_start), F.count_if(F.col("mass") > 0).over(of_start)
        return state.withColumn("push", (left > tolerance) & (F.col("mass") * reached > tolerance))

    def pushed(marked: DataFrame) -> DataFrame:
        kept = marked.select("start", "node", F.when(F.col("push"), 0.0).otherwise(F.col("mass")).alias("mass"), F.when(F.col("push"), F.col("score") + F.col("mass") * share).otherwise(F.col("score")).alias("score"))
        moved = marked.where("push").join(moves, F.col("node") == F.col("src")).groupBy("start", F.col("dst").alias("node")).agg(F.sum(F.col("mass") * F.col("p") * alpha).alias("mass"), F.lit(0.0).alias("score"))
        return kept.unionByName(moved).repartition("start").groupBy("start", "node").agg(F.sum("mass").alias("mass"), F.sum("score").alias("score"))

    now = cut(marked(state))
    while not now.where("push").isEmpty():
        now = cut(marked(pushed(marked(pushed(now)))))  # two rounds for each write; without a node to push a round changes nothing
    return now.where("score > 0").select("start", "node", "score"), now.groupBy("start").agg(F.sum("mass").alias("rest"))


def greedy_modularity(nodes: int, pairs: list[tuple[int, int]]) -> list[int]:
    """Communities of an unweighted graph by joining, each time, the two whose union gains most modularity."""
    m = len(pairs)
    label = list(range(nodes))
    if not m:
        return label
    degree = [0] * nodes
    between: dict[int, dict[int, int]] = {i: {} for i in range(nodes)}
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
        between[a][b] = between[a].get(b, 0) + 1
        between[b][a] = between[b].get(a, 0) + 1
    # the gain of a union, times twice the square of m, in whole numbers: ties are exact and go to the smallest pair
    gain = lambda a, b: 2 * m * between[a][b] - degree[a] * degree[b]
    heap = [(-gain(a, b), a, b) for a in between for b in between[a] if a < b]
    heapq.heapify(heap)
    while heap:
        found, a, b = heapq.heappop(heap)
        if found >= 0:
            break
        if a not in between or b not in between[a] or -found != gain(a, b):
            continue  # from before one of them grew
        for c, n in between.pop(b).items():
            between[c].pop(b)
            if c != a:
                between[a][c] = between[c][a] = between[a].get(c, 0) + n
        degree[a] += degree[b]
        label[b] = a
        for c in between[a]:
            x, y = min(a, c), max(a, c)
            heapq.heappush(heap, (-gain(x, y), x, y))
    for i in range(nodes):  # a union keeps its smaller number
        label[i] = label[label[i]]
    return label


def communities(edges: DataFrame) -> DataFrame:
    """(node, community) of an undirected product graph (src < dst) by greedy modularity, at every size.

    The algorithm is sequential, so one task does it.
    """
    edges = edges.select(F.col("src").cast("string"), F.col("dst").cast("string")).distinct()

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*batch.src, *batch.dst})
        at = {n: i for i, n in enumerate(names)}
        found = greedy_modularity(len(names), sorted((at[a], at[b]) for a, b in zip(batch.src, batch.dst)))
        return pd.DataFrame({"node": names, "community": [names[c] for c in found]})

    return edges.groupBy(F.lit(0).alias("_one")).applyInPandas(run, "node string, community string")


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of communities (node, community) in an undirected graph whose edges (src, dst, weight) are given in both directions."""
    known = labels.select("node", "community")
    both = edges.join(known.withColumnsRenamed({"node": "src", "community": "a"}), "src").join(known.withColumnsRenamed({"node": "dst", "community": "b"}), "dst")
    sums = both.groupBy("a").agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inside"))
    r = sums.agg(F.sum("k").alias("all"), F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("squares")).first()
    return r["inside"] / r["all"] - r["squares"] / r["all"] ** 2 if r["all"] else 0.0


def moved_communities(edges: DataFrame, least_gain: float = 1e-4, most_rounds: int = 12) -> DataFrame:
    """(node, community) of an undirected graph (src < dst, a weight of 1 where there is none) by local moving and coarsening, over joins alone.

    In a round a changing half of the nodes may go to the neighbouring community that gains most modularity (of equal ones the one that sorts
    last); a round that lowers it is taken back, and nodes stop after two rounds of little gain. Communities then become the nodes of a smaller graph and the same begins anew,
    until nothing gains. Unlike communities() no task sees the graph; a node's edges are summed by community before they meet.
    """
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    one = edges.select(F.col("src").cast("string"), F.col("dst").cast("string"), weight.alias("weight")).where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))
    level = cut(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    total = level.agg(F.sum("weight")).first()[0] or 0.0
    whole = level.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    if not total:
        return whole
    reached = modularity(level, whole)
    while True:
        labels, before, idle = cut(level.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))), reached, 0
        degree = cut(level.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k")))
        for i in range(most_rounds):
            sizes = labels.join(degree, "node").groupBy("community").agg(F.sum("k").alias("size"))
            own = labels.join(degree, "node").withColumnRenamed("community", "own")
            near = level.where("src <> dst").join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("weight").alias("links"))
            # a node's own community counts without it; where it has no link there, staying gains nothing less what the community weighs
            stay = own.select("node", F.col("own").alias("community"), F.lit(0.0).alias("links"))
            each = near.unionByName(stay).groupBy("node", "community").agg(F.sum("links").alias("links")).join(own, "node").join(sizes, "community")
            rest = F.col("size") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
            gain = F.col("links") / total - F.col("k") * rest / (total * total)
            each = each.withColumn("gain", gain)
            best = each.groupBy("node", "own").agg(F.max_by("community", F.struct("gain", (F.col("community") == F.col("own")).alias("stays"))).alias("best"), F.max("gain").alias("most"), F.max(F.when(F.col("community") == F.col("own"), F.col("gain"))).alias("kept"))
            may = F.pmod(F.xxhash64("node", F.lit(i)), F.lit(2)) == 0
            after = cut(best.select("node", F.when(may & (F.col("most") > F.col("kept") + 1e-12), F.col("best")).otherwise(F.col("own")).alias("community")))
            got = modularity(level, after)
            idle = 0 if got > reached + least_gain else idle + 1
            if got > reached:
                labels, reached = after, got
            if idle == 2:
                break
        if reached <= before + least_gain / 10:
            return whole
        whole = cut(whole.withColumnRenamed("community", "_old").join(labels.withColumnRenamed("node", "_old"), "_old").select("node", "community"))
        name = lambda end: labels.select(F.col("node").alias(end), F.col("community").alias(f"{end}2"))
        level = cut(level.join(name("src"), "src").join(name("dst"), "dst").groupBy(F.col("src2").alias("src"), F.col("dst2").alias("dst")).agg(F.sum("weight").alias("weight")))
