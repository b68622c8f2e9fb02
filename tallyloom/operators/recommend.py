"""Hybrid recommender: personalised PageRank on purchases and a low-rank model, over what a customer doesn't own.

Input: purchases (kunde_id, produkt_id, jahr, menge, einzelpreis, umsatz).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.exprs import even
from tallyloom.operators import basket, graph
from tallyloom.sources.session import cut, stored

PPR_SHARE, SVD_SHARE, RANK = 0.6, 0.4, 4
#: Catalogues up to so many products are compared as matrices.
BITS = 1024
#: Sets of a tile that ask, bytes of the sets that they meet there, and the sets of a row of the table that is dealt to all tiles.
ASKING, TILE_BYTES, ROWS_OF_BLOCK = 65_536, 32 << 20, 2048
#: Sets that are compared with sets of one size at once.
ROWS, COLUMNS = 256, 4096


def numbered(purchases: DataFrame) -> tuple[list, DataFrame]:
    """The products in order, on the driver, and (produkt_id, nr)."""
    products = [r[0] for r in purchases.select("produkt_id").where("produkt_id IS NOT NULL").distinct().orderBy("produkt_id").collect()]
    return products, purchases.sparkSession.createDataFrame(list(zip(products, range(len(products)))), f"produkt_id {dict(purchases.dtypes)['produkt_id']}, nr int")


def customer_vectors(purchases: DataFrame, numbers: DataFrame) -> DataFrame:
    """kunde_id, nr, x: each customer's products by number, and the logarithms of their revenue; written, as every pass reads them."""
    own = purchases.groupBy("kunde_id", "produkt_id").agg(F.log1p(F.greatest(F.lit(0.0), F.sum(F.col("umsatz").cast("decimal(28,4)")).cast("double"))).alias("x"))
    cell = F.array_sort(F.collect_list(F.struct("nr", "x")))
    return cut(own.join(numbers, "produkt_id").groupBy("kunde_id").agg(cell.alias("c")).select("kunde_id", F.col("c.nr").alias("nr"), F.col("c.x").alias("x")))


def projected(batch: pd.DataFrame, vectors: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells of a batch (customer, product, value), the customers' means over all products, and their centred rows times vectors.

    total: the sum of vectors over the products. Only the cells that a customer has are looked at; centring is a term of its own.
    """
    who = np.repeat(np.arange(len(batch)), batch.nr.str.len().to_numpy(np.int64))
    at, x = np.concatenate(batch.nr.to_list()), np.concatenate(batch.x.to_list())
    mean = np.bincount(who, x, len(batch)) / len(vectors)
    out = np.column_stack([np.bincount(who, x * vectors[at, j], len(batch)) for j in range(vectors.shape[1])])
    return who, at, x, mean, out - mean[:, None] * total


def dense(nr: pd.Series, values: pd.Series, n: int) -> np.ndarray:
    """A row of n numbers for each customer."""
    out = np.zeros((len(nr), n))
    if len(nr):
        out[np.repeat(np.arange(len(nr)), nr.str.len().to_numpy(np.int64)), np.concatenate(nr.to_list())] = np.concatenate(values.to_list())
    return out


def gram(rows: DataFrame, n: int, column: str, centred: bool = False, even_out: bool = False) -> np.ndarray:
    """The sum over customers of their rows times their rows (centred; or the second to a sum of 1), products by products (at most BITS each way): a square for each task, these added up by row."""

    def run(batches):
        total = np.zeros((n, n))
        for part in pieces(batches, n):
            a = dense(part.nr, part[column], n)
            if centred:
                a -= a.mean(axis=1, keepdims=True)
            total += a.T @ (a / a.sum(axis=1, keepdims=True) if even_out else a)
        if total.any():
            yield pd.DataFrame({"nr": range(n), "g": list(total)})

    def added(some: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"nr": some.nr.iloc[:1], "g": [np.sum(some.g.to_list(), axis=0)]})

    out, schema = np.zeros((n, n)), "nr int, g array<double>"
    for r in rows.select("nr", column).mapInPandas(run, schema).groupBy("nr").applyInPandas(added, schema).collect():
        out[r.nr] = r.g
    return out


def shares(purchases: DataFrame, numbers: DataFrame) -> DataFrame:
    """kunde_id, nr, w for customers with revenue: products by number (null: none), and their shares of the customer's revenue, as graph.purchase_edges."""
    own = purchases.groupBy("kunde_id", "produkt_id").agg(F.sum(F.col("umsatz").cast("decimal(28,4)")).alias("u")).join(F.broadcast(numbers), "produkt_id", "left")
    cells = F.array_sort(F.collect_list(F.when(F.col("u") > 0, F.struct("nr", F.col("u").cast("double").alias("u")))))
    packed = own.groupBy("kunde_id").agg(F.sum("u").alias("t"), cells.alias("c")).where((F.col("t") > 0) & (F.size("c") > 0))
    return packed.select("kunde_id", F.col("c.nr").alias("nr"), F.transform("c", lambda c: c["u"] / F.col("t").cast("double")).alias("w"))


def ranks_of_one(purchases: DataFrame, start: DataFrame, tolerance: float) -> DataFrame:
    """(start, node, score): personalised PageRank of all customers and products for one customer (start, one row), as graph.personalised_pagerank on graph.purchase_edges.

    Mass on customers comes from the products of the step before, so the steps are taken among products, by their square of shared customers,
    and customers are found from the last but one: their shares, a row each, are all that is written. Catalogues over BITS products, and
    purchases without customer or product, go by joins of edges.
    """
    spark, alpha, steps = purchases.sparkSession, graph.ALPHA, graph.steps_for(tolerance)
    products, numbers = numbered(purchases)
    n = len(products)
    by_edges = lambda: graph.personalised_pagerank(graph.purchase_edges(purchases), start, tolerance=tolerance)
    if not 0 < n <= BITS:
        return by_edges()
    rows = cut(shares(purchases, numbers).withColumn("k", F.concat(F.lit("k:"), F.col("kunde_id").cast("string"))))
    if not rows.where("k IS NULL OR exists(nr, x -> x IS NULL)").isEmpty():
        return by_edges()
    who = [r.start for r in start.limit(2).collect()]
    home = rows.where(F.col("k").isin(who)).select("nr", "w").collect()
    if len(who) != 1 or len(home) != 1:  # none, several, or one without revenue
        return by_edges()
    both = gram(rows, n, "w", even_out=True)
    total = both.sum(axis=1)
    move = np.divide(both, total[:, None], out=np.zeros_like(both), where=total[:, None] > 0)
    own = np.zeros(n)
    own[home[0].nr] = home[0].w
    own /= own.sum()
    before, now = np.zeros(n), alpha * own  # products before and after the first step
    for _ in range(steps - 1):
        before, now = now, alpha * alpha * (before @ move) + alpha * (1.0 - alpha) * own
    each = np.divide(before, total, out=np.zeros(n), where=total > 0) * alpha
    kept = spark.sparkContext.broadcast(each)
    one, back = who[0], 1.0 - alpha

    def found(batches):
        for b in batches:
            if len(b):
                score = np.bincount(np.repeat(np.arange(len(b)), b.nr.str.len().to_numpy(np.int64)), kept.value[np.concatenate(b.nr.to_list())] * np.concatenate(b.w.to_list()), len(b))
                yield pd.DataFrame({"start": one, "node": b.k, "score": score + back * (b.k == one)})

    schema = "start string, node string, score double"
    customers = rows.select("k", "nr", "w").mapInPandas(found, schema)
    return customers.unionByName(spark.createDataFrame([(one, f"p:{p}", float(y)) for p, y in zip(products, now)], schema)).where("score > 0")


def gram_times(rows: DataFrame, vectors: np.ndarray) -> np.ndarray:
    """The centred matrix, transposed, times the matrix times vectors: one pass; products times vectors is all that is shipped and summed."""
    shipped, width = rows.sparkSession.sparkContext.broadcast(vectors), vectors.shape[1]
    total = vectors.sum(axis=0)

    def run(batches):
        off = np.zeros(width)
        for b in batches:
            if len(b):
                who, at, x, mean, y = projected(b, shipped.value, total)
                off -= mean @ y
                some, place = np.unique(at, return_inverse=True)
                yield pd.DataFrame({"nr": some, "z": np.column_stack([np.bincount(place, x * y[who, j], len(some)) for j in range(width)]).tolist()})
        yield pd.DataFrame({"nr": [-1], "z": [off.tolist()]})

    parts = rows.select("nr", "x").mapInPandas(run, "nr int, z array<double>")
    out, off = np.zeros_like(vectors), np.zeros(width)
    for r in parts.groupBy("nr").agg(F.array(*[F.sum(F.col("z")[j]) for j in range(width)]).alias("z")).collect():
        if r.nr < 0:
            off = np.array(r.z)
        else:
            out[r.nr] = r.z
    shipped.destroy()
    return out + off


def triangle(rows: DataFrame, vectors: np.ndarray, fan: int = 16) -> np.ndarray:
    """R of the QR decomposition of the centred matrix times vectors: a task's customers to one small triangle, these to fan ones, and these to one."""
    shipped, width = rows.sparkSession.sparkContext.broadcast(vectors), vectors.shape[1]
    total = vectors.sum(axis=0)

    def folded(blocks):
        r = np.zeros((0, width))
        for block in blocks:
            r = np.linalg.qr(np.vstack([r, block]), mode="r")
        return pd.DataFrame({"r": pd.Series(r.tolist(), dtype=object)})

    def first(batches):
        yield folded(projected(b, shipped.value, total)[4] for b in batches if len(b))

    def again(batches):
        yield folded(np.array(b.r.to_list()) for b in batches if len(b))

    tall = rows.select("nr", "x").mapInPandas(first, "r array<double>").repartition(fan).mapInPandas(again, "r array<double>")
    return np.linalg.qr(np.array([r.r for r in tall.collect()] or np.zeros((1, width))), mode="r")


def singular(rows: DataFrame, n: int, k: int, tolerance: float = 1e-9, extra: int = 8, blocks: int = 10, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values of the customers' centred vectors over n products, and their right vectors (n by k).

    A randomised range finder: a few random columns more than k are multiplied by the matrix and its transpose, and what each pass adds joins the sketch, until
    the vectors found from the sketch are ones of the matrix to the tolerance. Catalogues up to BITS products take one pass for their square, and no more. A sketch of blocks passes starts again from its best
    columns. The driver holds n times (k + extra) times blocks numbers; values come from the triangle of the matrix times the vectors.
    """
    square = gram(rows, n, "x", centred=True) if n <= BITS else None
    width = min(n, k + extra)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))[0]
    basis, images = np.zeros((n, 0)), np.zeros((n, 0))
    for _ in range(50 * blocks):
        basis, images = np.hstack([basis, block]), np.hstack([images, image := gram_times(rows, block) if square is None else square @ block])
        inner = basis.T @ images
        values, mix = np.linalg.eigh((inner + inner.T) / 2)
        best = mix[:, ::-1][:, :width]
        vectors, moved = basis @ best, images @ best
        missing = np.linalg.norm(moved[:, :k] - vectors[:, :k] * values[::-1][:k], axis=0)
        if missing.max() <= tolerance * max(values[-1], 1e-300):
            break
        if basis.shape[1] + width > width * blocks:
            basis, images, image = vectors, moved, moved
        for _ in range(2):
            image = image - basis @ (basis.T @ image)
        block, size = np.linalg.qr(image)
        block = block[:, np.abs(np.diag(size)) > 1e-13 * max(values[-1], 1e-300)]
        block = block - basis @ (basis.T @ block)
        block = np.linalg.qr(block)[0] if block.shape[1] else block
        if not block.shape[1]:
            break  # the sketch holds all there is
    _, sizes, turn = np.linalg.svd(triangle(rows, vectors[:, :k]))
    return sizes[:k], vectors[:, :k] @ turn.T


def factors(purchases: DataFrame, rank: int = RANK) -> tuple[list, DataFrame, DataFrame, np.ndarray]:
    """Products, their numbers, customers' vectors and the right vectors of the low-rank model (none where there is too little to tell)."""
    products, numbers = numbered(purchases)
    rows = customer_vectors(purchases, numbers)
    n, customers = len(products), rows.limit(rank + 1).count()
    k = min(rank, customers - 1, n - 1)
    return products, numbers, rows, singular(rows, n, k)[1] if k > 0 else np.zeros((n, 0))


def low_rank(purchases: DataFrame, rank: int = RANK) -> DataFrame:
    """(kunde_id, produkt_id, svd): log revenue, centred by customer, rebuilt from its first singular vectors, for all customers and products."""
    products, _, rows, vectors = factors(purchases, rank)
    kinds = dict(purchases.dtypes)
    schema = f"kunde_id {kinds['kunde_id']}, produkt_id {kinds['produkt_id']}, svd double"
    if not vectors.shape[1]:
        return purchases.sparkSession.createDataFrame([], schema)
    shipped, names = purchases.sparkSession.sparkContext.broadcast((vectors, np.array(products, object))), len(products)

    def rebuild(batches):
        vectors, products = shipped.value
        for part in pieces(batches, names):
            _, _, _, mean, y = projected(part, vectors, vectors.sum(axis=0))
            yield pd.DataFrame({"kunde_id": np.repeat(part.kunde_id.to_numpy(), names), "produkt_id": np.tile(products, len(part)), "svd": (y @ vectors.T + mean[:, None]).ravel()})

    return rows.mapInPandas(rebuild, schema)


def pieces(batches, width: int, cells: int = 1 << 21):
    """Parts of the batches that make at most so many cells of width columns."""
    step = max(1, cells // max(1, width))
    for b in batches:
        for a in range(0, len(b), step):
            yield b.iloc[a : a + step].reset_index(drop=True)


def customer_ranks(purchases: DataFrame, iterations: int | None = None, tolerance: float = 1e-3) -> DataFrame:
    """(kunde_id, produkt_id, ppr): personalised PageRank of products for every customer, to a tolerance (by forward push) or after so many steps (an even number).

    A walk that starts at a customer is, after its first step, a mix of walks that start at the customer's
    products. So only the products' ranks are found, over the way from product to customer to product as one step, and each customer adds up those it owns.
    What the push leaves over is at most the tolerance for each product, and so for each customer.
    """
    edges = cut(graph.purchase_edges(purchases))
    first = edges.where(F.col("src").startswith("k:")).select(F.col("src").alias("k"), F.col("dst").alias("start"), "weight")
    total = edges.where(F.col("src").startswith("p:")).groupBy("src").agg(F.sum("weight").alias("total"))
    buyers = edges.join(total, "src").select("src", F.col("dst").alias("k"), (F.col("weight") / F.col("total")).alias("p"))
    between = buyers.join(first.withColumnsRenamed({"start": "dst", "weight": "w"}), "k").groupBy("src", "dst").agg(F.sum(F.col("p") * F.col("w")).alias("weight"))
    double, starts = graph.ALPHA**2, between.select(F.col("src").alias("start"))
    if iterations is None:
        ranks, _ = graph.pushed_pagerank(between, starts, tolerance, double, back=1.0 - graph.ALPHA)
    else:
        ranks = graph.personalised_pagerank(between, starts, iterations // 2, double, back=1.0 - graph.ALPHA)
    mixed = first.join(ranks, "start").groupBy("k", "node").agg(F.sum(F.col("weight") * F.col("score") * graph.ALPHA).alias("ppr"))
    return mixed.select(F.substring("k", 3, 1 << 30).alias("kunde"), F.substring("node", 3, 1 << 30).alias("produkt"), "ppr")


def product_ranks(rows: DataFrame, n: int, iterations: int | None) -> np.ndarray:
    """The ranks of customer_ranks before they are mixed, times what a customer's first step keeps: a row for each product walked from; exact where iterations is none."""
    both = gram(rows, n, "w")
    total, double, back = both.sum(axis=1), graph.ALPHA**2, 1.0 - graph.ALPHA
    linked = total > 0
    move = np.divide(both, total[:, None], out=np.zeros_like(both), where=linked[:, None])
    if iterations is None:
        ranks = back * np.linalg.inv(np.eye(n) - double * move)
    else:
        ranks = np.eye(n)
        for _ in range(iterations // 2):
            ranks = double * ranks @ move + back * np.eye(n)
    return ranks * linked[:, None] * graph.ALPHA


def scaled(x: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Rows scaled to 0..1 over their free cells; 0.5 where all are equal."""
    low = np.where(free, x, np.inf).min(axis=1, keepdims=True)
    width = np.where(free, x, -np.inf).max(axis=1, keepdims=True) - low
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(width < 1e-12, 0.5, (x - low) / width)


def ranks_by_joins(purchases: DataFrame, numbers: DataFrame, iterations: int | None) -> DataFrame:
    """kunde, rank_nr, rank_ppr: each customer's ranks as arrays."""
    rank = customer_ranks(purchases, iterations).join(numbers.withColumn("produkt", F.col("produkt_id").cast("string")), "produkt")
    return rank.groupBy("kunde").agg(F.collect_list("nr").alias("rank_nr"), F.collect_list("ppr").alias("rank_ppr"))


def hybrid(purchases: DataFrame, iterations: int | None = None, top: int | None = None) -> DataFrame:
    """Per customer products not owned: ppr and svd (scaled), hybrid, match of 45 to 97, rank; the top ones or all.

    A customer's scores of all products are rebuilt in its task, a few customers at a time, and only the top ones leave it: customers times products is never
    written. Tasks hold the products' vectors, products times RANK numbers.
    """
    spark, kinds = purchases.sparkSession, dict(purchases.dtypes)
    products, numbers, rows, vectors = factors(purchases)
    schema = f"kunde_id {kinds['kunde_id']}, nr int, ppr double, svd double, hybrid double, low double, high double, rang int"
    if not vectors.shape[1]:
        rows = rows.limit(0)
    own = purchases.where("umsatz > 0").join(numbers, "produkt_id").groupBy("kunde_id").agg(F.collect_set("nr").alias("mine"))
    n = len(products)
    part = cut(shares(purchases.where("kunde_id IS NOT NULL"), numbers)) if 0 < n <= BITS and vectors.shape[1] else None
    if part is not None and part.where("exists(nr, x -> x IS NULL)").isEmpty():
        # a customer's ranks are a product of its shares and the products' ranks, made in the task that wants them
        kept = spark.sparkContext.broadcast(product_ranks(part, n, iterations))
        rank = part.select(F.col("kunde_id").cast("string").alias("kunde"), F.col("nr").alias("rank_nr"), F.col("w").alias("rank_ppr"))
    else:
        kept, rank = None, ranks_by_joins(purchases, numbers, iterations)
    each = rows.join(own, "kunde_id").join(rank, F.col("kunde_id").cast("string") == F.col("kunde"), "left").drop("kunde")
    shipped = spark.sparkContext.broadcast(vectors)

    def run(batches):
        vectors = shipped.value
        total = vectors.sum(axis=0)
        for part in pieces(batches, n):
            _, _, _, mean, y = projected(part, vectors, total)
            svd, ppr, free = y @ vectors.T + mean[:, None], np.zeros((len(part), n)), np.ones((len(part), n), bool)
            for i, (mine, nr, value) in enumerate(zip(part.mine, part.rank_nr, part.rank_ppr)):
                free[i, mine] = False
                if nr is not None:
                    ppr[i, nr] = value
            if kept is not None:
                ppr = ppr @ kept.value
            keep = free.any(axis=1)
            svd, ppr, free, who = svd[keep], ppr[keep], free[keep], part.kunde_id.to_numpy()[keep]
            svd, ppr = scaled(svd, free), scaled(ppr, free)
            both = np.where(free, ppr * PPR_SHARE + svd * SVD_SHARE, -np.inf)
            low, high = np.where(free, both, np.inf).min(axis=1, initial=np.inf), both.max(axis=1, initial=-np.inf)
            best = np.argsort(-both, axis=1, kind="stable")[:, : n if top is None else top]  # equal scores: the product that sorts first
            i, place = np.nonzero(np.take_along_axis(free, best, axis=1))
            nr = best[i, place]
            yield pd.DataFrame({"kunde_id": who[i], "nr": nr, "ppr": ppr[i, nr], "svd": svd[i, nr], "hybrid": both[i, nr], "low": low[i], "high": high[i], "rang": place + 1})

    found = each.mapInPandas(run, schema).join(numbers, "nr")
    match = even(F.when(F.col("high") - F.col("low") > 0, F.try_divide(F.col("hybrid") - F.col("low"), F.col("high") - F.col("low"))).otherwise(1.0) * 52 + 45)
    return found.select("kunde_id", "produkt_id", "ppr", "svd", "hybrid", match.alias("match"), "rang")


def product_values(purchases: DataFrame) -> DataFrame:
    """Median price over all years, median quantity of the latest year (1 if none), and their product to the tens."""
    latest = purchases.agg(F.max("jahr").alias("_latest"))
    out = purchases.crossJoin(F.broadcast(latest)).groupBy("produkt_id").agg(F.median("einzelpreis").alias("preis"), F.coalesce(F.median(F.when(F.col("jahr") == F.col("_latest"), F.col("menge"))), F.lit(1.0)).alias("menge"))
    return out.withColumn("jahreswert", even(F.col("preis") * F.col("menge"), -1))


def coverage(purchases: DataFrame) -> DataFrame:
    """Per customer the share of the catalogue that is owned, in per cent."""
    total = purchases.agg(F.count_distinct("produkt_id").alias("_all"))
    own = purchases.where("umsatz > 0").groupBy("kunde_id").agg(F.count_distinct("produkt_id").alias("n_produkte"))
    return own.crossJoin(F.broadcast(total)).select("kunde_id", "n_produkte", even(F.col("n_produkte") / F.col("_all") * 100).alias("abdeckung_pct"))


def masked(lists: DataFrame, products: list) -> DataFrame:
    """kunde_id, maske: a bit for each product of teils, in words of 64."""
    width = 64 * (-(-len(products) // 64) or 1)

    def run(batches):
        for b in batches:
            teils = b.column(1)
            bits = np.zeros((b.num_rows, width), np.uint8)
            nr = pc.index_in(teils.flatten(), value_set=pa.array(products, teils.type.value_type)).to_numpy(zero_copy_only=False)
            bits[np.repeat(np.arange(b.num_rows), pc.list_value_length(teils).to_numpy(zero_copy_only=False)), nr] = 1
            data = np.packbits(bits, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in data], pa.binary())], names=["kunde_id", "maske"])

    return lists.select("kunde_id", "teils").mapInArrow(run, f"kunde_id {dict(lists.dtypes)['kunde_id']}, maske binary")


def words(masks) -> np.ndarray:
    """Masks (bytes) as rows of words."""
    return np.frombuffer(b"".join(masks), np.uint64).reshape(len(masks), -1)


def has(masks: np.ndarray, nr) -> np.ndarray:
    nr = np.broadcast_to(np.asarray(nr, np.int64), len(masks))
    return (masks[np.arange(len(masks)), nr >> 6] >> (nr & 63).astype(np.uint64)) & np.uint64(1) != 0


def rank_of(shared: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number that orders by Jaccard similarity (four digits, half even), then by the shared products; 0 where nothing is shared."""
    return np.where(shared > 0, np.rint(shared / np.maximum(sizes - shared, 1) * 1e4) * 2 * BITS + shared, 0).astype(np.int32)


def counted(a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The products that each row of a shares with each of b."""
    both = room[: len(a) * len(b)].reshape(len(a), len(b))
    out = np.bitwise_count(np.bitwise_and(a[:, :1], b[:, 0], out=both))
    out = out if a.shape[1] < 4 else out.astype(np.uint16)
    for k in range(1, a.shape[1]):
        out += np.bitwise_count(np.bitwise_and(a[:, k : k + 1], b[:, k], out=both))
    return out


def best_sets(mine: np.ndarray, will: list, at: np.ndarray, theirs: np.ndarray, most: int) -> list[np.ndarray]:
    """For each wanted product (will: a list for each row of mine) the most rows of theirs with it that are most alike: row of mine, product, at, rank.

    Ranks are those of rank_of(); of equals the least at is taken, and none share nothing. Rows are words of bits. Sets of like size meet first; once a wanted product has its
    most, its last one tells how many products a set of a size must share, and sizes too small or too large are passed over.
    """
    y, x = (np.bitwise_count(z).sum(axis=1, dtype=np.int64) for z in (theirs, mine))
    order = np.lexsort((at, y))
    at, theirs, y = at[order], theirs[order], y[order]
    ends = [*np.flatnonzero(np.diff(y)) + 1, len(y)]
    cuts = [(k, min(k + COLUMNS, e)) for s, e in zip([0, *ends], ends) for k in range(s, e, COLUMNS)]
    size = np.array([y[s] for s, _ in cuts])
    many = np.array([len(w) for w in will])
    room, marks, out = np.empty(ROWS * COLUMNS, np.uint64), np.zeros(ROWS * COLUMNS + 8, bool), []
    by_size = np.argsort(x, kind="stable")
    for g in range(0, len(mine), ROWS):
        rows = by_size[g : g + ROWS]
        a, ax, each = mine[rows], x[rows], many[rows]
        start = np.r_[0, np.cumsum(each)]
        who, nr = np.repeat(np.arange(len(rows)), each), np.concatenate([will[r] for r in rows])
        best, zu = np.zeros((len(nr), most), np.int32), np.zeros((len(nr), most), np.int64)
        limit = np.full(len(rows), np.inf)  # shared products by both sizes that a row asks for, of wanted products that have their most
        waiting, count = [], 0

        def settle(waiting=waiting):
            place, one, rank = (np.concatenate(z) for z in zip((np.repeat(np.arange(len(nr)), most), zu.ravel(), best.ravel()), *waiting))  # noqa: B023
            waiting.clear()
            k = np.lexsort((one, -rank.astype(np.int64), place))
            k = k[np.arange(len(k)) - np.searchsorted(place[k], place[k]) < most]
            best[:], zu[:] = rank[k].reshape(-1, most), one[k].reshape(-1, most)  # noqa: B023
            alike = (best[:, -1] // (2 * BITS) - 0.5) / 1e4  # noqa: B023
            limit[:] = np.minimum.reduceat(np.where(best[:, -1] > 0, alike / (1 + alike), np.inf), start[:-1])  # noqa: B023

        for c in np.argsort(np.abs(size - np.median(ax)), kind="stable"):
            b, by, bat = theirs[slice(*cuts[c])], size[c], at[slice(*cuts[c])]
            least = best[:, -1]
            need = np.ceil(limit * (ax + by) - 1e-9)
            live = np.flatnonzero(need <= np.minimum(ax, by))
            if len(live):
                n = counted(a[live], b, room)
                low = need[live, None].clip(1).astype(n.dtype)
                held = marks[: n.size].reshape(n.shape)
                np.greater_equal(n, low, out=held)
                marks[n.size : n.size + 8] = False
                hit = np.flatnonzero(marks[: -(-n.size // 8) * 8].view(np.uint64))
                hit = (hit[:, None] * 8 + np.arange(8)).ravel()
                hit = hit[marks[hit]]
                i, j = live[hit // len(b)], hit % len(b)
                w = np.repeat(start[i] + each[i] - np.cumsum(each[i]), each[i]) + np.arange(each[i].sum())
                j, hit = np.repeat(j, each[i]), np.repeat(hit, each[i])
                good = (least[w] > 0) & has(b[j], nr[w])
                w, j, hit = w[good], j[good], hit[good]
                rank = rank_of(n.ravel()[hit].astype(np.int64), ax[who[w]] + by)
                good = rank >= least[w]
                waiting.append((w[good], bat[j[good]], rank[good]))
                count += good.sum()
            few = np.flatnonzero(least == 0)
            for p in np.unique(nr[few]):
                w, j = few[nr[few] == p], np.flatnonzero(has(b, p))
                if len(j):
                    rank = rank_of(counted(a[who[w]], b[j], room if len(w) * len(j) <= len(room) else np.empty(len(w) * len(j), np.uint64)).astype(np.int64), ax[who[w], None] + by)
                    for _ in range(most):
                        k = rank.argmax(axis=1)
                        value = rank[np.arange(len(w)), k]
                        waiting.append((w[value > 0], bat[j[k[value > 0]]], value[value > 0]))
                        rank[np.arange(len(w)), k] = 0
                    count += len(nr)
            if count >= len(nr):
                settle()
                count = 0
        if waiting:
            settle()
        k = best > 0
        out.append((np.repeat(rows[who], k.sum(axis=1)), np.repeat(nr, k.sum(axis=1)), zu[k], best[k]))
    return [np.concatenate(z) for z in zip(*out)]


def _nearest_sets(sets: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """(von, nr, zu, rank): for each set and product number of asked the most alike sets with that product.

    sets: at (in the order that settles ties), maske; asked: at, maske, will. Sets that ask are dealt in tiles, all sets in parts of bounded size, and each tile
    meets each part in one task: what is dealt is the sets once for each tile, a few bytes each, and never pairs of them.
    """
    cores, n, m = sets.sparkSession.sparkContext.defaultParallelism, sets.count(), asked.count()
    width = len((asked.select("maske").first() or [b""])[0]) + 8
    tiles, parts = max(-(-m // ASKING), min(3 * cores, -(-m // ROWS))) or 1, -(-n * width // TILE_BYTES) or 1
    block = F.pmod(F.xxhash64("at"), F.lit(max(parts, -(-n // ROWS_OF_BLOCK)))).cast("int")
    packed = F.collect_list(F.struct("at", "maske"))
    right = sets.groupBy(block.alias("block")).agg(packed.alias("_p")).select(F.pmod("block", F.lit(parts)).alias("part"), F.col("_p.at").alias("zu"), F.col("_p.maske").alias("deren"))
    right = right.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    left = asked.withColumn("tile", F.pmod(F.xxhash64("at"), F.lit(tiles)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 4
        if a.num_rows and b.num_rows:
            at = np.concatenate([c.flatten().to_numpy() for c in b.column("zu").chunks])
            deren = words([x for c in b.column("deren").chunks for x in c.flatten().to_pylist()])
            von = a.column("at").to_numpy()
            row, *found = best_sets(words(a.column("maske").to_pylist()), [np.asarray(w, np.int32) for w in a.column("will").to_pylist()], at, deren, most)
            found = [von[row], *found]
        return pa.table({k: pa.array(x, t) for k, x, t in zip(("von", "nr", "zu", "rank"), found, (pa.int64(), pa.int32(), pa.int64(), pa.int32()))})

    # a task to a tile and part, as nearly as hashing allows
    deal = [F.col("tile"), F.col("part")]
    found = left.groupBy(*deal).cogroup(right.groupBy(*deal)).applyInArrow(run, "von long, nr int, zu long, rank int")
    if parts == 1:
        return found
    order = Window.partitionBy("von", "nr").orderBy(F.desc("rank"), "zu")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def evidence(purchases: DataFrame, wanted: DataFrame, most: int = 3) -> DataFrame:
    """Why a product: for each (kunde_id, produkt_id) of wanted the most similar customers who own it.

    anderer, gemeinsam (the shared products, sorted), their number, the Jaccard similarity (four digits) and nr. What is found depends on what a customer
    owns alone, so customers with the same products are one set. Catalogues up to BITS products are compared as bits, tiles of sets with tiles;
    in larger ones buyers of a wanted product are met by an equi-join on it.
    """
    return evidence_listed(basket.listed(purchases), wanted, most)


def evidence_listed(lists: DataFrame, wanted: DataFrame, most: int = 3, shared: bool = True) -> DataFrame:
    """evidence() of purchases as basket.listed() gives them; gemeinsam only where shared."""
    products = basket.products_of(lists, "teils", BITS)
    if products is None:
        found = _evidence_by_joins(lists, wanted, most)
        return found if shared else found.drop("gemeinsam")
    found = _evidence_by_bits(lists, wanted, products, most, shared).select("*", F.posexplode("best").alias("nr", "b"))
    same = [_names_of(products, dict(lists.dtypes)["teils"])("maske", "b.deren").alias("gemeinsam")] if shared else []
    n = F.pmod("b.rank", F.lit(2 * BITS))
    return found.select("kunde_id", "produkt_id", "b.anderer", *same, n.cast("long").alias("n_gemeinsam"), ((F.col("b.rank") - n) / (2 * BITS) / 1e4).alias("jaccard"), (F.col("nr") + 1).alias("nr"))


def _names_of(products: list, kind: str):
    """A function of two masks: the products in both, in order."""
    names = np.array(products, object)

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        bits = np.unpackbits((words(a) & words(b)).view(np.uint8), axis=1, bitorder="little")[:, : len(names)]
        return pd.Series([names[np.flatnonzero(x)].tolist() for x in bits])

    return run


def _evidence_by_bits(lists: DataFrame, wanted: DataFrame, products: list, most: int, shared: bool) -> DataFrame:
    """kunde_id, produkt_id, best: up to most of anderer and rank (and deren, beside the customer's own maske, where shared), the best first."""
    spark = lists.sparkSession
    kind = dict(lists.dtypes)["teils"].removeprefix("array<").removesuffix(">")
    numbers = spark.createDataFrame(list(zip(products, range(len(products)))), f"produkt_id {kind}, nr int")
    masks = stored(masked(lists.where("kunde_id IS NOT NULL AND size(teils) > 0"), products))
    # a customer may be among the best of its own set, so one more is kept of each
    first = Window.partitionBy("maske").orderBy("kunde_id")
    heads = masks.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most + 1)
    sets = heads.groupBy("maske").agg(F.sort_array(F.collect_list("kunde_id")).alias("kunden"))
    sets = stored(sets.orderBy(F.col("kunden")[0]).withColumn("at", F.monotonically_increasing_id()))
    asked = wanted.select("kunde_id", "produkt_id").distinct().join(F.broadcast(numbers), "produkt_id")
    asked = stored(asked.join(masks, "kunde_id").join(sets.select("maske", F.col("at").alias("von")), "maske").select("kunde_id", "produkt_id", "nr", "von", *["maske"] * shared))
    will = asked.groupBy(F.col("von").alias("at")).agg(F.sort_array(F.collect_set("nr")).alias("will"))
    near = _nearest_sets(sets.select("at", "maske"), stored(will.join(sets.select("at", "maske"), "at")), most + 1)
    each = near.join(sets.select(F.col("at").alias("zu"), "kunden", F.col("maske").alias("deren")), "zu").select("von", "nr", "rank", *["deren"] * shared, F.explode("kunden").alias("anderer"))
    last = F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "anderer", *["deren"] * shared)))
    best = each.groupBy("von", "nr").agg(F.slice(last, 1, most + 1).alias("best"))  # no more than (most + 1) squared
    others = F.slice(F.filter("best", lambda x: x["anderer"] != F.col("kunde_id")), 1, most)
    told = F.transform(others, lambda x: F.struct(x["anderer"].alias("anderer"), (-x["r"]).alias("rank"), *[x["deren"].alias("deren")] * shared))
    return asked.join(best, ["von", "nr"]).select("kunde_id", "produkt_id", *["maske"] * shared, told.alias("best"))


def _evidence_by_joins(lists: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    lists = cut(lists.where("kunde_id IS NOT NULL AND size(teils) > 0").select("kunde_id", F.sort_array("teils").alias("liste")))
    asked = wanted.select("kunde_id", "produkt_id").distinct()
    first = Window.partitionBy("liste").orderBy("kunde_id")
    heads = lists.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most + 1)
    sets = heads.groupBy("liste").agg(F.sort_array(F.collect_list("kunde_id")).alias("kunden"))
    sets = cut(sets.orderBy(F.col("kunden")[0]).withColumn("at", F.monotonically_increasing_id()))
    member = lists.join(sets.select("liste", F.col("at").alias("von")), "liste").select("kunde_id", "von")
    asked = cut(asked.join(member, "kunde_id"))
    holders = sets.select(F.col("at").alias("zu"), F.col("liste").alias("deren"), F.explode("liste").alias("produkt_id"))
    pairs = asked.select("von", "produkt_id").distinct().join(sets.select(F.col("at").alias("von"), "liste"), "von").join(holders, "produkt_id")
    pairs = pairs.select("von", "produkt_id", "zu", F.size(F.array_intersect("liste", "deren")).alias("_n"), (F.size("liste") + F.size("deren")).alias("_alle")).where("_n > 0")
    order = Window.partitionBy("von", "produkt_id").orderBy(F.desc(even(F.col("_n") / (F.col("_alle") - F.col("_n")), 4)), F.desc("_n"), "zu")
    near = pairs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most + 1).select("von", "produkt_id", "zu")
    near = near.join(sets.select(F.col("at").alias("von"), F.col("liste").alias("_a")), "von").join(sets.select(F.col("at").alias("zu"), F.col("liste").alias("_b"), "kunden"), "zu")
    shared = near.withColumn("gemeinsam", F.array_intersect("_a", "_b")).withColumn("n_gemeinsam", F.size("gemeinsam").cast("long"))
    shared = shared.withColumn("jaccard", even(F.col("n_gemeinsam") / (F.size("_a") + F.size("_b") - F.col("n_gemeinsam")), 4))
    each = shared.select("von", "produkt_id", "gemeinsam", "n_gemeinsam", "jaccard", F.explode("kunden").alias("anderer"))
    last = F.array_sort(F.collect_list(F.struct((-F.col("jaccard")).alias("j"), (-F.col("n_gemeinsam")).alias("n"), "anderer", "gemeinsam")))
    best = each.groupBy("von", "produkt_id").agg(F.slice(last, 1, most + 1).alias("best"))
    found = asked.join(best, ["von", "produkt_id"]).select("kunde_id", "produkt_id", F.posexplode(F.slice(F.filter("best", lambda x: x["anderer"] != F.col("kunde_id")), 1, most)).alias("nr", "b"))
    return found.select("kunde_id", "produkt_id", "b.anderer", "b.gemeinsam", (-F.col("b.n")).alias("n_gemeinsam"), (-F.col("b.j")).alias("jaccard"), (F.col("nr") + 1).alias("nr"))


def explain(purchases: DataFrame, wanted: DataFrame, most: int = 3) -> DataFrame:
    """For each (kunde_id, produkt_id) of wanted: n_kunden (others who own the product), the best evidence, the bridge product and a sentence.

    The bridge is the customer's product that most of the evidence shares; of equals the one that comes first in it.
    """
    return explain_listed(basket.listed(purchases), wanted, most)


def explain_listed(lists: DataFrame, wanted: DataFrame, most: int = 3) -> DataFrame:
    """explain() of purchases as basket.listed() gives them."""
    products = basket.products_of(lists, "teils", BITS)
    text_of = lambda others: F.array_join(F.transform(others, lambda x: x["anderer"].cast("string")), ", ")
    wanted = stored(wanted.select("kunde_id", "produkt_id").distinct())
    if products is None:
        found = stored(_evidence_by_joins(lists, wanted, most))
        named = found.groupBy("kunde_id", "produkt_id").agg(text_of(F.sort_array(F.collect_list(F.struct("nr", "anderer")))).alias("belege"))
        shared = found.select("kunde_id", "produkt_id", "nr", F.explode("gemeinsam").alias("bruecke")).groupBy("kunde_id", "produkt_id", "bruecke").agg(F.count("*").alias("n"), F.min("nr").alias("erst"))
        bridge = shared.groupBy("kunde_id", "produkt_id").agg(F.min_by("bruecke", F.struct(-F.col("n"), F.col("erst"), F.col("bruecke"))).alias("bruecke"))
        told = named.join(bridge, ["kunde_id", "produkt_id"], "left")
    else:
        found = _evidence_by_bits(lists, wanted, products, most, True).where(F.size("best") > 0)
        told = found.select("kunde_id", "produkt_id", text_of("best").alias("belege"), _bridge(products, dict(lists.dtypes)["teils"], most)("maske", "best.deren").alias("bruecke"))
    buyers = lists.select(F.explode("teils").alias("produkt_id")).groupBy("produkt_id").agg(F.count("*").alias("alle"))
    rows = wanted.join(lists.select("kunde_id", "teils"), "kunde_id", "left").select("kunde_id", "produkt_id", F.coalesce(F.array_contains("teils", F.col("produkt_id")).cast("int"), F.lit(0)).alias("_own"))
    rows = rows.join(told, ["kunde_id", "produkt_id"], "left").join(buyers if products is None else F.broadcast(buyers), "produkt_id", "left").withColumn("n_kunden", F.coalesce("alle", F.lit(0)) - F.col("_own"))
    text = F.concat(F.col("n_kunden").cast("string"), F.lit(" vergleichbare Kunden setzen dieses Produkt bereits ein – darunter "), F.col("belege"), F.lit("."))
    text = F.concat(text, F.lit(" Die Verbindung läuft vor allem über Ihr Produkt „"), F.col("bruecke"), F.lit("“."))
    return rows.select("kunde_id", "produkt_id", "n_kunden", "belege", "bruecke", F.coalesce(text, F.lit("Das Modell leitet die Empfehlung aus latenten Kaufmustern ab.")).alias("text"))


def _bridge(products: list, kind: str, most: int):
    """A function of a mask and a list of masks, the best first: the product in it that most of them have; of equals the one whose first is best, then the one that sorts first."""
    names = np.array(products, object)

    @F.pandas_udf(kind.removeprefix("array<").removesuffix(">"))
    def run(mine: pd.Series, deren: pd.Series) -> pd.Series:
        many = deren.str.len().to_numpy(np.int64)
        who = np.repeat(np.arange(len(mine)), many)
        place = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
        own, theirs = words(mine), words([x for masks in deren for x in masks])
        score = np.zeros((len(mine), len(names)), np.int32)
        for k in range(most):  # the place of the first counts less than one more, so the last one is looked at first
            some = who[place == most - 1 - k]
            bits = np.unpackbits((own[some] & theirs[place == most - 1 - k]).view(np.uint8), axis=1, bitorder="little")[:, : len(names)] > 0
            score[some] = np.where(bits, score[some] // (most + 1) * (most + 1) + (most + 1) + k + 1, score[some])
        return pd.Series(names[score.argmax(axis=1)])

    return run


def network(purchases: DataFrame) -> DataFrame:
    """One row: customers, products, edges between them and the density in per cent."""
    own = purchases.groupBy("kunde_id", "produkt_id").agg(F.max((F.col("umsatz") > 0).cast("int")).alias("kante"))
    cells = F.count_distinct("kunde_id") * F.count_distinct("produkt_id")
    return own.agg(F.count_distinct("kunde_id").alias("n_kunden"), F.count_distinct("produkt_id").alias("n_produkte"), F.coalesce(F.sum("kante"), F.lit(0)).alias("n_kanten"), F.coalesce(even(F.try_divide(F.sum("kante"), cells) * 100, 1), F.lit(0.0)).alias("dichte"))
