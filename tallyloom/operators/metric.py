"""A metric partition of vectors: cells around pivots, blocks of vectors in rings of like distance to the pivot.

What is in a block is known by three numbers, its cell and the least and greatest distance to the pivot. By the triangle inequality
they bound every distance to a vector outside of it from below, so blocks that can't matter are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.session import cut

#: Vectors of a block, and pivots at most: all that the driver ever holds of a set.
SIZE, MOST_PIVOTS = 512, 512
#: A bound is trusted up to this share of it.
SLACK = 1e-9


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ y.T + (y**2).sum(axis=1), 0)


def pivots_of(vectors: DataFrame, column: str, rows: int) -> np.ndarray:
    """Some of the vectors, one for a few blocks: of four times as many by least hash those that are far from each other; equal ones once."""
    want = max(1, min(MOST_PIVOTS, rows // (2 * SIZE)))
    vec = F.col(column).cast("array<double>").alias("v")
    some = np.unique(np.array([r.v for r in vectors.select(vec).where("v IS NOT NULL").distinct().orderBy(F.xxhash64("v"), "v").limit(4 * want).collect()], np.float64), axis=0)
    chosen, far = [0], squares(some, some[:1])[:, 0]
    while len(chosen) < min(want, len(some)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squares(some, some[chosen[-1:]])[:, 0])
    return np.unique(some[chosen], axis=0)


def blocks(vectors: DataFrame, pivots: np.ndarray, id_col: str, column: str, size: int = SIZE) -> DataFrame:
    """block, cell, low, high, ids, matrix: vectors of one cell in order of their distance to its pivot, at most size together."""
    kind = dict(vectors.dtypes)[id_col]
    source = vectors.select(F.col(id_col).alias("id"), F.col(column).cast("array<double>").alias("v")).where("v IS NOT NULL")

    def placed(batches):
        for b in batches:
            if len(b):
                x = np.array(b.v.tolist(), np.float64)
                cell = squares(x, pivots).argmin(axis=1)
                yield pd.DataFrame({"id": b.id, "cell": cell, "r": np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1)), "v": [row.tobytes() for row in x]})

    def packed(batches):
        for b in batches:
            for _, part in b.groupby("cell", sort=False):
                for a in range(0, len(part), size):
                    some = part.iloc[a : a + size]
                    yield pd.DataFrame({"cell": [some.cell.iloc[0]], "low": [some.r.iloc[0]], "high": [some.r.iloc[-1]], "ids": [some.id.tolist()], "matrix": [b"".join(some.v)]})

    near = source.mapInPandas(placed, f"id {kind}, cell int, r double, v binary")
    # the id's hash deals out copies of one vector
    ranged = near.repartitionByRange("cell", "r", F.xxhash64("id")).sortWithinPartitions("cell", "r", "id")
    return ranged.mapInPandas(packed, f"cell int, low double, high double, ids array<{kind}>, matrix binary").withColumn("block", F.monotonically_increasing_id())


def read(matrix: bytes, width: int) -> np.ndarray:
    return np.frombuffer(matrix).reshape(-1, width)


def closest(x: np.ndarray, bank: np.ndarray) -> np.ndarray:
    """The distance of each vector to the nearest of the bank, free of what the expansion cancels."""
    near = ((bank**2).sum(axis=1) - 2 * x @ bank.T).argmin(axis=1)
    return np.sqrt(((x - bank[near]) ** 2).sum(axis=1))


def nearest(vectors: DataFrame, bank: DataFrame, id_col: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(id, distance) of each vector to the nearest of the bank, exact; and (block, other): the pairs of blocks that were compared.

    First each block of vectors meets the bank's block of its cell whose ring is closest, which bounds its distances from above. Then
    it meets those others that can hold something nearer: cells by the distance of the pivots, blocks of these by their rings.
    """
    rows = bank.where(F.col(column).isNotNull()).count()
    if not rows:
        return vectors.select(id_col, F.lit(None).cast("double").alias("distance")), vectors.sparkSession.createDataFrame([], "block long, other long")
    pivots = pivots_of(bank, column, rows)
    width, apart = pivots.shape[1], np.sqrt(squares(pivots, pivots))
    own, kept = cut(blocks(vectors, pivots, id_col, column)), cut(blocks(bank, pivots, id_col, column))
    shape = kept.select("cell", F.col("low").alias("blow"), F.col("high").alias("bhigh"), F.col("block").alias("other"))
    gap = F.greatest(F.col("low") - F.col("bhigh"), F.col("blow") - F.col("high"), F.lit(0.0))
    ring = F.abs(F.col("low") + F.col("high") - F.col("blow") - F.col("bhigh"))
    met = cut(own.select("block", "cell", "low", "high").join(shape, "cell").groupBy("block").agg(F.min_by("other", F.struct(gap, ring, F.col("other"))).alias("other")))
    other = kept.select(F.col("block").alias("other"), F.col("matrix").alias("bank"))

    def meet(batches):
        for b in batches:
            best = [closest(read(x, width), read(y, width)) for x, y in zip(b.matrix, b.bank)]
            yield b.drop(columns="bank").assign(best=[x.tobytes() for x in best], most=[x.max() for x in best])

    schema = own.schema.simpleString()[7:-1]
    first = cut(own.join(met, "block").join(other, "other").select(*own.columns, "bank").mapInPandas(meet, f"{schema}, best binary, most double"))
    reach = np.zeros(len(pivots))
    for r in shape.groupBy("cell").agg(F.max("bhigh").alias("r")).collect():  # one row a pivot
        reach[r.cell] = r.r

    def cells(batches):
        for b in batches:
            for block, cell, low, high, most in zip(b.block, b.cell, b.low, b.high, b.most):
                least, far = np.maximum(apart[cell] - high, 0), apart[cell] + high
                least[cell], far[cell] = low, high
                open_ = np.flatnonzero((least - reach) * (1 - SLACK) - SLACK < most)
                yield pd.DataFrame({"block": block, "cell": open_, "least": least[open_], "far": far[open_], "most": most})

    asked = first.select("block", "cell", "low", "high", "most").mapInPandas(cells, "block long, cell int, least double, far double, most double")
    gap = F.greatest(F.col("least") - F.col("bhigh"), F.col("blow") - F.col("far"), F.lit(0.0))
    pairs = cut(asked.join(shape, "cell").where(gap * (1 - SLACK) - SLACK < F.col("most")).select("block", "other").join(met, ["block", "other"], "left_anti"))
    kind = dict(vectors.dtypes)[id_col]

    def again(batches):
        for b in batches:
            for block, matrix, best, y in zip(b.block, b.matrix, b.best, b.bank):
                far, old = closest(read(matrix, width), read(y, width)), np.frombuffer(best)
                at = np.flatnonzero(far < old)
                yield pd.DataFrame({"block": block, "at": at, "distance": far[at]})

    better = pairs.join(first.select("block", "matrix", "best"), "block").join(other, "other").select("block", "matrix", "best", "bank").mapInPandas(again, "block long, at int, distance double")
    better = better.groupBy("block", "at").agg(F.min("distance").alias("nearer"))

    def each(batches):
        for b in batches:
            for block, ids, best in zip(b.block, b.ids, b.best):
                yield pd.DataFrame({"id": list(ids), "block": block, "at": np.arange(len(ids)), "distance": np.frombuffer(best)})

    known = first.select("block", "ids", "best").mapInPandas(each, f"id {kind}, block long, at int, distance double")
    found = known.join(better, ["block", "at"], "left").select(F.col("id").alias(id_col), F.least("distance", "nearer").alias("distance"))
    return found, met.unionByName(pairs)


#: Candidates that a block offers and that the driver looks at in one round of choices.
OFFERED, LOOKED_AT = 64, 8_192


def farthest_first(vectors: DataFrame, want: int, id_col: str, column: str) -> tuple[DataFrame, int]:
    """The ids of the farthest-first choice of want vectors, and the rounds it took; the same as choosing one by one.

    From the smallest id on, always the vector farthest from those chosen (of equal ones the smallest id). In a round each block offers its farthest vectors
    and the distance of the best one it keeps back. Among the offered the driver chooses on, updating their distances, for as long as the best is ahead of all
    that were kept back: distances only fall, so nothing else can be ahead. The choices then go to the blocks, and a block looks only at those that its cell
    and ring allow to be nearer than its farthest vector. Chosen vectors are marked in the blocks; the driver holds those of a round alone.
    """
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[id_col]
    if not want:
        return vectors.select(id_col).limit(0), 0
    rows = vectors.count()
    pivots = pivots_of(vectors, column, rows)
    width = pivots.shape[1]
    base = blocks(vectors, pivots, id_col, column)
    state = cut(base.withColumn("far", F.lit(None).cast("binary")))
    schema = state.schema.simpleString()[7:-1]
    first = vectors.where(F.col(column).isNotNull()).orderBy(id_col).select(F.col(id_col).alias("id"), F.col(column).cast("array<double>").alias("v")).first()
    ids, centres, rounds, chosen, offered = [first.id], np.array([first.v], np.float64), 0, 1, OFFERED

    def told(ids: list, centres: np.ndarray):
        taken, gaps = set(ids), np.sqrt(squares(centres, pivots))

        def run(batches):
            for b in batches:
                out = []
                for cell, low, high, own, matrix, far in zip(b.cell, b.low, b.high, b.ids, b.matrix, b.far):
                    x = read(matrix, width)
                    far = np.full(len(x), np.inf) if far is None else np.frombuffer(far).copy()
                    away = np.maximum(gaps[:, cell] - high, low - gaps[:, cell]) * (1 - SLACK) - SLACK
                    for i in np.flatnonzero(np.maximum(away, 0) ** 2 < far.max()):
                        np.minimum(far, ((x - centres[i]) ** 2).sum(axis=1), out=far)
                    for i, own_id in enumerate(own):
                        if own_id in taken:
                            far[i] = -1.0
                    out.append(far.tobytes())
                yield b.assign(far=out)

        return run

    def offers(batches):
        for b in batches:
            for own, matrix, far in zip(b.ids, b.matrix, b.far):
                far, x = np.frombuffer(far), read(matrix, width)
                order = sorted(range(len(far)), key=lambda i: (-far[i], own[i]))[: offered + 1]
                order = [i for i in order if far[i] >= 0]
                yield pd.DataFrame({"id": [own[i] for i in order], "far": far[order], "v": [x[i].tobytes() for i in order], "back": [n == offered for n in range(len(order))]})

    while True:
        state = cut(state.mapInPandas(told(ids, centres), schema))
        rounds += 1
        if chosen >= want:
            return state.select("ids", "far").mapInPandas(marked, f"id {kind}").withColumnRenamed("id", id_col), rounds
        # what is kept back is led by the best kept back, or by the best beyond those looked at
        found = state.select("ids", "matrix", "far").mapInPandas(offers, f"id {kind}, far double, v binary, back boolean")
        best = found.orderBy(F.desc("far"), "id").limit(LOOKED_AT).collect()
        stop = next((i for i, r in enumerate(best) if r.back), len(best) - 1 if len(best) == LOOKED_AT else len(best))
        ids, centres = chosen_from(best[:stop] or best[:1], best[stop] if 0 < stop < len(best) else None, want - chosen, width)
        offered = offered if len(ids) >= 4 * OFFERED else min(SIZE, 2 * offered)
        chosen += len(ids)


def marked(batches):
    for b in batches:
        for own, far in zip(b.ids, b.far):
            yield pd.DataFrame({"id": [own[i] for i in np.flatnonzero(np.frombuffer(far) < 0)]})


def chosen_from(rows: list, ahead_of, want: int, width: int) -> tuple[list, np.ndarray]:
    """Choices among rows (in order of far, then id) while the best comes before the row ahead_of."""
    x, far = np.array([np.frombuffer(r.v) for r in rows]).reshape(-1, width), np.array([r.far for r in rows])
    # far falls; of equal ones the smaller id: rank of the id among the rows
    rank = np.empty(len(rows), np.int64)
    rank[sorted(range(len(rows)), key=lambda i: rows[i].id)] = np.arange(len(rows))
    picked: list[int] = []
    while len(picked) < want:
        top = far.max()
        if top < 0:
            break
        same = np.flatnonzero(far == top)
        i = int(same[rank[same].argmin()])
        if picked and ahead_of is not None and (-top, rows[i].id) >= (-ahead_of.far, ahead_of.id):
            break
        picked.append(i)
        np.minimum(far, ((x - x[i]) ** 2).sum(axis=1), out=far)
        far[i] = -1.0
    return [rows[i].id for i in picked], x[picked]
