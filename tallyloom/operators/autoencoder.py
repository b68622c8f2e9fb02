"""A small autoencoder trained over partitions: tasks go through their vectors from common parameters, and the mean of theirs is where the next round begins.

Vectors are dealt by the hash of their id into a fixed number of parts and sorted there, so the same vectors give the same model however they were stored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.session import cut

#: Parts that the vectors are dealt to, each a learner of its own within a round.
PARTS = 16


def shapes(width: int, hidden: int, code: int) -> list[tuple[int, ...]]:
    return [(width, hidden), (hidden,), (hidden, code), (code,), (code, hidden), (hidden,), (hidden, width), (width,)]


def unpacked(flat: np.ndarray, width: int, hidden: int, code: int) -> list[np.ndarray]:
    out, at = [], 0
    for shape in shapes(width, hidden, code):
        size = int(np.prod(shape))
        out.append(flat[at : at + size].reshape(shape))
        at += size
    return out


def rebuilt(x: np.ndarray, p: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Vectors through the bottleneck, and what stands at each layer."""
    first = np.tanh(x @ p[0] + p[1])
    code = first @ p[2] + p[3]
    last = np.tanh(code @ p[4] + p[5])
    return last @ p[6] + p[7], [x, first, code, last]


def gradient(x: np.ndarray, p: list[np.ndarray]) -> np.ndarray:
    """Of half the mean squared error."""
    y, (x, first, code, last) = rebuilt(x, p)
    d = (y - x) / len(x)
    g6, g7 = last.T @ d, d.sum(axis=0)
    d = (d @ p[6].T) * (1 - last**2)
    g4, g5 = code.T @ d, d.sum(axis=0)
    d = d @ p[4].T
    g2, g3 = first.T @ d, d.sum(axis=0)
    d = (d @ p[2].T) * (1 - first**2)
    return np.concatenate([g.ravel() for g in (x.T @ d, d.sum(axis=0), g2, g3, g4, g5, g6, g7)])


def trained(source: DataFrame, width: int, hidden: int, code: int, rounds: int, rate: float, seed: int, batch: int = 16, passes: int = 8) -> np.ndarray:
    """Parameters after so many rounds over source (id, x): each some Adam passes in every part, then their mean by rows."""
    draw = np.random.default_rng(seed)
    flat = np.concatenate([(draw.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s)).ravel() for s in shapes(width, hidden, code)])
    for i in range(rounds):
        step = rate * (0.5 + 0.5 * np.cos(np.pi * i / rounds))

        def learn(frames, flat=flat, step=step, i=i):
            own, n, t = flat.copy(), 0, 0
            mean, square = np.zeros_like(own), np.zeros_like(own)
            for b in frames:
                x = np.array(b.x.tolist()).reshape(len(b), -1)
                order = np.concatenate([np.random.default_rng((seed, i, k)).permutation(len(x)) for k in range(passes)])
                for a in range(0, len(order), batch):
                    g = gradient(x[order[a : a + batch]], unpacked(own, width, hidden, code))
                    t += 1
                    mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
                    own -= step * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
                n += len(x)
            if n:
                yield pd.DataFrame({"at": np.arange(len(own)), "v": own * n, "n": n})

        parts = source.select("x").mapInPandas(learn, "at int, v double, n long").groupBy("at").agg((F.sum("v") / F.sum("n")).alias("v"))
        for r in parts.collect():  # one row a parameter
            flat[r["at"]] = r.v
    return flat


def scores(vectors: DataFrame, code: int = 8, hidden: int = 32, rounds: int = 24, rate: float = 0.02, seed: int = 0, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, score): the squared error of each vector after the bottleneck of code numbers; null vectors give no row, an empty table none.

    Vectors are scaled by the mean and deviation of each component; the error is in their own units.
    """
    rows = vectors.where(F.col(column).isNotNull()).select(F.col(id_col).alias("id"), F.col(column).cast("array<double>").alias("v"))
    stats = rows.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("at").collect()  # one row a component
    if not stats:
        return vectors.select(id_col, F.lit(None).cast("double").alias("score")).limit(0)
    mean, spread = np.array([r.m for r in stats]), np.maximum([r.s for r in stats], 1e-9)
    width = len(mean)
    scaled = F.transform("v", lambda x, i: (x - F.get(F.lit(mean.tolist()), i)) / F.get(F.lit(spread.tolist()), i)).alias("x")
    # the part by a hash, not by the engine's choice of partitions
    source = cut(rows.select("id", scaled).repartition(PARTS, F.pmod(F.xxhash64("id"), F.lit(PARTS))).sortWithinPartitions(F.xxhash64("id"), "id", "x"))
    flat = trained(source, width, hidden, code, rounds, rate, seed)

    def score(frames):
        p = unpacked(flat, width, hidden, code)
        for b in frames:
            x = np.array(b.x.tolist()).reshape(len(b), width)
            yield pd.DataFrame({"id": b.id, "score": (((rebuilt(x, p)[0] - x) * spread) ** 2).sum(axis=1)})

    return source.mapInPandas(score, f"id {dict(vectors.dtypes)[id_col]}, score double").withColumnRenamed("id", id_col)
