"""Centroid clustering with Drake's adaptive bounds.

Every vector carries its centroid with an upper bound of the distance, the next nearest few centroids with a lower bound each, and one
lower bound for all the rest. When centroids move, the bounds move by as much. A vector whose upper bound is below all
lower bounds keeps its centroid without a look at the others; where the first j lower bounds don't settle it, only these j centroids are
measured again, and all of them only where the remainder bound doesn't settle it either. How many centroids a vector
carries falls to what the last round needed of them (b, at first a quarter of the centroids, never below LEAST).

Vectors are whole numbers, so distances are exact and equal ones go to the smaller number. Bounds are doubles, rounded away from the
distance by more than their errors, and an equal bound settles nothing: the result is that of measuring everything.

A round is one pass over the vectors' table without a shuffle: tasks write vectors with their new bounds, and what left and entered
each centroid, as one row a task, which Spark sums; the driver sees k times the dimension of sums. The table is written to the
shared folder and the one before is removed, so rounds restart from files and disk holds two tables at most.

Defined results: vectors of another length, with nulls or without finite values, null vectors included, give no row; a null id stays null (its
hash is that of no digits); repeated rows are vectors of their own and may be several of the first centroids; with fewer
vectors than centroids there are as many centroids as vectors; an empty table gives no row. A component of 65,536 or more
stops the job with an error, as squared distances wouldn't fit a long any more.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import batch_of, fresh_path, remove_path, struct

#: Components are multiplied by this and rounded down.
SCALE = 1024
#: Scaled components are below this, so that sums of 64 squared differences fit a long.
MOST = 1 << 26
#: Centroids that each vector carries besides its own, at least.
LEAST = 2
#: A few units in the last place: what rounding may add to a bound.
UP, DOWN = 1 + 4e-15, 1 - 4e-15


def state_type(b: int) -> np.dtype:
    """A vector's state: its centroid and the b next ones, the upper bound, their lower bounds, that of the rest, and the distances measured so far."""
    return np.dtype([("order", "<u2", (b + 1,)), ("upper", "<f8"), ("lower", "<f8", (b,)), ("rest", "<f8"), ("looked", "<i4")])


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all vectors to all centroids, exactly."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * top * top < 1 << 53:  # doubles hold every sum exactly
        x, centroids = x.astype(np.float64), centroids.astype(np.float64)
    out = (x * x).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(axis=1)
    return out.astype(np.int64)


def gaps(x: np.ndarray, centroids: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Squared distances of each vector to the centroids that its row of chosen names."""
    return np.stack([((x - centroids[c]) ** 2).sum(axis=1) for c in chosen.T], axis=1)


@dataclass
class Bounds:
    """One round's centroids, how far each has moved (rounded up), and the number of centroids that vectors carry from now on."""

    centroids: np.ndarray
    drift: np.ndarray
    b: int

    def first(self, x: np.ndarray) -> np.ndarray:
        state = np.zeros(len(x), state_type(self.b))
        self.measure(x, state, np.arange(len(x)))
        return state

    def measure(self, x: np.ndarray, state: np.ndarray, rows: np.ndarray) -> None:
        """All distances of these rows."""
        far = squares(x[rows], self.centroids)
        order = np.argsort(far, axis=1, kind="stable")
        far = np.sqrt(np.take_along_axis(far, order, axis=1).astype(np.float64))
        state["order"][rows] = order[:, : self.b + 1]
        state["upper"][rows] = far[:, 0] * UP
        state["lower"][rows] = far[:, 1 : self.b + 1] * DOWN
        state["rest"][rows] = far[:, self.b + 1] * DOWN if self.b + 1 < far.shape[1] else np.inf
        state["looked"][rows] += len(self.centroids)

    def moved(self, x: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, int]:
        """The states after the centroids' move, and the most of the carried centroids that any vector needed."""
        state = np.zeros(len(x), state_type(self.b))
        order = old["order"].astype(np.int64)
        lower = np.maximum((old["lower"] - self.drift[order[:, 1:]]) * DOWN, 0)
        rest = np.maximum((old["rest"] - self.drift.max()) * DOWN, 0)
        state["rest"] = np.minimum(rest, lower[:, self.b :].min(axis=1, initial=np.inf))  # what is no longer carried joins the rest
        state["order"], state["lower"], state["looked"] = order[:, : self.b + 1], lower[:, : self.b], old["looked"]
        state["upper"] = (old["upper"] + self.drift[order[:, 0]]) * UP
        # the least bound from each place on
        least = np.minimum.accumulate(np.column_stack([state["lower"], state["rest"]])[:, ::-1], axis=1)[:, ::-1]
        unsure = np.flatnonzero(state["upper"] >= least[:, 0])
        if not len(unsure):
            return state, 0
        own = gaps(x[unsure], self.centroids, order[unsure, :1])[:, 0]
        state["upper"][unsure] = np.sqrt(own.astype(np.float64)) * UP
        state["looked"][unsure] += 1
        depth = (state["upper"][unsure][:, None] >= least[unsure]).sum(axis=1)
        for j in range(1, self.b + 1):
            at = np.flatnonzero(depth == j)
            if len(at):
                rows = unsure[at]
                chosen = state["order"][rows, : j + 1].astype(np.int64)
                far = np.column_stack([own[at], gaps(x[rows], self.centroids, chosen[:, 1:])])
                by_number = np.argsort(chosen, axis=1)
                chosen, far = np.take_along_axis(chosen, by_number, axis=1), np.take_along_axis(far, by_number, axis=1)
                by_far = np.argsort(far, axis=1, kind="stable")
                root = np.sqrt(np.take_along_axis(far, by_far, axis=1).astype(np.float64))
                state["order"][rows, : j + 1] = np.take_along_axis(chosen, by_far, axis=1)
                state["upper"][rows] = root[:, 0] * UP
                state["lower"][rows, :j] = root[:, 1:] * DOWN
                state["looked"][rows] += j
        self.measure(x, state, unsure[depth > self.b])
        return state, int(min(depth.max(), self.b))


def fixed(column: pa.Array, kind) -> np.ndarray:
    """A binary column of values of one length and no nulls as an array, a row a value; or as records, where kind is a record."""
    column, kind = column.cast(pa.binary()), np.dtype(kind)
    ends = np.frombuffer(column.buffers()[1], "<i4", len(column) + 1, column.offset * 4)
    out = np.frombuffer(column.buffers()[2], kind, (int(ends[-1]) - int(ends[0])) // kind.itemsize, int(ends[0]))
    return out if kind.names else out.reshape(len(column), -1)


def binary(rows: np.ndarray) -> pa.Array:
    """The other way round."""
    rows = np.ascontiguousarray(rows)
    size = rows.nbytes // max(1, len(rows))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype="<i4") * np.int32(size)), pa.py_buffer(rows.tobytes())])


def kept(vectors: DataFrame, id_col: str, column: str, size: int) -> DataFrame:
    """id and vec (doubles): the vectors of that size with finite components only."""
    vec = F.col(f"`{column}`").cast("array<double>")
    fine = (F.size(vec) == size) & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(f"`{id_col}`").alias("id"), vec.alias("vec")).where(fine)


def scaled(x: np.ndarray) -> np.ndarray:
    x = np.floor(x * SCALE)
    if np.abs(x).max(initial=0) >= MOST:
        raise ValueError(f"components must be below {MOST // SCALE} in size")
    return x.astype(np.int64)


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of least hash of seed and id; of equal ones the vector that sorts first."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(mark, "vec").limit(k).collect()
    return scaled(np.array([r.vec for r in first], np.float64)) if first else np.zeros((0, 0), np.int64)


def clusters(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", k: int = 8, rounds: int = 10, size: int = 64, seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance, n_distances) for each vector, and the final centroids.

    distance is squared; n_distances counts the distances that were measured for the vector in all rounds, of (rounds + 1) times k.
    """
    spark = vectors.sparkSession
    rows = kept(vectors, id_col, column, size)
    now = starts(rows, k, seed)
    k = len(now)
    id_type = rows.schema["id"].dataType
    done = struct(("id", id_type), ("cluster", "int"), ("distance", "long"), ("n_distances", "int"))
    if not k:
        return spark.createDataFrame([], done).withColumnRenamed("id", id_col), []
    schema = struct(("id", id_type), ("vec", "binary"), ("state", "binary"), ("change", "array<long>"), ("deepest", "int"))

    def walked(source: DataFrame, bounds: Bounds, carried: int | None, last: bool) -> DataFrame:
        """One pass: states by bounds from those of before (carried centroids each; None: there are none yet)."""

        def run(batches):
            change, deepest, any_row = np.zeros((k, size + 1), np.int64), 0, False
            for batch in batches:
                if not batch.num_rows:
                    continue
                any_row = True
                if carried is None:
                    x = scaled(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
                    state, depth = bounds.first(x), 0
                else:
                    x = fixed(batch.column(1), "<i4").astype(np.int64)
                    old = fixed(batch.column(2), state_type(carried))
                    state, depth = bounds.moved(x, old)
                mine, deepest = state["order"][:, 0].astype(np.int64), max(deepest, depth)
                if last:
                    far = gaps(x, bounds.centroids, mine[:, None])[:, 0]
                    yield batch_of({"id": batch.column(0), "cluster": mine, "distance": far, "n_distances": state["looked"]}, done)
                    continue
                with_one = np.column_stack([x, np.ones(len(x), np.int64)])
                if carried is None:
                    np.add.at(change, mine, with_one)
                else:
                    left = old["order"][:, 0].astype(np.int64)
                    to = np.flatnonzero(left != mine)
                    np.add.at(change, mine[to], with_one[to])
                    np.subtract.at(change, left[to], with_one[to])
                none = pa.nulls(len(x))
                yield batch_of({"id": batch.column(0), "vec": binary(x.astype("<i4")), "state": binary(state), "change": none, "deepest": none}, schema)
            if any_row and not last:
                yield batch_of({"id": pa.nulls(1), "vec": pa.nulls(1), "state": pa.nulls(1), "change": [change.ravel().tolist()], "deepest": [deepest]}, schema)

        return source.mapInArrow(run, done if last else schema)

    sums = np.zeros((k, size + 1), object)
    bounds, carried, path, source = Bounds(now, np.zeros(k), min(k - 1, max(LEAST, k // 4 + 1))), None, None, rows
    for _ in range(rounds):
        before, path = path, fresh_path(spark, "centroids")
        walked(source, bounds, carried, False).write.parquet(path)
        if before:
            remove_path(spark, before)
        table = spark.read.schema(schema).parquet(path)
        of_tasks = table.where("change IS NOT NULL")
        cells = of_tasks.select(F.posexplode("change").alias("at", "v"), "deepest").groupBy("at").agg(F.sum("v").alias("v"), F.max("deepest").alias("deepest")).collect()
        for c in cells:
            sums[c["at"] // (size + 1), c["at"] % (size + 1)] += c["v"]
        after = np.array([[int(v) // int(row[size]) for v in row[:size]] if row[size] else list(old) for row, old in zip(sums, now)], np.int64)
        needed = bounds.b if carried is None else max(c["deepest"] for c in cells)
        source, carried = table.where("vec IS NOT NULL").select("id", "vec", "state"), bounds.b
        drift = np.sqrt(((after - now) ** 2).sum(axis=1).astype(np.float64)) * UP
        bounds = Bounds(after, drift, min(bounds.b, max(LEAST, needed)))
        if (after == now).all():
            break  # every later round would be the same
        now = after
    final = fresh_path(spark, "clusters")
    walked(source, bounds, carried, True).write.parquet(final)
    if path:
        remove_path(spark, path)
    return spark.read.schema(done).parquet(final).withColumnRenamed("id", id_col), bounds.centroids.tolist()


def described(found: DataFrame, centroids: list[list[int]], id_col: str = "vec_id") -> DataFrame:
    """found with the sum of distances of each cluster and of all, and a digest of the cluster's centroid."""
    sums = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # one row a centroid
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    pick = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster")) if values else F.lit(None).cast(kind)
    return found.select(id_col, "cluster", "distance", pick([sums.get(i, 0) for i in range(len(centroids))], "long").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), pick(marks, "string").alias("centroid_sha256"), "n_distances")
