"""Vector anomalies: nearest neighbours in a memory bank, thresholds, classifier metrics, coresets.

Vectors are arrays. Neighbours and coresets are found over a metric partition (cells around pivots, blocks in rings), so neither the bank nor the choices are ever on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import metric

def nearest(vectors: DataFrame, bank: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, distance): the Euclidean distance of each vector to the nearest of the bank; exact, null where the bank is empty. Null vectors give no row."""
    return metric.nearest(vectors, bank, id_col, column)[0]


def save_bank(bank: DataFrame, limit: DataFrame, path: str) -> None:
    """A fitted detector as two tables: the bank's vectors, and the row of its threshold."""
    bank.write.mode("overwrite").parquet(f"{path}/bank")
    limit.write.mode("overwrite").parquet(f"{path}/threshold")


def load_bank(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/bank"), spark.read.parquet(f"{path}/threshold")


def image_scores(distances: DataFrame, image: str) -> DataFrame:
    """An image's score: the greatest distance of its patches."""
    return distances.groupBy(image).agg(F.max("distance").alias("score"))


def threshold(scores: DataFrame, quantile: float = 0.95) -> DataFrame:
    """One row: that quantile of the scores and the greatest score."""
    return scores.agg(F.percentile("score", F.lit(quantile)).alias("schwelle"), F.max("score").alias("maximum"))


def decided(scores: DataFrame, limit: DataFrame) -> DataFrame:
    """Scores by the greatest of training (at most 1) and NOK strictly above the threshold."""
    return scores.crossJoin(F.broadcast(limit)).withColumns({"norm": F.least(F.col("score") / (F.col("maximum") + 1e-8), F.lit(1.0)), "decision": F.when(F.col("score") > F.col("schwelle"), "NOK").otherwise("OK")}).drop("schwelle", "maximum")


def metrics(scored: DataFrame, label: str, score: str, limit: float) -> DataFrame:
    """One row: ROC AUC (ties count half), average precision, and precision, recall and F1 strictly above limit.

    Works on counts by distinct score, so one partition holds scores, not rows; running sums over them come
    from a range partitioning and the totals of its parts.
    """
    counts = scored.groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    ranged = counts.repartitionByRange(F.desc("s")).withColumn("_part", F.spark_partition_id())
    from tallyloom.sources.session import cut

    ranged = cut(ranged)
    totals = ranged.groupBy("_part").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_bp"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_bn"))
    inner = Window.partitionBy("_part").orderBy(F.desc("s"))
    run = ranged.join(F.broadcast(offsets), "_part").select("s", "p", "n", (F.sum("p").over(inner) + F.col("_bp")).alias("tp"), (F.sum("n").over(inner) + F.col("_bn")).alias("fp"))
    # pairs (positive, negative) in right order: each group's negatives below all positives so far, ties half
    area = F.sum((F.col("n") * (F.col("tp") - F.col("p")) * 2 + F.col("n") * F.col("p")).cast("decimal(38,0)"))
    sums = run.agg(
        area.alias("area"), F.sum("p").alias("P"), F.sum("n").alias("N"), exact_ap(),
        F.sum(F.when(F.col("s") > limit, F.col("p")).otherwise(0)).alias("TP"), F.sum(F.when(F.col("s") > limit, F.col("n")).otherwise(0)).alias("FP"),
    )
    precision, recall = F.try_divide(F.col("TP").cast("double"), (F.col("TP") + F.col("FP")).cast("double")), F.try_divide(F.col("TP").cast("double"), F.col("P").cast("double"))
    return sums.select(
        F.try_divide(F.col("area").cast("double"), F.col("P").cast("double") * F.col("N") * 2).alias("auc"),
        F.try_divide(F.col("ap"), F.col("P").cast("double")).alias("ap"),
        F.coalesce(precision, F.lit(0.0)).alias("precision"), F.coalesce(recall, F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2.0 * F.col("TP"), 2.0 * F.col("TP") + F.col("FP") + (F.col("P") - F.col("TP"))), F.lit(0.0)).alias("f1"),
    )


def exact_ap():
    return F.sum((F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).cast("decimal(38,10)")).cast("double").alias("ap")


def coreset(vectors: DataFrame, share: float = 0.1, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The farthest-first subset: from the first vector on, always the one farthest from those chosen.

    Many choices are settled in one pass over blocks of vectors, the same ones as one at a time. A vector (ids are unique) is chosen once, even where copies of it are all that is left.
    """
    n = vectors.where(F.col(column).isNotNull()).count()
    ids, _ = metric.farthest_first(vectors, max(1, int(n * share)) if n else 0, id_col, column)
    return vectors.select(id_col, column).join(ids, id_col, "left_semi")


def reconstruction_scores(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, score): squared error after projection on k principal components (a linear stand-in for an autoencoder)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(id_col, F.col(column).cast("array<double>").alias("x"))
    means = rows.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col").alias("m"), F.count("*").alias("c")).orderBy("pos").collect()  # one row a dimension
    mean = F.array(*[F.lit(float(r.m)) for r in means])
    centred = rows.withColumn("x", F.zip_with("x", mean, lambda a, b: a - b)).withColumn("v", array_to_vector("x"))
    model = PCA(k=k, inputCol="v", outputCol="z").fit(centred)
    norm = lambda c: F.aggregate(c, F.lit(0.0), lambda s, a: s + a * a)
    return model.transform(centred).select(id_col, F.greatest(F.lit(0.0), norm(F.col("x")) - norm(vector_to_array("z"))).alias("score"))
