"""Toxicity scores from a factorization machine over hashed terms.

Terms are the distinct lower-case words of a text, hashed to BUCKETS. The machine has a bias, a weight
for each bucket and a vector of FACTORS for each: a pair of terms in one text adds the product of their
vectors, so that a word may count differently beside another than alone.

It is fitted on the driver, on a sample of the labelled rows that is bounded by max_rows (rows of least
hash of the id; an expectation a tenth below the bound and a hard limit at it). The sample arrives as
hashed terms, not as text. Buckets that tell the labels apart and the most frequent ones take part,
at most FEATURES of them. Scoring ships the fitted arrays, of constant size, and shuffles nothing.

Defined results: null or empty text has no terms and the score of the bias; rows without a label or
with a null id teach nothing; without rows of both labels or any telling term, every score is the share of label 1
(0 if there are none); repeated rows get equal scores; of several labels of one id the greatest counts; a very
long text is scored by all its terms; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import batch_of, bytes_of, struct
from tallyloom.llm.decontaminate import words_of

BUCKETS = 1 << 20
FEATURES = 1024
FACTORS = 8
#: Labelled rows that the machine is fitted on, at most.
MAX_ROWS = 12_000


def terms(text: bytes) -> np.ndarray:
    """The distinct hashed terms of a text, ascending."""
    return np.unique(np.fromiter((zlib.crc32(w) for w in set(words_of(text))), np.int64) & (BUCKETS - 1))


@dataclass
class Machine:
    buckets: np.ndarray  # ascending
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, own: np.ndarray) -> float:
        """The probability of label 1 for a text of these terms."""
        if len(self.buckets) and len(own):
            at = np.searchsorted(self.buckets, own)
            at[at == len(self.buckets)] = 0
            at = at[self.buckets[at] == own]
            v = self.vectors[at]
            margin = self.bias + self.weights[at].sum() + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        else:
            margin = self.bias
        return float(1 / (1 + np.exp(-np.clip(margin, -35, 35))))


def chosen_buckets(rows: list[np.ndarray], labels: np.ndarray, features: int) -> np.ndarray:
    """Buckets whose share differs most between the labels (three quarters of features), then the most frequent, one for 50 rows."""
    which = np.concatenate(rows)
    buckets, back = np.unique(which, return_inverse=True)
    n, positive = len(rows), labels.sum()
    row_of = np.repeat(np.arange(n), [len(r) for r in rows])
    count = np.bincount(back, minlength=len(buckets))
    hits = np.bincount(back, labels[row_of], len(buckets))
    share = count / n
    z = (hits - positive * share) / np.sqrt(np.maximum(positive * share * (1 - share), 1e-9) + 0.5)
    telling = np.argsort(-np.abs(z), kind="stable")
    telling = telling[(np.abs(z[telling]) > 4) & (count[telling] >= 4)][: features * 3 // 4]
    common = np.argsort(-count, kind="stable")[: min(features // 4, n // 50)]
    return buckets[np.unique(np.concatenate((telling, common)))]


def fit(rows: list[np.ndarray], labels: np.ndarray, features: int = FEATURES, factors: int = FACTORS, epochs: int = 40, rate: float = 0.3, decay: float = 1e-6, weight: float = 4.0, seed: int = 7) -> Machine:
    """Minimises the log loss, rows of label 1 counting weight times, by Adagrad over batches of 128 rows."""
    labels = np.asarray(labels, np.float64)
    share = float(labels.mean()) if len(labels) else 0.0
    buckets = chosen_buckets(rows, labels, features) if 0 < share < 1 and any(map(len, rows)) else np.empty(0, np.int64)
    if not len(buckets):
        return Machine(np.empty(0, np.int64), float(np.clip(np.log(max(share, 1e-15) / max(1 - share, 1e-15)), -35, 35)), np.empty(0), np.empty((0, factors)))
    random = np.random.default_rng(seed)
    x = np.zeros((len(rows), len(buckets)), np.bool_)
    for i, own in enumerate(rows):
        at = np.searchsorted(buckets, own)
        at[at == len(buckets)] = 0
        x[i, at[buckets[at] == own]] = True
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(len(buckets), np.float32), random.normal(0, 0.01, (len(buckets), factors)).astype(np.float32)
    seen_b, seen_w, seen_v = 1e-6, np.full_like(w, 1e-6), np.full_like(v, 1e-6)
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for a in range(0, len(order), 128):
            batch = x[order[a : a + 128]].astype(np.float32)
            sums = batch @ v
            margin = bias + batch @ w + 0.5 * ((sums**2).sum(axis=1) - batch @ (v**2).sum(axis=1))
            truth = labels[order[a : a + 128]]
            error = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - truth) * (1 + (weight - 1) * truth)
            error = (error / len(batch)).astype(np.float32)
            gw = batch.T @ error + decay * w
            gv = batch.T @ (error[:, None] * sums) - (batch.T @ error)[:, None] * v + decay * 10 * v
            gb = float(error.sum())
            seen_b, seen_w, seen_v = seen_b + gb * gb, seen_w + gw * gw, seen_v + gv * gv
            bias -= rate * gb / seen_b**0.5
            w -= rate * gw / np.sqrt(seen_w)
            v -= 0.25 * rate * gv / np.sqrt(seen_v)
    return Machine(buckets, float(bias), w.astype(np.float64), v.astype(np.float64))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Terms and labels of at most max_rows labelled documents."""
    known = labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("label"))
    n = known.count()
    if n > max_rows:
        share = int(0.9 * max_rows / n * (1 << 30))
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share)
    bounded = known.limit(max_rows)  # ids and labels alone: proven to be small, so it may be broadcast
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), bytes_of(text_col).alias("text")).join(F.broadcast(bounded), "id").select("id", "label", "text")
    schema = struct(("id", "string"), ("label", "int"), ("terms", "binary"))

    def run(batches):
        for batch in batches:
            own = [terms(t).astype("<u4").tobytes() for t in batch.column(2).to_pylist()]
            yield batch_of({"id": batch.column(0).cast(pa.string()), "label": batch.column(1), "terms": own}, schema)

    got = sorted((r.id, r.label, bytes(r.terms)) for r in rows.mapInArrow(run, schema).limit(max_rows).collect())
    return [np.frombuffer(t, "<u4").astype(np.int64) for _, _, t in got], np.array([y for _, y, _ in got], np.float64)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Machine:
    """A machine from the labelled rows of docs."""
    return fit(*sample(docs, labels, id_col, text_col, label_col, max_rows))


def scored(docs: DataFrame, machine: Machine, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns keep and the score of each row."""
    source = docs.select(*[F.col(f"`{c}`") for c in keep], bytes_of(text_col))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(name, "double")

    def run(batches):
        for batch in batches:
            scores = [machine.score(terms(t)) for t in batch.column(len(keep)).to_pylist()]
            yield batch_of({c: batch.column(i) for i, c in enumerate(keep)} | {name: scores}, schema)

    return source.mapInArrow(run, schema)
