"""Interaction audit of five document filters: what each removes in every order of them.

A: under 100 words; B: distinct words under 80 of 100; C: capital letters over 10 of 100 code points; D: any of #$%&*|; E: a copy of a
text of a smaller id. Four look at one text. Copies are found by sorting: rows are dealt in ranges of text fingerprint and id, each task
sorts its range by fingerprint, whole text and id, and compares every row with its predecessor. Ids are part of the
ranges, so copies of one text spread over many tasks; the texts that reach a task's end tell the tasks after it that
their first rows are copies too. Texts are no part of the ranges themselves, as Spark samples those on the driver.

Each document is then one mask of failures, and all figures follow from the number of documents of each part and mask: counts add up over
tasks, and the orders are laid over 32 counters of a part, not over documents.

Defined results: a null text is empty (no words, no code points: it fails A alone, and E if it isn't the first); words are
runs of other than ASCII white space; rows of one id are no copies of each other; a null id comes after all others and has no
labels; a document is good or toxic if any label row of its id says so; a null part is the empty string; a very long text is read whole; an
empty table gives no row.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import batch_of, bytes_of, cut, key_of, salted_join, struct

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
COPY = 1 << FILTERS.index("E")
WORDS, DISTINCT_PCT, CAPITALS_PCT = 100, 80, 10
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of UTF-8 that begin no character.
CONTINUED = bytes(range(0x80, 0xC0))
SIGNS = re.compile(rb"[#$%&*|]")


def failures(text: bytes) -> int:
    """The mask of filters A to D that a text (UTF-8) fails."""
    words = text.split()
    points = len(text.translate(None, CONTINUED))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    tests = (len(words) < WORDS, 100 * len(set(words)) < DISTINCT_PCT * len(words), 100 * capitals > CAPITALS_PCT * points, SIGNS.search(text) is not None)
    return sum(1 << i for i, failed in enumerate(tests) if failed)


def judged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """A row for each document: key, part, mask; task, and mark (fingerprint and digest of the text) where tasks before may hold copies of it.

    A row without a mask says that the text of its mark reaches the end of its task.
    """
    text = bytes_of(text_col)
    source = docs.select(F.xxhash64(text).alias("fp"), key_of(id_col).alias("key"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    ranged = source.repartitionByRange("fp", "key").sortWithinPartitions("fp", "text", "key").withColumn("task", F.spark_partition_id())
    schema = struct(("key", "long"), ("part", "string"), ("mask", "int"), ("task", "int"), ("mark", "binary"))

    def run(batches):
        first_fp = last_fp = last_text = None
        mask = least = task = 0
        mark, open_marks = None, []
        for batch in batches:
            masks, marks = [], []
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for fp, key, text in zip(batch.column(0).to_pylist(), keys.tolist(), batch.column(3)):
                if fp != last_fp or (value := text.as_py()) != last_text:
                    if fp != last_fp:
                        value, open_marks = text.as_py(), []
                        if last_fp is None:
                            first_fp = fp
                    last_fp, last_text, least, mask = fp, value, key, failures(value)
                    # the digest is asked for where the range began or may end with this text
                    mark = fp.to_bytes(8, "big", signed=True) + hashlib.sha256(value).digest()
                    open_marks.append(mark)
                masks.append(mask | COPY * (key > least))
                marks.append(mark if fp == first_fp else None)
            if batch.num_rows:
                task = batch.column(4)[0].as_py()
                yield batch_of({"key": batch.column(1), "part": batch.column(2), "mask": masks, "task": batch.column(4), "mark": pa.array(marks, pa.binary())}, schema)
        if open_marks:
            n = len(open_marks)
            yield batch_of({"key": [None] * n, "part": [None] * n, "mask": [None] * n, "task": [task] * n, "mark": open_marks}, schema)

    return ranged.mapInArrow(run, schema)


def counters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents of each part by the filters they fail."""
    rows = cut(judged(docs, id_col, text_col, part_col))
    ends = rows.where("mask IS NULL").groupBy("mark").agg(F.min("task").alias("since"))
    own = rows.where("mask IS NOT NULL")
    told = labels.groupBy(F.col(id_col).cast("long").alias("key")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad")).where("key IS NOT NULL AND (good = 1 OR bad = 1)")
    by = ["part", "mask", "task", "mark"]
    in_first = F.when(F.col("mark").isNotNull(), F.col("task")).alias("task")  # the task matters where a mark stands alone
    every = own.groupBy("part", "mask", in_first, "mark").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    # never broadcast: Spark's estimate from the file of labels knows nothing of the copies
    known = salted_join(own.select("key", "part", "mask", in_first, "mark"), told, "key", merge=True)
    known = known.groupBy(*by).agg(F.lit(0).cast("long").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("toxic"))
    # a few rows for each part and task from here on
    merged = every.unionByName(known).join(ends, "mark", "left")
    mask = F.when(F.col("since") < F.col("task"), F.col("mask").bitwiseOR(F.lit(COPY))).otherwise(F.col("mask"))
    return merged.groupBy("part", mask.alias("mask")).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "good", "toxic")])


def orders() -> list[dict]:
    """filter_order, step, the mask of the filters before it, the filter's own bit; for all orders."""
    out: list[dict] = []
    for order in map("".join, permutations(FILTERS)):
        bits = [1 << FILTERS.index(f) for f in order]
        out += [{"filter_order": order, "step": i + 1, "before": sum(bits[:i]), "bit": bits[i]} for i in range(len(bits))]
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    shapley sums what the filter removes over all orders: of a document that fails m filters each removes it in 120 / m of them.
    """
    count = counters(docs, labels, id_col, text_col, part_col)
    part = count.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # 32 at most
    steps = F.from_json(F.lit(json.dumps(orders())), "array<struct<filter_order:string,step:int,before:int,bit:int>>")  # the 600 steps, as one constant
    rows = part.select("part", "counts", F.explode(steps).alias("s")).select("part", "counts", "s.*")

    def total(test, value=lambda c: c["n"]):
        return F.aggregate(F.filter("counts", test), F.lit(0).cast("long"), lambda s, c: s + value(c))

    has = lambda c: c["mask"].bitwiseAND(F.col("bit")) != 0
    clear = lambda c: c["mask"].bitwiseAND(F.col("before")) == 0
    removed = lambda c: has(c) & clear(c)
    return rows.select(
        "part", "filter_order", "step",
        total(lambda c: clear(c) & ~has(c)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda c: has(c) & ~clear(c)).alias("redundant"),
        total(lambda c: c["mask"] == F.col("bit")).alias("unique_fails"),
        total(removed, lambda c: c["good"]).alias("good_lost"),
        total(removed, lambda c: c["toxic"]).alias("toxic_lost"),
        total(has, lambda c: c["n"] * (F.lit(120) / F.bit_count(c["mask"])).cast("long")).alias("shapley"),
    )
