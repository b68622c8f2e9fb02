"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent n-grams, most frequent first. A document's own
list is compared to each profile: an n-gram counts by how far it is out of place, or the length
of the profile if it isn't there. The language of the smallest sum wins.

Profiles are learned from all given rows: each task counts n-grams by language, Spark adds them up
and keeps the top of each language. What goes to the tasks is langs x TOP n-grams. N-grams are of 1
to 3 characters over lower-case letters, words set off by a space.

Defined results: null text or text without a letter is "und" with score 0; ties between languages go
to the name that sorts first; without any row to learn from, all is "und"; a null language
teaches nothing; repeated rows count each time in learning and get equal results; very long texts are
read whole; an empty table teaches nothing and gives no row.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import batch_of, free_name, give_back, pieces, struct, text_at, text_of

#: N-grams of a profile and of a document's list.
TOP = 400
#: Distinct n-grams that a task counts in one piece before it hands them on.
PIECE = 1 << 21


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point itself if it is a letter, else 0."""
    return np.fromiter((i if chr(i).isalpha() else 0 for i in range(sys.maxunicode + 1)), np.int64, sys.maxunicode + 1)


def grams(text: str) -> np.ndarray:
    """The n-grams of 1 to 3 characters as numbers, 21 bits a character; empty if there is no letter."""
    points = letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    if not points.any():
        return np.empty(0, np.int64)
    points = np.concatenate(([0], points, [0]))
    gap = points == 0
    points = points[~(gap & np.r_[False, gap[:-1]])]  # one space between words
    two = points[:-1] << 21 | points[1:]
    three = two[:-1] << 21 | points[2:]
    middle = three[(points[1:-1] != 0)]  # no word ends and begins inside
    return np.concatenate((points[points != 0], two + (1 << 42), middle))


def ranked(text: str, top: int = TOP) -> np.ndarray:
    """A text's most frequent n-grams, most frequent first; equal counts by number."""
    every = np.sort(grams(text))
    if not len(every):
        return every
    starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    counts = np.diff(np.r_[starts, len(every)])
    if len(starts) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        starts, counts = starts[counts >= least], counts[counts >= least]
    return every[starts[np.argsort(-counts, kind="stable")[:top]]]


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> dict[str, list[int]]:
    """The profile of each language of docs, from all its rows."""
    rows = docs.where(F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{lang_col}`").cast("string").alias("lang"), text_of(text_col).alias("text"))
    schema = struct(("lang", "string"), ("gram", "long"), ("n", "long"))

    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in pieces(batches, 2_500, 16 << 20):
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for a in range(0, len(texts), 500):
                    held.setdefault(lang, []).append(np.unique(np.concatenate([grams(t) for t in texts[a : a + 500]]), return_counts=True))
            if sum(len(g) for x in held.values() for g, _ in x) > PIECE:
                yield from flush(held)
        yield from flush(held)
        give_back()

    def flush(held):
        for lang, parts in held.items():
            keys, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)
            for a in range(0, len(keys), 1 << 16):
                part = keys[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part), pa.array(counts[a : a + (1 << 16)])], names=["lang", "gram", "n"])
        held.clear()

    counts = rows.mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # a language's best of each of 64 parts, then the best of these: no language meets in one task with all its n-grams
    from pyspark.sql import Window

    for part in (F.pmod(F.xxhash64("gram"), F.lit(64)), F.lit(0)):
        best = Window.partitionBy("lang", part).orderBy(F.desc("n"), "gram")
        counts = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).drop("rank")
    out: dict[str, list[int]] = {}
    for r in counts.orderBy("lang", F.desc("n"), "gram").collect():  # languages x top rows
        out.setdefault(r.lang, []).append(r.gram)
    return out


class Ranks:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, by_lang: dict[str, list[int]], top: int = TOP):
        self.langs, self.top = sorted(by_lang), top
        self.grams = np.unique(np.array([g for x in by_lang.values() for g in x], np.int64))
        self.place = np.full((len(self.langs), len(self.grams) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.place[i, np.searchsorted(self.grams, by_lang[lang])] = np.arange(len(by_lang[lang]))

    def predict(self, text: str) -> tuple[str, float, int]:
        """The language, a score of 0 to 1 (how much nearer its profile is than a text of unknown n-grams), and the length of the text's list."""
        own = ranked(text, self.top)
        if not len(own) or not self.langs:
            return "und", 0.0, len(own)
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == own, at, len(self.grams)) if len(self.grams) else np.zeros(len(own), np.int64)
        place = self.place[:, at]
        distance = np.where(place < 0, self.top, np.abs(place - np.arange(len(own)))).sum(axis=1)
        best = int(distance.argmin())
        return self.langs[best], 1.0 - float(distance[best]) / (self.top * len(own)), len(own)


def with_language(docs: DataFrame, by_lang: dict[str, list[int]], pred: str, score: str, text_col: str = "text", keep: list[str] | None = None, size: str | None = None) -> DataFrame:
    """docs (or its columns keep) and the two columns of the prediction; with size also the number of the text's n-grams that were compared."""
    keep = docs.columns if keep is None else keep
    raw = free_name(docs, "_lang_text")
    at = text_at(docs, keep, text_col)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], *[text_of(text_col).alias(raw)] * (at is None))
    schema = source.drop(raw).schema.add(pred, "string").add(score, "double")
    if size:
        schema = schema.add(size, "long")

    def run(batches):
        model = Ranks(by_lang)
        for batch in pieces(batches):
            said = [model.predict(t or "") for t in batch.column(len(keep) if at is None else at).to_pylist()]
            columns = {c: batch.column(i) for i, c in enumerate(keep)} | {pred: [x for x, _, _ in said], score: [x for _, x, _ in said]}
            yield batch_of(columns | ({size: [x for _, _, x in said]} if size else {}), schema)

    return source.mapInArrow(run, schema)
