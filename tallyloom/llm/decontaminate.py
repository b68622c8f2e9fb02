"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, one scan of the text.

Items and documents are normalised alike: A-Z in lower case, words are runs of digits, letters and
bytes above 0x7F, joined by one space. Windows of ten consecutive item words (or the whole of a
shorter item) are the automaton's patterns. A document is scanned once; hits are mapped back to
words and to byte offsets of the original text.

The benchmark is shipped to the tasks. Its size is checked: beyond bound bytes it is cut into parts
by item. Each part is one more scan with an automaton of its own, its hits are written to the shared
folder, and all hits of a document are put together in the end; so neither the driver nor a task ever
holds more than a part. Nothing else is gathered, and with one part nothing is shuffled.

Defined results: null or empty text has no words and no hits; a null or wordless item has no window;
items of the same words all count; repeated rows get equal results; a null item_id is left out of
the list of items, though its windows hit; a very long text is scanned whole; an empty table gives no row,
an empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import batch_of, bytes_of, cut, free_name, key_of, pieces, struct, text_at

WINDOW = 10
#: UTF-8 bytes of benchmark text that one automaton takes; in memory it is some 500 times as large.
BOUND = 1 << 19

#: Byte by byte: letters in lower case, digits and bytes above 0x7F as they are, all else a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Automaton:
    """All windows of some items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        import ahocorasick

        owners: dict[bytes, tuple[int, set[int]]] = {}
        self.names = [name for name, _ in items]
        for i, (_, text) in enumerate(items):
            words = words_of(text)
            width = min(window, len(words))
            for a in range(len(words) - width + 1) if width else ():
                owners.setdefault(b" ".join(words[a : a + width]), (width, set()))[1].add(i)
        self.found = ahocorasick.Automaton()
        for pattern, (width, who) in owners.items():
            self.found.add_word(f" {pattern.decode('latin-1')} ", (width, tuple(sorted(who))))
        self.empty = not owners
        if owners:
            self.found.make_automaton()

    def scan(self, words: list[bytes]) -> list[tuple[int, int, tuple[int, ...]]]:
        """Occurrences as first word, one past the last word, and the items."""
        if self.empty or not words:
            return []
        text = f" {b' '.join(words).decode('latin-1')} "
        hits = [(end, what) for end, what in self.found.iter(text)]
        if not hits:
            return []
        spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
        last = np.searchsorted(spaces, [end for end, _ in hits])  # the space after word i is the i+1st
        return [(int(e) - width, int(e), who) for e, (width, who) in zip(last, (w for _, w in hits))]


def merge(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Sorted disjoint spans; those that overlap or touch become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def byte_spans(text: bytes, spans: list[list[int]]) -> list[list[int]]:
    """Where spans of words stand in the original text."""
    plain = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
    edge = np.diff(np.r_[False, plain, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [[int(starts[a]), int(ends[b - 1])] for a, b in spans]


def parts_of(items: DataFrame, id_col: str, text_col: str, bound: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in parts of about bound bytes at most, and at least one part."""
    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("id"), bytes_of(text_col).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // bound) if total > bound else 1)
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)
        yield [(r.id, bytes(r.text)) for r in part.distinct().collect()]


FOUND = struct(("n_words", "long"), ("words", "array<array<int>>"), ("bytes", "array<array<int>>"), ("items", "array<string>"))


def scanned(docs: DataFrame, items: list[tuple[str | None, bytes]], text_col: str, keep: list[str], window: int, known: str | None = None) -> tuple[DataFrame, str]:
    """keep and a struct of n_words, spans of hit words, their bytes, and the item ids; known: such a column whose hits count as well."""
    raw, out = free_name(docs, "_leak_text"), free_name(docs, "_leak")
    before = F.col(known) if known else F.lit(None).cast(FOUND)
    at = text_at(docs, keep, text_col)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], *[bytes_of(text_col).alias(raw)] * (at is None), before.alias(out))
    schema = source.drop(raw).schema

    def run(batches):
        one = Automaton(items, window)
        for batch in pieces(batches):
            found = []
            texts = batch.column(len(keep) if at is None else at).cast(pa.binary())
            for text, had in zip(texts.to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                text = text or b""
                words = words_of(text)
                spans = [tuple(s) for s in had["words"]] if had else []
                names = set(had["items"]) if had else set()
                for a, b, who in one.scan(words):
                    spans.append((a, b))
                    names.update(one.names[i] for i in who)
                spans = merge(spans)
                found.append({"n_words": len(words), "words": spans, "bytes": byte_spans(text, spans) if spans else [], "items": sorted(x for x in names if x is not None)})
            columns = {c: batch.column(i) for i, c in enumerate(keep)}
            yield batch_of(columns | {out: found}, schema)

    return source.mapInArrow(run, schema), out


def leaks(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, bound: int = BOUND) -> tuple[DataFrame, str]:
    """docs (or its columns keep) and a struct of what is hit; returns that frame and the struct's name."""
    keep = docs.columns if keep is None else keep
    parts = parts_of(items, item_col, item_text, bound)
    first, hits, known = next(parts), None, None
    for part in parts:
        rows = docs.select(key_of(id_col).alias("key"), F.xxhash64(bytes_of(text_col), F.lit(1)).alias("mark"), F.col(f"`{text_col}`").alias("text"))
        found, out = scanned(rows, part, "text", ["key", "mark"], window)
        found = cut(found.where(F.size(F.col(out)["words"]) > 0))
        hits = found if hits is None else hits.unionByName(found)
    if hits is not None:
        key, mark, known = free_name(docs, "_leak_key"), free_name(docs, "_leak_mark"), free_name(docs, "_leak_known")
        flat = lambda field: F.array_distinct(F.flatten(F.collect_list(F.col(out)[field])))
        every = hits.groupBy(F.col("key").alias(key), F.col("mark").alias(mark)).agg(F.struct(F.lit(0).cast("long").alias("n_words"), flat("words").alias("words"), flat("bytes").alias("bytes"), flat("items").alias("items")).cast(FOUND).alias(known))
        docs = docs.withColumns({key: key_of(id_col), mark: F.xxhash64(bytes_of(text_col), F.lit(1))}).join(every, [key, mark], "left")
    return scanned(docs, first, text_col, keep, window, known)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """For each document: id, n_words, n_hit, n_items, items_sha256, contaminated, and hit spans and items."""
    found, out = leaks(docs, items, [id_col], id_col=id_col, **how)
    hit = F.col(out)
    return found.select(
        F.col(f"`{id_col}`"),
        hit["n_words"].alias("n_words"),
        F.aggregate(hit["words"], F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0]).alias("n_hit"),
        F.size(hit["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hit["items"], ","), 256).alias("items_sha256"),
        (F.size(hit["words"]) > 0).alias("contaminated"),
        hit["bytes"].alias("hit_bytes"),
        hit["items"].alias("items"),
    )


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """docs without the rows that an item's window occurs in; the columns stay as they are."""
    found, out = leaks(docs, items, **how)
    return found.where(F.size(F.col(out)["words"]) == 0).drop(out)
