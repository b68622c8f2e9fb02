"""SimHash near-duplicates through a Gray-order hierarchical index.

A document's fingerprint is the bitwise majority of the XXH64 of its word shingles. Two documents
link if their fingerprints differ in at most max_bits bits; a component is what links connect.

Only distinct fingerprints are compared. Of blocks of the 64 bits, any two that link agree in all
but max_bits; for each choice of the blocks that agree, fingerprints go to a bucket by those bits, so
that tasks share the work. Within its bucket each fingerprint is searched in a GrayIndex, which prunes
whole groups. It gives back one edge for each fingerprint that it joins to
another, not the pairs, so a group of n near copies makes n - 1 edges a bucket. Components follow
from the edges by repeated minimum labels over star-shaped graphs. The number of blocks is taken from
the number of distinct fingerprints; each choice finds all links.

Defined results: null, empty or blank text has no words and fingerprint zero, which links like any
other; fewer words than a shingle make one shingle; repeated shingles count each time; copies
and repeated rows have one fingerprint; a null id keeps its row and never is a component's id
unless no other is in it; a very long text is hashed whole, in slices; an empty table gives no row.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import LAST_ID, bytes_of, cut, free_name, key_of, pieces, salted_join, struct
from tallyloom.llm.gray_index import GrayIndex, gray_rank

#: Shingles hashed before their bits are added up.
SLICE = 1 << 16
#: Fingerprints that a bucket is expected to hold at most (as if they were spread evenly).
BUCKET = 4096
#: Tasks that the rows of one hub, label or fingerprint are dealt over.
SALTS = 16


def fingerprint(text: bytes, size: int = 4, seed: int = 42) -> int:
    """The SimHash of UTF-8 text over shingles of size words."""
    words = text.lower().split()  # of bytes: A-Z alone, and at \\x20 and \\x09-\\x0D alone
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = max(1, len(words) - size + 1)
    if n == 1:
        return digest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = ends[size - 1 :].tolist()
    set_bits = np.zeros(64, np.int64)
    for a in range(0, n, SLICE):
        hashes = np.array([digest(joined[i:j], seed) for i, j in zip(starts[a : a + SLICE], ends[a : a + SLICE])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # uint8 rows are added in blocks of 255, whose sums still fit
        whole = len(bits) // 255 * 255
        if whole:
            set_bits += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        set_bits += bits[whole:].sum(axis=0, dtype=np.int64)
    return sum(1 << i for i, x in enumerate((set_bits * 2 > n).tolist()) if x)


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text", size: int = 4, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) and a column of fingerprints as signed longs."""
    keep = docs.columns if keep is None else keep
    raw = free_name(docs, "_simhash_text")
    source = docs.select(*[F.col(f"`{c}`") for c in keep], bytes_of(text_col).alias(raw))
    schema = source.drop(raw).schema.add(name, "long")

    def run(batches):
        for batch in pieces(batches):
            marks = np.array([fingerprint(t, size) for t in batch.column(len(keep)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(marks)], names=schema.names)

    return source.mapInArrow(run, schema)


def blocks_for(n: int, max_bits: int, bucket: int = BUCKET) -> int:
    """The least number of blocks the 64 bits are cut into so that a bucket is expected to hold no more than bucket fingerprints.

    Few blocks make few tables with large buckets, in which the Gray tree does the pruning.
    """
    blocks = max_bits + 1
    while blocks < max_bits + 6 and n > bucket << (64 * (blocks - max_bits) // blocks):
        blocks += 1
    return blocks


def tables_of(blocks: int, max_bits: int) -> list[int]:
    """For each choice of blocks that agree, the mask of their bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    out = [sum(masks[i] for i in kept) for kept in combinations(range(blocks), blocks - max_bits)]
    assert len(out) == comb(blocks, max_bits)
    return out


def links(prints: DataFrame, max_bits: int = 4, count: int | None = None) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints (column fp) that connect what links connect."""
    masks = tables_of(blocks_for(prints.count() if count is None else count, max_bits), max_bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)]))
    rows = prints.select("fp", table.alias("t")).select("fp", "t.i", "t.key").repartition("i", "key")
    schema = struct(("src", "long"), ("dst", "long"))

    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        value, i, key = (np.concatenate(x) for x in zip(*parts))
        value = value.view(np.uint64)
        order = np.lexsort((gray_rank(value), key, i))
        value, i, key = value[order], i[order], key[order]
        bucket = np.cumsum(np.r_[False, (i[1:] != i[:-1]) | (key[1:] != key[:-1])])
        sizes = np.bincount(bucket)
        shared = sizes[bucket] > 1
        if not shared.any():
            return
        value, bucket = value[shared], bucket[shared]
        root = GrayIndex(bucket, value).joined(max_bits).roots(np.arange(len(value)))
        more = root != np.arange(len(value))
        edges = np.unique(np.stack([value[root[more]].view(np.int64), value[more].view(np.int64)], axis=1), axis=0)
        for a in range(0, len(edges), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(edges[a : a + (1 << 16), 0]), pa.array(edges[a : a + (1 << 16), 1])], names=["src", "dst"])

    return rows.mapInArrow(run, schema).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of an edge: label is the smallest node reachable.

    Alternates two steps until nothing changes: each node links its larger neighbours, then its
    smaller ones, to the smallest of them and itself (large star and small star). Every round is
    written to the shared folder. Minima are partial aggregates, and a hub's neighbours are dealt over
    SALTS tasks where they meet its minimum.
    """
    both = lambda e: e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    edges = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("dst"), F.greatest("src", "dst").alias("src")).distinct())
    before = None
    while True:
        near = both(edges)
        low = near.groupBy("src").agg(F.min("dst").alias("low")).withColumn("low", F.least("low", "src"))
        large = salted_join(near, low, "src", SALTS).where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst")
        kept = low.where("src > low").select("src", F.col("low").alias("dst"))
        edges = cut(large.unionByName(kept).distinct())
        down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = down.groupBy("src").agg(F.min("dst").alias("low"))
        small = salted_join(down, low, "src", SALTS).select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst")
        edges = cut(small.unionByName(low.select("src", F.col("low").alias("dst"))).distinct())
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            return edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("label"))
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, max_bits: int = 4) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id, the smallest id of the component, for each row."""
    marked = cut(with_fingerprint(docs, "fp", text_col, size, keep=[id_col]).select(F.col(f"`{id_col}`").alias("id"), "fp"))
    prints = cut(marked.groupBy("fp").agg(F.min(key_of("id")).alias("least")))
    found = components(links(prints, max_bits))
    named = prints.join(found, prints.fp == found.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    classes = salted_join(named.select("fp", "label"), least, "label", SALTS).select("fp", "component")
    return salted_join(marked, classes, "fp", SALTS).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component") != LAST_ID, F.col("component")).alias("component_id"),
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of docs without near copies: of each component the row of the smallest id (of repeated rows one)."""
    row = {k: free_name(docs, f"_simhash_{k}") for k in ("fp", "id", "text", "rank")}
    told = docs.select(key_of(id_col).alias(row["id"]), F.xxhash64(bytes_of(text_col), F.lit(1)).alias(row["text"]), F.col(f"`{text_col}`"))
    marked = cut(with_fingerprint(told, row["fp"], text_col, size, [row["id"], row["text"]]))
    fp = F.col(row["fp"])
    prints = cut(marked.groupBy(fp.alias("fp")).agg(F.min(row["id"]).alias("least")))
    found = components(links(prints, max_bits))
    named = prints.join(found, prints.fp == found.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    lowest = named.groupBy("label").agg(F.min("least").alias("lowest"))
    chosen = salted_join(named, lowest, "label", SALTS).where("least = lowest").groupBy("label").agg(F.min("fp").alias("fp"), F.min("lowest").alias("lowest"))
    # a fingerprint's rows are spread by their ids in this join
    chosen = marked.join(chosen, (fp == F.col("fp")) & (F.col(row["id"]) == F.col("lowest"))).groupBy(F.col("lowest").alias(row["id"]), F.col("fp")).agg(F.min(row["text"]).alias(row["text"]))
    kept = docs.withColumns({row["id"]: key_of(id_col), row["text"]: F.xxhash64(bytes_of(text_col), F.lit(1))})
    kept = kept.join(chosen.select(row["id"], row["text"]), [row["id"], row["text"]], "left_semi")
    from pyspark.sql import Window

    one = Window.partitionBy(row["id"], row["text"]).orderBy(F.lit(0))
    return kept.withColumn(row["rank"], F.row_number().over(one)).where(F.col(row["rank"]) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
