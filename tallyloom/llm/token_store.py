"""Token ids in files of directly addressable codes.

Ids are split into chunks of eight bits. Level 0 holds the lowest chunk of every id; a bitmap says
which ids go on, and level 1 holds the next chunk of just those, and so on. A rank directory over
each bitmap gives an id's place in the next level at once, so any token is read without decoding
a block.

Documents go to files in ascending id order: rows are ranged by id, tasks write files of a bounded
number of tokens, and a running sum over the tasks' totals (a row a task) gives where each begins.
A file is a row with its bytes in a Parquet table of the shared folder, so that any store that
Spark writes to will do, and a task that is run again writes the same file.

Defined results: null or empty text gives the end id alone; a null id comes last; rows of equal ids
are ordered by text; ids that need more bits make more levels; a very long text is encoded whole and
ends its file; an empty table gives no file and no row. The files stay in the shared folder: they are
what the operator writes, and whoever owns that folder removes them.
"""

from __future__ import annotations

import os
import struct as binary
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.chunks import ChunkCodec
from tallyloom.llm.common import batch_of, fresh_path, key_of, struct, text_of

MAGIC = b"DAC1"
#: Bits between entries of the rank directory.
BLOCK = 512
#: Characters of the documents that are split at a time.
BLOCK_CHARS = 4 << 20
#: Tokens of a file; a file ends with the document that reaches them.
FILE_TOKENS = 1 << 20
#: Chunks given to the tokenizer as one text.
JOINED = 64


def encode_codes(ids: np.ndarray) -> bytes:
    """The levels of ids (unsigned 32-bit)."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunk, more = (rest & 255).astype(np.uint8), rest > 255
        bits = np.packbits(np.r_[more, np.zeros(-len(more) % BLOCK, bool)], bitorder="little")
        ones = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.int64)
        directory = np.r_[0, np.cumsum(ones)].astype("<u8")
        levels.append((chunk.tobytes(), bits.tobytes(), directory.tobytes(), len(rest)))
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            break
    head = MAGIC + binary.pack("<I", len(levels)) + b"".join(binary.pack("<Q", n) for *_, n in levels)
    return head + b"".join(directory + bits + chunk for chunk, bits, directory, _ in levels)


class Codes:
    """Random access to encoded ids."""

    def __init__(self, data: bytes | memoryview):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a file of codes")
        (count,) = binary.unpack_from("<I", data, 4)
        sizes, at = binary.unpack_from(f"<{count}Q", data, 8), 8 + 8 * count
        self.levels, self.bits, self.bitmaps = [], [], []
        for n in sizes:
            blocks = -(-n // BLOCK)
            directory = np.frombuffer(data, "<u8", blocks + 1, at)
            at += 8 * (blocks + 1)
            words = np.frombuffer(data, "<u8", blocks * BLOCK // 64, at)
            at += blocks * BLOCK // 8
            self.levels.append((np.frombuffer(data, np.uint8, n, at), words, directory))
            self.bits.append(words.view(np.uint8))
            self.bitmaps.append(self.bits[-1].tobytes())
            at += n
        self.size = sizes[0]
        self.end = at

    def rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """How many ids before position at go on to the next level: the directory and at most a block of bits."""
        _, words, directory = self.levels[level]
        block, inside = at // BLOCK, at % BLOCK
        out = directory[block].astype(np.int64)
        word = block * (BLOCK // 64)
        for i in range(BLOCK // 64):
            bits = np.clip(inside - 64 * i, 0, 64)
            mask = np.where(bits == 64, np.uint64(2**64 - 1), (np.uint64(1) << (bits % 64).astype(np.uint64)) - np.uint64(1))
            out += np.bitwise_count(words[word + i] & mask)
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        """The ids at any positions."""
        at = np.asarray(at, np.int64)
        out, who = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, (chunk, words, _) in enumerate(self.levels):
            out[who] |= chunk[at].astype(np.uint32) << np.uint32(8 * level)
            on = (words[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1
            if not on.any():
                break
            at, who = self.rank(level, at[on]), who[on]
        return out

    def rank_one(self, level: int, at: int) -> int:
        """As rank, for one position: the directory's entry and the bits of at most one block."""
        _, words, directory = self.levels[level]
        block = at // BLOCK
        first, byte = block * BLOCK // 8, at // 8
        bits = int.from_bytes(self.bitmaps[level][first : byte + 1], "little") & ((1 << at - first * 8) - 1)
        return int(directory[block]) + bits.bit_count()

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids of a range: one lookup in each directory, then neighbours; nothing before it is decoded."""
        out = np.zeros(end - start, np.uint32)
        who, a, b = None, start, end
        for level, (chunk, _, _) in enumerate(self.levels):
            if a >= b:
                break
            part = chunk[a:b].astype(np.uint32) << np.uint32(8 * level)  # positions of a range stay neighbours on every level
            if who is None:
                out += part
            else:
                out[who] |= part
            if level + 1 == len(self.levels):
                break
            low = a // 8
            on = np.flatnonzero(np.unpackbits(self.bits[level][low : -(-b // 8)], bitorder="little")[a - 8 * low : b - 8 * low])
            if not len(on):
                break
            who = on if who is None else who[on]
            a = self.rank_one(level, a)
            b = a + len(on)
        return out


def pack_file(keys: list[int], lengths: list[int], ids: np.ndarray) -> bytes:
    """A file: number of documents, their ids, where each starts, and the codes."""
    starts = np.r_[0, np.cumsum(lengths)].astype("<u8")
    return binary.pack("<Q", len(keys)) + np.array(keys, "<i8").tobytes() + starts.tobytes() + encode_codes(ids)


def unpack_file(data: bytes) -> tuple[np.ndarray, np.ndarray, Codes]:
    (n,) = binary.unpack_from("<Q", data)
    return np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<u8", n + 1, 8 + 8 * n), Codes(memoryview(data)[16 + 16 * n :])


def token_widths(tokenizer) -> np.ndarray:
    """For each id the bytes of text that it stands for: a character of a byte-level token is a byte, an added token is written as it is."""
    added = tokenizer.get_added_tokens_decoder()
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    widths = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        widths[i] = len(added[i].content.encode()) if i in added else len(token)
    return widths


@lru_cache(maxsize=2)
def codec(path: str) -> ChunkCodec:
    """One tokenizer and cache for all tasks of a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    many = getattr(own, "encode_batch_fast", own.encode_batch)
    widths = token_widths(own)

    def encode_each(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in many(strings, add_special_tokens=False)]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, counts.sum()), counts

    def encode_chunks(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, _ = encode_each([" " + " ".join(chunks[a : a + JOINED]) for a in range(0, len(chunks), JOINED)])
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, chunks)), np.int64, len(chunks)) + 1)
        reached = np.cumsum(widths[ids])
        upto = np.searchsorted(reached, ends, side="right")
        if np.array_equal(np.r_[0, reached][upto], ends) and upto[-1] == len(ids):
            return ids, np.diff(upto, prepend=0)
        return encode_each([f" {x}" for x in chunks])  # a tokenizer whose tokens don't stand for the text's bytes

    def encode_many(chunks: list[str], strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [f(x[a : a + 20_000]) for f, x in ((encode_chunks, chunks), (encode_each, strings)) for a in range(0, len(x), 20_000)]
        return np.concatenate([np.zeros(0, np.uint32), *(ids for ids, _ in parts)]), np.concatenate([np.zeros(0, np.int64), *(counts for _, counts in parts)])

    return ChunkCodec(encode_many, BLOCK_CHARS)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> None:
    """Encodes all documents in ascending id order and writes the files as a table at path."""
    ranged = docs.select(key_of(id_col).alias("key"), F.col(f"`{id_col}`").isNull().alias("none"), text_of(text_col).alias("text")).repartitionByRange("key", "none").sortWithinPartitions("key", "none", "text")
    schema = struct(("part", "int"), ("file", "int"), ("start", "long"), ("documents", "long"), ("tokens", "long"), ("nulls", "long"), ("data", "binary"))
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        own, part = codec(tokenizer), TaskContext.get().partitionId()
        file, start = 0, 0
        keys: list[int] = []
        lengths: list[int] = []
        codes: list[bytes] = []
        nulls = held = 0

        def packed():
            ids = np.frombuffer(b"".join(codes), "<u4")
            row = {"part": [part], "file": [file], "start": [start], "documents": [len(keys)], "tokens": [len(ids)], "nulls": [nulls], "data": [pack_file(keys, lengths, ids)]}
            return batch_of(row, schema)

        for batch in batches:
            for key, none, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), own.encode(batch.column(2))):
                keys.append(key)
                nulls += none
                codes.append(code + end)
                lengths.append(len(code) // 4 + 1)
                held += lengths[-1]
                if held >= file_tokens:
                    yield packed()
                    file, start = file + 1, start + held
                    keys, lengths, codes = [], [], []
                    nulls = held = 0
        if keys:
            yield packed()

    ranged.mapInArrow(run, schema).write.parquet(path)


def placed_files(spark, path: str, *more: str) -> DataFrame:
    """start (ids of all files before), more columns and data of each file."""
    files = spark.read.parquet(path)
    # a row for each task that wrote: a running sum over them is small wherever the tasks could be planned
    totals = files.groupBy("part").agg(F.sum("tokens").alias("all"))
    before = F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.join(totals.select("part", before.alias("before")), "part").select((F.col("before") + F.col("start")).alias("start"), *more, "data")


def read_tokens(spark, path: str, id_col: str = "doc_id", ids: bool = True) -> DataFrame:
    """For each document of the files: id, start (ids of all documents before), n_tokens, ids_crc32, and its ids."""
    schema = struct((id_col, "long"), ("start", "long"), ("n_tokens", "long"), ("ids_crc32", "long"), *[("ids", "array<int>")] * ids)

    def run(batches):
        for batch in batches:
            for first, nulls, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                keys, starts, codes = unpack_file(data)
                out = {f.name: [] for f in schema}
                places = starts.tolist()
                for i, key in enumerate(keys.tolist()):
                    a, b = places[i], places[i + 1]
                    own = codes.slice(a, b)  # through the rank directories, as for any single document
                    out[id_col].append(None if i >= len(keys) - nulls else key)
                    out["start"].append(first + a)
                    out["n_tokens"].append(b - a)
                    out["ids_crc32"].append(zlib.crc32(own.astype("<u4", copy=False)))
                    if ids:
                        out["ids"].append(own.tolist())
                yield batch_of(out, schema)

    return placed_files(spark, path, "nulls").mapInArrow(run, schema)


def read_places(spark, path: str, places: list[int]) -> DataFrame:
    """(place, id): the ids at some places of the whole store, counted over all documents; only the files that hold one are opened."""
    schema = struct(("place", "long"), ("id", "long"))
    wanted = sorted(set(places))

    def run(batches):
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                codes = unpack_file(data)[2]
                at = [p for p in wanted if first <= p < first + codes.size]
                yield batch_of({"place": at, "id": codes.get(np.array(at) - first).tolist()}, schema)

    held = F.exists(F.array(*map(F.lit, wanted)).cast("array<long>"), lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("tokens")))
    return placed_files(spark, path, "tokens").where(held).select("start", "tokens", "data").mapInArrow(run, schema)


def stored_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-codes")
    write_tokens(docs, tokenizer, path, end_id, id_col, text_col)
    return read_tokens(spark, path, id_col, ids)
