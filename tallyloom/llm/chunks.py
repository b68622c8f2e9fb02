"""Whole texts encoded through a bounded cache of space-delimited chunks.

The usual byte-level pre-tokenisers attach one space to the word after it and never look across a
single space that stands between two other characters. So a text whose spaces are all of this kind
can be cut at them: the ids of " chunk" don't depend on what surrounds it. Texts with other white
space next to a space are encoded as a whole.

Chunks are split, told apart and looked up as Arrow columns; the ids of all of them stand in one
array, from which those of a block are gathered. Only chunks that the cache doesn't know become Python strings.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks of one generation of the cache; two are held.
CACHE_ENTRIES = 300_000
#: Longer chunks are encoded anew each time, so that the cache's bytes are bounded as well.
LONGEST_CACHED = 48

Ids = tuple[np.ndarray, np.ndarray]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges that start at starts, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class ChunkCodec:
    """Encodes texts to ids, as bytes of little-endian unsigned 32-bit integers.

    encode_many(chunks, strings) gives the ids of each chunk with a space before it, then those of each string, all in
    a row, and how many each has alone. Chunks have no white space at their ends, so they may be encoded as one text. is how many
    characters are looked up at a time: the places of a block's chunks are held in memory. When a generation is full, chunks that it didn't see are forgotten.
    """

    def __init__(self, encode_many: Callable[[list[str], list[str]], Ids], block: int, entries: int = CACHE_ENTRIES):
        self.encode_many, self.block, self.entries = encode_many, block, entries
        #: Known chunks, where the ids of " chunk" start and how many they are; -1 where white space stands beside the space.
        self.chunks = pa.array([], pa.string())
        self.ids = np.zeros(0, np.uint32)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: Which of them this generation saw.
        self.seen = np.zeros(0, bool)

    def turn(self) -> None:
        """The generation becomes the old one, what only the one before knew goes."""
        keep = np.flatnonzero(self.seen)
        sizes = np.maximum(self.sizes[keep], 0)
        self.ids = self.ids[spread(self.starts[keep], sizes)]
        self.chunks = self.chunks.take(pa.array(keep))
        self.starts, self.sizes = np.cumsum(sizes) - sizes, self.sizes[keep]
        self.seen = np.zeros(len(keep), bool)

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text."""
        column = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        out: list[bytes] = []
        ends = np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = before = 0
        while start < len(column):
            stop = min(int(np.searchsorted(ends, before + self.block)) + 1, len(column))
            out += self.encode_block(column.slice(start, stop - start))
            start, before = stop, int(ends[stop - 1])
        return out

    def encode_block(self, texts: pa.Array) -> list[bytes]:
        if np.count_nonzero(self.seen) > self.entries:
            self.turn()
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy()
        heads, told = bounds[:-1], split.values.dictionary_encode()
        codes = told.indices.to_numpy()
        inner = np.ones(len(codes), bool)
        inner[heads] = False
        used = np.zeros(len(told.dictionary), bool)
        used[codes[inner]] = True
        at = np.flatnonzero(used)
        place = np.zeros(len(used), np.int64)
        place[at] = pc.index_in(told.dictionary.take(pa.array(at)), self.chunks).fill_null(-1).to_numpy()
        known = place[at]
        self.seen[known[known >= 0]] = True
        at = at[known < 0]
        long = pc.utf8_length(told.dictionary.take(pa.array(at))).to_numpy() > LONGEST_CACHED
        at = at[np.argsort(long, kind="stable")]  # those that stay first
        new = told.dictionary.take(pa.array(at))
        first = split.values.take(pa.array(heads)).dictionary_encode()
        strings, first_strings = new.to_pylist(), first.dictionary.to_pylist()
        clean = [x != "" and x.strip() == x for x in strings]
        plain = [x == "" or not x[-1].isspace() for x in first_strings]
        ids, counts = self.encode_many(list(compress(strings, clean)), list(compress(first_strings, plain)))

        added = np.full(len(strings) + len(first_strings), -1, np.int64)
        added[np.flatnonzero(clean + plain)] = counts
        full = np.maximum(added, 0)
        before, own = len(self.chunks), len(self.ids)
        all_ids = np.concatenate((self.ids, ids))
        starts, sizes = np.concatenate((self.starts, own + np.cumsum(full) - full)), np.concatenate((self.sizes, added))
        place[at] = np.arange(before, before + len(at))
        at_word = place[codes]
        at_word[heads] = before + len(at) + first.indices.to_numpy()
        size = sizes[at_word]
        whole = np.unique(np.searchsorted(bounds, np.flatnonzero(size < 0), side="right") - 1).tolist()  # white space beside a space
        for i in whole:
            size[bounds[i] : bounds[i + 1]] = 0
        out = cut_at(all_ids[spread(starts[at_word], size)], np.r_[0, np.cumsum(size)][bounds])
        if whole:
            ids, counts = self.encode_many([], texts.take(pa.array(whole)).to_pylist())
            for i, code in zip(whole, cut_at(ids, np.r_[0, np.cumsum(counts)])):
                out[i] = code

        stay = len(at) - int(np.count_nonzero(long))
        self.chunks = pa.concat_arrays([self.chunks, new.slice(0, stay)])
        self.ids = all_ids[: own + int(full[:stay].sum())]
        self.starts, self.sizes = starts[: before + stay], sizes[: before + stay]
        self.seen = np.concatenate((self.seen, np.ones(stay, bool)))
        return out


def cut_at(ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The ids between each two bounds."""
    data = ids.astype("<u4", copy=False).tobytes()
    return [data[4 * a : 4 * b] for a, b in pairwise(bounds.tolist())]
