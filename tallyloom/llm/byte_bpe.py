"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pre-tokens of a block of documents are laid out as one array of bytes. An inverted
index maps the rank of each token pair to the positions where that pair starts. Ranks are taken in
order; one step merges every occurrence of a pair in the whole block and updates only the pairs to
its left and right. Blocks are bounded in characters, so memory doesn't grow with a partition, nothing is
shuffled, and a lost task is just run again. Chunks seen before come from a bounded cache of the
Python worker.

Defined results: null or empty text gives no ids and the digests of empty strings; repeated rows
get equal results; the order of rows and extra columns don't matter; a very long text is encoded whole, as a block of its own;
an empty table gives no row.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.chunks import ChunkCodec
from tallyloom.llm.common import batch_of, give_back, struct, text_of

NONE = np.int32(2**31 - 1)
#: Characters of the documents whose new pre-tokens are replayed together.
BLOCK = 4 << 20
#: Chunks of one generation of a worker's cache.
CACHED = 200_000
#: Rows of a batch of results.
ROWS_OUT = 1_000
#: Unicode's White_Space, which `\s` means in the pattern; Python's own `\s` has four more.
SPACE = r"\t-\r\x20\x85\xa0  -     　"


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Encodes many words at once; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.keys = np.fromiter(sorted(pairs), np.int64, len(pairs))
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes of unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(words)
        todo = []
        for i, word in enumerate(words):
            rank = self.ranks.get(word)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif not word:
                out[i] = b""
            else:
                todo.append(i)
        if todo:
            ids, ends, odd = self.replay([words[i] for i in todo])
            whole, start = ids.astype("<u4").tobytes(), 0
            for i, end in zip(todo, ends.tolist()):
                out[i] = whole[4 * start : 4 * end]
                start = end
            for i in odd:
                out[todo[i]] = self.one_word(words[todo[i]])
        return out

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Ids of all words in a row, where each word's ids end, and the words that need one_word.

        A merge can make a pair of lower rank than its own only with the few tokens whose rank is
        above that of a token they are part of; words where this happens are given back.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        tok = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(tok)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1] = n  # no neighbour
        prv[ends - lengths] = -1
        rank_at = np.full(n + 1, NONE, np.int32)
        inner = np.flatnonzero(nxt < n)
        rank_at[inner] = self.pair_ranks(tok[inner], tok[inner + 1])
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        odd: list[np.ndarray] = []

        def file(positions: np.ndarray, ranks: np.ndarray) -> None:
            """Puts positions under their ranks in the inverted index."""
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist()]
            for a, b, rank in zip(starts, [*starts[1:], len(ranks)], ranks[starts].tolist()):
                if rank in index:
                    index[rank].append(positions[a:b])
                else:
                    index[rank] = [positions[a:b]]
                    heapq.heappush(heap, rank)

        start = np.flatnonzero(rank_at[:n] != NONE)
        if len(start):
            file(start, rank_at[start])
        while heap:
            rank = heapq.heappop(heap)
            parts = index.pop(rank)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[rank_at[at] == rank]
            if not len(at):
                continue
            after = nxt[at]
            if len(at) > 1:
                chained = after[:-1] == at[1:]
                if chained.any():  # in a run of overlapping pairs every other one is merged, from the left
                    run = np.arange(len(at))
                    head = np.maximum.accumulate(np.where(np.r_[True, ~chained], run, 0))
                    keep = (run - head) % 2 == 0
                    at, after = at[keep], after[keep]
            old_right = nxt[after]
            beside = old_right < n
            if len(at) > 1:
                touching = np.flatnonzero(old_right[:-1] == at[1:])
                if len(touching):  # between two merges the first result stood beside the second's left part
                    between = self.pair_ranks(np.full(len(touching), rank, np.int32), tok[at[touching + 1]])
                    if (between < rank).any():
                        odd.append(at[touching[between < rank]])
            tok[at] = rank
            alive[after] = False
            rank_at[after] = NONE
            nxt[at] = old_right
            prv[old_right[beside]] = at[beside]
            rank_at[at[~beside]] = NONE
            left = prv[at]
            left = left[left >= 0]
            touched = np.concatenate((at[beside], left))
            if len(touched):
                if len(left):
                    touched = np.unique(touched)
                ranks = self.pair_ranks(tok[touched], tok[nxt[touched]])
                rank_at[touched] = ranks
                if (ranks < rank).any():
                    odd.append(touched[ranks < rank])
                live = ranks != NONE
                if live.any():
                    file(touched[live], ranks[live])
        word_of = np.repeat(np.arange(len(words)), lengths)
        counts = np.bincount(word_of[alive], minlength=len(words))
        again = np.unique(word_of[np.concatenate(odd)]).tolist() if odd else []
        return tok[alive], np.cumsum(counts), again

    def one_word(self, word: bytes) -> bytes:
        """The ids of one word by a queue of its pairs, lowest rank and leftmost first."""
        tok, n = self.byte_ids[np.frombuffer(word, np.uint8)].tolist(), len(word)
        nxt, prv, get = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs.get
        queue = [(r, i, tok[i], tok[i + 1]) for i in range(n - 1) if (r := get(tok[i] << 32 | tok[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = nxt[i] if tok[i] == a else n
            if j >= n or tok[j] != b:
                continue
            tok[i], tok[j] = rank, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (r := get(tok[x] << 32 | tok[y])) is not None:
                    heapq.heappush(queue, (r, x, tok[x], tok[y]))
        return np.array([t for t in tok if t >= 0], "<u4").tobytes()


class Encoding:
    """Encodes and decodes whole texts with the ranks of a file and a splitting pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        pattern = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.split = regex.compile(pattern).findall
        self.replay = MergeReplay(load_ranks(path))
        self.codec = ChunkCodec(self.encode_many, BLOCK, CACHED)
        size = max(self.replay.ranks.values()) + 1
        self.token = [b""] * size
        for token, rank in self.replay.ranks.items():
            self.token[rank] = token
        self.decimal = [str(i) for i in range(size)]

    def encode_many(self, chunks: list[str], strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words: dict[bytes, int] = {}
        lists = []
        for s in chain((f" {x}" for x in chunks), strings):
            lists.append([words.setdefault(w.encode("utf-8", "replace"), len(words)) for w in self.split(s)])
        ids = self.replay.encode_words(list(words))
        codes = [ids[x[0]] if len(x) == 1 else b"".join([ids[i] for i in x]) for x in lists]
        return np.frombuffer(b"".join(codes), "<u4"), np.fromiter(map(len, codes), np.int64, len(codes)) // 4

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.codec.encode(texts)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> Encoding:
    """One encoding for all tasks of a worker."""
    return Encoding(path, pattern)


def encoded(own: Encoding, texts: pa.Array):
    """Where each ROWS_OUT texts begin, and their ids: a batch's texts are never all held as strings, nor all their ids."""
    for a in range(0, len(texts), ROWS_OUT):
        yield a, own.encode(texts.slice(a, ROWS_OUT).to_pylist())


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: id, n_tokens, ids (an array; left out if not asked for), the SHA-256 of the
    decimal ids joined by commas, that of the bytes that the ids decode to, and the columns named in keep as they are.

    path is a rank file that every executor can open; pattern splits texts before merging.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = struct((id_col, kind), ("n_tokens", "long"), *[("ids", "array<int>")] * ids, ("ids_sha256", "string"), ("decoded_sha256", "string"), *[(c, docs.schema[c].dataType) for c in keep])

    def run(batches):
        own = encoding(path, pattern)
        for batch in batches:
            for a, part in encoded(own, batch.column(1)):
                out = {f.name: [] for f in schema}
                for code in part:
                    numbers = np.frombuffer(code, "<u4").tolist()
                    out["n_tokens"].append(len(numbers))
                    out["ids_sha256"].append(hashlib.sha256(",".join(map(own.decimal.__getitem__, numbers)).encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(own.decode(numbers)).hexdigest())
                if ids:
                    ends = np.cumsum([0, *out["n_tokens"]], dtype=np.int32)
                    out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(part), "<i4")))
                for i, c in enumerate(keep):
                    out[c] = batch.column(2 + i).slice(a, len(part))
                out[id_col] = batch.column(0).slice(a, len(part))
                yield batch_of(out, schema)
        batch = part = out = None
        give_back()

    return docs.select(F.col(f"`{id_col}`"), text_of(text_col).alias("text"), *[F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(keep)]).mapInArrow(run, schema)
