"""Substring deduplication by relative Lempel-Ziv parsing in runs of words.

The reference of a document is all text before it: documents of smaller ids and its own earlier
words. It is cut into blocks by anchor (the least hash of the short word runs inside a window): a run of
windows that share an anchor is a region, and a block holds the regions of an anchor wherever they stand.
Equal texts choose equal anchors, so whatever a region repeats is in the block of its anchor. Each
region is factored against that block; factors of at least a window become duplicate spans.

1. Documents give their regions, by hash. A region that occurred before as a whole is one factor, and so
   settled; tasks settle what repeats inside them first. Its block knows first occurrences alone.
2. First occurrences in a block with other regions send their words there. The block's index is a
   hash of k words, k growing from a window on: the longest match of each place with earlier text. Factors are taken
   greedily from the left; at a factor's end the windows across it are looked up before the parse goes on.
3. A block that holds more regions than MOST_SNIPPETS (a phrase that recurs in ever other surroundings), or more than
   MOST_REGIONS from one task, would not fit in a task. Its regions are parsed window by window, dealt by the window's hash: factors of one
   window each, which is exact as well.
4. A document's factors are put together, those that touch or overlap as one span, and its kept words returned.

A factor ends with its region; a copy over many regions is as many factors in a row. Anchors are about an eighth of the words. A task gives at most one row
of a region to its block, so that a passage held by a third of all documents doesn't gather in one task. An anchor of many regions in
one task is spread by the regions' hashes, and one row as a witness tells the anchor's block.

Defined results: null, empty or blank text has no words; texts of fewer words than a window keep all;
rows of the same id and text are one document; rows of one id and different texts are ordered by
their starts alone; a null id comes after all others; a very long text is read whole, in one task a
time; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import batch_of, bytes_of, cut, key_of, struct
from tallyloom.llm.decontaminate import merge

WINDOW = 20
#: Words of an anchor.
RUN = 6
#: Rows that a task settles among themselves before it hands them on.
PIECE = 1 << 20
#: Regions of one anchor that a task gives to the anchor's block; if there are more, it spreads them.
MOST_REGIONS = 16
#: Distinct regions of an anchor that its block parses by longest match; a block of more goes window by window.
MOST_SNIPPETS = 4096
#: Snippets that a task parses at a time (whole blocks, so some more).
PARSED = 1 << 15
#: What a row is: an occurrence, a repeat that is settled, a region of a spread anchor, a witness of other regions, words to parse.
PLAIN, COPY, EDGE, WITNESS, WORDS = range(5)
#: In the number of windows of a place: its anchor's block is too large to be parsed by longest match.
CROWDED = 128

C1, C2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MARK = (1 << 24) - 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, at least."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 4096) * 2, base, np.uint64)
        known[0] = 1
        known = _powers[base] = np.multiply.accumulate(known)
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of any run of a document's words."""

    def __init__(self, words: list[bytes] | np.ndarray):
        digest = xxhash.xxh3_64_intdigest
        self.h = words if isinstance(words, np.ndarray) else np.array([digest(w) for w in words], np.uint64)
        self.sums: dict[int, np.ndarray] = {}

    def runs(self, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
        if base not in self.sums:
            h = self.h if base == C1 else mixed(self.h ^ np.uint64(base))
            self.sums[base] = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers(base, len(h)))))
        total = self.sums[base]
        back = powers(pow(base, -1, 1 << 64), len(total))[starts]
        return mixed((total[ends] - total[starts]) * back)

    def windows(self, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(starts, starts + window, C1), self.runs(starts, starts + window, C2)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each width values in a row."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def regions(words: Words, window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, ...]:
    """Anchor, region hash, first window and number of windows of each region; a window is in one region."""
    n = len(words.h)
    at = np.arange(n - run + 1)
    short = words.runs(at, at + run, C1)
    low = np.uint64((1 << 32) - 1)
    chosen = (least_of(short & ~low | at.astype(np.uint64), window - run + 1) & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    count = np.diff(np.r_[first, len(chosen)])
    place = chosen[first]
    whole = words.runs(first, first + count + window - 1, C2)
    whole = mixed(whole + count.astype(np.uint64) * np.uint64(C1) + (place - first).astype(np.uint64))
    return short[place], whole, first, count


def settle(a: np.ndarray, b: np.ndarray, key: np.ndarray, loc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of occurrences of (a, b) at document key and place loc: the order, which begin a new (a, b), which repeat one before.

    Occurrences at the same start of the same id are one (they differ in the text's mark, or not at all).
    """
    order = np.lexsort((loc, key, b, a))
    a, b, key, start = a[order], b[order], key[order], loc[order] >> 32
    fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0))
    later = (key != key[head]) | (start != start[head])
    return order, fresh, later


def longest_matches(text: Words, start: np.ndarray, room: np.ndarray, key: np.ndarray, loc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For places of text: the length in words of the longest match, of at most room words, with a place before it (0 if below a window), and that place.

    key and loc order the places. The index of k words is looked up for growing k; only places that share k words
    with another are looked up for k + 1.
    """
    length, source = np.zeros(len(start), np.int64), np.full(len(start), -1)
    live, k = np.flatnonzero(room >= window), window
    while len(live):
        a, b = text.windows(start[live], k)
        order, fresh, later = settle(a, b, key[live], loc[live])
        at = live[order]
        head = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        length[at[later]], source[at[later]] = k, head[later]
        several = np.bincount(np.cumsum(fresh) - 1)[np.cumsum(fresh) - 1] > 1
        live = np.sort(at[several])
        k += 1
        live = live[room[live] >= k]
    return length, source


def greedy_factors(count: np.ndarray, length: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Snippet and window of each factor of a parse from the left.

    count: windows of each snippet; length: the longest match at each window of all snippets in a row. After a factor the parse
    goes on with the first window that isn't wholly in it, so that windows across its end are looked up.
    """
    base = np.cumsum(count) - count
    who, place = np.arange(len(count)), np.zeros(len(count), np.int64)
    found = []
    while len(who):
        inside = place < count[who]
        who, place = who[inside], place[inside]
        own = length[base[who] + place]
        hit = own >= window
        found.append((who[hit], place[hit]))
        place = place + np.where(hit, own - window + 1, 1)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def parsed(words: list[bytes], key: np.ndarray, loc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Snippet, first window, words and source place (snippet and window as one number over all) of each factor; words: the hashes of each snippet's words."""
    size = np.fromiter(map(len, words), np.int64, len(words)) // 8
    count = size - window + 1
    text = Words(np.frombuffer(b"".join(words), np.uint64))
    of = np.repeat(np.arange(len(words)), count)
    place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = (np.cumsum(size) - size)[of] + place
    length, source = longest_matches(text, start, size[of] - place, key[of], loc[of] + (place << 32), window)
    who, at = greedy_factors(count, length, window)
    flat = (np.cumsum(count) - count)[who] + at
    return who, at, length[flat], source[flat]


ROWS = struct(("a", "long"), ("b", "long"), ("key", "long"), ("loc", "long"), ("kind", "tinyint"))
#: Rows of the second pass; words: hashes of a region's words, for rows of kind WORDS alone.
WORD_ROWS = struct(("a", "long"), ("b", "long"), ("key", "long"), ("loc", "long"), ("kind", "tinyint"), ("words", "binary"))
#: loc: first window << 32 | number of windows << 24 | 24 bits that tell texts of one id apart.


def batches_of(columns: list[np.ndarray], names: list[str]):
    for i in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in columns], names=names)


def given(parts: list[tuple[np.ndarray, ...]], spread: bool = True):
    """Rows for the blocks: the first occurrence of each (a, b) in parts, and repeats as settled, dealt out anywhere.

    With spread, an a of many b is dealt out by b, and one of its rows is a witness in the block of a.
    """
    a, b, key, loc = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    order, fresh, later = settle(a, b, key, loc)
    a, b, key, loc = a[order], b[order], key[order], loc[order]
    kind = np.where(later, np.int8(COPY), np.int8(PLAIN))
    extra = np.empty(0, np.int64)
    if spread:
        begins = np.r_[True, a[1:] != a[:-1]]
        group = np.cumsum(begins) - 1
        many = (np.bincount(group[fresh]) > MOST_REGIONS)[group]
        kind[many & ~later] = EDGE
        extra = np.flatnonzero(begins & many)
    home = np.where(kind == COPY, mixed(loc.astype(np.uint64) * np.uint64(C2) ^ key.astype(np.uint64)), np.where(kind == EDGE, mixed(a ^ mixed(b)), a))
    b = np.where(kind == COPY, np.uint64(0), b)
    rows = [(home, a[extra]), (b, ~b[extra]), (key, key[extra]), (loc, loc[extra]), (kind, np.full(len(extra), WITNESS, np.int8))]
    home, b, key, loc, kind = (np.concatenate(x) for x in rows)
    yield from batches_of([home.view(np.int64), b.view(np.int64), key, loc, kind], ROWS.names)


def region_factors(rows: DataFrame, most_snippets: int = MOST_SNIPPETS) -> DataFrame:
    """(key, loc) of each region that repeats an earlier one, and ~loc of each first occurrence in a block of several (marked where the block is crowded)."""
    schema = struct(("key", "long"), ("loc", "long"))

    def run(batches):
        parts = []
        for x in batches:
            if x.num_rows:
                columns = [x.column(i).to_numpy() for i in range(5)]
                done = columns[4] == COPY
                yield from batches_of([columns[2][done], columns[3][done]], schema.names)
                parts.append([c[~done] for c in columns])
        if not parts:
            return
        a, b, key, loc, kind = (np.concatenate(x) for x in zip(*parts))
        if not len(a):
            return
        order, fresh, later = settle(a, b, key, loc)
        a, key, loc, kind = a[order], key[order], loc[order], kind[order]
        real = kind != WITNESS
        yield from batches_of([key[later & real], loc[later & real]], schema.names)
        group = np.cumsum(np.r_[False, a[1:] != a[:-1]])
        regions = np.bincount(group[fresh])[group]
        # all tasks agree: a spread region knows it, and the block of its anchor has a witness or sees them all
        crowded = (kind == EDGE) | (np.bincount(group[~real], minlength=group[-1] + 1)[group] > 0) | (regions > most_snippets)
        edge = ((regions > 1) | (kind == EDGE)) & ~later & real
        yield from batches_of([key[edge], ~(loc[edge] | (crowded[edge].astype(np.int64) * CROWDED) << 24)], schema.names)

    return rows.repartition("a").mapInArrow(run, schema)


def word_factors(rows: DataFrame, window: int) -> DataFrame:
    """(key, loc) of the factors of regions by the words of their blocks, and of windows that repeat an earlier one."""
    schema = struct(("key", "long"), ("loc", "long"))

    def run(batches):
        parts, words = [], []
        for x in batches:
            if x.num_rows:
                a, b, key, loc, kind = (x.column(i).to_numpy() for i in range(5))
                done, whole = kind == COPY, kind == WORDS
                yield from batches_of([key[done], loc[done]], schema.names)
                single = ~(done | whole)
                parts.append([c[single] for c in (a, b, key, loc)])
                if whole.any():
                    words.append((x.column(5).filter(pa.array(whole)), a[whole], key[whole], loc[whole]))
        if words:
            raw = pa.chunked_array([x for x, *_ in words])
            a, key, loc = (np.concatenate(x) for x in list(zip(*words))[1:])
            words.clear()
            order = np.argsort(a, kind="stable")
            begins = np.flatnonzero(np.r_[True, a[order][1:] != a[order][:-1]])
            cuts = [0, *begins[np.flatnonzero(np.diff(begins // PARSED)) + 1].tolist(), len(a)]
            for i, j in zip(cuts, cuts[1:]):  # whole blocks, about PARSED snippets at a time
                own = order[i:j]
                who, at, size, _ = parsed(raw.take(pa.array(own)).to_pylist(), key[own], loc[own], window)
                who = own[who]
                yield from batches_of([key[who], (loc[who] >> 32) + at << 32 | size - window + 1 << 24 | loc[who] & MARK], schema.names)
        if parts:
            a, b, key, loc = (np.concatenate(x) for x in zip(*parts))
            if len(a):
                order, _, later = settle(a, b, key, loc)
                yield from batches_of([key[order][later], loc[order][later]], schema.names)

    return rows.repartition("a").mapInArrow(run, schema)


def listed(places: DataFrame, name: str) -> DataFrame:
    """All places of a document in one array; it is as long as the document at most."""
    loc = F.col("loc")
    mark = F.when(loc < 0, F.bitwise_not(loc)).otherwise(loc).bitwiseAND(MARK)
    return places.groupBy("key", mark.alias("mark")).agg(F.collect_list("loc").alias(name))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, run: int = RUN, most_snippets: int = MOST_SNIPPETS) -> DataFrame:
    """For each row: id, n_words, spans of removed words (start, end), and the kept words joined by spaces."""
    if not run < window < run + CROWDED - 1:
        raise ValueError(f"a window has more words than a run ({run}), and fewer than {run + CROWDED - 1}")
    text = bytes_of(text_col)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), key_of(id_col).alias("key"), F.xxhash64(text, F.lit(1)).bitwiseAND(MARK).alias("mark"), text.alias("text"))

    def anchors(batches):
        parts, n = [], 0
        for x in batches:
            for key, mark, raw in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2).to_pylist()):
                words = raw.split()
                if len(words) < window:
                    continue
                a, b, first, count = regions(Words(words), window, run)
                parts.append((a, b, np.full(len(a), key), first << 32 | count << 24 | mark))
                n += len(a)
                if n >= PIECE:
                    yield from given(parts)
                    n = 0
        if parts:
            yield from given(parts)

    found = cut(listed(region_factors(source.select("key", "mark", "text").mapInArrow(anchors, ROWS), most_snippets), "places"))

    def with_words(rows):
        for x in rows:
            yield pa.RecordBatch.from_arrays([*x.columns, pa.nulls(x.num_rows, pa.binary())], names=WORD_ROWS.names)

    def edges(batches):
        parts, n, homes, keys, locs, words = [], 0, [], [], [], []

        def snippets():
            loc = np.concatenate(locs)
            rows = (np.concatenate(homes).view(np.int64), np.zeros(len(loc), np.int64), np.concatenate(keys), loc, np.full(len(loc), WORDS, np.int8))
            yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(words, pa.binary())], names=WORD_ROWS.names)
            for x in (homes, keys, locs, words):
                x.clear()

        for x in batches:
            for key, mark, places, raw in zip(x.column(1).to_pylist(), x.column(2).to_pylist(), x.column(3).to_pylist(), x.column(4).to_pylist()):
                places = ~np.array([p for p in places if p < 0], np.int64)
                first, count = places >> 32, places >> 24 & 255
                crowded, count = count >= CROWDED, count % CROWDED
                text = Words(raw.split())
                if not crowded.all():
                    a, _, begin, _ = regions(text, window, run)
                    own = np.flatnonzero(~crowded)
                    homes.append(a[np.searchsorted(begin, first[own])])
                    keys.append(np.full(len(own), key))
                    locs.append(first[own] << 32 | count[own] << 24 | mark)
                    plain = text.h.tobytes()
                    words += [plain[8 * f : 8 * (f + c + window - 1)] for f, c in zip(first[own].tolist(), count[own].tolist())]
                    if len(words) >= 1 << 13:
                        yield from snippets()
                first, count = first[crowded], count[crowded]
                if len(first):
                    first = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                    a, b = text.windows(first, window)
                    parts.append((a, b, np.full(len(a), key), first << 32 | 1 << 24 | mark))
                    n += len(a)
                    if n >= PIECE:
                        yield from with_words(given(parts, False))
                        n = 0
        if words:
            yield from snippets()
        if parts:
            yield from with_words(given(parts, False))

    at = ["key", "mark"]
    edge_rows = source.join(found.where(F.exists("places", lambda p: p < 0)), at).select("id", "key", "mark", "places", "text")
    checked = listed(word_factors(edge_rows.mapInArrow(edges, WORD_ROWS), window), "checked")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = struct((id_col, kind), ("n_words", "long"), ("spans", "array<array<int>>"), ("kept", "string"))

    def final(batches):
        for x in batches:
            out = {f.name: [] for f in schema}
            for raw, places, more in zip(x.column(1).to_pylist(), x.column(2).to_pylist(), x.column(3).to_pylist()):
                words = raw.split()
                gone = np.array([p for p in (*(places or ()), *(more or ())) if p >= 0], np.int64)
                spans = merge(list(zip((gone >> 32).tolist(), ((gone >> 32) + (gone >> 24 & 255) + window - 1).tolist())))
                kept, end = [], 0
                for a, b in spans:
                    kept += words[end:a]
                    end = b
                out["n_words"].append(len(words))
                out["spans"].append(spans)
                out["kept"].append(b" ".join(kept + words[end:]).decode())
            out[id_col] = x.column(0)
            yield batch_of(out, schema)

    whole = source.join(found, at, "left").join(checked, at, "left").select("id", "text", "places", "checked")
    return whole.mapInArrow(final, schema)
