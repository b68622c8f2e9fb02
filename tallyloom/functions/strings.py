"""How alike many pairs of short strings are, in numpy: a character's places in a string are the bits of one number, and a step is one operation for all pairs."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Longer strings are left to the plain functions.
LONGEST, BATCH, CELLS = 64, 1 << 14, 1 << 22


class Coded:
    """Strings as numbers of their characters (0 after the end), with lengths."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        self.size = np.fromiter(map(len, strings), np.int32, len(strings))
        self.width = max(1, min(int(self.size.max(initial=1)), LONGEST))
        flat = np.frombuffer("".join(s[: self.width] for s in strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        found, place = np.unique(flat, return_inverse=True)
        self.kinds, self.codes = len(found) + 1, np.zeros((len(strings), self.width), np.int32)
        self.codes[np.arange(self.width) < self.size[:, None]] = place + 1
        self.bits = np.uint16 if self.width <= 16 else np.uint32 if self.width <= 32 else np.uint64
        self.places = self._places(self.codes) if len(strings) * self.kinds <= CELLS else None

    def _places(self, codes: np.ndarray) -> np.ndarray:
        out, row = np.zeros((len(codes), self.kinds), self.bits), np.arange(len(codes))
        for p in range(codes.shape[1]):
            out[row, codes[:, p]] |= self.bits(1 << p)
        out[:, 0] = 0
        return out

    def met(self, i: np.ndarray, j: np.ndarray):
        """Parts of the pairs, those of long second strings first: their numbers, and for each character of the second the bits of its places in the first."""
        order, step = np.argsort(-np.minimum(self.size[j], LONGEST + 1).astype(np.int16), kind="stable"), BATCH if self.places is not None else max(64, CELLS // self.kinds)
        for k in range(0, len(order), step):
            at = order[k : k + step]
            if self.places is not None:
                table, row = self.places, i[at]
            else:
                rows, row = np.unique(i[at], return_inverse=True)
                table = self._places(self.codes[rows])
            letters = self.codes[j[at], : self.size[j[at]].max(initial=0)].T
            yield at, np.take(table.ravel(), row.astype(np.int64) * self.kinds + letters)


def bags(strings: list[str], most: int = 64, deep: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """A row of ones and zeros for each string (the nth letter of a kind), and how many letters it leaves out: what two strings have in
    common is at most the product of their rows, and the smaller of what they leave out. Letters beyond so many kinds share a column.
    """
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, place = np.unique(flat, return_inverse=True)
    width = max(1, min(most, len(kinds)))
    counts = np.bincount(np.repeat(np.arange(len(strings)), size) * width + place % width, minlength=len(strings) * width).reshape(-1, width)
    columns = [counts[:, k] > i for i in range(deep) for k in range(width) if (counts[:, k] > i).any()]
    rows = np.array(columns, np.float32).T if columns else np.zeros((len(strings), 1), np.float32)
    return np.ascontiguousarray(rows), (size - rows.sum(axis=1)).astype(np.float32)


def distances(x: Coded, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Edit distances of pairs (Myers' bits: where a column of the table rises and falls)."""
    out = np.zeros(len(i), np.int32)
    for at, eq in x.met(i, j):
        n, m = x.size[i[at]], x.size[j[at]]
        inside = (x.bits(1) << n.astype(x.bits)) - x.bits(1) if x.width < 8 * x.bits().itemsize else ~x.bits(0) >> (x.width - n).astype(x.bits)
        rise, fall = np.full(len(at), ~x.bits(0)), np.zeros(len(at), x.bits)
        for q, e in enumerate(eq):
            some = slice(0, int(np.searchsorted(-m, -q, side="left")))  # those longer than q
            e, up, down = e[some], rise[some], fall[some]
            xv, xh = e | down, (((e & up) + up) ^ up) | e
            ph, mh = down | ~(xh | up), (up & xh) << 1
            ph = (ph << 1) | x.bits(1)
            rise[some], fall[some] = mh | ~(xv | ph), ph & xv
        out[at] = m + np.bitwise_count(rise & inside).astype(np.int32) - np.bitwise_count(fall & inside)
    return out


def subsequences(x: Coded, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs."""
    out = np.zeros(len(i), np.int32)
    for at, eq in x.met(i, j):
        v = np.full(len(at), ~x.bits(0))
        for e in eq:
            u = v & e
            v = (v + u) | (v - u)
        out[at] = np.bitwise_count(~v)
    return out


def matches(x: Coded, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Characters that SequenceMatcher matches: the longest equal stretch (the first in x, then in y), and the same left and right of it."""
    out = np.zeros(len(i), np.int64)
    for at, every in x.met(i, j):
        total, place = np.zeros(len(at), np.int64), np.arange(len(every), dtype=np.int32)[:, None]
        one, lo, hi, low, high = np.arange(len(at)), np.zeros(len(at), np.int32), x.size[i[at]], np.zeros(len(at), np.int32), x.size[j[at]]
        while len(one) and len(every):
            last = ~x.bits(0) >> (8 * x.bits().itemsize - np.maximum(hi, 1)).astype(x.bits)
            inside = np.where(hi > lo, (last >> lo.astype(x.bits)) << lo.astype(x.bits), 0).astype(x.bits)
            eq = np.where((place >= low) & (place < high), every[:, one] & inside, 0).astype(x.bits)
            some, run = np.flatnonzero(np.bitwise_or.reduce(eq, axis=0)), eq
            size, ends, q = np.zeros(len(one), np.int32), np.zeros(len(one), np.int32), np.zeros(len(one), np.int32)
            run = eq = eq[:, some]
            while len(some):  # bits of run end stretches of the size so far
                any_ = np.bitwise_or.reduce(run, axis=0)
                first = any_ & (~any_ + x.bits(1))
                size[some] += 1
                longer = np.zeros_like(run)
                longer[1:] = eq[1:] & (run[:-1] << 1)
                more = np.bitwise_or.reduce(longer, axis=0) != 0
                done = ~more
                ends[some[done]] = np.bitwise_count(first[done] - x.bits(1))
                q[some[done]] = ((run[:, done] & first[done]) != 0).argmax(axis=0)
                some, run, eq = some[more], longer[:, more], eq[:, more]
            total += np.bincount(one, size, len(total)).astype(np.int64)
            p, q = ends + 1, q + 1
            left, right = (size > 0) & (p - size > lo) & (q - size > low), (size > 0) & (p < hi) & (q < high)
            one, lo, hi, low, high = (np.concatenate(z) for z in ((one[left], one[right]), (lo[left], p[right]), ((p - size)[left], hi[right]), (low[left], q[right]), ((q - size)[left], high[right])))
        out[at] = total
    return out


def edit_ratios(x: Coded, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """1 - edit distance / longer length; NaN where a string is too long for here."""
    longest = np.maximum(x.size[i], x.size[j])
    out = np.where(longest == 0, 1.0, np.nan)
    some = np.flatnonzero((longest > 0) & (longest <= LONGEST))
    out[some] = 1.0 - distances(x, i[some], j[some]) / longest[some].astype(np.float64)
    return out


def match_ratios(x: Coded, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The ratio of SequenceMatcher."""
    both, out = (x.size[i] + x.size[j]).astype(np.float64), np.ones(len(i))
    long = np.maximum(x.size[i], x.size[j]) > LONGEST
    some = np.flatnonzero((both > 0) & ~long)
    out[some] = 2.0 * matches(x, i[some], j[some]) / both[some]
    for k in np.flatnonzero(long):
        out[k] = SequenceMatcher(None, x.strings[i[k]], x.strings[j[k]]).ratio()
    return out
