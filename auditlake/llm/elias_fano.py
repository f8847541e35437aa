"""Elias-Fano coded levels of an n-gram trie, in one memory-mapped file."""

from __future__ import annotations

import tempfile

import numpy as np

CODES = 1 << 16


def packed_low(values: np.ndarray, bits: int) -> np.ndarray:
    """The lowest bits of each value, one after the other in 64-bit words."""
    out = np.zeros((len(values) * bits >> 6) + 2, np.uint64)
    if not bits or not len(values):
        return out
    low = values & np.uint64((1 << bits) - 1)
    at = np.arange(len(values), dtype=np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    np.bitwise_or.at(out, word, low << shift)
    over = shift + np.uint64(bits) > np.uint64(64)
    np.bitwise_or.at(out, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
    return out


class EliasFano:
    """A non-decreasing sequence below a bound: unary high parts in a bit string, low parts packed.

    Nothing is unpacked: a bucket's place is found by the zeros counted before each word of the bit
    string (zeros) and a search inside that word.
    """

    def __init__(self, n: int, bits: int, high: np.ndarray, zeros: np.ndarray, low: np.ndarray):
        self.n, self.bits, self.high, self.zeros, self.low = n, np.uint64(bits), high, zeros, low

    @staticmethod
    def code(values: np.ndarray, bound: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
        n = len(values)
        bits = max(0, (bound // max(n, 1)).bit_length() - 1)
        top = (values >> np.uint64(bits)).astype(np.int64)
        string = np.zeros((n + (bound >> bits) + 2 + 63) // 64 * 64, np.uint8)
        string[top + np.arange(n)] = 1
        high = np.packbits(string, bitorder="little").view("<u8")
        zeros = np.cumsum(64 - np.bitwise_count(high), dtype=np.int64) - (64 - np.bitwise_count(high))
        return n, bits, high, zeros.astype(np.uint32 if len(string) < 1 << 32 else np.uint64), packed_low(values, bits)

    def zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the bit string, from 0."""
        word = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), side="right") - 1
        left = k - self.zeros[word]
        rest = ~self.high[word]
        at = np.zeros(len(k), np.uint64)
        for step in (32, 16, 8, 4, 2, 1):
            inside = np.bitwise_count((rest >> at) & np.uint64((1 << step) - 1))
            on = left >= inside
            left = left - inside * on
            at += on.astype(np.uint64) * np.uint64(step)
        return word * 64 + at.astype(np.int64)

    def low_of(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), np.uint64)
        place = at.astype(np.uint64) * self.bits
        word, shift = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
        ahead = self.low[word] >> shift
        behind = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (ahead | behind) & np.uint64((1 << int(self.bits)) - 1)

    def _bucket(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First element of x's bucket, and the first of the next."""
        top = (x >> self.bits).astype(np.int64)
        return np.where(top > 0, self.zero(np.maximum(top - 1, 0)) + 1, 0) - top, self.zero(top) - top

    def _search(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        low, lo, hi = x & np.uint64((1 << int(self.bits)) - 1), lo.copy(), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.low_of(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Position of the first element that is x or more; n where there is none. x is below the bound."""
        return self._search(x, *self._bucket(x))

    def find(self, x: np.ndarray) -> np.ndarray:
        """Position of x, or -1: the successor, if it is in x's bucket and has its low part."""
        if not self.n:
            return np.full(len(x), -1, np.int64)
        lo, hi = self._bucket(x)
        at = self._search(x, lo, hi)
        inside = np.minimum(at, self.n - 1)
        return np.where((at < hi) & (self.low_of(inside) == x & np.uint64((1 << int(self.bits)) - 1)), inside, -1)


def quantised(values: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(least, step, codes): values held to CODES even steps."""
    if not len(values):
        return 0.0, 0.0, np.zeros(0, np.uint16)
    least = float(values.min())
    step = (float(values.max()) - least) / (CODES - 1)
    return least, step, (np.rint((values - least) / step) if step else np.zeros(len(values))).astype(np.uint16)


class Level:
    """Children of the level above: child c of parent p is coded as p * width + c, so the sequence is
    monotone and a lookup is one successor search relative to the context p. values: quantised numbers."""

    def __init__(self, parts: list[np.ndarray], head: dict):
        self.width = np.uint64(head["width"])
        self.keys = EliasFano(head["n"], head["bits"], *parts[:3])
        self.tables = [(least, step, codes) for (least, step), codes in zip(head["steps"], parts[3:], strict=True)]

    @staticmethod
    def code(parent: np.ndarray, child: np.ndarray, parents: int, width: int, values: list[np.ndarray]) -> tuple[dict, list[np.ndarray]]:
        n, bits, *coded = EliasFano.code(parent.astype(np.uint64) * np.uint64(width) + child.astype(np.uint64), max(1, parents * width))
        tables = [quantised(v) for v in values]
        return {"n": n, "bits": bits, "width": width, "steps": [t[:2] for t in tables]}, [*coded, *(t[2] for t in tables)]

    def find(self, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Position of each (parent, child), or -1; parent -1 has no children."""
        at = self.keys.find(np.maximum(parent, 0).astype(np.uint64) * self.width + child.astype(np.uint64))
        return np.where(parent >= 0, at, -1)

    def value(self, table: int, at: np.ndarray) -> np.ndarray:
        least, step, codes = self.tables[table]
        return least + step * codes[at]


def mapped(levels: list[tuple[dict, list[np.ndarray]]]) -> list[Level]:
    """Write all levels to one file and map it; the file's name is gone at once, its pages are the system's to keep."""
    with tempfile.TemporaryFile() as f:
        places = []
        for _, parts in levels:
            for part in parts:
                f.write(b"\0" * (-f.tell() % 8))
                places.append(f.tell())
                f.write(np.ascontiguousarray(part).data)
        f.write(b"\0" * 8)
        f.flush()
        file = np.memmap(f, np.uint8, "r")
    out, k = [], 0
    for head, parts in levels:
        views = []
        for part in parts:
            views.append(file[places[k] : places[k] + part.nbytes].view(part.dtype))
            k += 1
        out.append(Level(views, head))
    return out
