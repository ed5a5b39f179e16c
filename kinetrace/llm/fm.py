"""Compressed full-text index: the Burrows-Wheeler transform of a sequence of integers in a wavelet matrix of packed bits."""

from __future__ import annotations

import numpy as np


class BitRank:
    """Bits in words of 64 with the number of ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits) // 64 + 1
        packed = np.zeros(n * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)
        self.zeros = len(bits) - int(ones.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        word, mask = self.words[i >> 6], (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(word & mask)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class FMIndex:
    """Index of a sequence of integers >= 0, in which 0 ends a text. Patterns hold no 0.

    Ends of texts sort by their place, so row k belongs to the end of text k and no two suffixes tie. The suffix array serves to make the transform and is not kept; what an interval needs to know of places is one bit a row: whether the suffix's first `threshold` symbols (its window) stand at an earlier place too.
    """

    def __init__(self, text: np.ndarray, threshold: int = 20) -> None:
        symbols, t = np.unique(text, return_inverse=True)
        if not len(symbols) or symbols[0] != 0:
            symbols, t = np.append(0, symbols), t + 1
        self.symbols, n, self.threshold = symbols, len(t), threshold
        ends = t == 0
        rank = np.where(ends, np.cumsum(ends) - 1, t + int(ends.sum()))
        pick = 1 << (threshold.bit_length() - 1)
        saved, k, order, unique = rank, 1, np.argsort(rank, kind="stable"), False
        while not unique or k < pick:
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - k)] = rank[k:] + 1
            key = rank * (int(rank.max(initial=0)) + n + 2) + ahead
            order = np.argsort(key)
            key = key[order]
            step = np.cumsum(np.append(False, key[1:] != key[:-1])) if n else key
            rank = np.empty(n, np.int64)
            rank[order] = step
            k *= 2
            if k == pick:
                saved = rank
            unique = not n or int(step[-1]) == n - 1
        rest = np.minimum(order + threshold - pick, n - 1)
        whole, tail = saved[order], saved[rest]
        block = np.flatnonzero(np.append(True, (whole[1:] != whole[:-1]) | (tail[1:] != tail[:-1]))) if n else order
        least = np.repeat(np.minimum.reduceat(order, block) if n else order, np.diff(np.append(block, n)))
        self.again = BitRank(order > least)
        self.n = n
        last = t[order - 1]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(symbols)))]).astype(np.int64)
        self.levels: list[tuple[int, BitRank]] = []
        for b in range(max(1, int(len(symbols) - 1).bit_length()) - 1, -1, -1):
            bit = (last >> b & 1).astype(bool)
            self.levels.append((b, BitRank(bit)))
            last = np.concatenate([last[~bit], last[bit]])
        self.origin = self._descend(np.zeros(len(symbols), np.int64), np.arange(len(symbols)))

    def _descend(self, i: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where the first i symbols of the transform end up for each symbol's path through the wavelet matrix."""
        for b, bits in self.levels:
            ones = bits.rank1(i)
            i = np.where(symbol >> b & 1, bits.zeros + ones, i - ones)
        return i

    def encode(self, values: np.ndarray) -> np.ndarray:
        """Symbol numbers; 0 for values the index doesn't hold."""
        at = np.minimum(np.searchsorted(self.symbols, values), len(self.symbols) - 1)
        return np.where(self.symbols[at] == values, at, 0)

    def before(self, i: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """One end of a backward step: the row of symbol + pattern from that of pattern."""
        return self._descend(i, symbol) - self.origin[symbol] + self.less[symbol]

    def step(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: intervals of symbol + pattern from those of pattern. Empty ones have lo >= hi."""
        at = self.before(np.concatenate([lo, hi]), np.concatenate([symbol, symbol])).reshape(2, -1)
        return at[0], np.where(symbol == 0, at[0], at[1])

    def matching_statistics(self, query: np.ndarray, cap: int) -> np.ndarray:
        """For each position of a query from elsewhere, the length of the longest match that ends there, `cap` at most."""
        symbols, n = self.encode(query), len(query)
        length, alive = np.zeros(n, np.int64), np.arange(n)
        lo, hi = np.zeros(n, np.int64), np.full(n, self.n)
        for k in range(cap):
            keep = alive >= k
            alive, lo, hi = alive[keep], lo[keep], hi[keep]
            lo, hi = self.step(lo, hi, symbols[alive - k])
            keep = lo < hi
            alive, lo, hi = alive[keep], lo[keep], hi[keep]
            length[alive] += 1
        return length

    def report(self, query: np.ndarray, threshold: int) -> list[tuple[int, int]]:
        """Intervals (start, end) of a query whose matching statistics reach the threshold, merged where they touch."""
        ends = np.flatnonzero(self.matching_statistics(query, threshold) >= threshold)
        out: list[tuple[int, int]] = []
        for e in ends.tolist():
            s = e + 1 - threshold
            if out and s <= out[-1][1]:
                out[-1] = (out[-1][0], e + 1)
            else:
                out.append((s, e + 1))
        return out

    def earlier(self, text: np.ndarray, end: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, place in it) of every window of the indexed texts whose matching statistic against all that starts earlier reaches the threshold.

        All texts are streamed backward side by side, from the row of their end: a backward step a symbol, and from the threshold on the row's bit says whether the window that starts there was met before. text: symbols as indexed; end: where each text's 0 stands, ascending; length: its symbols.
        """
        symbols = self.encode(text)
        by_size = np.argsort(-length, kind="stable")
        at, size = end[by_size], length[by_size]
        row, which, place = by_size.copy(), [], []
        for k in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -k, side="left"))
            row = self.before(row[:live], symbols[at[:live] - 1 - k])
            if k + 1 >= self.threshold:
                old = np.flatnonzero(self.again[row])
                which.append(by_size[old])
                place.append(size[old] - 1 - k)
        none = np.zeros(0, np.int64)
        which, place = np.concatenate([none, *which]), np.concatenate([none, *place])
        order = np.lexsort((place, which))
        return which[order], place[order]
