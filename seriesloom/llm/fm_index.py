"""FM-index of word sequences: a wavelet matrix over the transform, and matching statistics by backward search.

Suffixes are sorted by their first words only, as many as the longest match that is asked for (at most 63); backward
search gives exact intervals up to that length.  Many sequences are streamed at once, a word of each in a step.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Wavelet:
    """Ranks of symbols in a sequence: a bit vector for each bit of the symbols, the highest first (Claude, Navarro
    and Ordonez, 2015)."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.size, self.levels = len(symbols), []
        now = symbols
        for bit in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            on = (now >> bit & 1).astype(bool)
            padded = np.zeros(-(-(len(on) + 1) // 64) * 64, dtype=np.uint8)
            padded[: len(on)] = on
            bits = np.packbits(padded, bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)[:-1]]).astype(np.int32)
            self.levels.append((bit, bits, before, len(on) - int(on.sum())))
            now = np.concatenate([now[~on], now[on]])

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where `at` leads to along each symbol's bits; less the same from 0, it is the symbol's rank before `at`."""
        at = at.astype(np.int64)
        for bit, bits, before, zeros in self.levels:
            word, inside = at >> 6, (at & 63).astype(np.uint64)
            ones = before[word] + np.bitwise_count(bits[word] & ((np.uint64(1) << inside) - np.uint64(1)))
            at = np.where(symbols >> bit & 1, zeros + ones, at - ones)
        return at


class Matches(NamedTuple):
    length: np.ndarray  # of the longest match that starts at each word, at most the index's
    owner: np.ndarray  # the least owner of a sequence that holds such a match of full length, else -1


class FmIndex:
    """An index of sequences of symbols (1 and more), each with an owner's number, for matches of up to `longest`."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, owners: np.ndarray, longest: int):
        if not 1 <= longest <= 63:
            raise ValueError("matches have 1 to 63 words")
        self.longest = longest
        ends = np.cumsum(sizes + 1)
        text = np.zeros(int(ends[-1]) if len(ends) else 1, dtype=np.int64)
        inside = np.ones(len(text), dtype=bool)
        inside[ends - 1] = False
        inside[-1] = False
        text[inside] = flat
        n = self.n = len(text)
        ranks, width = [self._dense(text)], 1
        while width < longest:
            last = ranks[-1].astype(np.int64)
            then = np.zeros(n, dtype=np.int64)
            then[: n - width] = last[width:] if width < n else 0
            ranks.append(self._dense(last * (n + 1) + then))
            width *= 2
        rows = np.argsort(ranks[-1], kind="stable")
        self.lcp = self._common(ranks, rows)
        largest = int(text.max(initial=0))
        self.wavelet = Wavelet(text[rows - 1], largest)
        starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 1))])[:-1]
        self.base = starts - self.wavelet.descend(np.arange(largest + 1), np.zeros(largest + 1, np.int64))
        self.known = np.bincount(text, minlength=largest + 1) > 0
        holder = np.repeat(owners, sizes + 1) if len(ends) else np.zeros(1, np.int64)
        heads = np.flatnonzero(self.lcp[:-1] < longest)
        self.least = np.repeat(np.minimum.reduceat(holder[rows], heads), np.diff(np.r_[heads, n]))
        self.smaller_before, self.smaller_after = self._neighbours()

    @staticmethod
    def _dense(keys: np.ndarray) -> np.ndarray:
        return np.unique(keys, return_inverse=True)[1].astype(np.int32)

    def _common(self, ranks: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
        """Words that neighbouring suffixes share, by halving over the ranks; -1 at both ends."""
        n = self.n
        left, right, common = rows[:-1].copy(), rows[1:].copy(), np.zeros(max(0, n - 1), dtype=np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            inside = np.maximum(left, right) < n
            same = np.zeros(len(left), dtype=bool)
            same[inside] = ranks[level][left[inside]] == ranks[level][right[inside]]
            for x in (left, right, common):
                x[same] += 1 << level
        return np.concatenate([[-1], np.minimum(common, self.longest), [-1]]).astype(np.int8)

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """The nearest rows before and after each whose common length is smaller, one length at a time."""
        place = np.arange(self.n + 1, dtype=np.int32)
        before, after = np.zeros(self.n + 1, dtype=np.int32), np.full(self.n + 1, self.n, dtype=np.int32)
        for v in np.unique(self.lcp)[1:]:
            less, own = self.lcp < v, self.lcp == v
            before[own] = np.maximum.accumulate(np.where(less, place, 0))[own]
            after[own] = np.minimum.accumulate(np.where(less, place, self.n)[::-1])[::-1][own]
        return before, after

    def _parent(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The interval of the longest shorter match that more rows share, and its length."""
        at = np.where(self.lcp[low] >= self.lcp[high], low, high)
        return self.smaller_before[at], self.smaller_after[at], np.maximum(self.lcp[at], 0)

    def stream(self, flat: np.ndarray, sizes: np.ndarray) -> Matches:
        """Matching statistics of sequences, each read from its end; symbols that the index lacks match nothing."""
        length, owner = np.zeros(len(flat), dtype=np.int64), np.full(len(flat), -1, dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        last = np.cumsum(sizes)[order] - 1
        count = sizes[order]
        low, high, depth = np.zeros(len(order), np.int64), np.full(len(order), self.n, dtype=np.int64), np.zeros(len(order), np.int64)
        for step in range(int(count[0]) if len(count) else 0):
            live = int(np.searchsorted(-count, -step, "left"))
            at = last[:live] - step
            symbol = flat[at]
            l, h, d = low[:live], high[:live], depth[:live]
            full = np.flatnonzero(d == self.longest)
            if len(full):  # give up the last word: one shorter, in the interval of those that share the rest
                wl, wh, wd = self._parent(l[full], h[full])
                wide = wd == self.longest - 1
                l[full[wide]], h[full[wide]] = wl[wide], wh[wide]
                d[full] -= 1
            known = (symbol > 0) & (symbol < len(self.known))
            known[known] = self.known[symbol[known]]
            l[~known], h[~known], d[~known] = 0, self.n, 0
            todo = np.flatnonzero(known)
            while len(todo):
                s = symbol[todo]
                ends = self.wavelet.descend(np.r_[s, s], np.r_[l[todo], h[todo]]) + np.r_[self.base[s], self.base[s]]
                nl, nh = ends[: len(todo)], ends[len(todo) :]
                found = nl < nh
                hit = todo[found]
                l[hit], h[hit] = nl[found], nh[found]
                d[hit] += 1
                todo = todo[~found]
                l[todo], h[todo], d[todo] = self._parent(l[todo], h[todo])
            length[at] = d
            whole = np.flatnonzero(d == self.longest)
            owner[at[whole]] = self.least[l[whole]]
        return Matches(length, owner)
