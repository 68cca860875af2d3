"""A compressed FM-index over words in numpy: suffix array, wavelet matrix, backward search.

The text of an index is a list of pieces; every piece ends in a separator of its own, so no match runs
from one piece into the next. A piece may stand for several equal ones: its weight is their number,
and the weight of a suffix interval is the number of places in the corpus at which the pattern begins.
All steps work on many patterns at once.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols in a sequence of numbers below ``2 ** levels``: one bit row per level, packed, with counts per 64 bits."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.rows: list[tuple[np.ndarray, np.ndarray, int]] = []
        s = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = ((s >> level) & 1).astype(bool)
            padded = np.zeros((len(bit) // 64 + 1) * 64, bool)
            padded[: len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.zeros(len(packed), np.int64)
            np.cumsum(np.bitwise_count(packed[:-1]), out=before[1:])
            self.rows.append((packed, before, len(bit) - int(bit.sum())))
            s = np.concatenate([s[~bit], s[bit]])
        self.first = self._place(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (packed, before, zeros) in enumerate(self.rows):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            word = i >> 6
            low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(packed[word] & low)
            i = np.where(bit == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands in the first ``i`` places."""
        return self._place(symbol, i) - self.first[symbol]


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Suffixes in order by prefix doubling; only those that are still tied are sorted again."""
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    rank = np.empty(n, np.int64)

    def regroup(idx: np.ndarray, new: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Gives the sorted suffixes ``idx`` their ranks; returns which of them are still tied."""
        first = np.maximum.accumulate(np.where(new, np.arange(len(idx)), 0))
        rank[idx] = base + first
        ends = np.append(new[1:], True)
        return ~(new & ends)

    key = ranks[order]
    new = np.append(True, key[1:] != key[:-1])
    tied = regroup(order, new, np.zeros(n, np.int64))
    place, step = np.flatnonzero(tied), 1
    while len(place):
        idx = order[place]
        group = rank[idx]
        behind = rank[np.minimum(idx + step, n - 1)]
        o = np.lexsort((behind, group))
        idx, group, behind = idx[o], group[o], behind[o]
        order[place] = idx
        new = np.append(True, (group[1:] != group[:-1]) | (behind[1:] != behind[:-1]))
        tied = regroup(idx, new, place - np.arange(len(idx)))
        place, step = place[tied], step * 2
    return order


class FMIndex:
    """``words``: numbers from 1 on, pieces laid end to end; ``sizes``: words per piece; ``weights``: equal pieces it stands for."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, weights: np.ndarray):
        pieces = len(sizes)
        self.size = sizes
        self.start = np.cumsum(sizes + 1) - sizes - 1
        self.text = np.zeros(len(words) + pieces, np.int64)
        inside = np.ones(len(self.text), bool)
        inside[self.start + sizes] = False
        self.text[inside] = words
        ranks = self.text + (pieces - 1)
        ranks[~inside] = np.arange(pieces)  # every separator differs
        sa = suffix_array(ranks)
        n_symbols = int(self.text.max()) + 1
        self.below = np.zeros(n_symbols + 1, np.int64)
        np.cumsum(np.bincount(self.text, minlength=n_symbols), out=self.below[1:])
        self.bwt = WaveletMatrix(self.text[sa - 1], n_symbols)
        self.weight = np.zeros(len(sa) + 1, np.int64)
        np.cumsum(np.repeat(weights, sizes + 1)[sa], out=self.weight[1:])

    def reach(self, end: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Backward search from the word at ``end``: the smallest place from ``least`` on from which the text up
        to ``end`` stands at two places or more; ``end + 1`` if not even its last word does."""
        out = end + 1
        lane = np.arange(len(end))
        lo, hi = np.zeros(len(end), np.int64), np.full(len(end), len(self.text), np.int64)
        while len(lane):
            symbol = self.text[out[lane] - 1]
            both = self.below[symbol] + self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])).reshape(2, -1)
            go = self.weight[both[1]] - self.weight[both[0]] >= 2
            lane, lo, hi = lane[go], both[0][go], both[1][go]
            out[lane] -= 1
            go = out[lane] > least[lane]
            lane, lo, hi = lane[go], lo[go], hi[go]
        return out

    def repeated(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, first, last): runs of windows of ``window`` words, by their first word's place in the piece,
        whose words begin at two places or more.

        The first search reads each piece from its end. Then windows are tried from the left: where the search
        breaks off at ``p``, no window over that break repeats, so the next one begins behind it; where it
        gets through, the longest repeated stretch from here on is found by bisection.
        """
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        piece = np.flatnonzero(self.size >= window)
        begin = self.start[piece]
        end = begin + self.size[piece] - 1
        p = self.reach(end, begin)
        last = end - window + 1
        full = p <= last
        found.append((piece[full], p[full], last[full]))
        at, last = begin.copy(), np.minimum(p, last) - 1
        while True:
            go = at <= last
            piece, at, last = piece[go], at[go], last[go]
            if not len(at):
                break
            p = self.reach(at + window - 1, at)
            hit = np.flatnonzero(p == at)
            if len(hit):
                low, high = np.zeros(len(hit), np.int64), last[hit] - at[hit]
                open_ = np.flatnonzero(low < high)
                while len(open_):
                    middle = (low[open_] + high[open_] + 1) // 2
                    a = at[hit[open_]]
                    ok = self.reach(a + window - 1 + middle, a) == a
                    low[open_[ok]] = middle[ok]
                    high[open_[~ok]] = middle[~ok] - 1
                    open_ = open_[low[open_] < high[open_]]
                found.append((piece[hit], at[hit], at[hit] + low))
                p[hit] = at[hit] + low + 1
            at = p
        piece, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
        return piece, first - self.start[piece], last - self.start[piece]
