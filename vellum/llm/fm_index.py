"""A compressed FM-index over word sequences: a wavelet matrix of the Burrows-Wheeler transform, in numpy."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank queries over integers below 2**levels: one packed bit vector with block counts for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.bits, self.before, self.zeros = levels, [], [], []
        s = symbols
        for level in range(levels - 1, -1, -1):
            bit = (s >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(len(s) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.bits.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(int(len(s) - bit.sum()))
            one = bit.astype(bool)
            s = np.concatenate([s[~one], s[one]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place, counted from the start of the symbol's final run."""
        start = np.zeros_like(at)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            a, s = self._ones(k, at), self._ones(k, start)
            at = np.where(one, self.zeros[k] + a, at - a)
            start = np.where(one, self.zeros[k] + s, start - s)
        return at - start

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[k][block] + np.bitwise_count(self.bits[k][block] & mask).astype(np.int64)


class FMIndex:
    """Of a text of integers >= 1 with separators 0, its suffixes in order of their first ``window`` symbols.

    Suffixes that agree on ``window`` symbols form a group. Extending a match to the left and, at full length, widening it
    to its group gives the matching statistics cut at ``window`` in one backward step for each word.
    """

    def __init__(self, text: np.ndarray, window: int):
        n = len(text)
        rank, h = text.astype(np.int64), 1
        while h * 2 <= window:
            rank, h = self._double(rank, h), h * 2
        if h < window:
            rank = self._double(rank, window - h)
        order = np.argsort(rank, kind="stable")
        ranked = rank[order]
        new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        group = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]]))
        self.low, self.high = new[group], np.concatenate([new[1:], [n]])[group]
        self.n = n
        size = int(text.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.bwt = WaveletMatrix(text[order - 1], max(1, (size - 1).bit_length()))

    @staticmethod
    def _double(rank: np.ndarray, shift: int) -> np.ndarray:
        """Ranks by a longer prefix: a suffix's rank, then that of the suffix ``shift`` further on."""
        after = np.concatenate([rank[shift:], np.zeros(min(shift, len(rank)), np.int64)])
        return np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)[1].astype(np.int64)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that begin with symbol and then what [low, high) begins with."""
        both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.first[symbol] + both[: len(low)], self.first[symbol] + both[len(low) :]


def repeated_windows(segments: list[np.ndarray], copies: np.ndarray, window: int) -> list[np.ndarray]:
    """For each segment (integers >= 1), the starts of its windows that occur more than once among all segments.

    ``copies``: how many places each segment stands for. All segments are streamed through the index of them all at once, from
    their right ends: a match of one place is unique, so windows over it are skipped, and the search starts anew at the window
    that leaves out the match's last word.
    """
    lengths = np.array([len(s) for s in segments], np.int64)
    if not len(segments):
        return []
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    text = np.zeros(int((lengths + 1).sum()), np.int64)
    inside = np.ones(len(text), bool)
    inside[starts + lengths] = False
    text[inside] = np.concatenate(segments)
    index = FMIndex(text, window)
    found_q, found_at = [], []
    q = np.flatnonzero(lengths >= window)
    at, length = lengths[q] - 1, np.zeros(len(q), np.int64)
    low, high = np.zeros(len(q), np.int64), np.full(len(q), index.n, np.int64)
    while len(q):
        low, high = index.step(text[starts[q] + at], low, high)
        length = np.minimum(length + 1, window)
        full = length == window
        low, high = np.where(full, index.low[low], low), np.where(full, index.high[low], high)
        lone = (high - low < 2) & (copies[q] < 2)
        hit = full & ~lone
        found_q.append(q[hit])
        found_at.append(at[hit])
        # a unique match of `length` words from `at`: the next window ends before its last word
        at = np.where(lone, at + length - 2, at - 1)
        length = np.where(lone, 0, length)
        low, high = np.where(lone, 0, low), np.where(lone, index.n, high)
        go = (at >= 0) & (at + 1 + length >= window)  # words left of the match, and the match, make a window
        q, at, length, low, high = q[go], at[go], length[go], low[go], high[go]
    fq, fa = np.concatenate(found_q), np.concatenate(found_at)
    order = np.lexsort((fa, fq))
    return np.split(fa[order], np.cumsum(np.bincount(fq, minlength=len(segments)))[:-1])
