"""FM-index over integer sequences: wavelet-matrix ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np

#: Every so many text positions one suffix position is stored.
SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; the text must end with a symbol that is smaller than all others."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-width] = rank[width:] + 1
        key = rank * (len(rank) + 1) + ahead
        order = np.argsort(key, kind="stable")
        steps = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty_like(rank)
        rank[order] = steps
        if steps[-1] == len(rank) - 1:
            return order
        width *= 2
        if width >= len(rank):
            return order


class FMIndex:
    """Index of ``text``, integers of at least 1; the end symbol 0 is added."""

    def __init__(self, text: np.ndarray):
        text = np.append(np.asarray(text, np.int64), 0)
        self.size = len(text)
        order = suffix_array(text)
        last = text[order - 1]
        self.levels = max(1, int(text.max()).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.levels))])
        self.ones, self.zeros = [], []
        symbols = last
        for level in range(self.levels - 1, -1, -1):
            bit = symbols >> level & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        # where each symbol starts in the last level
        self.start = self._down(np.arange(1 << self.levels), np.zeros(1 << self.levels, np.int64))
        marked = order % SAMPLE == 0
        self.mark_rank = np.concatenate([[0], np.cumsum(marked)])
        self.marked, self.positions = marked, order[marked]

    def _down(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.ones[k][row]
            row = np.where(symbol >> level & 1, self.zeros[k] + ones, row - ones)
        return row

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the last column before each row."""
        return self._down(symbol, row) - self.start[symbol]

    def back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one position earlier."""
        symbol, at = np.zeros(len(row), np.int64), row
        for k in range(self.levels):
            here = self.ones[k][at]
            bit = self.ones[k][at + 1] - here
            at = np.where(bit, self.zeros[k] + here, at - here)
            symbol = symbol << 1 | bit
        return self.before[symbol] + at - self.start[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each pattern, all searched together; patterns stand at the right end of their rows."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        top = 1 << self.levels
        for step in range(patterns.shape[1]):
            on = np.flatnonzero((step < lengths) & (low < high))
            if not len(on):
                break
            symbol = patterns[on, patterns.shape[1] - 1 - step].astype(np.int64)
            known = symbol < top
            inside = np.where(known, symbol, 0)
            low[on] = self.before[inside] + self.rank(inside, low[on])
            high[on] = np.where(known, self.before[inside] + self.rank(inside, high[on]), low[on])
        return low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, text position) of every row in the ranges: walk back to a sampled suffix."""
        counts = np.maximum(high - low, 0)
        pattern = np.repeat(np.arange(len(low)), counts)
        row = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        walked, open_ = np.zeros(len(row), np.int64), np.flatnonzero(~self.marked[row])
        while len(open_):
            row[open_] = self.back(row[open_])
            walked[open_] += 1
            open_ = open_[~self.marked[row[open_]]]
        return pattern, self.positions[self.mark_rank[row]] + walked
