"""An FM-index over integer symbols in numpy, for batches of queries at once.

The Burrows-Wheeler transform is held as a wavelet matrix: one bit vector per bit of a symbol, each level stably partitioned by
the bit before.  Bit vectors are packed words with counts in front of each word, so a rank is a look-up and a population count.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order; the last symbol must be 0 and occur nowhere else, and symbols stay below 2 ** 31.

    Starts from the first three symbols (two, if a symbol needs more than 21 bits) and doubles the compared length, for
    suffixes that still share a rank only.
    """
    n = len(symbols)
    most = int(symbols.max())
    if most >= 1 << 31:
        raise ValueError("symbols below 2 ** 31 expected")
    s = np.concatenate([symbols, np.zeros(2, symbols.dtype)]).astype(np.int64)
    wide = most >= 1 << 21
    key = (s[:-2] << 31) | s[1:-1] if wide else (s[:-2] << 42) | (s[1:-1] << 21) | s[2:]
    order = np.argsort(key)
    sorted_key = key[order]
    first = np.flatnonzero(np.diff(sorted_key, prepend=-1))
    size = np.diff(first, append=n)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, size)
    tied = np.flatnonzero(np.repeat(size > 1, size))  # places in the order
    length = 2 if wide else 3
    while len(tied):
        at = order[tied]
        key = rank[at] * n + rank[at + length]  # a tie ends before the end of the text, where 0 stands once
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[tied] = at
        first = np.flatnonzero(np.diff(key, prepend=-1))
        size = np.diff(first, append=len(at))
        rank[at] = np.repeat(tied[first], size)
        tied = tied[np.repeat(size > 1, size)]
        length *= 2
    return order


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.ones = int(ones.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    def __init__(self, values: np.ndarray, kinds: int):
        self.levels, self.zeros = [], []
        self.shifts = range(max(1, int(kinds - 1).bit_length()) - 1, -1, -1)
        for shift in self.shifts:
            bit = (values >> shift) & 1
            self.levels.append(Bits(bit))
            one = bit.astype(bool)
            self.zeros.append(len(values) - self.levels[-1].ones)
            values = np.concatenate([values[~one], values[one]])
        # where each kind's block starts below the last level
        self.block = self._down(np.arange(kinds), np.zeros(kinds, np.int64))

    def _down(self, value: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, level, zeros in zip(self.shifts, self.levels, self.zeros):
            ones = level.rank(i)
            i = np.where((value >> shift) & 1, zeros + ones, i - ones)
        return i

    def rank(self, value: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each value stands before each position."""
        return self._down(value, i) - self.block[value]

    def step(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the value at i, how often it stands before i)"""
        value = np.zeros(len(i), np.int64)
        for level, zeros in zip(self.levels, self.zeros):
            bit, ones = level.get(i), level.rank(i)
            value = value * 2 + bit
            i = np.where(bit, zeros + ones, i - ones)
        return value, i - self.block[value]


class FMIndex:
    def __init__(self, symbols: np.ndarray, sample: int = 16):
        """``symbols`` end with a single 0; every ``sample``-th text position is kept with its row."""
        order = suffix_array(symbols)
        kinds = int(symbols.max()) + 1
        self.size = len(symbols)
        counts = np.bincount(symbols, minlength=kinds)
        self.less = np.cumsum(counts) - counts
        self.bwt = WaveletMatrix(symbols[order - 1].astype(np.int64), kinds)
        marked = order % sample == 0
        self.marked, self.positions = Bits(marked), order[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [from, to) of equally long patterns, by backward search; empty where one does not occur."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        alive = np.arange(len(patterns))
        for column in patterns.T[::-1]:
            value = column[alive]
            lo[alive] = self.less[value] + self.bwt.rank(value, lo[alive])
            hi[alive] = self.less[value] + self.bwt.rank(value, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a kept position and add the steps."""
        out = np.empty(len(rows), np.int64)
        at, row, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(at):
            here = self.marked.get(row)
            out[at[here]] = self.positions[self.marked.rank(row[here])] + steps
            at, row = at[~here], row[~here]
            value, before = self.bwt.step(row)
            row = self.less[value] + before
            steps += 1
        return out
