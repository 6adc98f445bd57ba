"""A bidirectional FM-index over word ids, as numpy arrays.

A text is an array of symbols; 0 separates its pieces and stands at both ends. Its rows are the
places of the text sorted by their next `depth` symbols, and the transform holds the symbol before each
row, so all intervals of phrases up to `depth` symbols are exact while the sort needs few rounds. The same
over the reversed text gives extension to the right. Every phrase has an interval in either, of one length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def transform(text: np.ndarray, depth: int) -> np.ndarray:
    """The symbol before each place, places sorted by their next `depth` symbols (doubling rounds)."""
    n = len(text)
    separator = text == 0
    sizes = np.bincount(text, minlength=1)
    rank = (np.concatenate(([0], np.cumsum(sizes)))[text]).astype(np.int64)
    rank[separator] = np.arange(int(separator.sum()))  # each one of its own: no phrase runs over it
    open_ = np.flatnonzero(~separator & (sizes[text] > 1))
    known = 1
    while known < depth and len(open_):
        key = rank[open_] * (n + 1) + rank[open_ + known]
        order = np.argsort(key)
        key, open_ = key[order], open_[order]
        old = rank[open_]
        at = np.arange(len(open_))
        heads = np.concatenate(([True], key[1:] != key[:-1]))
        groups = np.concatenate(([True], old[1:] != old[:-1]))
        rank[open_] = old + np.maximum.accumulate(np.where(heads, at, 0)) - np.maximum.accumulate(np.where(groups, at, 0))
        alone = heads & np.concatenate((heads[1:], [True]))
        open_ = open_[~alone]
        known *= 2
    rows = np.argsort(rank, kind="stable")
    return text[rows - 1]  # the place before the first is the last separator


@dataclass
class Phrases:
    """Phrases with their intervals: symbols (one row each), lows of both intervals, occurrences."""

    symbols: np.ndarray
    low: np.ndarray
    reverse_low: np.ndarray
    count: np.ndarray

    def where(self, mask: np.ndarray) -> Phrases:
        return Phrases(self.symbols[mask], self.low[mask], self.reverse_low[mask], self.count[mask])


class WordIndex:
    def __init__(self, forward: np.ndarray, reverse: np.ndarray, alphabet: int) -> None:
        """Transforms of a text and of its reversal; symbols are below `alphabet`."""
        self.transforms = forward, reverse
        self.alphabet = alphabet
        self.steps: list[np.ndarray | None] = [None, None]

    def _steps(self, side: int) -> np.ndarray:
        """Row of the place before each row (for rows whose symbol is no separator)."""
        if self.steps[side] is None:
            order = np.argsort(self.transforms[side], kind="stable")
            step = np.empty(len(order), np.int64)
            step[order] = np.arange(len(order))
            self.steps[side] = step
        return self.steps[side]

    def single(self) -> Phrases:
        """All symbols of the text as phrases of one word."""
        sizes = np.bincount(self.transforms[0], minlength=self.alphabet)
        low = np.cumsum(sizes) - sizes
        found = np.flatnonzero(sizes)
        found = found[found > 0]
        return Phrases(found[:, None], low[found], low[found], sizes[found])

    def _extended(self, side: int, low: np.ndarray, other: np.ndarray, count: np.ndarray):
        """(phrase, symbol, low, other low, count) of every one-symbol extension on one side."""
        if not len(low):
            return (np.zeros(0, np.int64),) * 5
        before = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(low)), count)
        rows = np.arange(int(count.sum())) + np.repeat(low - before, count)
        key = owner * self.alphabet + self.transforms[side][rows]
        key, first, held = np.unique(key, return_index=True, return_counts=True)
        owner, symbol = key // self.alphabet, key % self.alphabet
        smaller = np.cumsum(held) - held - before[owner]
        real = symbol > 0
        owner, symbol, first, held, smaller = (x[real] for x in (owner, symbol, first, held, smaller))
        return owner, symbol, self._steps(side)[rows[first]], other[owner] + smaller, held

    def left(self, p: Phrases) -> Phrases:
        owner, symbol, low, reverse_low, count = self._extended(0, p.low, p.reverse_low, p.count)
        return Phrases(np.concatenate((symbol[:, None], p.symbols[owner]), axis=1), low, reverse_low, count)

    def right(self, p: Phrases) -> Phrases:
        owner, symbol, reverse_low, low, count = self._extended(1, p.reverse_low, p.low, p.count)
        return Phrases(np.concatenate((p.symbols[owner], symbol[:, None]), axis=1), low, reverse_low, count)
