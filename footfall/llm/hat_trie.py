"""Counting sequences of word ids in a HAT-trie: a shallow trie over word ids whose leaves are hash containers that burst.

A key is up to four word ids, packed into two 64-bit numbers in the order of the trie's levels. Leaves cover ranges of keys: as long as
few keys lie below them, many first words share one container (a hybrid bucket). A container that holds more than ``BURST`` keys
bursts into two whose ranges meet at a boundary of the shallowest level that has one inside: first words as long as there are
several, else second words, and so on. Containers are open-addressing tables in arrays, filled a batch of different keys at a time.

If the whole trie holds more than ``FULL`` keys, the largest subtrees are taken out as sorted runs until half is left.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np

BURST = 1 << 16
FULL = 1 << 20
Run = tuple[np.ndarray, np.ndarray, np.ndarray]
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_LEVELS = (np.uint64((1 << 64) - (1 << 32)), np.uint64((1 << 64) - 1))  # a first word; a first and a second word


def packed(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for one to four columns of ids from 1 to 2^32 - 1; 0 stands for no word."""
    zero = np.zeros(len(ids[0]), np.uint64)
    one, two, three, four = [x.astype(np.uint64) for x in ids] + [zero] * (4 - len(ids))
    return one << np.uint64(32) | two, three << np.uint64(32) | four


def unpacked(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """The four columns of ids, 0 where there is no word."""
    parts = (high >> np.uint64(32), high & np.uint64(0xFFFFFFFF), low >> np.uint64(32), low & np.uint64(0xFFFFFFFF))
    return [x.astype(np.int64) for x in parts]


def counted(high: np.ndarray, low: np.ndarray, number: np.ndarray | None = None) -> Run:
    """Different keys in order, with the sum of their numbers (1 each if there are none)."""
    if not low.any() and number is None:
        keys, sums = np.unique(high, return_counts=True)
        return keys, np.zeros(len(keys), np.uint64), sums.astype(np.int64)
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    if not len(high):
        return high, low, np.zeros(0, np.int64)
    begin = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
    sums = np.diff(np.r_[begin, len(high)]) if number is None else np.add.reduceat(number[order], begin)
    return high[begin], low[begin], sums.astype(np.int64)


class Container:
    """An open-addressing hash table from keys to counts."""

    def __init__(self, slots: int = 1 << 8):
        self.high, self.low = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.count = np.zeros(slots, np.int64)  # 0: a free slot
        self.size = 0

    def add(self, high: np.ndarray, low: np.ndarray, number: np.ndarray) -> None:
        """Add numbers above 0 to the counts of different keys."""
        if 2 * (self.size + len(high)) > len(self.count):
            old, slots = self.entries(), len(self.count)
            while 2 * (self.size + len(high)) > slots:
                slots *= 2
            self.__init__(slots)
            self.add(*old)
        mask = np.uint64(len(self.count) - 1)
        with np.errstate(over="ignore"):
            spot = high * _MIX[0] + low * _MIX[1]
            spot = ((spot ^ (spot >> np.uint64(32))) * _MIX[0] >> np.uint64(20)) & mask
        left = np.arange(len(high))
        while len(left):
            at = spot[left]
            free = left[self.count[at] == 0]
            self.high[spot[free]], self.low[spot[free]] = high[free], low[free]  # of several that claim one slot the last gets it
            self.size += int(np.count_nonzero(self._mine(spot[free], high[free], low[free])))
            mine = self._mine(at, high[left], low[left])
            self.count[at[mine]] += number[left[mine]]
            left = left[~mine]
            spot[left] = (spot[left] + np.uint64(1)) & mask

    def _mine(self, at: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        return (self.high[at] == high) & (self.low[at] == low)

    def entries(self) -> Run:
        used = self.count > 0
        return self.high[used], self.low[used], self.count[used]

    def run(self) -> Run:
        high, low, count = self.entries()
        order = np.lexsort((low, high))
        return high[order], low[order], count[order]


class HatTrie:
    """Counts of packed keys; ``starts`` holds the first key that each leaf can hold, in order."""

    def __init__(self, burst: int = BURST, full: int = FULL):
        self.burst, self.full = burst, full
        self.starts: list[tuple[int, int]] = [(0, 0)]
        self.leaves = [Container()]

    def __len__(self) -> int:
        return sum(leaf.size for leaf in self.leaves)

    def add(self, high: np.ndarray, low: np.ndarray) -> Iterator[Run]:
        """Count keys, repeats included; yields the runs of subtrees that had to go."""
        high, low, number = counted(high, low)
        at = 0
        while at < len(high):
            leaf = bisect_right(self.starts, (int(high[at]), int(low[at]))) - 1
            end = self._reach(high, low, leaf)
            # What is added at once is bounded, so that a leaf bursts long before it holds too much.
            end = min(end, at + self.burst)
            self.leaves[leaf].add(high[at:end], low[at:end], number[at:end])
            at = end
            if self.leaves[leaf].size > self.burst:
                self._split(leaf)
        if len(self) > self.full:
            yield from self.spill(self.full // 2)

    def _reach(self, high: np.ndarray, low: np.ndarray, leaf: int) -> int:
        """Position of the first key beyond a leaf."""
        if leaf + 1 == len(self.starts):
            return len(high)
        first, second = self.starts[leaf + 1]
        begin, end = (int(np.searchsorted(high, np.uint64(first), side)) for side in ("left", "right"))
        return begin + int(np.searchsorted(low[begin:end], np.uint64(second), "left"))

    def _split(self, leaf: int) -> None:
        high, low, count = self.leaves[leaf].run()
        middle = len(high) // 2
        cuts = np.zeros(0, np.int64)
        for mask in _LEVELS:
            cuts = np.flatnonzero((high[1:] & mask) != (high[:-1] & mask)) + 1
            if len(cuts):
                break
        if not len(cuts):  # one first and one second word: below them the keys differ in the second number
            cuts = np.arange(1, len(low))
        cut = int(cuts[np.abs(cuts - middle).argmin()])
        parts = []
        for some in (slice(0, cut), slice(cut, None)):
            part = Container()
            part.add(high[some], low[some], count[some])
            parts.append(part)
        self.leaves[leaf:leaf + 1] = parts
        self.starts.insert(leaf + 1, (int(high[cut]), int(low[cut])))

    def spill(self, left: int = 0) -> Iterator[Run]:
        """Take out the largest leaves as sorted runs until at most ``left`` keys stay."""
        for leaf in sorted(self.leaves, key=lambda x: -x.size):
            if len(self) <= left:
                break
            if leaf.size:
                run = leaf.run()
                leaf.__init__()
                yield run
