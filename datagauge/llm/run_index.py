"""A run-length index of a small collection of byte strings, and its matching statistics.

The strings' suffixes are sorted, their Burrows-Wheeler transform is cut into runs, and
common prefixes with the next suffix before and after are compared only at ends of runs
(the samples). In text order every other value follows from the one before it:
inside a run the previous suffix's neighbours are the neighbours of this one, one byte
longer. So the longest match of each position elsewhere comes from the samples alone.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes in order; left[i] is the distance to the end of i's string (its separator, symbol 0).

    Prefix doubling that sorts only suffixes whose rank isn't settled. Equal
    suffixes of different strings stand in the order of their places.
    """
    n = len(symbols)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(8, np.int64)])
    for j in range(7):
        key = (key << 9) | np.where(left >= j, padded[j : j + n], 0)
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n, np.int64)
    fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = head
    k, longest = 7, int(left.max(initial=0)) + 1
    while k < longest:
        lone = fresh & np.append(fresh[1:], True)
        at = np.flatnonzero(~lone)  # places in order that aren't settled
        if not len(at):
            break
        own = order[at]
        then = np.where(left[own] >= k, rank[np.minimum(own + k, n - 1)] + 1, 0)
        sort = np.lexsort((own, then, head[at]))
        own, then, group = own[sort], then[sort], head[at][sort]
        order[at] = own
        fresh[at] = np.concatenate([[True], (group[1:] != group[:-1]) | (then[1:] != then[:-1])])
        head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[order] = head
        k *= 2
    return order


def common_prefixes(symbols: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of common prefixes of suffixes a[i] and b[i], compared eight bytes at a time."""
    most = np.minimum(left[a], left[b])
    raw = np.concatenate([(symbols - 1).clip(0).astype(np.uint8), np.zeros(8, np.uint8)])
    packed = np.zeros(len(symbols), np.uint64)
    for j in range(8):
        packed |= raw[j : j + len(symbols)].astype(np.uint64) << np.uint64(8 * j)
    out, live, at = most.copy(), np.flatnonzero(most > 0), 0
    while len(live):
        x = packed[a[live] + at] ^ packed[b[live] + at]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.floor(np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int64) // 8)
        out[live] = np.minimum(most[live], at + same)
        at += 8
        live = live[(x == 0) & (most[live] > at)]
    return out


class RunIndex:
    def __init__(self, strings: list[bytes]):
        size = np.array([len(s) for s in strings], np.int64)
        ends = np.cumsum(size + 1)
        self.starts = ends - size - 1
        symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int16) + 1
        symbols[ends - 1] = 0
        n = len(symbols)
        self.left = np.repeat(ends - 1, size + 1) - np.arange(n)
        self.symbols = symbols
        order = suffix_array(symbols, self.left)
        transform = symbols[order - 1]
        transform[np.isin(order, self.starts)] = 0
        change = (transform[1:] != transform[:-1]) | (transform[1:] == 0)
        #: Run heads and ends, as places in the order of suffixes, and the suffixes sampled there.
        self.heads, self.tails = np.flatnonzero(np.concatenate([[True], change])), np.flatnonzero(np.append(change, True))
        self.runs = len(self.heads)
        self.head_suffix, self.tail_suffix = order[self.heads], order[self.tails]
        self.before, self.after = order[np.maximum(self.heads - 1, 0)], order[np.minimum(self.tails + 1, n - 1)]

    def matching_statistics(self) -> np.ndarray:
        """For each place the length of its longest match with another place."""
        n = len(self.symbols)
        out = np.zeros(n, np.int64)
        for suffix, other, none in ((self.head_suffix, self.before, self.heads == 0), (self.tail_suffix, self.after, self.tails == n - 1)):
            value = np.zeros(n, np.int64)
            value[suffix] = np.where(none, 0, common_prefixes(self.symbols, self.left, suffix, other))
            sampled = np.zeros(n, bool)
            sampled[suffix] = True
            last = np.maximum.accumulate(np.where(sampled, np.arange(n), 0))
            out = np.maximum(out, value[last] - (np.arange(n) - last))
        return out
