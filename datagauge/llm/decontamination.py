"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification.

An item of w terms is held against windows of w terms of every document, by shingles of five terms.
Items of about one size are a class. For each class windows of its size, at most an eighth of a window apart, get a
64-bit SimHash; the class's items stand in a multi-index of four blocks of sixteen bits, each under all
values within RADIUS // BLOCKS bits of its own: by the pigeonhole principle every item within
RADIUS bits of a window is found. Candidates, and nothing else, are verified by the exact weighted
similarity of their shingles (sum of least counts over sum of greatest), at all places about the window.

At a similarity of exactly 0.8 a window's fingerprint is on average 9.7 bits from the item's, 12 from that of the nearest
window of the grid: about 1 in 100 such pairs is missed, and less than 1 in 10,000 from a similarity of 0.9 on.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datagauge.llm.kernels import LOWER, buffers, mix, prefix_hash, ragged, slices, span_hash
from datagauge.llm.toxicity import TERM

SHINGLE = 5
BLOCKS, RADIUS = 4, 19
#: A class has items of this share of its window at least. Windows are a power of two apart, this part of their size at most.
CLASS, APART = 0.93, 8
#: Items are broadcast in blocks of at most so many items, whose index then has 40 kB an item, and bytes of text; each block is a pass over the documents.
BLOCK_ITEMS, BLOCK_BYTES = 4_000, 16_000_000
#: Texts are worked on so many bytes at a time.
SLICE = 300_000


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms (runs of letters, digits and non-ASCII bytes, A-Z in lower case) and each row's first."""
    low, inside, n = LOWER[data], TERM[data], len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, stop = inside.copy(), inside.copy()
    if n:
        start[1:] &= ~inside[:-1] | edge[1:n]
        stop[:-1] &= ~inside[1:] | edge[1:n]
    a = np.flatnonzero(start)
    return span_hash(prefix_hash(low), a, np.flatnonzero(stop) + 1), np.searchsorted(a, offsets)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k neighbours (over ends of rows too; callers leave those out)."""
    salts = mix(np.arange(1, k + 2, dtype=np.uint64))
    out = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        out += mix(h[j : j + len(out)] + salts[j]) * salts[j + 1]
    return mix(out + np.uint64(k))


def lanes(width: int) -> int:
    """Bits of a counter that holds twice the width."""
    return next(n for n in (8, 16, 32) if width < 1 << (n - 1))


def planes(g: np.ndarray, lane: int) -> np.ndarray:
    """Running sums of the bits of hashes: row j counts bits j, j + lane, ... in 64 // lane counters of a word.

    Differences of running sums are exact, as carries cancel, while a window's counts fit in a counter.
    """
    ones = np.uint64(sum(1 << i for i in range(0, 64, lane)))
    out = np.zeros((lane, len(g) + 1), np.uint64)
    for j in range(lane):
        np.cumsum((g >> np.uint64(j)) & ones, out=out[j, 1:])
    return out


def window_prints(sums: np.ndarray, width: int, stride: int = 1) -> np.ndarray:
    """Fingerprints of the windows of `width` hashes that begin every `stride` places: which bits most of the hashes have."""
    lane, n = len(sums), (sums.shape[1] - 1 - width) // stride + 1
    last = (n - 1) * stride + 1
    top = np.uint64(sum(1 << i for i in range(lane - 1, 64, lane)))
    lift = np.uint64(sum(((1 << (lane - 1)) - 1 - width // 2) << i for i in range(0, 64, lane)))
    out, x = np.zeros(max(n, 0), np.uint64), np.empty(max(n, 0), np.uint64)
    for j in range(lane if n > 0 else 0):
        np.subtract(sums[j, width : width + last : stride], sums[j, :last:stride], out=x)
        x += lift
        x &= top
        x >>= np.uint64(j)
        out |= x
    return out


@dataclass
class Class:
    """Items of one shingle length and about one size, and their multi-index: by block and value the items near it."""

    k: int
    width: int
    items: np.ndarray
    prints: np.ndarray

    def __post_init__(self):
        self.stride = 1 << max(self.width // APART, 1).bit_length() - 1
        near = np.array([sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(64 // BLOCKS), r)], np.uint16)
        self.number, self.first, self.of = [], [], []
        for block in self.prints.view(np.uint16).reshape(-1, BLOCKS).T:
            values = (block[:, None] ^ near).ravel()
            order = np.argsort(values, kind="stable")
            number = np.bincount(values, minlength=1 << 16)
            self.number.append(number.astype(np.min_scalar_type(number.max(initial=0))))
            self.first.append((np.cumsum(number) - number).astype(np.int32))
            self.of.append((order // len(near)).astype(np.int32))

    def probe(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place in items) of all pairs within the radius, each once."""
        windows, found = [], []
        for block, number, first, of in zip(prints.view(np.uint16).reshape(-1, BLOCKS).T, self.number, self.first, self.of, strict=True):
            n = number[block]
            at = np.flatnonzero(n)
            n = n[at].astype(np.int64)
            item, window = of[ragged(first[block[at]].astype(np.int64), n)], np.repeat(at, n)
            near = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
            windows.append(window[near])
            found.append(item[near])
        both = np.unique(np.concatenate(windows) * len(self.items) + np.concatenate(found))
        return both // len(self.items), both % len(self.items)


class Items:
    def __init__(self, rows: list[tuple[int, str]], least: float):
        self.least = least
        self.ids, self.grams, self.size, self.k = [], [], [], []
        for item, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            h, _ = term_hashes(raw, np.array([0, len(raw)]))
            if len(h):
                k = min(SHINGLE, len(h))
                self.ids.append(item)
                self.k.append(k)
                self.grams.append(grams(h, k))
                self.size.append(len(h) - k + 1)
        self.counts = [Counter(g.tolist()) for g in self.grams]
        self.need = np.array([int(np.ceil(least * n - 1e-9)) for n in self.size], np.int64)
        self.classes: dict[int, list[Class]] = defaultdict(list)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in sorted(set(self.k)):
            own = sorted((i for i in range(len(self.ids)) if self.k[i] == k), key=lambda i: -self.size[i])
            while own:
                width = self.size[own[0]]
                members = [i for i in own if self.size[i] >= CLASS * width]
                own = own[len(members) :]
                prints = np.concatenate([window_prints(planes(mix(self.grams[i]), lanes(width)), self.size[i]) for i in members])
                self.classes[k].append(Class(k, width, np.array(members), prints))
            keys = np.unique(np.concatenate([g for g, n in zip(self.grams, self.k, strict=True) if n == k]))
            seen = np.zeros(1 << 20, bool)
            seen[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.known[k] = keys, seen

    def matches(self, data: np.ndarray, offsets: np.ndarray):
        """(row, item, similarity, first term, terms) of each row's best window for each item that it holds."""
        h, at = term_hashes(data, offsets)
        for k, classes in self.classes.items():
            g = grams(h, k)
            size = np.maximum(np.diff(at) - k + 1, 0)
            # rows begin at multiples of the greatest stride and end in padding that counts for neither value of a bit, so no window depends on other rows
            step = max(2, *(c.stride for c in classes))
            room = np.where(size > 0, -(-(size + classes[0].width) // step) * step, 0)
            begin = np.cumsum(room) - room
            total = int(room.sum())
            own, source = ragged(begin, size), ragged(at[:-1], size)
            laid = np.where(np.arange(total) & 1, ~np.uint64(0), np.uint64(0))
            laid[own] = mix(g[source])
            keys, seen = self.known[k]
            maybe = np.flatnonzero(seen[(g[source] & np.uint64((1 << 20) - 1)).astype(np.int64)])
            exact = g[source[maybe]]
            hit = np.zeros(total + 1, np.int32)
            hit[own[maybe[keys[np.minimum(np.searchsorted(keys, exact), len(keys) - 1)] == exact]] + 1] = 1
            hits = np.cumsum(hit)
            sums: dict[int, np.ndarray] = {}
            found = defaultdict(list)
            for c in classes:
                lane = lanes(c.width)
                if lane not in sums:
                    sums[lane] = planes(laid, lane)
                window, item = c.probe(window_prints(sums[lane], c.width, c.stride))
                window, item = window * c.stride, c.items[item]
                enough = hits[np.minimum(window + c.width + c.stride, total)] - hits[np.maximum(window - c.stride, 0)] >= self.need[item]
                window, item = window[enough], item[enough]
                row = np.searchsorted(begin + room, window, "right")
                for r, i, w in zip(row.tolist(), item.tolist(), (window - begin[row]).tolist(), strict=True):
                    found[r, i].append((w - c.stride, w + c.stride + c.width - self.size[i]))
            for (r, i), ranges in sorted(found.items()):
                best = self.best(i, g[at[r] : at[r] + size[r]], ranges)
                if best:
                    yield r, i, best[0], best[1], self.size[i] + k - 1

    def best(self, i: int, g: np.ndarray, ranges: list[tuple[int, int]]) -> tuple[float, int] | None:
        """Similarity and place of the most similar window that begins in one of the ranges, if it is enough; a document shorter than the item is one window."""
        m, last, found = self.size[i], max(0, len(g) - self.size[i]), None
        for s in sorted({min(max(x, 0), last) for a, b in ranges for x in range(a, b + 1)}):
            window = Counter(g[s : s + m].tolist())
            both = sum(min(n, self.counts[i][x]) for x, n in window.items() if x in self.counts[i])
            value = both / (len(g[s : s + m]) + m - both)
            if value >= self.least and (found is None or value > found[0]):
                found = value, s
        return found


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, first_term, n_terms) of each document and item of which a window is similar enough: the most similar one, the first of such.

    A document shorter than an item is one window. Null and empty texts and items match nothing. An item of fewer than five terms is one shingle. Repeated
    rows of docs give repeated results; repeated items too; null ids pass through. Other columns are not read.
    """
    items = [(r[0], r[1], len(r[1])) for r in benchmark.select("item_id", "text").where("text is not null and text <> ''").toLocalIterator()]
    items.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    blocks, size = [[]], 0
    for item, said, n in items:
        if blocks[-1] and (size + n > BLOCK_BYTES or len(blocks[-1]) >= BLOCK_ITEMS):
            blocks.append([])
            size = 0
        blocks[-1].append((item, said))
        size += n
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", F.col(f"`{text}`").alias("text"))
    out = None
    for block in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            import pyarrow as pa

            found = Items(shared.value, least)
            for part in slices(batches, "text", SLICE):
                rows = list(found.matches(*buffers(part.column("text"))))
                take = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), pa.array([found.ids[r[1]] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())], names=["doc_id", "item_id", "similarity", "first_term", "n_terms"])

        made = own.mapInArrow(run, f"doc_id {kind}, item_id bigint, similarity double, first_term bigint, n_terms bigint")
        out = made if out is None else out.unionByName(made)
    return out
