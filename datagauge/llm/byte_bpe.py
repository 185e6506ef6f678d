"""Byte-level BPE encoding and decoding on length-bucketed padded matrices.

Distinct pieces of a batch are put in matrices by length. In each round every row
merges its leftmost pair of least rank; pairs are looked up in a hash table held in
arrays, and rows without a pair left are compacted away. A piece wider than the widest matrix is a row of its
own, which is compacted in each round; there a round merges all places of the pair, from the left, up to one that makes
a pair of lower rank, so that rounds are as few as the pairs that differ.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from datagauge.llm.frames import map_text, widened
from datagauge.llm.kernels import Interner, buffers, ragged

NONE = np.int32(2**31 - 1)
KEPT_CHUNKS = 600_000
WIDTHS = (2, 4, 6, 8, 12, 16, 32, 64, 128, 512)
_loaded: dict[str, "Ranks"] = {}
_encoders: dict[tuple[str, str], "Encoder"] = {}
MAYBE_WHITE = np.zeros(256, bool)
MAYBE_WHITE[[*range(9, 14), *range(28, 33)]] = True
TAIL = frozenset(".,:;!?)")
SAFE_SPACE = re.compile(r"(?<!\s) (?!\s)")


class Ranks:
    """A rank file: bytes of each token, and a hash table from adjacent tokens to the merged one."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(left, right, rank) for token, rank in self.ranks.items() for i in range(1, len(token)) if (left := self.ranks.get(token[:i])) is not None and (right := self.ranks.get(token[i:])) is not None]
        left, right, merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.bits = int(4 * len(left)).bit_length()
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        key = left << 32 | right
        slot, rest = self.slot(key), np.arange(len(key))
        while len(rest):
            free = rest[self.keys[slot[rest]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = key[put], merged[put]
            rest = np.setdiff1d(rest, put)
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged tokens of pairs, NONE where there is none or a side is padding (-1)."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        key[(left < 0) | (right < 0)] = -2
        slot = self.slot(key)
        out = np.full(len(key), NONE, np.int32)
        rest = np.flatnonzero(key >= 0)
        while len(rest):
            found = self.keys[slot[rest]]
            hit = found == key[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
        return out

    def merge_matrix(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens (padded with -1) and their numbers of pieces of at most `width` bytes."""
        column = np.arange(width)
        inside = column < lengths[:, None]
        symbols = np.full((len(starts), width), -1, np.int32)
        symbols[inside] = self.single[data[ragged(starts, lengths)]]
        done = symbols.copy()
        row = np.arange(len(starts))
        ranks = np.full((len(starts), max(width - 1, 1)), NONE, np.int32)
        if width > 1:
            ranks = self.lookup(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(starts), width - 1)
        count = lengths.copy()
        while len(row):
            at = ranks.argmin(1)
            here = np.arange(len(row))
            best = ranks[here, at]
            live = best != NONE
            if not live.all():
                done[row[~live]] = symbols[~live]
                row, symbols, ranks, at, best = row[live], symbols[live], ranks[live], at[live], best[live]
                here = np.arange(len(row))
                if not len(row):
                    break
            symbols[here, at] = best
            shift = column[None, :-1] > at[:, None]
            symbols[:, :-1] = np.where(shift, symbols[:, 1:], symbols[:, :-1])
            symbols[:, -1] = -1
            if ranks.shape[1] > 1:
                ranks[:, :-1] = np.where(shift[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            count[row] -= 1
            after = np.minimum(at + 1, width - 1)
            ranks[here, at] = np.where(at + 1 < width, self.lookup(symbols[here, at], symbols[here, after]), NONE)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.lookup(symbols[left, at[left] - 1], symbols[left, at[left]])
        return done, count

    def merge_row(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens of one row: what merging its leftmost pair of least rank, again and again, leaves."""
        ranks = np.append(self.lookup(symbols[:-1], symbols[1:]), NONE)
        while len(symbols) > 1 and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            new = np.concatenate([[True], np.diff(at) > 1])
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(new, place, 0))) % 2 == 0]  # of places that overlap, every second
            before = np.where(np.concatenate([[False], np.diff(at) == 2]), best, np.where(at > 0, symbols[at - 1], -1))
            after = np.where(at + 2 < len(symbols), symbols[np.minimum(at + 2, len(symbols) - 1)], -1)
            merged = np.full(len(at), best)
            low = np.flatnonzero(np.minimum(self.lookup(before, merged), self.lookup(merged, after)) < best)
            if len(low):
                at = at[: low[0] + 1]
            symbols[at] = best
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, ranks = symbols[stay], ranks[stay]
            at = at - np.arange(len(at))
            at = np.unique(np.concatenate([at, at[at > 0] - 1]))
            at = at[at + 1 < len(symbols)]
            ranks[at] = self.lookup(symbols[at], symbols[at + 1])
            ranks[-1] = NONE
        return symbols

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces, one after another, and their number in each."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        data = np.frombuffer(b"".join(pieces), np.uint8)
        counts = np.zeros(len(pieces), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for width in WIDTHS:
            own = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for part in np.array_split(own, max(1, len(own) * width // 2_000_000)) if len(own) else ():
                tokens, n = self.merge_matrix(data, starts[part], lengths[part], width)
                counts[part] = n
                parts.append((part, tokens[tokens >= 0]))
        for i in np.flatnonzero(lengths > low):
            tokens = self.merge_row(self.single[data[starts[i] : starts[i] + lengths[i]]])
            counts[i] = len(tokens)
            parts.append((np.array([i]), tokens))
        at = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(at[-1], np.int32)
        for part, tokens in parts:
            out[ragged(at[part], counts[part])] = tokens
        return out, counts


def load_ranks(path: str) -> Ranks:
    if path not in _loaded:
        _loaded[path] = Ranks(path)
    return _loaded[path]


def loose(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows may have a space at an end or beside other white space; all that do are among them."""
    at = np.flatnonzero(data == 32)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    padded = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(1, np.uint8)])
    before, after = padded[at + 2], padded[at + 4]
    odd = MAYBE_WHITE[before] | MAYBE_WHITE[after] | edge[at] | edge[at + 1]
    odd |= (after == 0xC2) | (after >= 0xE1) & (after <= 0xE3)  # these begin other white space
    odd |= (padded[at + 1] == 0xC2) & ((before == 0x85) | (before == 0xA0)) | (padded[at] >= 0xE1) & (padded[at] <= 0xE3) & (before >= 0x80)
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, at[odd], "right") - 1] = True
    return out


def chunks_of(text: str, loosely: bool) -> list:
    """Parts of a text whose pieces don't depend on each other: cut before each lone space between other characters.

    All but the first stand for a space and what follows; the first is wrapped in a tuple. Unless `loosely`, every space is a lone one.
    """
    if not text:
        return []
    parts: list = SAFE_SPACE.split(text) if loosely else text.split(" ")
    parts[0] = (parts[0],)
    return parts


class Encoder:
    """Encodes texts of a batch; tokens of chunks seen before are kept, to a bound, and between tasks of a worker (see encoder())."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks, self.split = load_ranks(path), regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.known, self.tokens = Interner(), np.zeros(0, np.int32)
        self.counts, self.used = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def codes(self, texts) -> tuple[np.ndarray, np.ndarray]:
        out, ends = [], [0]
        for text, loosely in zip(texts.to_pylist(), loose(*buffers(texts)).tolist(), strict=True):
            out.extend(map(self.known.__getitem__, chunks_of(text or "", loosely)))
            ends.append(len(out))
        return np.array(out, np.int64), np.array(ends)

    def learn(self) -> None:
        pieces, of = Interner(), []  # of: pieces in each chunk
        flat: list[int] = []
        for chunk in self.known.fresh:
            if isinstance(chunk, tuple):
                found = self.split(chunk[0])
            elif chunk.isalpha():  # str.isalpha() is \\p{L}+
                flat.append(pieces[" " + chunk])
                of.append(1)
                continue
            elif chunk[-1:] in TAIL and chunk[:-1].isalpha():
                flat += (pieces[" " + chunk[:-1]], pieces[chunk[-1]])
                of.append(2)
                continue
            else:
                found = self.split(" " + chunk)
            flat += map(pieces.__getitem__, found)
            of.append(len(found))
        self.known.fresh.clear()
        if of:
            ids, n = self.ranks.encode_pieces([p.encode() for p in pieces])
            starts = np.concatenate([[0], np.cumsum(n)])[:-1]
            codes = np.array(flat, np.int64)
            ends = np.concatenate([[0], np.cumsum(n[codes])])[np.cumsum([0, *of])]
            self.tokens = np.concatenate([self.tokens, ids[ragged(starts[codes], n[codes])]])
            self.counts = np.concatenate([self.counts, np.diff(ends)])

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts of an Arrow array, and where each text's begin (one value more than texts)."""
        codes, ends = self.codes(texts)
        self.learn()
        starts = np.cumsum(self.counts) - self.counts
        n = self.counts[codes]
        at = np.concatenate([[0], np.cumsum(n)])[ends]
        out = self.tokens[ragged(starts[codes], n)]
        self.used = np.concatenate([self.used, np.zeros(len(self.known) - len(self.used), np.int32)])
        self.used += np.bincount(codes, minlength=len(self.used)).astype(np.int32)
        if len(self.known) > KEPT_CHUNKS:
            self.forget()
        return out, at

    def forget(self) -> None:
        """Keep chunks seen more than once, or nothing if those are most."""
        stay = np.flatnonzero(self.used > 1)
        if len(stay) > KEPT_CHUNKS // 2:
            return self.clear()
        names = list(self.known)
        starts, n = np.cumsum(self.counts) - self.counts, self.counts
        tokens = self.tokens[ragged(starts[stay], n[stay])]
        self.clear()
        for i in stay.tolist():
            self.known[names[i]]
        self.known.fresh.clear()
        self.tokens, self.counts, self.used = tokens, n[stay], np.zeros(len(stay), np.int32)


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def decode(ranks: Ranks, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of identifiers, and where each row's begin."""
    n = ranks.lengths[ids]
    return ranks.bytes[ragged(ranks.starts[ids], n)], np.concatenate([[0], np.cumsum(n)])[at]


def decimal_digests(ids: np.ndarray, at: np.ndarray, names: list[str]) -> list[str]:
    said = list(map(names.__getitem__, ids.tolist()))
    return [hashlib.sha256(",".join(said[a:b]).encode()).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


KINDS = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", output: tuple[str, ...] = ("n_tokens", "ids"), keep: list[str] | None = None) -> DataFrame:
    """Append what `output` names of: n_tokens, ids, decoded (bytes of the ids), ids_sha256 (of decimal ids joined by
    commas), decoded_sha256.

    Null and empty texts have no ids. Rows are worked on one by one, so repeated rows and null ids keep theirs;
    columns of `df` named like the new ones are replaced. One pass, nothing is shuffled.
    """

    def make():
        import pyarrow as pa

        from datagauge.llm.kernels import sha256_rows

        own = encoder(ranks_path, pattern)
        names = [str(i) for i in range(len(own.ranks.lengths))]

        def work(batch):
            ids, at = own(batch.column(text))
            raw, raw_at = decode(own.ranks, ids, at) if {"decoded", "decoded_sha256"} & {*output} else (None, None)
            made = {
                "n_tokens": lambda: pa.array(np.diff(at)),
                "ids": lambda: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)),
                "decoded": lambda: pa.array([raw[a:b].tobytes() for a, b in zip(raw_at[:-1], raw_at[1:], strict=True)], pa.binary()),
                "ids_sha256": lambda: pa.array(decimal_digests(ids, at, names)),
                "decoded_sha256": lambda: pa.array(sha256_rows(raw, raw_at)),
            }
            return [made[name]() for name in output]

        return work

    return map_text(df, text, [(name, KINDS[name]) for name in output], make, keep)


def decode_ids(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append the bytes that a column of ids stands for; null ids give no bytes. Ids outside the vocabulary raise."""
    kept = [c for c in df.columns if c != out]
    schema = widened([df.schema[c] for c in kept], [(out, "binary")])

    def run(batches):
        import pyarrow as pa

        ranks = load_ranks(ranks_path)
        for batch in batches:
            lists = [np.asarray(x or [], np.int64) for x in batch.column(ids).to_pylist()]
            if any(len(x) and (x.min() < 0 or x.max() >= len(ranks.lengths)) for x in lists):
                raise ValueError("an id is outside the vocabulary")
            data = [ranks.bytes[ragged(ranks.starts[x], ranks.lengths[x])].tobytes() for x in lists]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(data, pa.binary())], names=[*kept, out])

    return df.mapInArrow(run, schema)
