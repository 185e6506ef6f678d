"""Vectorised byte kernels shared by the text operators.

All work on the Arrow buffers of a text column: one uint8 array with offsets,
so no Python string is made. Hashes are polynomial over a table of random
64-bit values, modulo 2**64, finished by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000
#: For kernels that hold a hundred bytes of working space for each byte of text.
LEAN_BYTES = 250_000
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n; kept between calls, grown when a longer text comes."""
    if "up" not in _powers or len(_powers["up"]) < n:
        m = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def given_back(parts):
    """The same parts; at their end a worker, which lives on, gives memory that it no longer uses back to the system."""
    import ctypes

    try:
        yield from parts
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in GNU's C library
        if trim:
            trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the named text column has about `most` bytes; a longer single text stays whole."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    kind = np.int64 if wide else np.int32
    _, off, data = column.buffers()
    if off is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, kind, count=n + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with hash(data[a:b]) = (P[b] - P[a]) * BASE**-a."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * up, dtype=np.uint64, out=out[1:])
    return out


def span_hash(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _, down = powers(len(p))
    return mix((p[b] - p[a]) * down[a] + (b - a).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words between ASCII white space, and for each row the number of words before it."""
    inside = ~WHITE[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, stop = inside.copy(), inside.copy()
    if n:
        start[1:] &= ~inside[:-1] | edge[1:n]
        stop[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k lower-cased words; a row of fewer words, if it has any, gives one for the whole sequence.

    Returns the hashes in order and for each row the number before it (len(offsets) values).
    """
    data = LOWER[data]
    starts, ends, at = words(data, offsets)
    h = span_hash(prefix_hash(data), starts, ends)
    n = np.diff(at)
    m = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_at = np.concatenate([[0], np.cumsum(m)])
    out = np.zeros(out_at[-1], np.uint64)
    salts = mix(np.arange(1, k + 2, dtype=np.uint64))
    full = np.repeat(n >= k, m)
    first = np.repeat(at[:-1] - out_at[:-1], m) + np.arange(out_at[-1])
    i = first[full]
    total = np.zeros(len(i), np.uint64)
    for j in range(k):
        total += mix(h[i + j] + salts[j]) * salts[j + 1]
    out[full] = mix(total + np.uint64(k))
    for row in np.flatnonzero((n > 0) & (n < k)):
        s = np.uint64(0)
        with np.errstate(over="ignore"):
            for j in range(n[row]):
                s += mix(h[at[row] + j : at[row] + j + 1] + salts[j])[0] * salts[j + 1]
            out[out_at[row]] = mix(np.array([s + np.uint64(n[row])], np.uint64))[0]
    return out, out_at


def sha256_rows(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    import hashlib

    view = memoryview(np.ascontiguousarray(data))
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1 of all i, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Interner(dict):
    """Numbers strings in order of first sight; `fresh` lists those not yet worked on."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []

    def __missing__(self, key):
        n = self[key] = len(self)
        self.fresh.append(key)
        return n
