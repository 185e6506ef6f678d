"""Toxicity: a factorization machine over hashed terms.

A score is the logistic of b + sum w_i + sum over pairs <v_i, v_j> of the distinct terms
of a text, so that a pair of terms can count for more than its parts. Terms are runs of
letters and digits in lower case, and the first bytes of longer ones, hashed to BUCKETS.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datagauge.llm.frames import map_text
from datagauge.llm.kernels import LOWER, buffers, mix, prefix_hash, ragged, span_hash
from datagauge.llm.labelled import held_out, training_rows

BITS = 18
BUCKETS = 1 << BITS
#: Bytes of the beginnings that longer terms have as terms too.
STEMS = (4, 6)
#: How strongly training holds back: standard errors that a term's own share of label 1 must be from the mean to be looked at (0: no such
#: gate, so that terms can count in pairs only), and the penalty of weights and factors. The strength is chosen on rows kept back.
STRENGTHS = ({"deviation": 4.0, "l2": 1e-4}, {"deviation": 4.0, "l2": 2e-3}, {"deviation": 0.0, "l2": 2e-3, "epochs": 30})
#: Strengths are compared on so many terms of rows at most.
COMPARED = 600_000
TERM = np.zeros(256, bool)
TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of all rows, row by row, and where each row's begin."""
    low = LOWER[data]
    if len(data) > 1:  # capitals of Latin-1
        low[1:] = np.where((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E), data[1:] + 0x20, low[1:])
    inside = TERM[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, stop = inside.copy(), inside.copy()
    if n:
        start[1:] &= ~inside[:-1] | edge[1:n]
        stop[:-1] &= ~inside[1:] | edge[1:n]
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    p = prefix_hash(low)
    at, hashes = [a], [span_hash(p, a, b)]
    for k in STEMS:
        longer = a[b - a > k]
        at.append(longer)
        hashes.append(mix(span_hash(p, longer, longer + k) + np.uint64(k)))
    h = np.concatenate(hashes) >> np.uint64(64 - BITS)
    row = np.searchsorted(offsets, np.concatenate(at), "right") - 1
    key = np.unique((row.astype(np.int64) << BITS) | h.astype(np.int64))
    return (key & (BUCKETS - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(len(offsets)))


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        first = np.concatenate([[0.0], np.cumsum(self.weights[ids], dtype=np.float64)])
        out = self.bias + first[at[1:]] - first[at[:-1]]
        for k in range(self.factors.shape[1]):
            v = self.factors[ids, k].astype(np.float64)
            s, q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (v, v * v))
            out += 0.5 * ((s[at[1:]] - s[at[:-1]]) ** 2 - (q[at[1:]] - q[at[:-1]]))
        return out

    def score(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(ids, at), -30, 30)))


def chosen(ids: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms of some rows, and where each row's begin."""
    n = at[rows + 1] - at[rows]
    return ids[ragged(at[rows], n)], np.concatenate([[0], np.cumsum(n)])


def fitted(ids: np.ndarray, at: np.ndarray, y: np.ndarray, **options) -> Machine:
    """A machine of the strength that has the least log loss on every fifth row, when it learns from the others; then learned from all rows."""
    few = np.arange(int(np.searchsorted(at, COMPARED, "right")) - 1)
    few = few if len(few) < len(y) else np.arange(len(y))
    back = few % 5 == 0
    losses = []
    for strength in STRENGTHS if len(set(y[few[~back]].tolist())) > 1 and back.any() else STRENGTHS[:1]:
        if len(few) == 0:
            break
        machine = train(*chosen(ids, at, few[~back]), y[few[~back]], **(options | strength))
        p = np.clip(machine.score(*chosen(ids, at, few[back])), 1e-6, 1 - 1e-6)
        losses.append(-np.mean(np.where(y[few[back]] > 0.5, np.log(p), np.log(1 - p))))
    return train(ids, at, y, **(options | STRENGTHS[int(np.argmin(losses)) if losses else 0]))


def train(ids: np.ndarray, at: np.ndarray, y: np.ndarray, factors: int = 4, epochs: int = 80, rate: float = 0.5, l2: float = 1e-4, least: int = 3, deviation: float = 4.0) -> Machine:
    """Adagrad on mini-batches, in an order that doesn't depend on the run.

    Terms of fewer than `least` rows, and those whose share of label 1 is within `deviation` standard
    errors of the mean, stay at 0: labels are noisy, and rare terms would learn the noise.
    """
    rng = np.random.default_rng(5)
    n = len(y)
    count = np.bincount(ids, minlength=BUCKETS)
    mean = y.mean() if n else 0.5
    ones = np.bincount(ids, weights=np.repeat(y, np.diff(at)), minlength=BUCKETS)
    error = np.abs(ones - count * mean) / np.sqrt(np.maximum(count * mean * (1 - mean), 1e-9))
    known = (count >= least) & (error >= deviation)
    used = known[ids]
    at = np.concatenate([[0], np.cumsum(used)])[at]
    ids = ids[used]
    prior = (y.sum() + 0.5) / (n + 1)
    machine = Machine(float(np.log(prior / (1 - prior))), np.zeros(BUCKETS), np.where(known[:, None], rng.normal(0, 0.01, (BUCKETS, factors)), 0.0))
    slot = np.zeros(BUCKETS, np.int64)
    seen_w, seen_v = np.full(BUCKETS, 1e-2), np.full((BUCKETS, factors), 1e-2)
    for _ in range(epochs if n else 0):
        order = rng.permutation(n)
        for rows in np.array_split(order, max(1, n // 256)):
            count = at[rows + 1] - at[rows]
            own = np.repeat(at[rows] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            terms_ = ids[own]
            ends = np.concatenate([[0], np.cumsum(count)])
            wrong = machine.score(terms_, ends) - y[rows]
            active = np.unique(terms_)
            slot[active] = np.arange(len(active))
            code, each = slot[terms_], np.repeat(np.arange(len(rows)), count)
            g = np.bincount(code, weights=wrong[each], minlength=len(active)) / len(rows) + l2 * machine.weights[active] * 0.1
            seen_w[active] += g * g
            for k in range(factors):
                v = machine.factors[terms_, k]
                s = np.bincount(each, weights=v, minlength=len(rows))
                h = np.bincount(code, weights=wrong[each] * (s[each] - v), minlength=len(active)) / len(rows) + l2 * machine.factors[active, k]
                seen_v[active, k] += h * h
                machine.factors[active, k] -= 0.3 * rate * h / np.sqrt(seen_v[active, k])
            machine.weights[active] -= rate * g / np.sqrt(seen_w[active])
            machine.bias -= 0.05 * wrong.mean()
    return Machine(machine.bias, machine.weights.astype(np.float32), machine.factors.astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 20_000, text: str = "text", **options) -> Machine:
    """Learn from at most `most` labelled rows outside the held-out fold; the driver gets their hashed terms, no texts."""

    def make():
        import pyarrow as pa

        def work(batch):
            ids, at = terms(*buffers(batch.column("text")))
            return [pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(ids.astype("<i4"))])]

        return work

    sample = map_text(training_rows(docs, labels, label, most, text), "text", [("terms", "binary")], make, ["doc_id", "y"])
    rows = sorted((zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.y, bytes(r.terms)) for r in sample.collect())  # in an order that has nothing to do with the text
    size = np.array([len(r[3]) // 4 for r in rows], np.int64)
    ids = np.frombuffer(b"".join(r[3] for r in rows), "<i4").astype(np.int64)
    return fitted(ids, np.concatenate([[0], np.cumsum(size)]), np.array([r[2] for r in rows], float), **options)


def score(docs: DataFrame, machine: Machine, threshold: float = 0.5, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append score (0 to 1) and predicted (1 if score >= threshold, else 0) to every row.

    Only the text is looked at, the whole of it. Null and empty texts have no terms and get the score of the
    bias; scores are rounded to nine digits, so repeated rows get the same; columns of `docs` named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        import pyarrow as pa

        return lambda batch: [pa.array(np.round(shared.value.score(*terms(*buffers(batch.column(text)))), 9))]

    out = map_text(docs, text, [("score", "double")], make, keep)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """held_out, score and predicted of every row of docs by a machine learned from its labelled rows."""
    return score(docs, fit(docs, labels), threshold, keep=keep).withColumn("held_out", held_out())
