"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The features approximate a Gaussian kernel. Ridge is fitted from normal equations that
partitions sum for themselves; scores become probabilities by pool-adjacent-violators
on training rows that the ridge hasn't seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datagauge.llm.frames import map_text
from datagauge.llm.kernels import LEAN_BYTES, LOWER, buffers, prefix_hash, span_hash, words
from datagauge.llm.labelled import held_out, training_rows

#: Classes of bytes whose shares of a document are statistics.
CLASSES = ("upper", "lower", "digit", "space", "newline", "bar", "shout", "symbol", "stop", "other", "wide", "control")
CLASS_OF = np.full(256, CLASSES.index("other"), np.int64)
for _name, _bytes in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", b" \t"), ("newline", b"\n\r"), ("bar", b"|"), ("shout", b"!"), ("symbol", b"#$%&*+<=>@^_~/\\{}"), ("stop", b".,;:?"), ("wide", range(128, 256)), ("control", [*range(9), 11, 12, *range(14, 32), 127])):
    CLASS_OF[list(_bytes)] = CLASSES.index(_name)
STATISTICS = len(CLASSES) + 10
PARTS = 8


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics of each document; an empty one has zeros."""
    n, k = len(offsets) - 1, len(CLASSES)
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    share = np.bincount(row * k + CLASS_OF[data], minlength=n * k).reshape(n, k) / np.maximum(size, 1)[:, None]
    starts, ends, at = words(data, offsets)
    count = np.diff(at)
    of = np.repeat(np.arange(n), count)
    some = np.maximum(count, 1)
    length = ends - starts
    h = span_hash(prefix_hash(LOWER[data]), starts, ends) >> np.uint64(32)
    key = np.sort((of.astype(np.uint64) << np.uint64(32)) | h)
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    run = np.diff(np.append(np.flatnonzero(first), len(key)))
    own = (key[first] >> np.uint64(32)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, own, run)
    upper = np.concatenate([[0], np.cumsum((CLASS_OF[data] == 0))])
    capitals = np.bincount(of, weights=(upper[ends] - upper[starts]) * 2 > length, minlength=n)
    mean = np.bincount(of, weights=length, minlength=n) / some
    square = np.bincount(of, weights=length.astype(float) ** 2, minlength=n) / some
    breaks = np.flatnonzero(data == 10)
    line_at = np.unique(np.concatenate([offsets[:-1][size > 0], breaks + 1]))
    line_at = line_at[line_at < len(data)]
    line_end = np.append(line_at[1:], len(data))
    line_of = np.searchsorted(offsets, line_at, "right") - 1
    lines = np.bincount(line_of, minlength=n)
    line_key = np.unique((line_of.astype(np.uint64) << np.uint64(32)) | (span_hash(prefix_hash(data), line_at, line_end) >> np.uint64(32)))
    distinct_lines = np.bincount((line_key >> np.uint64(32)).astype(np.int64), minlength=n)
    extra = [np.log1p(size), np.log1p(count), mean, np.sqrt(np.maximum(square - mean**2, 0)), np.bincount(own, minlength=n) / some, top / some, capitals / some, np.log1p(lines), distinct_lines / np.maximum(lines, 1), np.log1p(count / np.maximum(lines, 1))]
    return np.column_stack([np.sqrt(share), *extra])


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.column_stack([np.ones(len(z)), np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.weights, self.knots, self.values)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots at the mean scores of blocks, with values pulled in from 0 and 1."""
    if not len(score):
        return np.zeros(1), np.full(1, 0.5)
    blocks: list[list[float]] = []
    for s, t in sorted(zip(score.tolist(), y.tolist(), strict=True)):
        blocks.append([t, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            t1, n1, s1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t1, blocks[-1][1] + n1, blocks[-1][2] + s1]
    total = np.array(blocks)
    return total[:, 2] / total[:, 1], (total[:, 0] + 0.02) / (total[:, 1] + 0.04)


def sums(rows: DataFrame, work, width: int) -> np.ndarray:
    """The sum over PARTS partitions at most of what work makes of each: the driver holds two sums at a time, however the sample was dealt."""

    def run(batches):
        import pandas as pd

        total = np.zeros(width)
        for b in batches:
            total += work(np.stack(b["x"].to_numpy()), b["y"].to_numpy()) if len(b) else 0
        yield pd.DataFrame({"total": [total.tobytes()]})

    parts = rows.coalesce(PARTS).mapInPandas(run, "total binary")
    return sum((np.frombuffer(r.total) for r in parts.toLocalIterator()), np.zeros(width))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 20_000, dimensions: int = 256, ridge: float = 1e-2, width: float = 8.0, text: str = "text") -> Model:
    """Learn from at most `most` labelled rows outside the held-out fold, chosen by hash of their ids.

    Without labelled rows every score is 0.5.
    """
    sample = map_text(training_rows(docs, labels, label, most, text), "text", [("x", "array<double>")], lambda: vectors("text"), ["doc_id", "y"], LEAN_BYTES)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    rows = sample.select("x", "y", fold.alias("calibrates")).repartition(PARTS, "doc_id").cache()
    try:
        d = STATISTICS
        moments = sums(rows, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)]), 2 * d + 1)
        n = max(moments[0], 1)
        centre = moments[1 : d + 1] / n
        scale = np.sqrt(np.maximum(moments[d + 1 :] / n - centre**2, 0))
        rng = np.random.default_rng(9)
        model = Model(centre, np.where(scale > 1e-9, scale, 1.0), rng.normal(size=(d, dimensions)) / width, rng.uniform(0, 2 * np.pi, dimensions), np.zeros(dimensions + 1), np.zeros(1), np.full(1, 0.5))
        m = dimensions + 1

        def normal(x, y):
            z = model.features(x)
            return np.concatenate([(z.T @ z).ravel(), z.T @ y])

        total = sums(rows.where(~F.col("calibrates")), normal, m * m + m)
        penalty = ridge * max(total[0], 1) / m * np.eye(m)
        penalty[0, 0] = 1e-9
        model.weights = np.linalg.solve(total[: m * m].reshape(m, m) + penalty, total[m * m :])
        unseen = rows.where("calibrates").collect()
        if not unseen:  # few rows: calibrate on what there is
            unseen = rows.collect()
        if unseen:
            z = model.features(np.array([r.x for r in unseen])) @ model.weights
            model.knots, model.values = isotonic(z, np.array([r.y for r in unseen]))
        return model
    finally:
        rows.unpersist()


def vectors(column: str):
    def work(batch):
        import pyarrow as pa

        x = statistics(*buffers(batch.column(column)))
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * STATISTICS), pa.array(x.ravel()))]

    return work


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append score (0 to 1) and predicted (1 if score >= threshold, else 0) to every row.

    Only the text is looked at. Null and empty texts have the statistics 0 and are scored too;
    scores are rounded to nine digits, so repeated rows get the same; columns of `docs` named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        import pyarrow as pa

        return lambda batch: [pa.array(np.round(np.clip(shared.value.score(statistics(*buffers(batch.column(text)))), 0, 1), 9))]

    out = map_text(docs, text, [("score", "double")], make, keep, LEAN_BYTES)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """held_out, score and predicted of every row of docs by a model learned from its labelled rows."""
    return score(docs, fit(docs, labels), threshold, keep=keep).withColumn("held_out", held_out())
