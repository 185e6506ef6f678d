"""Diversification of candidate pools, and how diverse a list is.

Greedy orders and determinantal samples are sequential, so each source's pool is worked on by a NumPy kernel
in applyInPandas; pools are bounded by the candidate depth (200), which MOST_POOL enforces.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datagauge.functions.scalars import dot, jaccard, unit

MOST_POOL = 5_000


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1))
    if not np.isfinite(x).all() or (n <= 0).any():
        raise ValueError("vectors need a finite positive norm")
    return x / n[:, None]


def similarities(x: np.ndarray) -> np.ndarray:
    u = unit_rows(x)
    return np.round(np.clip((1 + u @ u.T) / 2, 0, 1), 12)


def first_best(score: np.ndarray, taken: np.ndarray) -> int:
    """The place of the largest score among those not taken; ties go to the first, and places are in order of id."""
    return int(np.where(taken, -np.inf, np.round(score, 12)).argmax())


def greedy(n: int, k: int, gain) -> list[int]:
    out, taken = [], np.zeros(n, bool)
    for _ in range(min(k, n)):
        i = first_best(gain(out), taken)
        taken[i] = True
        out.append(i)
    return out


def mmr(quality: np.ndarray, similarity: np.ndarray, k: int, trade: float) -> list[int]:
    """trade * quality - (1 - trade) * the largest similarity to what is chosen."""
    near = np.zeros(len(quality))

    def gain(chosen):
        nonlocal near
        if chosen:
            near = np.maximum(near, similarity[:, chosen[-1]]) if len(chosen) > 1 else similarity[:, chosen[-1]].copy()
        return trade * quality - (1 - trade) * near

    return greedy(len(quality), k, gain)


def facility_location(similarity: np.ndarray, k: int) -> list[int]:
    """Each step adds most to the sum over the pool of the largest similarity to what is chosen."""
    best = np.zeros(len(similarity))

    def gain(chosen):
        nonlocal best
        if chosen:
            best = np.maximum(best, similarity[:, chosen[-1]])
        return np.maximum(similarity - best[:, None], 0).sum(0)

    return greedy(len(similarity), k, gain)


def farthest(distance: np.ndarray, k: int, start: int) -> list[int]:
    """From a start, each step takes the place farthest from all chosen."""

    def gain(chosen):
        return -np.abs(np.arange(len(distance)) - start).astype(float) if not chosen else distance[:, chosen].min(1)

    return greedy(len(distance), k, gain)


def determinantal_kernel(quality: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of the kernel of rows (1 + quality) * unit vector; clearly negative ones raise, others become 0."""
    b = (1 + quality)[:, None] * unit_rows(x)
    values, vectors = np.linalg.eigh((b @ b.T + (b @ b.T).T) / 2)
    if values.min(initial=0) < -1e-10 * max(1.0, values.max(initial=0)):
        raise ValueError("the kernel isn't positive semidefinite")
    return np.where(values > 1e-10 * max(1.0, values.max(initial=0)), values, 0), vectors


def determinantal_sample(values: np.ndarray, vectors: np.ndarray, k: int, rng: np.random.Generator) -> list[int] | None:
    """An exact sample of k places, by elementary symmetric polynomials; None if the rank is below k."""
    n = len(values)
    if (values > 0).sum() < k:
        return None
    scale = values[values > 0].mean()
    v = values / scale
    e = np.zeros((k + 1, n + 1))
    e[0] = 1
    for i in range(1, k + 1):
        for j in range(1, n + 1):
            e[i, j] = e[i, j - 1] + v[j - 1] * e[i - 1, j - 1]
    chosen, left = [], k
    for j in range(n, 0, -1):
        if not left:
            break
        if rng.random() < v[j - 1] * e[left - 1, j - 1] / e[left, j]:
            chosen.append(j - 1)
            left -= 1
    basis, out = vectors[:, chosen], []
    for _ in range(k):
        p = (basis**2).sum(1)
        p[out] = 0
        i = int(rng.choice(n, p=p / p.sum()))
        out.append(i)
        j = int(np.abs(basis[i]).argmax())
        basis = basis - np.outer(basis[:, j] / basis[i, j], basis[i])
        basis = np.delete(basis, j, 1)
        if basis.shape[1]:
            basis, _ = np.linalg.qr(basis)
    return out


def per_source(pool: DataFrame, source: str, item: str, kernel, schema: str) -> DataFrame:
    """kernel(rows of a source in order of item) for each source; a pool beyond MOST_POOL raises."""

    def run(pdf):
        if len(pdf) > MOST_POOL:
            raise ValueError(f"a pool has {len(pdf)} candidates, more than {MOST_POOL}")
        return kernel(pdf.sort_values(item, kind="stable").reset_index(drop=True))

    return pool.groupBy(source).applyInPandas(run, schema)


def ordered(pool: DataFrame, source: str, item: str, rule: str, k: int = 20, trade: float = 0.5, seed: int = 0) -> DataFrame:
    """(source, item, position) of a pool (source, item, quality, vector) by a rule.

    mmr, facility; farthest (starts at the best quality, Euclidean on unit vectors); farthest_first_id (starts at the least id,
    1 - similarity); kdpp (a determinantal sample in order of quality; sources whose kernel's rank is below k have no row).
    """
    kinds = {f.name: f.dataType.simpleString() for f in pool.schema.fields}

    def kernel(pdf):
        import pandas as pd

        x, q = np.array(pdf["vector"].tolist(), float), pdf["quality"].to_numpy(float)
        if rule == "mmr":
            got = mmr(q, similarities(x), k, trade)
        elif rule == "facility":
            got = facility_location(similarities(x), k)
        elif rule == "farthest":
            u = unit_rows(x)
            got = farthest(np.round(np.sqrt(np.maximum(2 - 2 * u @ u.T, 0)), 12), k, first_best(q, np.zeros(len(q), bool)))
        elif rule == "farthest_first_id":
            got = farthest(1 - similarities(x), k, 0)
        elif rule == "kdpp":
            sample = determinantal_sample(*determinantal_kernel(q, x), k, np.random.default_rng([seed, len(q)]))
            got = [] if sample is None else sorted(sample, key=lambda i: (-q[i], i))
        else:
            raise ValueError(f"no rule {rule}")
        return pd.DataFrame({source: pdf[source].iloc[got].to_numpy(), item: pdf[item].iloc[got].to_numpy(), "position": np.arange(1, len(got) + 1, dtype=np.int32)})

    return per_source(pool, source, item, kernel, f"`{source}` {kinds[source]}, `{item}` {kinds[item]}, position int")


def kernel_audit(pool: DataFrame, source: str, item: str, depths: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """(source, rank, depth, status): APPLICABLE where the kernel's rank reaches the depth, else STRUCTURAL_NA."""
    kind = pool.schema[source].dataType.simpleString()

    def kernel(pdf):
        import pandas as pd

        values, _ = determinantal_kernel(pdf["quality"].to_numpy(float), np.array(pdf["vector"].tolist(), float))
        return pd.DataFrame({source: pdf[source].iloc[:1], "rank": [int((values > 0).sum())]})

    ranks = per_source(pool, source, item, kernel, f"`{source}` {kind}, rank int")
    return ranks.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]))).withColumn("status", F.when(F.col("rank") >= F.col("depth"), "APPLICABLE").otherwise("STRUCTURAL_NA"))


def list_pairs(lists: DataFrame, source: str, position: str, columns: list[str]) -> DataFrame:
    """(source, a_<column>, b_<column>) of unordered pairs within each list."""
    a, b = (lists.select(source, F.col(position).alias(f"_{i}"), *[F.col(c).alias(f"{i}_{c}") for c in columns]) for i in "ab")
    return a.join(b, source).where("_a < _b").drop("_a", "_b")


def diversity(pairs: DataFrame, source: str, distance: Column) -> DataFrame:
    """(source, ild): the mean distance over a list's pairs; lists of one have no row."""
    return pairs.groupBy(source).agg(F.avg(distance).alias("ild"))


def semantic_distance(a: str, b: str) -> Column:
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(unit(F.col(a)), unit(F.col(b)))))


def coordinate_distance(fields: list[str]) -> Column:
    """Mean absolute difference of coordinates; 0 where both are missing, 1 where one is."""
    one = lambda f: F.when(F.col(f"a_{f}").isNull() & F.col(f"b_{f}").isNull(), 0.0).otherwise(F.coalesce(F.abs(F.col(f"a_{f}") - F.col(f"b_{f}")), F.lit(1.0)))
    return sum((one(f) for f in fields), F.lit(0.0)) / len(fields)


def set_distance(fields: list[str]) -> Column:
    """Mean of 1 - Jaccard of sets; two empty sets have distance 0."""
    return sum((1 - jaccard(F.col(f"a_{f}"), F.col(f"b_{f}"), 1.0) for f in fields), F.lit(0.0)) / len(fields)
