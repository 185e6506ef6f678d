"""All pairs of two sets of vectors by matrix products of blocks: best documents and best token products."""

from __future__ import annotations

import hashlib
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datagauge.operators.contracts import require, small

#: Vectors of a block of queries and of documents.
ASKED, HELD = 1024, 2048
#: Blocks of queries that are sent to all tasks, at most; more are joined by a product of partitions.
MOST_BLOCKS = 200
#: Numbers of results that a task holds before it hands them on.
MOST_HELD = 4_000_000


def vector_blocks(rows: DataFrame, keys: list[str], vector: str, most: int) -> DataFrame:
    """(length, n, <keys> as arrays, data): up to `most` vectors of one length, as bytes of doubles; length -1 for those that are null."""
    types = dict(rows.dtypes)
    schema = "length int, n int, " + ", ".join(f"`{k}` array<{types[k]}>" for k in keys) + ", data binary"

    def pack(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        waiting: dict[int, list] = {}

        def block(length, parts):
            held = pa.concat_tables(parts)
            values = held.column("_v").combine_chunks()
            flat = values.flatten().to_numpy(zero_copy_only=False) if length > 0 else np.zeros(0)
            keys_ = [pa.array([held.column(k).to_pylist()], pa.list_(held.schema.field(k).type)) for k in keys]
            return pa.RecordBatch.from_arrays([pa.array([length], pa.int32()), pa.array([held.num_rows], pa.int32()), *keys_, pa.array([np.ascontiguousarray(flat, np.float64).tobytes()], pa.binary())], ["length", "n", *keys, "data"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes = pc.fill_null(pc.list_value_length(table.column("_v")), -1).to_numpy()
            for length in np.unique(sizes):
                part = table.filter(pa.array(sizes == length))
                while part.num_rows:
                    own = waiting.setdefault(int(length), [])
                    room = most - sum(p.num_rows for p in own)
                    own.append(part.slice(0, room))
                    part = part.slice(room)
                    if sum(p.num_rows for p in own) == most:
                        yield block(int(length), waiting.pop(int(length)))
        for length, parts in waiting.items():
            yield block(length, parts)

    return rows.select(*keys, F.col(vector).alias("_v")).mapInArrow(pack, schema)


def block_pairs(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """All pairs of blocks; those of queries are sent to all tasks if they are few."""
    return docs.crossJoin(small(queries, MOST_BLOCKS))


def spread(rows: DataFrame, *by: str) -> DataFrame:
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism * 2, *by)


def matrix(data, n: int, length: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(n, -1) if length > 0 else np.zeros((n, 0))


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as Spark's round() does: the shortest decimal form, halves away from zero."""
    scaled = np.abs(x) * 10.0**digits
    out = np.copysign(np.floor(scaled + 0.5), x) / 10.0**digits
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out + 0.0


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows of a and b, summed from left to right as dot() does."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def merged(k: int, held: tuple, new: tuple) -> tuple:
    """The k best of each query by score downwards, then id, of two lists of (query, id, score)."""
    q, i, s = (np.concatenate(x) for x in zip(held, new, strict=True))
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    place = np.arange(len(q)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return q[place < k], i[place < k], s[place < k]


def improved(k: int, digits: int, held: tuple, asked: np.ndarray, a: np.ndarray | None, ids: np.ndarray, b: np.ndarray | None) -> tuple:
    """The k best of each query after a block of documents, an id equal to the query's left out; without vectors all scores are -inf, which stands for null."""
    order = np.argsort(ids, kind="stable")
    low, high = np.searchsorted(ids[order], asked, "left"), np.searchsorted(ids[order], asked, "right")
    if a is None:
        for j in range(len(asked)):
            own = np.r_[order[: low[j]][:k], order[high[j] :][:k]][:k]
            held = merged(k, held, (np.full(len(own), j), ids[own], np.full(len(own), -np.inf)))
        return held
    scores = a @ b.T
    for j in np.flatnonzero(high > low):
        scores[j, order[low[j] : high[j]]] = -np.inf
    full = np.bincount(held[0], minlength=len(asked)) >= k
    worst = np.full(len(asked), np.inf)
    np.minimum.at(worst, held[0], held[2])
    bar = np.where(full, worst, -np.inf)
    if not full.all() and len(ids) > k:
        bar[~full] = np.maximum(bar[~full], np.partition(scores[~full], len(ids) - k, axis=1)[:, len(ids) - k])
    # products of blocks are summed in another order, so whatever may round to the bar is worked out anew
    bar = np.where(np.isfinite(bar), bar - 2 * 10.0**-digits, np.finfo(float).min)
    waiting, n = [held], 0
    for start in range(0, len(asked), 64):
        q, d = np.nonzero(scores[start : start + 64] >= bar[start : start + 64, None])
        q += start
        waiting.append((q, ids[d], half_up(in_order(a[q], b[d]), digits)))
        n += len(q)
        if n > 100_000 or start + 64 >= len(asked):
            new = tuple(np.concatenate(x) for x in zip(*waiting[1:], strict=True))
            waiting, n = [merged(k, waiting[0], new)], 0
    return waiting[0]


def dense_topk(queries: DataFrame, docs: DataFrame, query: str, doc: str, qvector: Column, vector: Column, most: int, digits: int = 9) -> DataFrame:
    """(query, doc, score): for each query the `most` documents of the greatest products, rounded, then id, among those of another id.

    Exact: a product of blocks only says which pairs may be among the best, and those are summed anew. Each task hands on its own best.
    """
    whole = {"tinyint", "smallint", "int", "bigint"}
    require({dict(queries.dtypes)[query], dict(docs.dtypes)[doc]} <= whole, "ids must be whole numbers")
    q = queries.where(F.col(query).isNotNull()).select(F.col(query).cast("bigint").alias("_q"), qvector.alias("_x"))
    d = docs.where(F.col(doc).isNotNull()).select(F.col(doc).cast("bigint").alias("_d"), vector.alias("_y"))
    left = vector_blocks(q, ["_q"], "_x", ASKED).withColumnsRenamed({"length": "_ql", "n": "_qn", "data": "_qdata"})
    pairs = block_pairs(left, vector_blocks(spread(d, "_d"), ["_d"], "_y", HELD))

    def run(batches):
        import pyarrow as pa

        held: dict[bytes, tuple] = {}

        def best():
            for asked, (q, i, s) in held.items():
                names = np.frombuffer(asked, np.int64)[q]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(i), pa.array(s, mask=np.isneginf(s))], ["_q", "_d", "score"])
            held.clear()

        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row] for c in batch.schema.names}
                asked, ids = (np.asarray(r[c].values, np.int64) for c in ("_q", "_d"))
                a, b = (matrix(r[c].as_buffer(), r[n].as_py(), r[size].as_py()) for c, n, size in (("_qdata", "_qn", "_ql"), ("data", "n", "length")))
                alike = r["_ql"].as_py() == r["length"].as_py() >= 0
                key = asked.tobytes()
                none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                held[key] = improved(most, digits, held.get(key, none), asked, a if alike else None, ids, b if alike else None)
            if sum(len(h[0]) for h in held.values()) > MOST_HELD:
                yield from best()
        yield from best()

    best = pairs.mapInArrow(run, "_q bigint, _d bigint, score double")
    over = Window.partitionBy("_q").orderBy(F.desc("score"), "_d")
    ranked = best.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= most)
    return ranked.select(F.col("_q").alias(query), F.col("_d").alias(doc), "score", "rank")


def best_products(queries: DataFrame, docs: DataFrame, query: str, position: str, doc: str, qvector: Column, vector: Column) -> DataFrame:
    """(query, position, doc, m): the greatest product of each query token with the vectors of each document; null if none has its length."""
    whole = lambda x: F.when(~F.exists(x, lambda v: v.isNull()), x.cast("array<double>"))
    q = queries.select(F.col(query).alias("_q"), F.col(position).alias("_i"), whole(qvector).alias("_x"))
    d = docs.select(F.col(doc).alias("_d"), whole(vector).alias("_y"))
    left = vector_blocks(q, ["_q", "_i"], "_x", ASKED).withColumnsRenamed({"length": "_ql", "n": "_qn", "data": "_qdata"})
    pairs = block_pairs(left, vector_blocks(spread(d), ["_d"], "_y", HELD))
    kinds = dict(q.dtypes) | dict(d.dtypes)

    def run(batches):
        import pyarrow as pa

        held: dict[tuple, tuple] = {}

        def best():
            for (_, name), (asked, places, m) in held.items():
                names = pa.array([name] * len(m), known.value_type)
                # NaN is a product; -inf with the flag of none is null
                yield pa.RecordBatch.from_arrays([asked, places, names, pa.array(m[:, 0], mask=m[:, 1] == 0)], ["_q", "_i", "_d", "m"])
            held.clear()

        known = None
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row] for c in batch.schema.names}
                known = r["_d"].type
                n, nq, length = r["n"].as_py(), r["_qn"].as_py(), r["length"].as_py()
                codes = r["_d"].values.dictionary_encode("encode")
                at, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
                order = np.argsort(at, kind="stable")
                starts = np.searchsorted(at[order], np.arange(len(names)))
                best_ = np.full((nq, len(names)), -np.inf)
                alike = r["_ql"].as_py() == length >= 0
                if alike:
                    a, b = (matrix(r[c].as_buffer(), k, length) for c, k in (("_qdata", nq), ("data", n)))
                    best_ = np.maximum.reduceat((a @ b.T)[:, order], starts, axis=1)
                own = r["_q"].values, r["_i"].values
                tag = (r["_ql"].as_py(), hashlib.sha256(r["_qdata"].as_buffer()).digest(), tuple(own[0].to_pylist()), tuple(own[1].to_pylist()))
                for j, name in enumerate(names):
                    new = np.stack([best_[:, j], np.full(nq, float(alike))], 1)
                    old = held.get((tag, name))
                    held[(tag, name)] = (*own, new if old is None else np.maximum(old[2], new))
            if sum(len(h[2]) for h in held.values()) > MOST_HELD:
                yield from best()
        yield from best()

    found = pairs.mapInArrow(run, f"_q {kinds['_q']}, _i {kinds['_i']}, _d {kinds['_d']}, m double")
    return found.groupBy(F.col("_q").alias(query), F.col("_i").alias(position), F.col("_d").alias(doc)).agg(F.max("m").alias("m"))
