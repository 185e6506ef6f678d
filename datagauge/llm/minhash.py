"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch of SIZE coordinates is filled in rounds: in round i < SIZE each element is put
in a hashed bin; in the SIZE rounds that follow round SIZE + i puts every element in
bin i, so every coordinate is filled. A bin keeps its smallest (round, hash). Bands of ROWS
coordinates are compared. At a similarity of 0.8 a pair shares none of 48 bands of 6
with probability (1 - 0.8**6)**48 < 5e-7; what shares one is verified on whole sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datagauge.llm.components import components
from datagauge.llm.embeddings import connect
from datagauge.llm.frames import discard, map_text, release, stored
from datagauge.llm.kernels import LEAN_BYTES, buffers, given_back, mix, shingle_hashes

ROWS, BANDS = 6, 48
SIZE = ROWS * BANDS
#: Cells are cut into blocks of about so many sets, whose products are made so many shingles at a time.
BLOCK, COLUMNS = 256, 8192
SEEDS = mix(np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
BAND_SALTS = mix(np.arange(1, SIZE + 1, dtype=np.uint64) + np.uint64(77)).reshape(BANDS, ROWS) | np.uint64(1)


def sketch(elements: np.ndarray) -> np.ndarray:
    """SIZE coordinates of a set of 64-bit hashes that isn't empty."""
    out = np.full(SIZE, np.iinfo(np.uint64).max, np.uint64)
    done, step = 0, max(1, int(SIZE * (np.log(SIZE) + 1) / len(elements)) + 1)
    while done < SIZE:
        to = min(SIZE, done + step)
        h = mix(elements[None, :] ^ SEEDS[done:to, None])
        place = ((h >> np.uint64(40)) * np.uint64(SIZE) >> np.uint64(24)).astype(np.int64)
        value = (np.arange(done, to, dtype=np.uint64)[:, None] << np.uint64(48)) | (mix(h) >> np.uint64(16))
        np.minimum.at(out, place.ravel(), value.ravel())
        done = to
        if int(out.max()) >> 48 < SIZE:
            return out
        step = 4 * step
    left = np.flatnonzero(out >> np.uint64(48) >= SIZE)
    h = mix(mix(elements[None, :] ^ SEEDS[SIZE + left, None])) >> np.uint64(16)
    out[left] = ((left + SIZE).astype(np.uint64) << np.uint64(48)) | h.min(1)
    return out


def bands(elements: np.ndarray) -> np.ndarray:
    """A key of each band."""
    rows = mix(sketch(elements).reshape(BANDS, ROWS))
    return mix((rows * BAND_SALTS).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each row, sorted."""
    h, at = shingle_hashes(data, offsets, words)
    return [np.unique(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def lists(arrays: list[np.ndarray]):
    import pyarrow as pa

    at = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(arrays).view(np.int64) if len(arrays) else np.zeros(0, np.int64)))


def signatures(docs: DataFrame, words: int, text: str) -> DataFrame:
    """doc_id, n_shingles, two sums of mixed hashes that name the set of shingles, and the keys of its bands."""

    def make():
        import pyarrow as pa

        def work(batch):
            found = sets(*buffers(batch.column(text)), words)
            first = [mix(x).sum(dtype=np.uint64) for x in found]
            second = [mix(x ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) for x in found]
            named = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (first, second)]
            return [pa.array([len(x) for x in found], pa.int64()), *named, lists([bands(x) if len(x) else x for x in found])]

        return work

    return map_text(docs, text, [("n_shingles", "bigint"), ("s1", "bigint"), ("s2", "bigint"), ("bands", "array<bigint>")], make, ["doc_id"], LEAN_BYTES)


def shingle_sets(docs: DataFrame, words: int, text: str, keep: list[str]) -> DataFrame:
    return map_text(docs, text, [("shingles", "array<bigint>")], lambda: lambda batch: [lists(sets(*buffers(batch.column(text)), words))], keep, LEAN_BYTES)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have 100 * intersection >= percent * union.

    Words are runs of bytes outside ASCII white space, A-Z in lower case. A text of fewer than `words` words is
    one shingle; null, empty and blank texts have none and are linked with nothing.
    Returns the rows of docs with n_shingles, component_id (the smallest doc_id reachable), kept
    (doc_id = component_id). Rows of one doc_id are one document by id: copies of a row get the same
    values, and an id with several texts links through any of them. A null doc_id is linked
    with nothing, component_id null and kept true. Columns named like the new ones are replaced.

    Equal sets are one class, whatever their number. Classes that share a band are in the cell of the least class of that
    band, so any two that share one meet in a cell; within a cell, in pairs of blocks of bounded size, all
    intersections are counted on whole sets.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    rows = stored(signatures(named, words, text), "sets")
    some = rows.where("n_shingles > 0")
    least = some.groupBy("n_shingles", "s1", "s2").agg(F.min(F.struct("doc_id", "bands")).alias("one"))
    classes = stored(least.select("n_shingles", "s1", "s2", F.col("one.doc_id").alias("class"), "one.bands"), "classes")
    rows, classes_only = rows.drop("bands"), classes.drop("bands")
    keyed = classes.select(F.explode("bands").alias("band"), F.col("class").alias("id"))
    # counted by partial sums and written, so that Spark can split the members of a crowded band when it joins them
    leads = stored(keyed.groupBy("band").agg(F.min("id").alias("cell"), F.count("*").alias("members")).where("members > 1").select("band", "cell"), "leads")
    cells = stored(keyed.join(leads.hint("merge"), "band").select("cell", "id").distinct(), "cells")
    discard(leads)
    links = verified(cells, named, words, percent, text)
    discard(cells)
    found = components(links)
    discard(links)
    # components of classes by the leader's id; one id may lead several classes, which then are one document
    member = rows.join(classes_only, ["n_shingles", "s1", "s2"]).select("doc_id", F.col("class").alias("id")).join(found, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    per_id = member.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.max("component_id").alias("hi"))
    per_id = stored(per_id, "members")
    if per_id.where("component_id <> hi").limit(1).count():  # ids with several texts join their components
        joined = components(per_id.select(F.col("component_id").alias("a"), F.col("hi").alias("b")).unionByName(member.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))))
        per_id = joined.select(F.col("id").alias("doc_id"), "component_id")
    sizes = rows.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    facts = sizes.join(per_id.select("doc_id", "component_id"), "doc_id", "left")
    base = docs.select(*[c for c in docs.columns if c not in ("n_shingles", "component_id", "kept")])
    out = base.join(facts, "doc_id", "left")
    out = out.withColumn("n_shingles", F.coalesce("n_shingles", F.lit(0).cast("bigint"))).withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def verified(cells: DataFrame, docs: DataFrame, words: int, percent: int, text: str) -> DataFrame:
    """(a, b): links that join all whose whole sets are similar enough, within each cell (cell, id)."""
    kind = cells.schema["id"].dataType.simpleString()
    wanted = cells.select(F.col("id").alias("doc_id")).distinct()
    own = docs.select("doc_id", F.col(text).alias("text")).join(wanted.hint("merge"), "doc_id")
    held = stored(shingle_sets(own, words, "text", ["doc_id"]), "shingles")
    release(docs.sparkSession)
    blocks = cells.groupBy("cell").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("blocks")).where("blocks > 1")
    blocks = stored(blocks, "blocks")  # crowded cells only; written, so that Spark can split their members in the join
    placed = cells.join(blocks, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    placed = placed.select("cell", "id", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    tasks = placed.select("cell", "id", F.least("own", "other").alias("l"), F.greatest("own", "other").alias("r"), (F.col("own") > F.col("other")).alias("right"))
    sent = tasks.join(held.select(F.col("doc_id").alias("id"), "shingles").hint("merge"), "id").select("cell", "l", "r", "right", "id", "shingles")

    def run(batches):
        import pyarrow as pa

        def finish(rows):
            t = pa.Table.from_batches(rows).combine_chunks()
            values = t.column("shingles").chunk(0)
            flat, at = values.flatten().to_numpy(), values.value_lengths().to_numpy()
            edges = linked(flat, at, t.column("id").to_numpy(), t.column("right").to_numpy(zero_copy_only=False), rows[0].column("l")[0].as_py() == rows[0].column("r")[0].as_py(), percent)
            return edges

        held_, key, out = [], None, []
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("cell", "l", "r")), strict=True))
            at = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[at]:
                    if held_ and key != keys[at]:
                        out += finish(held_)
                        held_ = []
                    key = keys[at]
                    held_.append(b.slice(at, i - at))
                    at = i
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if held_:
            out += finish(held_)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["a", "b"])

    dealt = sent.repartition("cell", "l", "r").sortWithinPartitions("cell", "l", "r")
    links = stored(dealt.mapInArrow(lambda batches: given_back(run(batches)), f"a {kind}, b {kind}"), "links")
    for spent in (held, blocks):
        discard(spent)
    return links


def linked(flat: np.ndarray, size: np.ndarray, ids: np.ndarray, right: np.ndarray, alone: bool, percent: int) -> list[tuple]:
    """Links (id, least id of its group) among sets that stand one after another: all pairs of one block, or of left and right blocks."""
    at = np.concatenate([[0], np.cumsum(size)])
    if len(ids) == 2:
        both = len(np.intersect1d(flat[: at[1]], flat[at[1] :], assume_unique=True))
        return [(ids[0], ids[1])] if (alone or right[0] != right[1]) and 100 * both >= percent * (at[2] - both) else []
    order = np.argsort(flat, kind="stable")
    new = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
    code = np.cumsum(new) - 1
    often = np.bincount(code) > 1
    keep = often[code]
    column, row = (np.cumsum(often) - 1)[code[keep]], np.repeat(np.arange(len(ids)), size)[order[keep]]
    a = np.arange(len(ids)) if alone else np.flatnonzero(~right)
    b = a if alone else np.flatnonzero(right)
    if not len(a) or not len(b):
        return []
    both = np.zeros((len(a), len(b)), np.float32)
    low = 0
    for low in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        i, j = np.searchsorted(column, [low, low + COLUMNS])
        m = np.zeros((len(ids), min(COLUMNS, int(column[j - 1]) - low + 1)), np.float32)
        m[row[i:j], column[i:j] - low] = 1
        both += m[a] @ m[b].T
    hit = 100 * both.astype(np.int64) >= percent * (size[a][:, None] + size[b][None, :] - both.astype(np.int64))
    if alone:
        np.fill_diagonal(hit, False)
    edges: set = set()
    connect(hit, (left := ids[a].astype(np.int64)), left if alone else ids[b].astype(np.int64), edges)
    return sorted(edges)
