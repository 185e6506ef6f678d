"""Near-duplicate vectors by an exact metric range join over pivot cells.

On unit vectors, cosine >= c is a Euclidean distance of at most r = sqrt(2 - 2c). Each vector has the
cell of its nearest pivot as home. Let y, a partner of x, have home j and x home i. By the triangle
inequality d(x, p_j) <= d(y, p_j) + r <= radius_j + r; and as y is on p_j's side of the bisector of p_i
and p_j, x is no further than r beyond it: (d(x, p_j)**2 - d(x, p_i)**2) / (2 d(p_i, p_j)) <= r.
Where both hold, x is a guest of cell j, if j < i (a pair over two cells is met in the lower).

Cells are cut into blocks of bounded size, so a crowded cell is shared out, and blocks that follow each other
travel as a bundle: a guest goes to a bundle once, however many of its cells may hold a partner, and the cells'
bounds choose again within the task. A bundle's many guests are shared out too, each share with a copy of the bundle.

Within a task most pairs fall by a bound on their cosine: with projections y, z of x, x' to a few orthonormal
directions, x . x' <= y . z + |x - y| |x' - z|, worked out in single precision with room for its rounding. Only
pairs that it leaves are worked out whole, in double precision. Vectors of each length have pivots, cells and a basis of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datagauge.llm.components import components
from datagauge.llm.frames import stored
from datagauge.llm.kernels import buffers

SLACK = 1e-9
#: Room for the rounding of a sum of at most DIRECTIONS + 1 products in single precision (under 2e-6).
ROUNDING = 1e-5
DIRECTIONS = 16
#: Bytes of vectors in a bundle of several blocks.
BUNDLE_BYTES = 1 << 24


def scaled(out: np.ndarray) -> np.ndarray:
    """Scale rows to unit length, in place; which rows could be (not zero, no non-finite component): the others become 0."""
    with np.errstate(all="ignore"):
        top = np.abs(out).max(1, initial=0)
        good = np.isfinite(top) & (top > 0) & (out.shape[1] > 0)
        out[good] /= top[good, None]
        out[good] /= np.sqrt((out[good] ** 2).sum(1))[:, None]
    out[~good] = 0
    return good


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def connect(hit: np.ndarray, left: np.ndarray, right: np.ndarray, edges: set) -> None:
    """Give linked vectors the least label among them, in place; edges gets old and new labels of each change."""
    rows, columns = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    if not len(rows):
        return
    part = hit[np.ix_(rows, columns)]
    most = np.iinfo(np.int64).max
    a, b = left[rows], right[columns]
    while True:
        low_b = np.minimum(b, np.where(part, a[:, None], most).min(0))
        low_a = np.minimum(a, np.where(part, low_b, most).min(1))
        if (low_a == a).all() and (low_b == b).all():
            break
        a, b = low_a, low_b
    for old, new, at in ((left, a, rows), (right, b, columns)):
        changed = np.flatnonzero(old[at] != new)
        if len(changed):
            pairs = np.unique(np.column_stack([old[at][changed], new[changed]]), axis=0)
            edges.update(map(tuple, pairs.tolist()))
            old[at] = new


def basis(x: np.ndarray) -> np.ndarray:
    """Orthonormal columns, at most DIRECTIONS, along which the rows of x differ most, or nearly so."""
    rng = np.random.default_rng(0)
    out = rng.normal(size=(x.shape[1], min(DIRECTIONS, x.shape[1])))
    x = x - x.mean(0)
    for _ in range(4):
        out = np.linalg.qr(x.T @ (x @ out) + 1e-9 * rng.normal(size=out.shape))[0]
    return out


def coordinates(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Single-precision coordinates of unit vectors, and what is left of their length: no cosine is over the product of two such rows by ROUNDING."""
    y = x @ directions
    return np.column_stack([y, np.sqrt(np.maximum(1 - (y * y).sum(1), 0))]).astype(np.float32)


def near_cells(x: np.ndarray, own: np.ndarray, cells: np.ndarray, p: np.ndarray, radius: np.ndarray, reach: float) -> np.ndarray:
    """For rows of home cells `own`, which of the named cells may hold partners by the bounds of radius and bisector; the own one always may."""
    d, mine = distances(x, p[cells]), np.maximum(2 - 2 * np.einsum("ij,ij->i", x, p[own]), 0)
    out = (d <= radius[cells] + reach) & (d**2 - mine[:, None] <= 2 * reach * distances(p, p[cells])[own] + SLACK)
    return out | (own[:, None] == cells)


def packed(x: np.ndarray):
    """Rows of doubles as a binary Arrow column."""
    import pyarrow as pa

    x = np.ascontiguousarray(x, np.float64)
    offsets = (np.arange(len(x) + 1) * x.shape[1] * 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x.reshape(-1))])


def by_length(values: np.ndarray, offsets: np.ndarray):
    """For each length of row: that length, which rows have it, and those as a matrix."""
    sizes = np.diff(offsets)
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        yield n, at, values[offsets[0] : offsets[-1]].reshape(-1, n) if len(at) == len(sizes) else values[offsets[at][:, None] + np.arange(n)]


def unpacked(column):
    """by_length() of a column that packed() made."""
    raw, offsets = buffers(column)
    return by_length(raw.view(np.float64), offsets // 8)


def near_vectors(vectors: DataFrame, least: float = 0.95, pivots: int = 0, block: int = 2048, sample: int = 4096, vector: str = "embedding") -> DataFrame:
    """Rows of vectors with n_links, component_id and kept.

    Vectors link at a cosine of at least `least`, in double precision. Null, zero and empty vectors, those with null or
    non-finite components link with nothing; all others link with those of their own length.
    component_id is the smallest vec_id reachable, kept is vec_id = component_id. A vec_id that occurs with
    several vectors counts each of them, a repeated row is one vector; null vec_ids link with nothing, and are kept. Columns named like the new ones are replaced.

    `pivots` vectors of each length (0: one for each `block` rows, 4 to 512) come from a sample of at most
    `sample` rows, chosen by hash, and one row of each length that it misses; it only shapes the cells, the result
    doesn't depend on it. The driver holds one count a length.
    """
    spark = vectors.sparkSession
    reach = float(np.sqrt(2 - 2 * least)) + SLACK
    own = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
    rows = vectors.where(F.col("vec_id").isNotNull()).select("vec_id", own.alias("v")).distinct()
    rows = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
    sizes = {r.n: r for r in rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.min(F.xxhash64("vec_id", "v")).alias("least")).collect()}  # one row a length
    base = vectors.select(*[c for c in vectors.columns if c not in ("n_links", "component_id", "kept")])
    if not sizes:
        return base.withColumn("n_links", F.lit(0).cast("bigint")).withColumn("component_id", F.col("vec_id")).withColumn("kept", F.lit(True))
    sampled = [list(r.v) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()]
    missed = [(n, r.least) for n, r in sizes.items() if n not in set(map(len, sampled))]
    if missed:
        firsts = spark.createDataFrame(missed, "n int, least bigint")
        sampled += [list(r.v) for r in rows.join(F.broadcast(firsts), (F.size("v") == F.col("n")) & (F.xxhash64("vec_id", "v") == F.col("least")), "left_semi").collect()]
    cells_of, n_cells = {}, 0  # length: its first cell, its pivots and its basis
    for n in sorted(sizes):
        drawn = np.array([v for v in sampled if len(v) == n], np.float64)
        scaled(drawn)
        wanted = min(pivots or min(max(sizes[n].rows // block, 4), 512), len(drawn))
        chosen, far = [0], distances(drawn, drawn[:1])[:, 0]
        while len(chosen) < wanted and far.max() > reach:  # far from those before
            chosen.append(int(far.argmax()))
            far = np.minimum(far, distances(drawn, drawn[chosen[-1:]])[:, 0])
        cells_of[n] = n_cells, drawn[chosen], basis(drawn)
        n_cells += len(chosen)
    pivot = spark.sparkContext.broadcast(cells_of)

    def home(batches):
        import pyarrow as pa

        for b in batches:
            v = b.column("v")
            for n, at, x in by_length(v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()):
                first, p, _ = pivot.value[n]
                scaled(x := np.array(x, np.float64))
                d = distances(x, p)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(at)), packed(x), pa.array((first + cell).astype(np.int32)), pa.array(d[np.arange(len(x)), cell])], ["vec_id", "x", "cell", "d"])

    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "v")
    homes = rows.mapInArrow(home, "vec_id bigint, x binary, cell int, d double").withColumn("row", F.pmod(F.xxhash64("vec_id", "x"), F.lit(2**31 - 1)).cast("int"))
    homes = stored(homes, "homes")
    cells = {r.cell: (r.n, r.radius) for r in homes.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("radius")).collect()}  # one row a pivot
    radius = np.full(n_cells, -10.0)
    blocks = np.zeros(n_cells, np.int64)
    held = np.zeros(n_cells)
    for c, (n, r) in cells.items():
        held[c], radius[c], blocks[c] = n, r, -(-n // block)
    first_block = np.cumsum(blocks) - blocks
    cell_of = np.repeat(np.arange(n_cells), blocks)  # by block
    bundle_of, parts = np.zeros(len(cell_of), np.int64), []  # by block, by bundle
    for n, (first, p, _) in cells_of.items():
        own = np.flatnonzero((cell_of >= first) & (cell_of < first + len(p)))
        many = max(1, min(len(own) // 8, BUNDLE_BYTES // (8 * n * block)))  # blocks in a bundle
        bundle_of[own] = len(parts) + np.arange(len(own)) // many
        size = (held / np.maximum(blocks, 1))[cell_of[own]]
        parts += [max(1, -(-int(size[at + many :].sum()) // (4 * block * many))) for at in range(0, len(own), many)]
    parts = np.array(parts)

    def sent_to(batches):
        """Each vector goes to the shares of its block's bundle, and as a guest to a share of each bundle before that has blocks of cells near enough."""
        import pyarrow as pa

        for b in batches:
            row, cell, ids = (b.column(c).to_numpy() for c in ("row", "cell", "vec_id"))
            for n, at, x in unpacked(b.column("x")):
                first, p, _ = pivot.value[n]
                c = cell[at]
                number = first_block[c] + row[at] % blocks[c]
                mine = bundle_of[number]
                near = near_cells(x, c - first, np.arange(len(p)), p, radius[first : first + len(p)], reach)
                own = np.flatnonzero((cell_of >= first) & (cell_of < first + len(p)))
                low = bundle_of[own[0]]
                has = np.zeros((len(p), bundle_of[own[-1]] - low + 1), np.float32)
                has[cell_of[own] - first, bundle_of[own] - low] = 1
                guest, to = np.nonzero((near.astype(np.float32) @ has > 0) & (np.arange(has.shape[1]) < (mine - low)[:, None]))
                copies = np.repeat(np.arange(len(x)), parts[mine])
                share = np.arange(len(copies)) - np.repeat(np.cumsum(parts[mine]) - parts[mine], parts[mine])
                i = np.concatenate([copies, guest])
                bundle = np.concatenate([mine[copies], low + to])
                share = np.concatenate([share, row[at][guest] // 65536 % parts[low + to]])
                step = max(1, (1 << 23) // (8 * n))
                for k in range(0, len(i), step):
                    e, cut = i[k : k + step], slice(k, k + step)
                    arrays = [pa.array(v.astype(np.int32)) for v in (bundle[cut], share[cut], number[e])]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(ids[at[e]]), packed(x[e])], ["bundle", "share", "block", "vec_id", "x"])

    sent = homes.mapInArrow(sent_to, "bundle int, share int, block int, vec_id bigint, x binary")

    def join(key, table):
        import pyarrow as pa

        ((n, _, x),) = unpacked(table.column("x"))
        first, p, directions = pivot.value[n]
        number = table.column("block").to_numpy()
        order = np.argsort(number, kind="stable")  # the bundle's own come first
        x, number, ids = x[order], number[order], table.column("vec_id").to_numpy()[order].astype(np.int64)
        y = coordinates(x, directions)
        links, label, edges = np.zeros(len(x), np.int64), ids.copy(), set()

        def meet(left, right, alone):
            over = y[left] @ y[right].T >= least - ROUNDING
            if alone:  # a pair within a block once
                over = np.triu(over, 1)
            count = np.count_nonzero(over)
            if not count:
                return
            a, b = np.flatnonzero(over.any(1)), np.flatnonzero(over.any(0))
            over, a, b = over[np.ix_(a, b)], left[a], right[b]
            if over.size <= 16 * count:
                over &= x[a] @ x[b].T >= least
            else:
                i, j = np.nonzero(over)
                for k in range(0, count, 4096):
                    e, f = i[k : k + 4096], j[k : k + 4096]
                    over[e, f] = np.einsum("ij,ij->i", x[a[e]], x[b[f]]) >= least
            links[a] += over.sum(1)
            links[b] += over.sum(0)
            label_a, label_b = label[a], label[b]
            connect(over, label_a, label_b, edges)
            label[a] = label_a
            label[b] = np.minimum(label[b], label_b)

        own = np.searchsorted(number, np.flatnonzero(bundle_of == key[0].as_py())[-1], "right")
        alone = key[1].as_py() == 0  # the first share joins the bundle with itself
        there = np.unique(cell_of[number[:own]]) - first
        near = near_cells(x, cell_of[number] - first, there, p, radius[first : first + len(p)], reach)
        for k in np.unique(number[:own]).tolist():
            low, high = np.searchsorted(number, [k, k + 1]).tolist()
            after = high if alone else own
            others = after + np.flatnonzero(near[after:, np.searchsorted(there, cell_of[k] - first)])
            for at in range(low, high, 512):
                left = np.arange(at, min(at + 512, high))
                if alone:
                    meet(left, np.arange(at, high), True)
                for to in range(0, len(others), 4096):
                    meet(left, others[to : to + 4096], False)
        some = np.flatnonzero(links)
        changes = np.array(sorted(edges), np.int64).reshape(-1, 2)
        return pa.table({"a": np.concatenate([ids[some], changes[:, 0]]), "b": np.concatenate([ids[some], changes[:, 1]]), "n": np.concatenate([links[some], np.zeros(len(changes), np.int64)])})

    found = stored(sent.groupBy("bundle", "share").applyInArrow(join, "a bigint, b bigint, n bigint"), "found")
    links = found.where("n > 0").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    labels = components(found.where("n = 0").select("a", "b"))
    out = base.join(links, "vec_id", "left").join(labels.select(F.col("id").alias("vec_id"), "component_id"), "vec_id", "left")
    out = out.withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("bigint"))).withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
