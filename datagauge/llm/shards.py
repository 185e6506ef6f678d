"""Training-order materialisation: a keyed permutation of sequences, written as fixed-stride shards.

Texts become token identifiers, cut into sequences of `length` (the last of a document padded). Sequences are
numbered in the order of doc_id and text, whatever the table's files or partitions; only ids and counts are
sorted for that, and each task of the tokens reads the numbers of its own rows, so texts aren't shuffled for it. A keyed
Feistel network over the least even number of bits that holds the count, walked along its cycle until the result
is below the count, gives each sequence a global slot: a permutation that needs no table. Slot s is row s % rows of
shard s // rows, at byte (s % rows) * stride of its file, so a reader can stop and go on anywhere without an index.

Sequences travel to their shard in compressed blocks, one for each shard that a task's rows go to.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datagauge.llm.frames import discard, release, remove, shared_dir, stored
from datagauge.llm.kernels import mix, ragged, slices

ROUNDS = 6
#: A task packs blocks once it holds so many bytes of identifiers. So many tasks write shards at most, each several then.
PACKED, WRITERS = 48_000_000, 20_000


def round_keys(key: str) -> np.ndarray:
    return np.frombuffer(hashlib.sha512(key.encode()).digest(), np.uint64)[:ROUNDS]


def slots(numbers: np.ndarray, count: int, key: str) -> np.ndarray:
    """Where the permutation of range(count) named by `key` puts each number."""
    half = np.uint64(max((max(count - 1, 1).bit_length() + 1) // 2, 1))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = np.asarray(numbers).astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> half, out[walking] & mask
        for k in round_keys(key):
            left, right = right, left ^ (mix(right + k) & mask)
        out[walking] = (left << half) | right
        walking = walking[out[walking] >= count]
    return out.astype(np.int64)


def filesystem(path: str):
    """A file system that Python writers on executors reach, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def tokenised(docs: DataFrame, ranks_path: str, pattern: str, text: str, length: int) -> DataFrame:
    """(part, row, sequences, th, doc_id, ids) of all documents that have tokens; row counts those of a part."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from datagauge.llm.byte_bpe import encoder

        encode, part, before = encoder(ranks_path, pattern), TaskContext.get().partitionId(), 0
        for b in slices(batches, "text"):
            ids, at = encode(b.column("text"))
            some = np.flatnonzero(np.diff(at))
            n = np.diff(at)[some]
            made = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((at[np.append(some, len(at) - 1)] * 2).astype(np.int32)), pa.py_buffer(ids.astype("<u2"))])
            take = pa.array(some)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(before + np.arange(len(n))), pa.array(-(-n // length)), b.column("th").take(take), b.column("doc_id").take(take), made], names=["part", "row", "sequences", "th", "doc_id", "ids"])
            before += len(n)

    return own.mapInArrow(run, f"part int, row bigint, sequences bigint, th bigint, doc_id {kind}, ids binary")


def numbered(tokens: DataFrame, folder: str) -> int:
    """Write the number of the first sequence of each row, a file of int64 for each part in order of row; returns how many sequences there are.

    Rows are numbered in the order of doc_id (null first) and text; equal rows have equal sequences.
    """
    small = tokens.select("doc_id", "th", "part", "row", "sequences")
    dealt = small.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th")

    def add(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        reach, before = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("sequences").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), reach, np.int32)), pa.array(before + np.cumsum(n) - n), b.column("sequences"), b.column("part"), b.column("row")], names=["range", "within", "sequences", "part", "row"])
            before += int(n.sum())

    ranges = stored(dealt.select("sequences", "part", "row").mapInArrow(add, "range int, within bigint, sequences bigint, part int, row bigint"), "numbers")
    base, count = {}, 0
    for r in sorted(ranges.groupBy("range").agg(F.sum("sequences").alias("n")).collect()):  # one row a range
        base[r.range] = count
        count += r.n

    def write(batches):
        import pyarrow as pa

        fs, path = filesystem(folder)
        part, held = None, []

        def finish():
            if held:
                from pyspark import TaskContext

                fs.create_dir(path, recursive=True)
                own = f"{path}/.first-{part}-{TaskContext.get().taskAttemptId()}"
                with fs.open_output_stream(own) as out:
                    for x in held:
                        out.write(x.tobytes())
                fs.move(own, f"{path}/first-{part}.bin")
                held.clear()

        for b in batches:  # in order of part and row
            first = b.column("within").to_numpy() + np.array([base[x] for x in b.column("range").to_pylist()], np.int64)
            parts = b.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i < j and parts[i] != part:
                    finish()
                    part = int(parts[i])
                held.append(first[i:j].astype("<i8"))
        finish()
        yield pa.RecordBatch.from_arrays([pa.array([0])], names=["done"])

    if count:
        ranges.select("part", "row", "range", "within").repartition("part").sortWithinPartitions("part", "row").mapInArrow(write, "done bigint").agg(F.count("*")).collect()
    discard(ranges)
    return count


def packed(slot: np.ndarray, rows: int, doc, seq: np.ndarray, n: np.ndarray, ids: np.ndarray, at: np.ndarray):
    """A record batch with a row for each shard: its sequences' slots, documents, places and sizes, and their identifiers, compressed."""
    import pyarrow as pa

    order = np.argsort(slot, kind="stable")
    slot, seq, n, at = slot[order], seq[order], n[order], at[order]
    shard = slot // rows
    cut = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]]) if len(shard) else np.zeros(1, np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    said = ids[ragged(at, n)]
    codec, data, raw = pa.Codec("zstd", 1), [], ends[cut[1:]] - ends[cut[:-1]]
    for i, j in zip(ends[cut[:-1]].tolist(), ends[cut[1:]].tolist(), strict=True):
        data.append(codec.compress(np.ascontiguousarray(said[i:j].view(np.uint8).reshape(-1, 2).T), asbytes=True))
    lists = lambda x: pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), x)
    return pa.RecordBatch.from_arrays([pa.array(shard[cut[:-1]]), lists(pa.array(slot)), lists(doc.take(pa.array(order))), lists(pa.array(seq)), lists(pa.array(n)), pa.array(raw), pa.array(data, pa.binary())], names=["shard", "slots", "docs", "seqs", "sizes", "raw", "data"])


def materialise(docs: DataFrame, path: str, ranks_path: str, pattern: str, length: int = 512, pad: int = 50_256, rows: int = 16_384, key: str = "epoch-0", text: str = "text", rounds: int = 2) -> DataFrame:
    """Write shards under path; returns their manifest: (slot, shard, doc_id, seq_no, n_tokens, sha256), a row for each sequence, with the digest of its row as read back.

    Identifiers are little-endian uint16. Null and empty texts have no sequence. Repeated rows are sequences of their own, in
    any order among equals, which are the same bytes; null ids pass through. A text of any length is cut alike. Other columns are not read. A
    task holds one shard, writes it under a name of its attempt and then renames it, so a task that runs again leaves whole files.
    Shards are made in `rounds` ranges, one after another, so that the disk holds the shuffled rows of one range at a time; each reads the stored tokens.
    """
    if not 0 <= pad < 1 << 16:
        raise ValueError("identifiers are uint16")
    import uuid

    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = stored(tokenised(docs, ranks_path, pattern, text, length), "tokens", "zstd")
    numbers = f"{shared_dir(spark)}/firsts-{uuid.uuid4().hex}"
    count = numbered(tokens, numbers)
    release(spark)
    shards = -(-count // rows)
    each = max(1, -(-shards // WRITERS))

    def deal(batches, low, high):
        import pyarrow as pa

        fs, folder = filesystem(numbers)
        known: dict[int, np.ndarray] = {}
        held, size = [], 0

        def pack():
            row = np.concatenate([x[0] for x in held])
            own, first, at = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            doc = pa.chunked_array([x[4] for x in held]).combine_chunks()
            doc = doc.chunk(0) if isinstance(doc, pa.ChunkedArray) else doc
            ids = np.concatenate([x[5] for x in held])
            pieces = -(-own // length)
            seq = ragged(np.zeros(len(pieces), np.int64), pieces)
            of = np.repeat(np.arange(len(row)), pieces)
            slot = slots(np.repeat(first, pieces) + seq, count, key)
            now = np.flatnonzero((slot >= low * rows) & (slot < high * rows))
            slot, seq, of = slot[now], seq[now], of[now]
            return packed(slot, rows, doc.take(pa.array(of)), seq, np.minimum(own[of] - seq * length, length), ids, at[of] + seq * length)

        for b in batches:
            ids = b.column("ids")
            _, off, data = ids.buffers()
            off = np.frombuffer(off, np.int32, len(ids) + 1, ids.offset * 4).astype(np.int64) // 2
            values = np.frombuffer(data, "<u2")[off[0] : off[-1]]
            parts, row = b.column("part").to_numpy(), b.column("row").to_numpy()
            first = np.zeros(len(row), np.int64)
            for p in np.unique(parts).tolist():
                if p not in known:
                    known.clear()
                    with fs.open_input_stream(f"{folder}/first-{p}.bin") as f:
                        known[p] = np.frombuffer(f.read(), "<i8")
                first[parts == p] = known[p][row[parts == p]]
            held.append((row, np.diff(off), first, off[:-1] - off[0] + size // 2, b.column("doc_id"), values.copy()))
            size += 2 * len(values)
            if size > PACKED:
                yield pack()
                held, size = [], 0
        if held:
            yield pack()

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, folder = filesystem(path)
        fs.create_dir(folder, recursive=True)
        codec, attempt, now, blocks = pa.Codec("zstd"), TaskContext.get().taskAttemptId(), None, []

        def finish():
            whole = pa.Table.from_batches(blocks)
            lists = [pa.concat_arrays([c.flatten() for c in whole.column(x).chunks]) for x in ("slots", "docs", "seqs", "sizes")]
            slot, n = lists[0].to_numpy(), lists[3].to_numpy()
            first = now * rows
            shard = np.full((min(rows, count - first), length), pad, "<u2")
            ids = np.concatenate([np.frombuffer(codec.decompress(x.as_py(), 2 * r, asbytes=True), np.uint8).reshape(2, -1).T.ravel().view("<u2") for x, r in zip(whole.column("data"), whole.column("raw").to_pylist(), strict=True)])
            shard.ravel()[ragged((slot - first) * length, n)] = ids
            own = f"{folder}/.shard-{now:08d}-{attempt}"
            with fs.open_output_stream(own) as out:
                out.write(shard)
            with fs.open_input_stream(own) as f:
                back = memoryview(f.read())
            fs.move(own, f"{folder}/shard-{now:08d}.bin")
            stride = 2 * length
            digests = [hashlib.sha256(back[i * stride : (i + 1) * stride]).digest() for i in (slot - first).tolist()]
            return pa.RecordBatch.from_arrays([lists[0], pa.array(np.full(len(slot), now)), lists[1], lists[2], lists[3], pa.array(digests)], names=["slot", "shard", "doc_id", "seq_no", "n_tokens", "sha256"])

        for b in batches:  # in order of shard
            shard = b.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i < j and shard[i] != now:
                    if blocks:
                        yield finish()
                    now, blocks = int(shard[i]), []
                blocks.append(b.slice(i, j - i))
        if blocks:
            yield finish()

    cells = f"slot bigint, shard bigint, doc_id {kind}, seq_no bigint, n_tokens bigint, sha256 "
    if not count:
        return spark.createDataFrame([], cells + "string")
    manifest, block = None, f"shard bigint, slots array<bigint>, docs array<{kind}>, seqs array<bigint>, sizes array<bigint>, raw bigint, data binary"
    edges = [shards * i // rounds for i in range(rounds + 1)]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        if low < high:
            sent = tokens.select("part", "row", "doc_id", "ids").mapInArrow(partial(deal, low=low, high=high), block)
            dealt = sent.repartitionById(-(-(high - low) // each), F.expr(f"cast((shard - {low}) div {each} as int)")).sortWithinPartitions("shard")
            made = stored(dealt.mapInArrow(write, cells + "binary"), "manifest")
            manifest = made if manifest is None else manifest.unionByName(made)
            del sent, dealt
            release(spark)
    discard(tokens)
    remove(spark, numbers)
    return manifest.withColumn("sha256", F.lower(F.hex("sha256")))
