"""Exact repeats of `length` bytes, removed wherever they stand: a run-length index over groups of passages.

Each window of `length` bytes belongs to the least hash of its k-byte strings, so equal windows
belong to the same hash, whatever document they stand in. A stretch of neighbouring windows
of one hash is a passage: the windows' text. Hashes of one passage in which they occur once are dropped; a passage that occurs
twice repeats wholly, which its two 64-bit hashes (least hash and content) tell without its text being moved. What is left
(different passages under one hash, one copy of each) is gathered by hash, and a run-length index of each
gathering gives the longest match of every window.

No task holds a hash that very many different passages share: their windows are cut into passages again by the least hash of
longer strings, so that passages stay together only where they share more. With strings as long as the
windows all passages under a hash are equal.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datagauge.llm.frames import discard, stored, widened
from datagauge.llm.kernels import LEAN_BYTES, buffers, given_back, prefix_hash, ragged, sha256_rows, slices, span_hash

K = 32
LONGEST = 1024
INDEX_BYTES = 1_000_000


def passages(data: np.ndarray, offsets: np.ndarray, length: int, k: int = K) -> tuple[np.ndarray, ...]:
    """Row, first window, windows, least hash, content hash of all passages, and whether the hash occurs again inside."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    if len(data) < length:
        return none
    p = prefix_hash(data)
    first = np.arange(len(data) - k + 1)
    each = h = span_hash(p, first, first + k)
    width, span = length - k + 1, 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    if span < width:
        h = np.minimum(h[: len(h) - (width - span)], h[width - span :])
    size = np.diff(offsets)
    windows = np.maximum(size - length + 1, 0)
    at = ragged(offsets[:-1], windows)
    if not len(at):
        return none
    row = np.repeat(np.arange(len(size)), windows)
    own = h[at]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (row[1:] != row[:-1])])
    begin = np.flatnonzero(new)
    run = np.diff(np.append(begin, len(at)))
    if run.max() > LONGEST:  # periodic text: cut at fixed distances
        parts = -(-run // LONGEST)
        step = ragged(np.zeros(len(run), np.int64), parts) * LONGEST
        whole = np.repeat(run, parts)
        begin, run = np.repeat(begin, parts) + step, np.minimum(LONGEST, whole - step)
    start = at[begin]
    content = span_hash(p, start, start + run - 1 + length)
    wide = run + width - 1
    places = np.add.reduceat((each[ragged(start, wide)] == np.repeat(own[begin], wide)).astype(np.int32), np.cumsum(wide) - wide)
    return row[begin], start - offsets[row[begin]], run, own[begin], content, places > 1


def passage_table(texts: DataFrame, length: int, k: int, whole: bool = False) -> DataFrame:
    """(h, ch, doc_id, th, start, n, loops) of all passages, with their bytes if `whole`; texts has doc_id, th, text and at, the text's place in its document."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, "text", 100_000 if whole else LEAN_BYTES):
            data, offsets = buffers(part.column("text"))
            row, start, n, h, ch, loops = passages(data, offsets, length, k)
            take = pa.array(row)
            at = part.column("at").to_numpy()[row] + start
            made = [pa.array(h.view(np.int64)), pa.array(ch.view(np.int64)), part.column("doc_id").take(take), part.column("th").take(take), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(loops)]
            if whole:
                size = n + length - 1
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                made.append(pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(data[ragged(offsets[row] + start, size)])]))
            yield pa.RecordBatch.from_arrays(made, names=["h", "ch", "doc_id", "th", "start", "n", "loops", "passage"][: len(made)])

    return texts.mapInArrow(lambda batches: given_back(run(batches)), f"h bigint, ch bigint, doc_id {kind}, th bigint, start int, n int, loops boolean" + ", passage binary" * whole)


def gathered(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(h, doc_id, th, start, n, passage) of wanted passages, from a join with their documents."""
    lists = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "start", "n")).alias("own"))
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.th") == F.col("w.th"))
    both = docs.alias("d").join(lists.alias("w"), same).select("d.doc_id", "d.th", "d.text", "w.own")
    bytes_ = both.withColumn("raw", F.encode("text", "UTF-8")).select("doc_id", "th", "raw", F.explode("own").alias("o"))
    return bytes_.select("o.h", "doc_id", "th", "o.start", "o.n", F.expr(f"substring(raw, o.start + 1, o.n + {length - 1})").alias("passage"))


def indexed(parts: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, start, n) of the windows in gathered passages that match another window under their hash."""
    kind = parts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, th bigint, start int, n int"

    def run(batches):
        import pyarrow as pa

        from datagauge.llm.run_index import RunIndex

        def work(rows):
            t = pa.Table.from_batches(rows)
            index = RunIndex(t.column("passage").to_pylist())
            hit = (index.matching_statistics() >= length).astype(np.int8)
            edge = np.diff(np.concatenate([[0], hit, [0]]))
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            of = np.searchsorted(index.starts, a, "right") - 1
            start = t.column("start").to_numpy()[of] + (a - index.starts[of])
            take = pa.array(of)
            return pa.RecordBatch.from_arrays([t.column(c).combine_chunks().take(take) for c in ("doc_id", "th")] + [pa.array(start.astype(np.int32)), pa.array((b - a).astype(np.int32))], names=["doc_id", "th", "start", "n"])

        held, size = [], 0
        for batch in batches:  # in order of h: cut between hashes, once there is enough
            h = batch.column("h").to_numpy()
            cuts = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                part = batch.slice(a, b - a)
                if held and size > INDEX_BYTES and (i or held[-1].column("h")[-1].as_py() != h[a]):
                    yield work(held)
                    held, size = [], 0
                held.append(part)
                _, offsets = buffers(part.column("passage"))
                size += int(offsets[-1])
        if held:
            yield work(held)

    return parts.select("h", "doc_id", "th", "start", "n", "passage").repartition("h").sortWithinPartitions("h").mapInArrow(lambda batches: given_back(run(batches)), schema)


def merged(marks: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, spans) of lists of (start, n) windows: the byte ranges that they cover, maximal and in order."""
    kind = marks.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("marks")
            count = lists.value_lengths().to_numpy().astype(np.int64)
            start, n = (lists.flatten().field(i).to_numpy().astype(np.int64) for i in (0, 1))
            row = np.repeat(np.arange(len(count)), count)
            order = np.lexsort((start, row))
            start, n, row = start[order], n[order], row[order]
            stop = start + n + length - 1
            reach = np.maximum.accumulate((row << 33) + stop)
            begin = np.flatnonzero(np.concatenate([[True], (row[1:] << 33) + start[1:] > reach[:-1]])) if len(row) else np.zeros(0, np.int64)
            pairs = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (start[begin], np.maximum.reduceat(stop, begin) if len(begin) else begin)], names=["start", "stop"])
            at = np.searchsorted(row[begin], np.arange(len(count) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.ListArray.from_arrays(pa.array(at), pairs)], names=["doc_id", "th", "spans"])

    return marks.mapInArrow(lambda batches: given_back(run(batches)), f"doc_id {kind}, th bigint, spans array<struct<start:int,stop:int>>")


def repeated_spans(docs: DataFrame, length: int = 200, text: str = "text", crowd: int = 2_000) -> DataFrame:
    """Rows of docs with spans: array of (start, stop) byte ranges covered by a `length`-byte string that starts
    anywhere else too, in the same document or another. Ranges are maximal and in order.

    Null and empty texts, and texts of fewer than `length` bytes, have no spans. A row that occurs again is one more place
    of its strings, so both repeat wholly. Null doc_ids are kept apart from others. A hash of more than `crowd` different
    passages is cut again, by longer strings, before its passages are indexed; the result is the same whatever the bound.
    A column of docs named spans is replaced.
    """
    if length < 1:
        raise ValueError("strings have one byte at least")
    th = "_" + max([*docs.columns, "th"], key=len)  # longer than any name there is
    base = docs.drop("spans").withColumn(th, F.xxhash64(F.col(f"`{text}`")))
    own = base.select("doc_id", F.col(th).alias("th"), F.col(f"`{text}`").alias("text"))
    spent: list[DataFrame] = []

    def held(df: DataFrame, name: str) -> DataFrame:
        spent.append(stored(df, name))
        return spent[-1]

    place = ("doc_id", "th", "start", "n")
    marks, k = [], min(K, length)
    table = held(passage_table(own.withColumn("at", F.lit(0)), length, k), "passages")
    while True:
        carried = [c for c in table.columns if c == "passage"]
        seen = table.groupBy("h").agg(F.count("*").alias("places"), F.min("ch").alias("lo"), F.max("ch").alias("hi"), F.max("loops").alias("loops")).where("places > 1 or loops")
        shared = held(table.drop("loops").join(seen.select("h", F.expr("lo = hi and places > 1").alias("same")), "h"), "shared")
        discard(table)
        kinds = shared.where("not same").groupBy("h", "ch").agg(F.count("*").alias("c"), F.min(F.struct(*place, *carried)).alias("one"))
        kinds = held(kinds.select("h", "ch", "c", "one.*"), "kinds")
        marks.append(shared.where("same").select(*place))
        marks.append(shared.where("not same").join(kinds.where("c > 1").select("h", "ch"), ["h", "ch"], "left_semi").select(*place))
        parts = kinds if carried else held(gathered(own, kinds, length), "parts")
        crowds = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where(F.col("kinds") > crowd).select("h")
        if k == length or not crowds.limit(1).count():
            marks.append(indexed(parts, length))
            break
        crowds = held(crowds, "crowds")
        marks.append(indexed(parts.join(crowds, "h", "left_anti"), length))
        many = parts.join(crowds, "h", "left_semi").select("doc_id", "th", F.col("start").alias("at"), F.col("passage").alias("text"))
        k = length - (length - k) // 4
        table = held(passage_table(many, length, k, True), "passages")
    places = marks[0]
    for more in marks[1:]:
        places = places.unionByName(more)
    lists = places.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n")).alias("marks"))
    spans = stored(merged(lists, length), "marks")
    for df in spent:
        discard(df)
    joined = base.alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col(f"d.{th}") == F.col("s.th")), "left")
    return joined.select("d.*", F.coalesce("s.spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans")).drop(th)


def without_spans(docs: DataFrame, output: tuple[str, ...], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append what `output` names of the text without its spans.

    kept: the remaining text, where a span that cuts a character leaves the whole character; n_bytes, n_removed, n_spans,
    kept_sha256: of the bytes of the text without the spans, exactly.
    """
    kinds = {"kept": "string", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    read = list(dict.fromkeys([*(keep if keep is not None else docs.columns), text, "spans"]))
    source = docs.select(*[f"`{c}`" for c in read])
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in output]
    schema = widened([source.schema[c] for c in kept], [(o, kinds[o]) for o in output])

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, text, LEAN_BYTES):
            data, offsets = buffers(part.column(text))
            spans = part.column("spans")
            lists = spans.flatten()
            count = spans.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(count)), count)
            a, b = (lists.field(i).to_numpy().astype(np.int64) + offsets[row] for i in (0, 1))
            gone = np.zeros(len(data) + 1, np.int8)
            np.add.at(gone, a, 1)
            np.add.at(gone, b, -1)
            gone = np.cumsum(gone[:-1], dtype=np.int8) > 0
            left = np.concatenate([[0], np.cumsum(~gone)])[offsets]
            made = {"n_bytes": lambda: pa.array(np.diff(offsets)), "n_removed": lambda: pa.array(np.diff(offsets) - np.diff(left)), "n_spans": lambda: pa.array(count), "kept_sha256": lambda: pa.array(sha256_rows(data[~gone], left))}

            def text_left():
                tail = (data & 0xC0) == 0x80
                lead = np.maximum.accumulate(np.where(~tail, np.arange(len(data)), 0)) if len(data) else np.zeros(0, np.int64)
                alive = np.zeros(len(data), bool)
                alive[lead[~gone]] = True
                alive = alive[lead]
                at = np.concatenate([[0], np.cumsum(alive)])[offsets]
                raw = data[alive].tobytes()
                return pa.array([None if null else raw[x:y].decode() for x, y, null in zip(at[:-1].tolist(), at[1:].tolist(), part.column(text).is_null().to_pylist(), strict=True)], pa.string())

            made["kept"] = text_left
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(made[o]() for o in output)], names=[*kept, *output])

    return source.mapInArrow(lambda batches: given_back(run(batches)), schema)
