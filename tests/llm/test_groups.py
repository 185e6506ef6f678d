"""Operators on groups of rows: near duplicates, repeats, decontamination, the pipeline."""

import random

import numpy as np
import pytest

from tests.llm import brute


def corpus(seed=2, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 90))] for _ in range(n)]
    out = []
    for i, w in enumerate(base):
        out.append(" ".join(w))
        if i % 3 == 0:
            for _ in range(3):
                v = list(w)
                for _ in range(max(1, len(v) // 25)):
                    v[rng.randrange(len(v))] = rng.choice(words)
                out.append(" ".join(v))
    passage = " ".join(rng.choice(words) for _ in range(60))
    out += [f"{out[k]} {passage} {out[k + 1]}" for k in range(0, 12, 2)] + ["ab" * 300, "Same words", "same WORDS", "", None, "  ", "one"]
    rng.shuffle(out)
    return list(enumerate(out))


def frame(spark, rows, extra="'clash' as kept, 'x' as spans_"):
    return spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", *extra.split(", "))


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    from datagauge.llm.minhash import near_duplicates

    rows = corpus()
    got = near_duplicates(frame(spark, rows).repartition(3), words=words).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute.near_duplicates(rows, words)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    from datagauge.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 3)
    rows = corpus(5)
    got = minhash.near_duplicates(frame(spark, rows), words=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute.near_duplicates(rows, 2)


def test_near_duplicates_of_odd_ids(spark):
    from datagauge.llm.minhash import near_duplicates

    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (3, "x y z"), (3, "a b c"), (4, "x y z"), (None, "a b c"), (5, None)], "doc_id bigint, text string")
    got = near_duplicates(df, words=2).collect()
    assert len(got) == 8
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (None, None, True), (5, 5, True)}
    assert near_duplicates(df.limit(0)).count() == 0


def test_sketches_fill_and_estimate():
    from datagauge.llm.minhash import SIZE, sketch

    rng = np.random.default_rng(0)
    for n in (1, 2, 30, 3000):
        s = sketch(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        assert len(s) == SIZE and int(s.max()) >> 48 < 2 * SIZE
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    assert abs((sketch(a) == sketch(b)).mean() - 800 / 1200) < 0.12


@pytest.mark.parametrize("crowd", [2000, 2])
def test_repeats(spark, crowd):
    from datagauge.llm.repeats import repeated_spans, without_spans

    rows = [*corpus(), (900, "é" * 80 + "z"), (901, "q" + "é" * 80)]
    rows += [rows[3], (None, rows[4][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'clash' as n_bytes", "'clash' as spans", "1 as th", "1 as marks").repartition(3)
    out = without_spans(repeated_spans(df, 40, crowd=crowd), ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=repr) == brute.repeats(rows, 40)
    assert all(r.kept is None for r in out if r.text is None)
    assert repeated_spans(df.limit(0), 40).count() == 0


def test_a_hash_of_very_many_passages_is_cut_again(spark):
    from datagauge.llm.repeats import passage_table, repeated_spans, without_spans

    rng = random.Random(8)
    said = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common, twice = said(70), said(50)
    rows = [(i, said(50) + common + said(50)) for i in range(3_400)] + [(5_000 + i, said(30) + twice + said(30)) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    table = passage_table(df.selectExpr("doc_id", "doc_id as th", "text", "0 as at"), 40, 32)
    assert table.select("h", "ch").distinct().groupBy("h").count().agg({"count": "max"}).first()[0] > 2_000
    got = without_spans(repeated_spans(df, 40), ("n_bytes", "n_removed", "n_spans", "kept_sha256")).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == brute.repeats(rows, 40)


def test_run_index_matches_every_place():
    from datagauge.llm.run_index import RunIndex

    rng = random.Random(2)

    def prefix(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    for _ in range(40):
        strings = list(dict.fromkeys(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 8))))
        index = RunIndex(strings)
        places = [(c, i) for c, s in enumerate(strings) for i in range(len(s) + 1)]
        for got, (c, i) in zip(index.matching_statistics(), places, strict=True):
            assert got == max((prefix(strings[c][i:], strings[d][j:]) for d, j in places if (d, j) != (c, i)), default=0)
        assert index.runs <= len(places)


def test_decontamination(spark):
    from datagauge.llm.decontamination import contaminated

    rng = random.Random(7)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((30, 12, 60, 5, 3, 1, 30))] + [(50, None), (51, ""), (0, "another of the same id here")]
    docs = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        if i % 2:
            own = items[i % 7][1].split()
            if i % 4 == 1 and len(own) > 12:
                own[rng.randrange(len(own))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() if i % 3 == 0 and x.isascii() else x + "," * (i % 5 == 0) for x in own]
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), docs[1]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as similarity")
    got = contaminated(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    best = {}
    for r in got:
        best[r.doc_id, r.item_id] = max(best.get((r.doc_id, r.item_id), 0), r.similarity)
    assert best == pytest.approx(brute.contaminated(docs, items)) and best
    assert contaminated(df.limit(0), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
    assert contaminated(df, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_the_index_finds_all_within_the_radius():
    from datagauge.llm.decontamination import RADIUS, Items

    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    items = Items([(i, " ".join(rng.choice(words, 40))) for i in range(20)], 0.8)
    (own,) = items.classes[5]
    prints = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    prints[:1000] = own.prints[rng.integers(0, 20, 1000)]
    for i in range(1000):
        for bit in rng.choice(64, rng.integers(0, 30), replace=False):
            prints[i] ^= np.uint64(1 << int(bit))
    near = np.bitwise_count(prints[:, None] ^ own.prints) <= RADIUS
    assert {*zip(*(x.tolist() for x in own.probe(prints)), strict=True)} == {*map(tuple, np.argwhere(near).tolist())} and near.sum() > 500


def test_fingerprints_are_majorities_of_bits():
    from datagauge.llm.decontamination import lanes, planes, window_prints

    g = np.random.default_rng(2).integers(0, 1 << 63, 700, dtype=np.uint64)
    bits = np.unpackbits(g.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(int)
    for width, stride in ((1, 1), (12, 2), (55, 8), (127, 1), (128, 4), (600, 16)):
        lane = lanes(width)
        got = window_prints(planes(g, lane), width, stride)
        where = [lane * (b // lane) + lane - 1 - b % lane for b in range(64)]
        for n, at in enumerate(range(0, 700 - width + 1, stride)):
            most = bits[at : at + width].sum(0) > width // 2
            assert all(bool(int(got[n]) >> where[b] & 1) == most[b] for b in range(64))
        assert len(got) == len(range(0, 700 - width + 1, stride))
    assert len(window_prints(planes(g[:3], 8), 5)) == 0


def test_recall_of_the_fingerprints():
    from datagauge.llm.decontamination import Items

    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(5000)]
    said = lambda n: " ".join(rng.choice(words, n))
    items = [(i, said(n)) for i, n in enumerate(rng.integers(15, 60, 200))]
    cuts = [text.split()[: len(text.split()) - int(rng.random() * 0.11 * (len(text.split()) - 4))] for _, text in items * 2]  # a similarity of 0.8 to 1
    texts = [" ".join([said(rng.integers(0, 60)), *cut, said(rng.integers(0, 60))]) for cut in cuts]
    raw = [t.encode() for t in texts]
    index = Items(items, 0.8)
    got = {(r, i, round(v, 9)) for r, i, v, *_ in index.matches(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))}
    want = {(r, i, round(v, 9)) for r, t in enumerate(texts) for (_, i), v in brute.contaminated([(r, t)], [items[r % 200]]).items()}
    assert got <= want and len(want) > 300 and len(got) >= 0.98 * len(want)
    alone = {(r, i, round(v, 9)) for r, x in enumerate(raw) for _, i, v, *_ in index.matches(np.frombuffer(x, np.uint8), np.array([0, len(x)]))}
    assert alone == got  # whatever stands beside a document


def vectors():
    rng = np.random.default_rng(3)
    out = []
    for _ in range(12):
        c = rng.normal(size=8)
        out += [c + rng.normal(size=8) * 0.12 * rng.random() for _ in range(rng.integers(1, 12))]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(out)]
    return rows


@pytest.mark.parametrize("block", [2048, 4])
def test_embeddings(spark, block):
    from datagauge.llm.embeddings import near_vectors

    rows = vectors()
    x = np.array([v for _, v in rows])
    x /= np.sqrt((x * x).sum(1))[:, None]
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    links = [(i, j) for i in range(len(x)) for j in range(i) if hit[i, j]]
    found = brute.components(range(len(x)), links)
    bad = [(500, None), (501, [0.0] * 8), (502, [float("nan")] + [1.0] * 7), (503, [None] + [1.0] * 7), (504, []), rows[2], (None, rows[0][1])]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>").selectExpr("*", "'clash' as kept", "1 as label")
    got = near_vectors(df, block=block).collect()
    assert len(got) == len(rows) + 7
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.kept) == (0, True)
        else:
            want = (0, r.vec_id, True) if r.vec_id >= 500 else (int(hit[r.vec_id].sum()), found[r.vec_id], found[r.vec_id] == r.vec_id)
            assert (r.n_links, r.component_id, r.kept) == want
    assert near_vectors(df.limit(0)).count() == 0 and near_vectors(df.where("vec_id >= 500")).count() == 5


@pytest.mark.parametrize(("block", "sample"), [(2048, 4096), (4, 1)])
def test_embeddings_of_several_lengths(spark, block, sample):
    from datagauge.llm.embeddings import near_vectors

    short = [v for _, v in vectors()]
    every = [*short, *[[*v, *v[:3]] for v in short], [1.0] * 32]
    links = []
    for n in {len(v) for v in every}:
        at = [i for i, v in enumerate(every) if len(v) == n]
        x = np.array([every[i] for i in at])
        x /= np.sqrt((x * x).sum(1))[:, None]
        links += [(at[i], at[j]) for i, j in np.argwhere(x @ x.T >= 0.95).tolist() if i != j]
    found = brute.components(range(len(every)), links)
    got = near_vectors(spark.createDataFrame(list(enumerate(every)), "vec_id bigint, embedding array<double>"), block=block, sample=sample).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (sum(a == i for a, _ in links), found[i]) for i in range(len(every))}
    assert {len(every[a]) for a, _ in links} == {8, 11}


def shuffled(spark):
    """Rows that stages have written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(i) for i in range(stages.size()))}


def test_embeddings_travel_in_few_copies(spark):
    """Random vectors are all about equally far, so that no bound keeps them from a cell; yet a vector goes to few tasks, and no link is lost."""
    from datagauge.llm.embeddings import near_vectors

    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    near = rng.integers(0, 2700, 300)
    x[2700:] = x[near] + rng.normal(size=(300, 64)) * rng.uniform(0.2, 0.45, (300, 1))  # cosines about 0.95
    u = x / np.sqrt((x * x).sum(1))[:, None]
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    assert 300 < hit.sum() < 600
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id bigint, embedding array<double>")
    before = shuffled(spark)
    got = near_vectors(df, block=64, sample=500).collect()
    wrote = sum(n for k, n in shuffled(spark).items() if k not in before)
    found = brute.components(range(len(x)), [(i, j) for i, j in np.argwhere(hit).tolist() if i < j])
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (int(hit[i].sum()), found[i]) for i in range(len(x))}
    assert wrote < 20 * len(x)


@pytest.mark.parametrize("width", [3, 16, 40])
def test_no_cosine_is_over_its_bound(width):
    from datagauge.llm.embeddings import ROUNDING, basis, coordinates, scaled

    rng = np.random.default_rng(width)
    x = np.concatenate([rng.normal(size=(200, width)), 5 + rng.normal(size=(200, width)), np.ones((2, width)), np.eye(width)])
    scaled(x)
    for directions in (basis(x), basis(x[:1])):
        assert np.allclose(directions.T @ directions, np.eye(directions.shape[1]), atol=1e-12)
        y = coordinates(x, directions)
        assert (x @ x.T <= y @ y.T + ROUNDING / 3).all()


def test_pipeline_stages_on_their_own_input(spark, sf_dir):
    import corpus_pipeline as pipeline
    from datagauge.llm.quality import classify

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        kept[name] = (docs, out)
        if name != "tokens":
            assert out.columns == docs.columns
        docs = out
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    start, quality = kept["quality"]
    accepted = {r.doc_id for r in classify(start, labels, 0.3, ["doc_id"]).where("predicted = 1").collect()}
    assert {r.doc_id for r in quality.collect()} == accepted
    before, after = kept["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == {i for i, (_, _, k) in brute.near_duplicates(rows, 5).items() if k}
    before, after = kept["repeats"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    removed = {i: (n, gone) for i, n, gone, *_ in brute.repeats(rows, 200)}
    for r in after.collect():
        assert r.n_chars == len(r.text) and 0 <= len(r.text.encode()) - (removed[r.doc_id][0] - removed[r.doc_id][1]) < 40
    before, after = kept["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {d for d, _ in brute.contaminated([(r.doc_id, r.text) for r in before.collect()], items)}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - leaks
    assert {r.doc_id for r in kept["tokens"][1].collect()} == {r.doc_id for r in after.collect()}


def test_pipeline_keeps_one_row_of_copies(spark, sf_dir):
    import corpus_pipeline as pipeline

    rng = random.Random(4)
    said = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    a, b, c, d, e, near = (said(60) for _ in range(6))
    leak = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 100").orderBy("item_id").first().text
    rows = [(1, a), (1, a), (None, b), (None, b), (None, c), (2, d), (2, e), (2, e), (3, near), (3, near + " more"), (None, leak), (4, leak + " " + said(1)), (5, "other " + said(50)), (None, ""), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "length(text) as n_chars").repartition(3)
    for name in ("near_duplicates", "repeats", "decontamination"):
        docs = dict(pipeline.STAGES)[name](spark, docs, sf_dir)
        if name == "near_duplicates":
            assert sum(r.text in (near, near + " more") for r in docs.collect()) == 1
    got = docs.collect()
    assert sorted((r.doc_id or 0, r.text) for r in got if r.doc_id != 3) == sorted([(1, a), (0, b), (0, c), (2, d), (2, e), (5, rows[12][1]), (0, ""), (6, "")])
    assert [r.text for r in got if r.doc_id == 3] in ([near], [near + " more"])


def test_decontamination_drops_rows_without_id(spark, sf_dir):
    import corpus_pipeline as pipeline

    leak = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 100").orderBy("item_id").first().text
    docs = spark.createDataFrame([(None, leak), (None, "clean"), (1, leak), (1, "clean too"), (2, None)], "doc_id bigint, text string")
    got = pipeline.decontamination(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, "clean"), (1, "clean too"), (2, "")]


def test_pipeline_keeps_columns_of_any_name(spark, sf_dir):
    import corpus_pipeline as pipeline

    names = ("score", "predicted", "held_out", "kept", "spans", "row", "key", "own", "copies", "th", "component_id", "n_shingles", "marks", "similarity", "a b")
    start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None), (10**9, "", "x"), (10**9 + 1, None, "y"), (10**9 + 2, "word " * 30_000, None), (10**9 + 2, "word " * 30_000, None)], "doc_id bigint, text string, lang string")
    docs = start.unionByName(odd, allowMissingColumns=True).selectExpr("*", *[f"concat('{n}', doc_id) as `{n}`" for n in names])
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        docs = spark.createDataFrame(out.collect(), out.schema)
        for r in docs.collect():
            assert all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for n in names)
            assert name in ("repeats", "decontamination") or r.text == texts[r.doc_id]
    assert docs.count() > 50
    assert pipeline.tokens(spark, docs, sf_dir).count() == docs.count() and pipeline.tokens(spark, docs.limit(0), sf_dir).count() == 0


class Worker:
    """Stands for a DataFrame of documents: runs what a worker would run on a batch of them, here."""

    def __init__(self, batch, schema):
        from types import SimpleNamespace

        self.batch, self.schema, self.columns, self.rows = batch, schema, schema.names, 0
        self.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))

    def select(self, *columns):
        return self

    def withColumn(self, name, column):
        return self

    def mapInArrow(self, run, schema):
        self.rows = sum(b.num_rows for b in run(iter([self.batch])))
        return self


@pytest.mark.parametrize("stage", ["quality", "signatures", "shingle_sets", "passages", "without_spans"])
def test_workers_hold_little_beside_a_large_batch(spark, stage, monkeypatch):
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa
    from pyspark.sql.types import StructType

    from datagauge.llm import minhash, quality, repeats

    rng = random.Random(4)
    rows = [" ".join(f"{rng.getrandbits(24):x}" for _ in range(250)) for _ in range(2_000)]
    assert sum(map(len, rows)) > 3_000_000
    schema = StructType.fromDDL("doc_id bigint, th bigint, at int, text string, spans array<struct<start:int,stop:int>>")
    spans = pa.array([[{"start": 5, "stop": 300}]] * len(rows), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
    ids = pa.array(range(len(rows)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array([0] * len(rows), pa.int32()), pa.array(rows), spans], names=schema.names)
    monkeypatch.setattr(minhash, "bands", lambda x: x[:2])  # sketches are of one text each
    made = {
        "quality": lambda docs: quality.score(docs, SimpleNamespace(score=lambda x: x[:, 0])),
        "signatures": lambda docs: minhash.signatures(docs, 5, "text"),
        "shingle_sets": lambda docs: minhash.shingle_sets(docs, 5, "text", ["doc_id"]),
        "passages": lambda docs: repeats.passage_table(docs, 200, repeats.K),
        "without_spans": lambda docs: repeats.without_spans(docs, ("kept",)),
    }[stage]
    docs = Worker(batch, schema)
    tracemalloc.start()
    try:
        made(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert docs.rows >= len(rows) and peak < 30_000_000
