"""Definitions, hand-made cases and refusals of single operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from datagauge.functions import identity, scalars
from datagauge.operators import accounting, baselines, contracts, diversify, estimators, games, graph, inference, retrieval, splits, workload
from datagauge.sources import readers


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_contract_refuses(spark):
    df = spark.createDataFrame([(1, 0.5), (1, None)], "k int, v double")
    for kwargs in ({"columns": ["x"]}, {"unique": ["k"]}, {"rows": 3}, {"rules": {"v": F.col("v") > 0}}, {"distinct": {"k": 2}}):
        with pytest.raises(contracts.ContractError):
            contracts.check(df, **kwargs)
    assert contracts.check(df, columns=["k"], rows=2, distinct={"k": 1}) is df
    with pytest.raises(contracts.ContractError):
        contracts.one_to_one(spark.createDataFrame([(1, 1), (1, 2)], "a int, b int"), "a", "b")
    with pytest.raises(contracts.ContractError):
        contracts.outside(df, "v")
    assert contracts.lineage_allowed("a", "a", "derived") and not contracts.lineage_allowed("a", "b", "derived")
    assert contracts.lineage_allowed("a", "b", "intrinsic", "h", "h") and not contracts.lineage_allowed("a", "b", "intrinsic", "h", "g")


def test_identity_is_that_of_json(spark):
    import hashlib
    import json

    got = spark.createDataFrame([(7, "é|x")], "b int, a string").select(identity.canonical_uid("p_", b=F.col("b"), a=F.col("a")), identity.seed_of(F.sha2(F.lit("q"), 256))).first()
    assert got[0] == "p_" + hashlib.sha256(json.dumps({"a": "é|x", "b": 7}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert got[1] == int.from_bytes(hashlib.sha256(b"q").digest()[:8], "big") >> 1
    with pytest.raises(ValueError):
        identity.digest_of(float("nan"))


def test_scalars(spark):
    x = spark.createDataFrame([("5",), ("-1",), ("x",), (None,), ("NaN",), ("1e9",)], "v string")
    assert [r[0] for r in x.select(scalars.nonnegative(F.col("v"))).collect()] == [5.0, None, None, None, None, 1e9]
    assert [r[0] for r in x.select(scalars.size_class(F.col("v"))).collect()] == ["tiny", "tiny", "unknown", "unknown", "xlarge", "xlarge"]
    t = spark.createDataFrame([("a,b|unknown||a",), (None,), ("",)], "s string").select(scalars.token_set(F.col("s")))
    assert [r[0] for r in t.collect()] == [["a", "b"], [], []]
    one = spark.createDataFrame([(["a"], ["a", "b"], [])], "a array<string>, b array<string>, e array<string>")
    got = one.select(scalars.jaccard(F.col("a"), F.col("b")), scalars.jaccard(F.col("e"), F.col("e"), 1.0), scalars.jaccard(F.col("a"), F.col("e"))).first()
    assert tuple(got) == (0.5, 1.0, 0.0)
    with pytest.raises(Exception, match="positive norm"):
        spark.createDataFrame([([0.0],)], "v array<double>").select(scalars.unit(F.col("v"))).collect()
    assert spark.sql("select 'Alpha b-c é_1 - x:' as t").select(scalars.terms(F.col("t"))).first()[0] == ["alpha", "b-c", "é_1", "x"]


def test_baselines_by_hand(spark):
    train = spark.createDataFrame([(1, 10, 0.2), (1, 20, 0.6), (2, 10, 0.9)], "t int, f int, y double")
    test = spark.createDataFrame([(1, 10), (9, 10), (1, 99)], "t int, f int")
    mean = 1.7 / 3
    want = {"GM": [mean] * 3, "TD_MEAN": [0.4, mean, 0.4], "FLOW_MEAN": [0.55, 0.55, mean], "FREQ": [0.2, mean, mean], "TF_ADD": [0.3, mean - 0.1, 0.4]}
    for name, values in want.items():
        got = {(r.t, r.f): r.prediction for r in baselines.baseline(name, train, test, "y", "t", "f").collect()}
        assert [got[k] for k in ((1, 10), (9, 10), (1, 99))] == pytest.approx(values), name
    with pytest.raises(contracts.ContractError):
        baselines.baseline("GM", train, train, "y", "t", "f")
    with pytest.raises(contracts.ContractError):
        baselines.unique_best(spark.createDataFrame([(0.1,), (0.1 + 1e-13,)], "e double"), "e")


def test_undefined_is_not_zero(spark):
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double")
    got = baselines.regression_metrics(flat, "y", "p").first()
    assert got.r2 is None and got.spearman is None and got.mae == 0.5
    draws = spark.createDataFrame([(0.0,), (float("nan"),)], "v double")
    assert tuple(inference.interval(draws, "v").first()) == ("UNDEFINED", None, None)
    with pytest.raises(contracts.ContractError):
        inference.interval(spark.createDataFrame([(float("inf"),)], "v double"), "v")


def test_weights_are_repeated_rows(spark):
    rng = np.random.default_rng(1)
    data = [(float(a), float(b), int(w)) for a, b, w in zip(rng.integers(0, 5, 53), rng.integers(0, 5, 53), rng.integers(0, 4, 53), strict=True)]
    df = spark.createDataFrame(data, "y double, p double, w int")
    a = baselines.weighted_metrics(df, "y", "p", "w").first()
    b = baselines.regression_metrics(df.select("y", "p", F.explode(F.expr("case when w > 0 then sequence(1, w) end"))), "y", "p").first()
    assert (a.n, a.mae, a.r2, a.spearman) == pytest.approx((b.n, b.mae, b.r2, b.spearman), abs=1e-12)


def test_bootstrap_streams(spark):
    w = inference.bootstrap_weights(spark, {"namespace": "n"}, 4, 10).groupBy("replicate").agg(F.sum("weight").alias("s"))
    assert [r.s for r in w.collect()] == [10] * 4
    got = inference.draw(inference.canonical({"b": 1, "a": "é"}), 10, 5)
    assert (got == inference.draw('{"a":"é","b":1}'.encode(), 10, 5)).all()


def test_paired_effect(spark):
    pairs = spark.createDataFrame([(i, 0.1 * i, 0.05 * i) for i in range(1, 30)], "u int, a double, b double")
    weights = inference.bootstrap_weights(spark, {"namespace": "n"}, 99, 29)
    got = inference.paired_effect(pairs, "u", "a", "b", weights, 99).first()
    assert got.mean == pytest.approx(0.75) and got.low < 0.75 < got.high and got.win == 1 and got.p == 0.01


def test_holm_keeps_order(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    assert {r.k: round(r.holm_p, 9) for r in inference.holm(p, "k").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_hashed_index_is_the_whole_number_modulo_n(spark):
    import hashlib

    got = spark.range(3).select(inference.hashed_index("s", 1000003, F.col("id"), F.lit(4))).collect()
    assert [r[0] for r in got] == [int(hashlib.sha256(f"s|n=1000003|replicate={i}|draw=4".encode()).hexdigest(), 16) % 1000003 for i in range(3)]


def test_splits(spark):
    df = spark.range(97).select(F.col("id").alias("uid"), (F.col("id") % 7).alias("g"), (F.col("id") % 3).alias("h"))
    fold = splits.hashed_fold(df, "uid", "n")
    counts = [r["count"] for r in fold.groupBy("fold").count().collect()]
    assert max(counts) - min(counts) <= 1
    import hashlib

    order = sorted(range(97), key=lambda i: hashlib.sha256(f"n|{i}".encode()).hexdigest())
    assert {r.uid: r.fold for r in fold.collect()} == {u: i % 5 for i, u in enumerate(order)}
    groups = splits.balanced_folds(df, "g", "n", 5, 2)
    assert max(r["count"] for r in groups.groupBy("fold").count().collect()) <= 2
    long = splits.long_folds(df.join(groups, "g"), "uid")
    assert all(r.valid for r in splits.split_is_valid(long.join(df, "uid"), "uid", "g").collect())
    assert not all(r.valid for r in splits.split_is_valid(long.join(df, "uid"), "uid", "h").collect())
    with pytest.raises(contracts.ContractError):
        splits.balanced_folds(df, "g", "n", 5, 1)
    inner = splits.inner_splits(df, "uid", "g", "n")
    assert inner.where("role = 'TEST'").count() == 97
    registry = splits.players(df, ["g"], "n")
    assert registry.agg(F.sum("observations")).first()[0] == 97 and splits.crosswalk(df, registry, ["g"]).count() == 97
    with pytest.raises(Exception, match="no player"):
        splits.crosswalk(df.withColumn("g", F.lit(99).cast("bigint")), registry, ["g"]).collect()
    subsets = splits.quartile_subsets(df, "uid", "g", "n", 3, 2)
    assert [r["count"] for r in subsets.groupBy("replicate").count().collect()] == [12, 12]


def test_temporal_blocks_match_a_loop(spark):
    import datetime

    rng = np.random.default_rng(3)
    start = datetime.datetime(2024, 1, 1)
    times = sorted(start + datetime.timedelta(hours=int(h)) for h in rng.integers(0, 400, 300))
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    distinct = sorted(set(times))
    cum = [sum(t <= d for t in times) for d in distinct]
    want, low = [], 0
    for f in (0.2, 0.4, 0.6, 0.8):
        best = min(range(low, len(distinct) - 1), key=lambda i: (abs(cum[i] - f * 300), i))
        want.append(distinct[best])
        low = best + 1
    assert splits.temporal_boundaries(df, "ts") == want


def test_bm25_by_hand(spark):
    docs = ["Alpha alpha b-c", "alpha gamma", "b-c gamma", "unmatched", ""]
    df = spark.createDataFrame(list(enumerate(docs)), "d int, text string")
    asked = spark.createDataFrame([(0, "alpha alpha"), (1, "zzz")], "q int, text string")
    scores = retrieval.sparse_scores(retrieval.query_terms(asked, "q", "text"), retrieval.bm25_weights(df, "d", "text"), "q", "d")
    ranked = retrieval.rank(retrieval.with_zeros(scores, asked, df, "q", "d"), ["q"], "d").collect()
    assert [r.d for r in sorted(ranked, key=lambda r: r["rank"]) if r.q == 1] == [0, 1, 2, 3, 4]
    tokens = [x.lower().split() for x in docs]
    mean, idf = sum(map(len, tokens)) / 5, math.log(1 + (5 - 2 + 0.5) / 2.5)
    want = [2 * idf * t.count("alpha") * 2.2 / (t.count("alpha") + 1.2 * (0.25 + 0.75 * len(t) / mean)) for t in tokens]
    assert {r.d: r.score for r in ranked if r.q == 0} == pytest.approx(dict(enumerate(want)), abs=1e-8)
    with pytest.raises(contracts.ContractError):
        retrieval.bm25_weights(spark.createDataFrame([(1, "")], "d int, text string"), "d", "text")


def test_fusion_and_rerank(spark):
    a = spark.createDataFrame([(0, "b", 1), (0, "a", 2), (0, "c", 3)], "q int, d string, rank int")
    b = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3)], "q int, d string, rank int")
    fused = retrieval.fused_ranking(retrieval.fuse({"x": a, "y": b}, "q", "d"), "q", "d").orderBy("fused_rank").collect()
    assert [r.d for r in fused] == ["a", "b", "c"] and fused[0].score == pytest.approx(1 / 61 + 1 / 62)
    ranked = spark.createDataFrame([(0, i, i, float(i)) for i in range(1, 6)], "q int, d int, rank int, s double")
    assert [r.new_rank for r in retrieval.rerank_head(ranked, "q", "d", "s", 3).orderBy("d").collect()] == [3, 2, 1, 4, 5]


def test_greedy_steps_are_best(spark):
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(12, 5)), rng.random(12)
    s = diversify.similarities(x)
    chosen = diversify.facility_location(s, 4)
    for k in range(4):
        value = lambda i, k=k: s[:, [*chosen[:k], i]].max(1).sum()
        assert value(chosen[k]) == pytest.approx(max(value(i) for i in range(12) if i not in chosen[:k]))
    assert diversify.mmr(q, s, 12, 1.0) == sorted(range(12), key=lambda i: -q[i])
    d = 1 - s
    far = diversify.farthest(d, 3, 0)
    assert far[0] == 0 and far[1] == int(d[0].argmax())


def test_determinantal_rank(spark):
    x = np.vstack([np.eye(4), np.eye(4)])
    values, vectors = diversify.determinantal_kernel(np.ones(8), x)
    assert diversify.determinantal_sample(values, vectors, 5, np.random.default_rng(0)) is None
    for seed in range(20):
        got = diversify.determinantal_sample(values, vectors, 4, np.random.default_rng(seed))
        assert len({i % 4 for i in got}) == 4
    two = diversify.determinantal_kernel(np.zeros(3), np.array([[1.0, 0], [0.8, 0.6], [0, 1.0]]))
    counts = np.zeros(3)
    rng = np.random.default_rng(9)
    for _ in range(4000):
        counts[sum(diversify.determinantal_sample(*two, 2, rng)) - 1] += 1
    weight = np.array([0.36, 1.0, 0.64])
    assert counts / 4000 == pytest.approx(weight / weight.sum(), abs=0.03)


def test_shapley_axioms(spark):
    rng = np.random.default_rng(5)
    u = rng.random(16)
    df = spark.createDataFrame([(i, float(u[i])) for i in range(16)], "mask bigint, utility double")
    got = {r.player: r for r in games.exact_values(df, 4).collect()}
    assert sum(r.shapley for r in got.values()) == pytest.approx(u[15] - u[0])
    want = np.zeros(4)
    for order in itertools.permutations(range(4)):
        mask = 0
        for p in order:
            want[p] += u[mask | 1 << p] - u[mask]
            mask |= 1 << p
    assert [got[p].shapley for p in range(4)] == pytest.approx(want / 24)
    assert games.beta_weights(3) == pytest.approx([2 / 3, 4 / 15, 1 / 15])


def test_sampled_values_meet_exact_ones(spark):
    design = games.prefix_coalitions(games.permutation_design(spark, "n", 1, 4, 24))
    scores = [0.1, 0.4, 0.2, 0.3]
    utilities = design.select("coalition").distinct().select("coalition", F.aggregate(F.transform(F.split("coalition", ","), lambda x: F.element_at(F.array(*[F.lit(s) for s in scores]), x.cast("int") + 1)), F.lit(0.0), lambda s, x: s + x).alias("utility"))
    got = {r.player: r.shapley for r in games.permutation_values(design, utilities, 4, [24]).collect()}
    assert [got[p] for p in range(4)] == pytest.approx(scores)
    flips = games.bernoulli_design(spark, "n", 1, 3, 60)
    linear = flips.groupBy("row").agg(F.sum(F.col("inside") * (F.col("player") + 1.0)).alias("utility"))
    assert {r.status for r in games.reuse_values(flips, linear, [60]).collect()} == {"COMPLETE"}
    values = {r.player: r.value for r in games.ame(flips, linear).collect()}
    assert values[0] < values[1] < values[2]
    one = games.reuse_values(flips.where("player = 0 and row < 1"), linear, [1]).first()
    assert one.banzhaf is None and one.status == "INSUFFICIENT"


def test_curve_and_agreement(spark):
    got = games.curve(None, spark.createDataFrame([(0, 0.0), (1, 2.0), (2, 1.0)], "k int, utility double")).first()
    assert got.auc == 1.25 and got.normalised == 1.25
    v = spark.createDataFrame([(i, float(i), float(-i)) for i in range(1, 6)], "p int, a double, b double")
    got = games.value_agreement(v, "a", "b", "p").first()
    assert got.spearman == pytest.approx(-1) and got.reversed_pairs == 10 and got.same_rank == 1
    assert games.value_errors(v, "a", "a").first().largest == 0


def test_pagerank(spark):
    edges = spark.createDataFrame([("A::1", "B::1"), ("A::1", "B::1"), ("B::1", "A::2"), ("A::2", "A::2")], "src string, dst string")
    nodes = spark.createDataFrame([("A::1",), ("B::1",), ("A::2",), ("A::9",)], "node string")
    sources = spark.createDataFrame([("A::1",), ("A::9",)], "source string")
    fast = {(r.source, r.node): r.score for r in graph.pagerank_batches(nodes, edges, sources).collect()}
    assert fast[("A::9", "A::9")] == pytest.approx(1)
    assert sum(v for (s, _), v in fast.items() if s == "A::1") == pytest.approx(1)
    slow = {(r.source, r.node): r.score for r in graph.pagerank(nodes, edges, sources, tolerance=1e-3).collect()}
    assert {k: pytest.approx(v, abs=1e-2) for k, v in slow.items() if v > 1e-9} == {k: v for k, v in fast.items() if v > 1e-9}
    walked = graph.walks(edges, nodes.select(F.col("node").alias("root")), 4, 2).collect()
    assert len(walked) == 8 and all(not r.complete and r.walk == ["A::9"] for r in walked if r.root == "A::9")
    vectors = graph.skip_gram(graph.walks(graph.simple(edges), nodes.select(F.col("node").alias("root")), 4, 2), 4, 2, 2, 1, typed=True)
    assert vectors.count() == 4
    share = graph.negative_distribution(nodes, nodes.withColumn("count", F.lit(2))).groupBy("type").agg(F.sum("share").alias("s"))
    assert all(r.s == pytest.approx(1) for r in share.collect())


def test_estimators(spark):
    rng = np.random.default_rng(6)
    data = [(int(i), float(a), float(b), float(1 + 2 * a - b)) for i, (a, b) in enumerate(rng.normal(size=(40, 2)))]
    df = spark.createDataFrame(data, "i int, a double, b double, y double")
    got = estimators.ridge(df, df.drop("y"), ["a", "b"], "y", 1e-4).join(df.select("i", "y"), "i").agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert got < 1e-4
    with pytest.raises(contracts.ContractError):
        estimators.ridge(df, df.drop("y"), ["a"], "y", 0.5)
    scaled = estimators.standardised(df, df, ["a", "b"])
    assert scaled.agg(F.max(F.abs(F.col("a") ** 2 + F.col("b") ** 2 - 1))).first()[0] < 1e-9
    hot = estimators.one_hot_ridge(spark.createDataFrame([("x", 1.0), ("y", 3.0), ("x", 1.0), ("y", 3.0)], "k string, y double"), spark.createDataFrame([("x",), ("z",)], "k string"), ["k"], "y", 1e-4)
    assert {r.k: round(r.prediction, 1) for r in hot.collect()}["x"] == 1.0
    assert estimators.forest(df, df.drop("y"), ["a", "b"], "y", 5).count() == 40
    cells = spark.createDataFrame([(t, f, float(t * f), 1) for t in range(1, 4) for f in range(1, 4)], "task int, flow int, mean double, n int")
    tx = spark.createDataFrame([(t, [float(t), 1.0]) for t in range(1, 4)], "task int, x array<double>")
    fz = spark.createDataFrame([(f, [float(f), 1.0]) for f in range(1, 4)], "flow int, z array<double>")
    got = estimators.matrix_completion(cells, tx, fz, cells.select("task", "flow"), 2, 1e-6).collect()
    assert all(r.prediction == pytest.approx(r.task * r.flow, abs=0.05) for r in got)


def test_workload(spark):
    assert workload.root_quotas([10, 0, 5], 9, 2) and sum(workload.root_quotas([10, 0, 5], 9, 2)) == 9
    assert workload.even_quotas([10, 1, 10], 9) == [4, 1, 4]
    assert workload.root_quotas([100, 100, 100], 10, 0) == [4, 3, 3] and workload.root_quotas([16, 4, 0], 8, 1) == [5, 3, 0]
    assert workload.root_quotas([1, 1, 50], 40, 0) == [1, 1, 38] and workload.root_quotas([3, 3], 6, 9) == [3, 3]
    assert workload.root_quotas([9, 4, 1], 0, 0) == [0, 0, 0] and workload.root_quotas([9, 4, 1], 14, 2) == [9, 4, 1]
    assert workload.even_quotas([2, 9, 9], 11) == [2, 5, 4] and workload.even_quotas([0, 3, 8], 9) == [0, 3, 6]
    with pytest.raises(contracts.ContractError):
        workload.root_quotas([1], 2, 1)
    with pytest.raises(contracts.ContractError):
        workload.even_quotas([1, 1, 1], 4)
    texts = ['{"queries":["a","b","c"]}', '{"queries":["a","A ","c"]}', '{"queries":["a","b"]}', '{"queries":["a","b","c"],"x":1}', "no", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(workload.valid_response(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, False, False, False, False, False]
    flow = {"id": 1, "name": "Ａ  b", "parameter": [{"name": "z", "default_value": []}, {"name": "a", "default_value": "1"}], "component": {"identifier": "c", "flow": {"id": 2, "name": "x"}}}
    assert workload.flow_lines(flow).split("\n") == ["name: A b", "parameter a = 1", "parameter z = <MISSING>", "component c", "name: x"]
    with pytest.raises(ValueError, match="holds itself"):
        workload.flow_lines({"id": 1, "component": [{"identifier": "c", "flow": {"id": 1}}]})
    slots = spark.createDataFrame([(1, "g", "s", 1), (2, "g", "s", 2)], "slot int, group string, stratum string, slot_order int")
    pool = spark.createDataFrame([("r", "g", "s", "k", 1, "h")], "intent_id string, group string, stratum string, sampling_key string, support int, sha256 string")
    with pytest.raises(contracts.ContractError):
        workload.replacements(slots, pool)


def test_accounting_refuses(spark):
    df = spark.createDataFrame([("s", 1, 0.5), ("s", 2, 0.7), ("t", 1, 0.1)], "s string, seed int, v double")
    with pytest.raises(contracts.ContractError):
        accounting.seed_means(df, ["s"], "seed", ["v"], 2)
    assert accounting.seed_means(df.where("s = 's'"), ["s"], "seed", ["v"], 2).first().v == pytest.approx(0.6)


def test_sources(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 3\na 1 2 3\nb 4 5 6\n")
    assert rows(readers.word_vectors(spark, str(tmp_path / "v.txt")))[0] == ("a", [1.0, 2.0, 3.0])
    (tmp_path / "w.txt").write_text("3 3\na 1 2 3\n")
    with pytest.raises(contracts.ContractError):
        readers.word_vectors(spark, str(tmp_path / "w.txt"))
    np.save(tmp_path / "m.npy", np.eye(2))
    assert rows(readers.matrix(spark, str(tmp_path / "m.npy"))) == [(0, [1.0, 0.0]), (1, [0.0, 1.0])]
    (tmp_path / "d.json").write_text('{"a": 1}')
    assert readers.json_document(spark, str(tmp_path / "d.json")) == {"a": 1}
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert rows(readers.json_lines(spark, str(tmp_path / "l.jsonl"), "a int")) == [(1,), (2,)]
    (tmp_path / "c.csv").write_text("a,b\n1,0.1\n")
    assert rows(readers.csv(spark, str(tmp_path / "c.csv"), "a int, b double")) == [(1, 0.1)]
    sums = readers.checksums(spark, str(tmp_path))
    manifest = spark.createDataFrame([("c.csv", "0" * 64), ("none", "1" * 64)], "path string, sha256 string")
    assert {r.path: r.status for r in readers.integrity(sums, manifest).collect()} == {"c.csv": "changed", "none": "absent"}
    lists = spark.createDataFrame([("g", 1, "b"), ("g", 0, "a")], "g string, p int, v string")
    assert readers.support_lists(lists, "g", "p", "v").first().members == ["a", "b"]
    with pytest.raises(contracts.ContractError):
        readers.support_lists(lists.where("p > 0"), "g", "p", "v")
    readers.write_new(lists, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        readers.write_new(lists, str(tmp_path / "out"))


@pytest.mark.parametrize("name", ["value_agreement", "permutation_values", "reuse_values"])
def test_games_read_every_supplier(spark, monkeypatch, name):
    from datagauge.plans import ranking

    def result(late):
        rows = [(t, float(t >= 8) * late * (t % 5 + t % 3)) for t in range(24)]
        monkeypatch.setattr(ranking, "observations", lambda *_: spark.createDataFrame(rows, "task bigint, accuracy double"))
        return sorted(map(repr, ranking.QUERIES[name](spark, "").collect()))

    assert result(0.1) != result(0.0)


def test_rounds_of_replacements_can_be_chained(spark):
    census = spark.createDataFrame([(f"i{n}", "g", "s", f"{n:02d}", n, f"h{n}") for n in range(6)] + [("z", "g", "t", "00", 0, "h")], "intent_id string, `group` string, stratum string, sampling_key string, support int, sha256 string")
    active = spark.createDataFrame([("i0", "i0", 2), ("i1", "i1", 1), ("z", "z", 2)], "intent_id string, origin string, attempt int")
    used = active.select("intent_id")
    marked = spark.createDataFrame([("i0", "DUPLICATE"), ("i1", "DUPLICATE"), ("z", "KEPT")], "intent_id string, status string")
    assert {r.intent_id: (r.attempt, r.next_action) for r in workload.after_duplicates(active, marked).collect()} == {"i0": (3, "REPLACE"), "i1": (2, "NEXT_ATTEMPT"), "z": (2, "KEEP")}
    after, used = workload.next_round(census, active, spark.createDataFrame([("i0",)], "intent_id string"), used)
    assert {r.origin: r.intent_id for r in after.collect()} == {"i0": "i2", "i1": "i1", "z": "z"} and used.count() == 4
    after, used = workload.next_round(census, after.drop("status"), spark.createDataFrame([("i2",), ("i1",), ("z",)], "intent_id string"), used, keep_missing=True)
    assert {r.origin: (r.intent_id, r.status) for r in after.collect()} == {"i0": ("i3", "REPLACED"), "i1": ("i4", "REPLACED"), "z": (None, "STRUCTURAL_NA")}
    assert sorted(r.intent_id for r in used.collect()) == ["i0", "i1", "i2", "i3", "i4", "z"]


def test_identities_of_configurations_and_candidates(spark):
    import hashlib
    import json

    from datagauge.functions import identity, scalars

    assert identity.config_id({"b": 1, "a": "é"}) == hashlib.sha256('{"a":"é","b":1}'.encode()).hexdigest()
    df = spark.createDataFrame([("10",), ("9",), ("b",), ("-1",), ("a1",)], "id string")
    assert [r.id for r in df.orderBy(identity.id_order(F.col("id"))).collect()] == ["-1", "9", "10", "a1", "b"]
    got = df.where("id = 'b'").select(workload.candidate_identity(F.col("id"), F.lit(0), F.lit(2), F.lit("text")).alias("c")).first().c
    want = {"attempt": 0, "index": 2, "intent": "b", "text_sha256": hashlib.sha256(b"text").hexdigest()}
    assert got == hashlib.sha256(json.dumps(want, separators=(",", ":")).encode()).hexdigest()
    v = np.array([3.0, 1.0, 2.0], np.float32)
    got = spark.createDataFrame([([3.0, 1.0, 2.0],)], "v array<double>").select(scalars.unit32(F.col("v")).alias("u")).first().u
    assert np.allclose(got, v / np.sqrt((v * v).sum()), atol=1e-7)


def test_global_ranks_have_no_gaps(spark):
    from datagauge.operators import retrieval

    df = spark.range(500).selectExpr("id", "if(id % 50 = 7, null, cast(id * 37 % 20 as double)) as score")
    want = sorted(df.collect(), key=lambda r: (r.score is None, -(r.score or 0), r.id))
    for ranges in (1, 3, 200):
        got = {r.id: r["rank"] for r in retrieval.global_rank(df, "id", "score", ranges).collect()}
        assert got == {r.id: i + 1 for i, r in enumerate(want)}


def test_boundaries_are_sought_after_the_one_before(spark):
    from datagauge.operators import splits

    rows = spark.createDataFrame([(i, f"2024-01-01 0{i}:00:00") for i in range(6) for _ in range(50 if i == 0 else 1)], "i int, t string").selectExpr("i", "cast(t as timestamp) as time")
    assert [b.hour for b in splits.temporal_boundaries(rows, "time")] == [0, 1, 2, 3]
    from datagauge.operators import regimes

    inner = spark.createDataFrame([(0, 1, "TRAIN"), (0, 5, "VALIDATION"), (1, 4, "TRAIN"), (1, 2, "VALIDATION")], "fold_id int, uid int, role string")
    got = regimes.chronological(inner, rows.selectExpr("i as uid", "time").distinct()).collect()
    assert {r.fold_id: r.strict for r in got} == {0: True, 1: False}
