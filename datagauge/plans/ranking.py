"""Queries on retrieval, diversity, graphs and games, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datagauge.functions import scalars
from datagauge.operators import classes, dense, diversify, games, graph, retrieval
from datagauge.plans.adapters import NAMESPACE, observations, rounded, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Terms in DuckDB, as in scalars.TERM.
PATTERN = scalars.TERM
POSTINGS = f"""
cut AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(text), '{PATTERN}') AS t FROM documents), listed AS (SELECT doc_id, unnest(t) AS term, len(t) AS len FROM cut),
posted AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM listed GROUP BY ALL),
q AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '{PATTERN}')) AS term FROM benchmark), qt AS (SELECT item_id, term, count(*) AS qtf FROM q GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents)"""
BM25 = f"""{POSTINGS},
facts AS MATERIALIZED (SELECT (SELECT n FROM n) AS n, sum(len) / (SELECT n FROM n) AS a FROM (SELECT doc_id, any_value(len) AS len FROM posted GROUP BY 1)), df AS (SELECT term, count(*) AS df FROM posted GROUP BY 1),
weighted AS MATERIALIZED (SELECT doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a)) AS w FROM posted JOIN df USING (term), facts),
bm AS (SELECT item_id, doc_id, round(sum(qtf * w), 9) AS score FROM qt JOIN weighted USING (term) GROUP BY ALL),
bmr AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM bm)"""
TFIDF = """
tdf AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM posted GROUP BY 1 HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT 50000),
raw AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + CAST(df AS DOUBLE))) + 1) AS w FROM posted JOIN tdf USING (term), n), size AS (SELECT doc_id, sqrt(sum(w * w)) AS s FROM raw GROUP BY 1),
ti AS (SELECT item_id, doc_id, round(sum(qtf * w / s), 9) AS score FROM qt JOIN raw USING (term) JOIN size USING (doc_id) GROUP BY ALL),
tir AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM ti)"""


def bm25_scores(spark, sf_dir) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    asked = retrieval.query_terms(items, "item_id", "text")
    return retrieval.sparse_scores(asked, retrieval.bm25_weights(docs, "doc_id", "text", asked=asked), "item_id", "doc_id")


def tfidf_scores(spark, sf_dir) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    weights = retrieval.tfidf_weights(docs, "doc_id", "text")
    return retrieval.sparse_scores(retrieval.query_terms(items, "item_id", "text"), weights, "item_id", "doc_id")


@query(f"WITH {BM25} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM bmr WHERE rank <= 10")
def bm25(spark, sf_dir):
    """The ten best documents of each benchmark item by BM25."""
    return rounded(retrieval.rank(bm25_scores(spark, sf_dir), ["item_id"], "doc_id", most=10))


@query(f"WITH {POSTINGS}, {TFIDF} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM tir WHERE rank <= 10")
def tfidf(spark, sf_dir):
    """The ten best by TF-IDF."""
    return rounded(retrieval.rank(tfidf_scores(spark, sf_dir), ["item_id"], "doc_id", most=10))


@query(f"""WITH {BM25}, {TFIDF}, u AS (SELECT item_id, doc_id, 'bm25' AS c, rank FROM bmr WHERE rank <= 100 UNION ALL SELECT item_id, doc_id, 'tfidf', rank FROM tir WHERE rank <= 100),
f AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 12) AS score, min(rank) AS best, max(CASE WHEN c = 'bm25' THEN rank END) AS bm25_rank, max(CASE WHEN c = 'tfidf' THEN rank END) AS tfidf_rank FROM u GROUP BY ALL)
SELECT item_id, doc_id, round(score, 6) AS score, best, bm25_rank, tfidf_rank, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, best, doc_id) AS INT) AS fused_rank FROM f""")
def rank_fusion(spark, sf_dir):
    """Reciprocal rank fusion of both channels' hundred best."""
    channels = {"bm25": retrieval.rank(bm25_scores(spark, sf_dir), ["item_id"], "doc_id", most=100), "tfidf": retrieval.rank(tfidf_scores(spark, sf_dir), ["item_id"], "doc_id", most=100)}
    return rounded(retrieval.fused_ranking(retrieval.fuse(channels, "item_id", "doc_id"), "item_id", "doc_id"))


@query("""
WITH d AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings), u AS (SELECT vec_id, [x / sqrt(list_dot_product(e, e)) FOR x IN e] AS e FROM d),
s AS (SELECT a.vec_id AS source, b.vec_id AS candidate, round(list_dot_product(a.e, b.e), 9) AS score FROM u a, u b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, candidate) AS INT) AS rank FROM s)
SELECT source, candidate, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def dense_topk(spark, sf_dir):
    """The ten nearest vectors of a stated query set, without the vector itself."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("source"), F.col("embedding").alias("q"))
    return rounded(dense.dense_topk(asked, e.select(F.col("vec_id").alias("candidate"), "embedding"), "source", "candidate", scalars.unit(F.col("q")), scalars.unit(F.col("embedding")), 10))


@query("""
WITH e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), q AS (SELECT vec_id // 20 % 4 AS item, vec_id AS position, v FROM e WHERE vec_id % 20 = 0),
m AS (SELECT item, label, position, max(list_dot_product(q.v, e.v)) AS m FROM q, e GROUP BY ALL)
SELECT item, label, round(sum(m), 6) AS score FROM m GROUP BY ALL""")
def late_interaction(spark, sf_dir):
    """Sums of best token products: labels' vectors are documents, the stated query set's vectors make four queries."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0").select((F.floor(F.col("vec_id") / 20) % 4).alias("item"), F.col("vec_id").alias("position"), F.col("embedding").alias("vector"))
    return rounded(retrieval.maxsim(asked, e.select("label", F.col("embedding").alias("vector")), "item", "label"))


INTENTS = """
p AS (SELECT 'lang' AS f1, lang AS v1, NULL AS f2, NULL AS v2, count(*) AS support FROM documents GROUP BY lang UNION ALL SELECT 'source', source, NULL, NULL, count(*) FROM documents GROUP BY source UNION ALL SELECT 'lang', lang, 'source', source, count(*) FROM documents GROUP BY lang, source),
i AS (SELECT concat_ws('|', f1, v1, f2, v2) AS intent, * FROM p WHERE support BETWEEN 5 AND 20000),
j AS (SELECT intent, doc_id FROM i JOIN documents d ON (f1 = 'lang' AND v1 = d.lang OR f1 = 'source' AND v1 = d.source) AND (f2 IS NULL OR v2 = d.source))"""


@query(f"WITH {INTENTS} SELECT intent, f1 AS field1, v1 AS value1, f2 AS field2, v2 AS value2, support FROM i")
def predicate_census(spark, sf_dir):
    """Single and pair predicates with their support."""
    return retrieval.predicates(table(spark, sf_dir, "documents"), "doc_id", ["lang", "source"], 5)


@query(f"""WITH {INTENTS}, k AS (SELECT DISTINCT intent FROM j), r AS (SELECT intent, doc_id, row_number() OVER (PARTITION BY intent ORDER BY n_chars DESC, doc_id) AS rank FROM documents, k),
h AS (SELECT r.*, row_number() OVER (PARTITION BY intent ORDER BY rank) AS found FROM r SEMI JOIN j USING (intent, doc_id)), c AS (SELECT intent, count(*) AS n FROM j GROUP BY 1)
SELECT intent, round(coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(10, n) + 1) t(i)), 6) AS ndcg10,
round(coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 50), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(50, n) + 1) t(i)), 6) AS ndcg50, round(sum(found / rank) / n, 6) AS ap, round(max(1 / rank), 6) AS rr,
round(count(*) FILTER (rank <= 10) / 10, 6) AS p10, round(count(*) FILTER (rank <= 50) / n, 6) AS r50 FROM h JOIN c USING (intent) GROUP BY intent, n""")
def effectiveness(spark, sf_dir):
    """Retrieval metrics of a ranking by length against automatic judgements."""
    docs = table(spark, sf_dir, "documents")
    intents = retrieval.predicates(docs, "doc_id", ["lang", "source"], 5)
    qrels = retrieval.judgements(docs, "doc_id", ["lang", "source"], intents)
    ranked = retrieval.global_rank(docs.select("doc_id", F.col("n_chars").alias("score")), "doc_id", "score")  # one ranking for all intents
    return rounded(retrieval.effectiveness(ranked.join(qrels, "doc_id"), qrels, "intent", "doc_id"))


@query("""
WITH x AS (SELECT p_partkey, p_brand, string_split(p_name, ' ') AS t, p_type, p_size // 10 AS c FROM part),
s AS (SELECT a.p_partkey AS source, b.p_partkey AS candidate, round(0.4 * len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) + 0.3 * CAST(a.p_type = b.p_type AS INT) + 0.3 * CAST(a.c = b.c AS INT), 9) AS score FROM x a JOIN x b ON a.p_brand = b.p_brand WHERE a.p_partkey % 20 = 0 AND a.p_partkey <> b.p_partkey),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, candidate) AS INT) AS rank FROM s)
SELECT source, candidate, round(score, 6) AS score, rank FROM r WHERE rank <= 20""")
def metadata_compatibility(spark, sf_dir):
    """Weighted name and class similarity of parts of a brand with a stated query set."""
    x = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.array_distinct(F.split("p_name", " ")).alias("tokens"), "p_type", F.floor(F.col("p_size") / 10).alias("c"))
    score = lambda: F.round(retrieval.class_similarity(0.4, ["p_type", "c"]), 9)
    return rounded(classes.class_topk(x, "p_brand", "p_partkey", ["tokens", "p_type", "c"], score, 20, "p_partkey % 20 = 0").select("source", "candidate", "score", "rank"))


LISTS = "l AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings QUALIFY pos <= 20)"


@query(f"""WITH {LISTS} SELECT a.label, round(avg(1 - list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))), 6) AS ild FROM l a JOIN l b ON a.label = b.label AND a.pos < b.pos GROUP BY 1""")
def semantic_diversity(spark, sf_dir):
    """Mean pairwise distance of each label's first twenty vectors."""
    ranked = splits_rank(table(spark, sf_dir, "embeddings"), "label", "vec_id", 20)
    pairs = diversify.list_pairs(ranked, "label", "rank", ["embedding"])
    return rounded(diversify.diversity(pairs, "label", diversify.semantic_distance("a_embedding", "b_embedding")))


def splits_rank(rows: DataFrame, group: str, item: str, most: int) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(item))).where(F.col("rank") <= most)


@query("""
WITH l AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos, p_size / 50.0 AS x, CASE WHEN p_size % 3 = 0 THEN NULL ELSE (p_retailprice - 900) / 1200 END AS y, string_split(p_name, ' ') AS t FROM part QUALIFY pos <= 20)
SELECT a.p_brand, round(avg((abs(a.x - b.x) + CASE WHEN a.y IS NULL AND b.y IS NULL THEN 0 ELSE coalesce(abs(a.y - b.y), 1) END) / 2), 6) AS coordinates, round(avg(1 - len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))), 6) AS sets FROM l a JOIN l b ON a.p_brand = b.p_brand AND a.pos < b.pos GROUP BY 1""")
def structured_diversity(spark, sf_dir):
    """Diversity by coordinates, some of them missing, and by sets."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") / 50.0).alias("x"), F.when(F.col("p_size") % 3 != 0, (F.col("p_retailprice") - 900) / 1200).alias("y"), F.array_distinct(F.split("p_name", " ")).alias("t"))
    pairs = diversify.list_pairs(splits_rank(p, "p_brand", "p_partkey", 20), "p_brand", "rank", ["x", "y", "t"])
    a = diversify.diversity(pairs, "p_brand", diversify.coordinate_distance(["x", "y"])).withColumnRenamed("ild", "coordinates")
    return rounded(a.join(diversify.diversity(pairs, "p_brand", diversify.set_distance(["t"])).withColumnRenamed("ild", "sets"), "p_brand"))


def pools(spark, sf_dir) -> DataFrame:
    e = splits_rank(table(spark, sf_dir, "embeddings"), "label", "vec_id", 200)
    return e.select("label", "vec_id", (F.col("vec_id") % 97 / 97).alias("quality"), F.col("embedding").cast("array<double>").alias("vector"))


def greedy_sql(init: str, value: str, steps: int = 5) -> str:
    """Greedy steps over each label's first 200 vectors, by recursion over the chosen list."""
    return f"""
WITH RECURSIVE p AS (SELECT label, vec_id, (vec_id % 97) / 97.0::DOUBLE AS q, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 200),
s AS MATERIALIZED (SELECT a.label, a.vec_id AS i, b.vec_id AS j, round(greatest(0, least(1, (1 + list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))) / 2)), 12) AS k FROM p a JOIN p b USING (label)),
c(label, n, chosen) AS (SELECT label, 1, [arg_min(vec_id, (-round({init}, 12), vec_id))] FROM p x GROUP BY label
UNION ALL SELECT label, n + 1, list_append(any_value(chosen), arg_min(vec_id, (-round(g, 12), vec_id))) FROM (SELECT c.label, c.n, c.chosen, x.vec_id, {value} AS g FROM c JOIN p x USING (label) WHERE c.n < {steps} AND NOT list_contains(c.chosen, x.vec_id)) GROUP BY label, n)
SELECT label, unnest(chosen) AS vec_id, CAST(unnest(range(1, {steps} + 1)) AS INT) AS position FROM c WHERE n = {steps}"""


@query(greedy_sql("0.5 * x.q", "0.5 * x.q - 0.5 * (SELECT max(k) FROM s WHERE s.label = c.label AND s.i = x.vec_id AND list_contains(c.chosen, s.j))"))
def mmr(spark, sf_dir):
    """Five steps of maximal marginal relevance in each label's pool."""
    return diversify.ordered(pools(spark, sf_dir), "label", "vec_id", "mmr", 5)


@query(greedy_sql("(SELECT sum(k) FROM s WHERE s.label = x.label AND s.i = x.vec_id)", "(SELECT sum(greatest(0, s.k - b.m)) FROM s JOIN (SELECT i, max(k) AS m FROM s t WHERE t.label = c.label AND list_contains(c.chosen, t.j) GROUP BY i) b ON b.i = s.j WHERE s.label = c.label AND s.i = x.vec_id)"))
def facility_location(spark, sf_dir):
    """Five steps of facility location."""
    return diversify.ordered(pools(spark, sf_dir), "label", "vec_id", "facility", 5)


@query(greedy_sql("-x.vec_id", "(SELECT min(1 - k) FROM s WHERE s.label = c.label AND s.i = x.vec_id AND list_contains(c.chosen, s.j))"))
def farthest_first(spark, sf_dir):
    """Five steps of farthest-first from the least id."""
    return diversify.ordered(pools(spark, sf_dir), "label", "vec_id", "farthest_first_id", 5)


@query(greedy_sql("x.q", "(SELECT min(1 - k) FROM s WHERE s.label = c.label AND s.i = x.vec_id AND list_contains(c.chosen, s.j))", 20))
def farthest_from_best(spark, sf_dir):
    """Farthest-first from the best quality."""
    return diversify.ordered(pools(spark, sf_dir), "label", "vec_id", "farthest", 20)


@query()
def determinantal_sample(spark, sf_dir):
    """A determinantal sample of each pool."""
    return diversify.ordered(pools(spark, sf_dir), "label", "vec_id", "kdpp", 10)


@query()
def kernel_audit(spark, sf_dir):
    """Ranks of pools' kernels and the depths that they allow."""
    return diversify.kernel_audit(pools(spark, sf_dir), "label", "vec_id", (5, 10, 100))


GRAPH = """
x AS (SELECT p_partkey, p_size / 50.0 AS size, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE least((p_retailprice - 900) / 1200, 1) END AS price FROM part),
e AS (SELECT 'Item::' || p_partkey AS i, 'size::' || CAST(least(floor(size * 10), 9) AS INT) AS b, 'size' AS f FROM x UNION ALL SELECT 'Item::' || p_partkey, 'price::' || CAST(least(floor(price * 10), 9) AS INT), 'price' FROM x WHERE price IS NOT NULL)"""


def part_graph(spark, sf_dir) -> DataFrame:
    x = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("size"), F.when(F.col("p_partkey") % 7 != 0, F.least((F.col("p_retailprice") - 900) / 1200, F.lit(1.0))).alias("price"))
    return graph.bin_graph(x, "p_partkey", ["size", "price"])


@query(f"WITH {GRAPH} SELECT i AS src, b AS dst, 'Item-' || f AS edge_type FROM e UNION ALL SELECT b, i, f || '-Item' FROM e")
def bin_graph(spark, sf_dir):
    """A typed graph of parts and their bins."""
    return part_graph(spark, sf_dir)


def graph_and_sources(spark, sf_dir):
    edges = part_graph(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("node")).distinct()
    sources = spark.createDataFrame([("Item::1",), ("Item::7",), ("size::3",)], "source string")
    return nodes, edges, sources


#: After so many steps a change is below 1e-12 of what it was.
STEPS = 170
PAGERANK = f"""
WITH RECURSIVE {GRAPH}, l AS (SELECT i AS src, b AS dst FROM e UNION SELECT b, i FROM e),
d AS MATERIALIZED (SELECT src, dst, 0.85::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM l UNION ALL SELECT DISTINCT src, NULL, 0.15::DOUBLE FROM l),
r(n, source, node, score) AS (SELECT 0, s, s, 1.0::DOUBLE FROM (SELECT unnest(['Item::1', 'Item::7', 'size::3']) AS s)
UNION ALL SELECT n + 1, source, coalesce(dst, source) AS spot, sum(score * share) FROM r JOIN d ON d.src = r.node WHERE n < {STEPS} GROUP BY n, source, spot)
SELECT source, node, round(score, 6) AS score FROM r WHERE n = {STEPS}"""


@query(PAGERANK)
def pagerank(spark, sf_dir):
    """Personalised PageRank by joins."""
    nodes, edges, sources = graph_and_sources(spark, sf_dir)
    return rounded(graph.pagerank(nodes, edges, sources))


@query(PAGERANK)
def pagerank_batches(spark, sf_dir):
    """Personalised PageRank of batches of sources on a graph held by workers."""
    nodes, edges, sources = graph_and_sources(spark, sf_dir)
    return rounded(graph.pagerank_batches(nodes, edges, sources))


@query()
def typed_walks(spark, sf_dir):
    """Typed walks between parts and sizes."""
    nodes, edges, sources = graph_and_sources(spark, sf_dir)
    return graph.walks(edges, nodes.where("node like 'Item::%'").select(F.col("node").alias("root")), 7, 2, pattern=("Item", "size", "Item"))


GAME = """
s AS (SELECT l_suppkey % 8 AS player, avg(l_discount) * 10 AS score FROM lineitem GROUP BY 1),
m AS (SELECT unnest(range(256)) AS mask), u AS (SELECT mask, coalesce(avg(score), 0) AS utility FROM m LEFT JOIN s ON (mask >> player) & 1 = 1 GROUP BY mask),
g AS (SELECT player, bit_count(a.mask) AS k, b.utility - a.utility AS gain FROM (SELECT unnest(range(8)) AS player), u a JOIN u b ON b.mask = a.mask | (1 << player) WHERE (a.mask >> player) & 1 = 0),
w AS (SELECT k, factorial(k::INT) * factorial(7 - k::INT) / factorial(8)::DOUBLE AS sh, exp(lgamma(k + 1) + lgamma(11 - k) - lgamma(12)) AS be FROM (SELECT unnest(range(8)) AS k)),
z AS (SELECT sum(be * factorial(7) / (factorial(k::INT) * factorial(7 - k::INT))) AS total FROM w)"""


def fold_scores(spark, sf_dir) -> DataFrame:
    """(player, score) of eight players that share out all suppliers by id, so that every line item counts."""
    player = F.pmod("task", F.lit(8)).cast("int").alias("player")
    return observations(spark, sf_dir).groupBy(player).agg(F.avg("accuracy").alias("score"))


def game(spark, sf_dir) -> DataFrame:
    return games.exact_values(games.mean_utility(games.coalitions(spark, 8), fold_scores(spark, sf_dir), 8), 8)


@query(f"""WITH {GAME} SELECT CAST(player AS INT) AS player, round(max(CASE WHEN k = 0 THEN gain END), 6) AS standalone, round(max(CASE WHEN k = 7 THEN gain END), 6) AS loo, round(sum(gain * sh), 6) AS shapley, round(avg(gain), 6) AS banzhaf, round(sum(gain * be / total), 6) AS beta41
FROM g JOIN w USING (k), z GROUP BY player""")
def exact_values(spark, sf_dir):
    """Exact values of eight players by all 256 coalitions."""
    return rounded(game(spark, sf_dir))


CROSSFIT = """
o AS (SELECT l_suppkey % 10 AS player, l_partkey % 50 AS flow, l_discount * 10 AS y, l_suppkey % 5 AS fold FROM lineitem),
st AS (SELECT player, flow, fold, count(*) AS n, sum(y) AS total FROM o GROUP BY ALL),
c AS (SELECT 'c' || i AS coalition, p AS player FROM (SELECT unnest(range(1, 6)) AS i), (SELECT unnest(range(10)) AS p) WHERE p % (i + 1) = 0),
h AS (SELECT unnest(range(5)) AS held), ev AS (SELECT coalition, held, flow, n, total FROM c JOIN st USING (player), h WHERE fold <> held),
fm AS (SELECT coalition, held, flow, sum(total) / sum(n) AS m FROM ev GROUP BY ALL), wm AS (SELECT coalition, held, sum(total) / sum(n) AS w FROM ev GROUP BY ALL),
pu AS (SELECT k.coalition, st.player, coalesce(1 - sum(n * abs(total / n - coalesce(m, w))) / sum(n), 0) AS u FROM (SELECT DISTINCT coalition FROM c) k CROSS JOIN st LEFT JOIN wm ON wm.coalition = k.coalition AND wm.held = st.fold LEFT JOIN fm ON fm.coalition = k.coalition AND fm.held = st.fold AND fm.flow = st.flow GROUP BY ALL)"""


@query(f"WITH {CROSSFIT} SELECT coalition, round(avg(u), 6) AS utility FROM pu GROUP BY 1")
def crossfit_utility(spark, sf_dir):
    """How well coalitions of ten players, who share out all suppliers, predict all players' flows across folds."""
    o = observations(spark, sf_dir).select(F.pmod("task", F.lit(10)).alias("player"), (F.col("flow") % 50).alias("flow"), "accuracy")
    stats = o.groupBy("player", "flow").agg(F.count("*").alias("n"), F.sum("accuracy").alias("total"))
    registry = o.select("player", (F.col("player") % 5).alias("fold")).distinct()
    rows = [(f"c{i}", p) for i in range(1, 6) for p in range(10) if p % (i + 1) == 0]
    return rounded(games.crossfit_utility(spark.createDataFrame(rows, "coalition string, player bigint"), stats, registry))


@query(f"""WITH {GAME}, v AS (SELECT player, round(sum(gain * sh), 9) AS a, round(avg(gain), 9) AS b FROM g JOIN w USING (k) GROUP BY player),
r AS (SELECT *, row_number() OVER (ORDER BY a DESC, player) AS ra, row_number() OVER (ORDER BY b DESC, player) AS rb, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ma, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS mb FROM v)
SELECT round(corr(ma, mb), 6) AS spearman, round(avg(abs(ra - rb)), 6) AS mean_rank_change, CAST(max(abs(ra - rb)) AS INT) AS max_rank_change, count(*) FILTER (ra = rb) AS same_rank, round(avg(CAST(sign(a) = sign(b) AS DOUBLE)), 6) AS sign_agreement,
{", ".join(f"round(count(*) FILTER (ra <= {k} AND rb <= {k}) / {k}.0, 6) AS top{k}, round(count(*) FILTER (ra > 8 - {k} AND rb > 8 - {k}) / {k}.0, 6) AS bottom{k}" for k in (3, 5))}, (SELECT count(*) FROM r x JOIN r y ON x.ra < y.ra AND x.rb > y.rb) AS reversed_pairs FROM r""")
def value_agreement(spark, sf_dir):
    """Agreement of Shapley and Banzhaf values of eight players out of all suppliers."""
    values = game(spark, sf_dir).withColumn("a", F.round("shapley", 9)).withColumn("b", F.round("banzhaf", 9))
    return rounded(games.value_agreement(values, "a", "b", "player"))


@query(f"""WITH {GAME}, v AS (SELECT player, sum(gain * sh) AS a, avg(gain) AS b FROM g JOIN w USING (k) GROUP BY player)
SELECT round(avg(abs(a - b)), 6) AS mae, round(median(abs(a - b)), 6) AS median, round(sqrt(avg((a - b) ** 2)), 6) AS rmse, round(max(abs(a - b)), 6) AS largest FROM v""")
def value_errors(spark, sf_dir):
    """Errors of Banzhaf values held against Shapley values."""
    return rounded(games.value_errors(game(spark, sf_dir), "shapley", "banzhaf"))


@query("""
WITH s AS (SELECT l_orderkey % 85 AS player, sum(l_discount) * 10 AS t, count(*) AS n FROM lineitem GROUP BY 1), a AS (SELECT sum(t / n) AS t, count(*) AS n FROM s)
SELECT CAST(player AS INT) AS player, round(s.t / s.n, 6) AS standalone, round(a.t / a.n - (a.t - s.t / s.n) / (a.n - 1), 6) AS loo, 171 AS utilities FROM s, a""")
def isolated_values(spark, sf_dir):
    """Standalone and leave-one-out values of 85 players who share out all orders, from 171 utilities."""
    scores = observations(spark, sf_dir).groupBy(F.pmod("run", F.lit(85)).cast("int").alias("player")).agg(F.avg("accuracy").alias("score"))
    asked = spark.createDataFrame([(name, own) for name, own in games.standalone_and_last(85)], "coalition string, own array<int>").select("coalition", F.explode("own").alias("player"))
    utilities = asked.join(scores, "player").groupBy("coalition").agg(F.avg("score").alias("utility"))
    return rounded(games.isolated_values(utilities, 85))


def listed(rows: list[list[int]]) -> str:
    """Numbered lists as a table of SQL."""
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, {row})" for i, row in enumerate(rows)) + ") t(i, own)"


@query(f"""WITH {GAME}, d AS MATERIALIZED ({listed(games.permutations(NAMESPACE, 1, 8, 100))}), e AS (SELECT i, CAST(unnest(range(1, 9)) AS BIGINT) AS k, own FROM d),
c AS (SELECT i, e.k, own[e.k] AS player, avg(score) AS u FROM e JOIN s ON list_contains(own[1:e.k], s.player) GROUP BY ALL), x AS (SELECT i, k, player, u - lag(u, 1, 0.0) OVER (PARTITION BY i ORDER BY k) AS gain FROM c)
SELECT budget, CAST(player AS INT) AS player, round(sum(gain) / budget, 6) AS shapley, round(sum(8 * be * factorial(7) / (factorial(w.k::INT) * factorial(7 - w.k::INT)) / total * gain) / budget, 6) AS beta41
FROM x JOIN (SELECT unnest([50, 100]) AS budget) ON i < budget JOIN w ON w.k = x.k - 1, z GROUP BY budget, player""")
def permutation_values(spark, sf_dir):
    """Sampled Shapley and Beta values of the eight-player game."""
    scores = fold_scores(spark, sf_dir)
    design = games.prefix_coalitions(games.permutation_design(spark, NAMESPACE, 1, 8, 100))
    members = design.select("coalition").distinct().select("coalition", F.explode(F.split("coalition", ",").cast("array<int>")).alias("player"))
    utilities = members.join(scores, "player").groupBy("coalition").agg(F.avg("score").alias("utility"))
    return rounded(games.permutation_values(design, utilities, 8, [50, 100]))


@query(f"""WITH {GAME}, d AS MATERIALIZED ({listed(games.bernoulli_rows(NAMESPACE, 1, 8, 200))}), e AS (SELECT i, unnest(range(8)) AS player, unnest(own) AS inside FROM d),
u2 AS (SELECT i, coalesce(avg(score) FILTER (inside = 1), 0) AS u FROM e JOIN s USING (player) GROUP BY i)
SELECT budget, CAST(player AS INT) AS player, round(avg(u) FILTER (inside = 1) - avg(u) FILTER (inside = 0), 6) AS banzhaf, CASE WHEN count(DISTINCT inside) = 2 THEN 'COMPLETE' ELSE 'INSUFFICIENT' END AS status
FROM e JOIN u2 USING (i) JOIN (SELECT unnest([100, 200]) AS budget) ON i < budget GROUP BY budget, player""")
def reuse_values(spark, sf_dir):
    """Banzhaf values by reuse of random rows."""
    scores = fold_scores(spark, sf_dir)
    design = games.bernoulli_design(spark, NAMESPACE, 1, 8, 200)
    utilities = design.join(scores, "player").groupBy("row").agg(F.coalesce(F.avg(F.when(F.col("inside") == 1, F.col("score"))), F.lit(0.0)).alias("utility"))
    return rounded(games.reuse_values(design, utilities, [100, 200]))
