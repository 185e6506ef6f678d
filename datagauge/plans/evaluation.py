"""Queries on splits, baselines and statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datagauge.functions import scalars
from datagauge.operators import accounting, baselines, inference, splits, workload
from datagauge.operators.estimators import ridge
from datagauge.operators.graph import kept
from datagauge.plans.adapters import NAMESPACE, observations, rounded, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The observations with the fold of their run, and pairs of folds and rows with their role.
FOLDED = """
runs AS (SELECT DISTINCT l_orderkey AS run FROM lineitem),
folds AS (SELECT run, CAST((row_number() OVER (ORDER BY sha256('datagauge|' || run), run) - 1) % 5 AS INT) AS fold FROM runs),
obs AS (SELECT l_orderkey AS run, l_suppkey AS task, l_partkey AS flow, l_discount * 10 AS accuracy, fold FROM lineitem JOIN folds ON run = l_orderkey)"""


def folded(spark, sf_dir) -> DataFrame:
    obs = observations(spark, sf_dir)
    folds = splits.hashed_fold(obs.select("run").distinct(), "run", NAMESPACE)
    return obs.join(folds, "run")


@query(f"""
WITH {FOLDED}, held AS (SELECT unnest(range(5)) AS held),
train AS (SELECT held, task, flow, accuracy FROM obs, held WHERE fold <> held),
means AS (SELECT held, task, flow, avg(accuracy) AS m FROM train GROUP BY ALL), whole AS (SELECT held, avg(accuracy) AS g FROM train GROUP BY ALL)
SELECT o.fold AS held, count(*) AS n, count(*) FILTER (m IS NULL) AS fallbacks, round(avg(abs(coalesce(m, g) - accuracy)), 6) AS mae
FROM obs o JOIN whole w ON w.held = o.fold LEFT JOIN means x ON x.held = o.fold AND x.task = o.task AND x.flow = o.flow GROUP BY o.fold""")
def frequency_baseline(spark, sf_dir):
    """Mean by (task, flow) with the mean of all as fallback, on folds of whole runs."""
    facts = kept(folded(spark, sf_dir).select("task", "flow", "fold", "accuracy"), "folded")
    scored = baselines.held_out_means(facts, facts, ["task", "flow"], "fold", "accuracy", "m")
    scored = baselines.held_out_means(scored, facts, [], "fold", "accuracy", "g")
    return rounded(scored.groupBy(F.col("fold").alias("held")).agg(F.count("*").alias("n"), F.count_if(F.col("m").isNull()).alias("fallbacks"), F.avg(F.abs(F.coalesce("m", "g") - F.col("accuracy"))).alias("mae")))


@query(f"""
WITH {FOLDED}, held AS (SELECT unnest(range(5)) AS held),
train AS (SELECT held, task, flow, accuracy FROM obs, held WHERE fold <> held), whole AS (SELECT held, avg(accuracy) AS g FROM train GROUP BY ALL),
t AS (SELECT held, task, avg(accuracy) AS tm FROM train GROUP BY ALL), f AS (SELECT held, flow, avg(accuracy) AS fm FROM train GROUP BY ALL),
r AS (SELECT held, flow, avg(accuracy - tm) AS rm FROM train JOIN t USING (held, task) GROUP BY ALL),
x AS (SELECT o.accuracy AS y, g, tm, fm, rm FROM obs o JOIN whole w ON w.held = o.fold LEFT JOIN t ON t.held = o.fold AND t.task = o.task LEFT JOIN f ON f.held = o.fold AND f.flow = o.flow LEFT JOIN r ON r.held = o.fold AND r.flow = o.flow),
p AS (SELECT 'GM' AS name, y, g AS p, 'NATIVE' AS status FROM x UNION ALL SELECT 'TD_MEAN', y, coalesce(tm, g), CASE WHEN tm IS NULL THEN 'FALLBACK' ELSE 'NATIVE' END FROM x
UNION ALL SELECT 'FLOW_MEAN', y, coalesce(fm, g), CASE WHEN fm IS NULL THEN 'FALLBACK' ELSE 'NATIVE' END FROM x
UNION ALL SELECT 'TF_ADD', y, coalesce(tm, g) + coalesce(rm, 0), CASE WHEN tm IS NULL AND rm IS NULL THEN 'FALLBACK' WHEN tm IS NULL OR rm IS NULL THEN 'MIXED_COMPONENT_FALLBACK' ELSE 'NATIVE' END FROM x)
SELECT name, status, count(*) AS n, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) ** 2)), 6) AS rmse, round(count(*) / sum(count(*)) OVER (PARTITION BY name), 6) AS share FROM p GROUP BY name, status""")
def baseline_status(spark, sf_dir):
    """Status shares and errors of four mean baselines over all folds."""
    rows = facts = kept(folded(spark, sf_dir).select("task", "flow", "fold", "accuracy"), "folded")
    for keys, name in (([], "g"), (["task"], "t"), (["flow"], "f")):
        rows = baselines.held_out_means(rows, facts, keys, "fold", "accuracy", name)
    rows = baselines.held_out_residuals(rows, facts, "task", "flow", "fold", "accuracy", "r")
    t, f, r, g = (F.col(c) for c in "tfrg")
    native = lambda c: F.when(c.isNull(), baselines.FALLBACK).otherwise(baselines.NATIVE)
    both = F.when(t.isNull() & r.isNull(), baselines.FALLBACK).when(t.isNull() | r.isNull(), baselines.MIXED).otherwise(baselines.NATIVE)
    four = {"GM": (g, F.lit(baselines.NATIVE)), "TD_MEAN": (F.coalesce(t, g), native(t)), "FLOW_MEAN": (F.coalesce(f, g), native(f)), "TF_ADD": (F.coalesce(t, g) + F.coalesce(r, F.lit(0.0)), both)}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), p.alias("prediction"), status.alias("status")) for n, (p, status) in four.items()]))
    scored = rows.select(F.col("accuracy").alias("target"), each.alias("e")).select("target", "e.*")
    return rounded(baselines.status_report(scored, "target", "prediction", ["name"]))


@query(f"""
WITH {FOLDED} SELECT fold, count(*) AS n_rows, count(DISTINCT task) AS n_tasks, count(DISTINCT flow) AS n_flows FROM obs GROUP BY fold""")
def fold_support(spark, sf_dir):
    """Rows, tasks and flows of each fold of whole runs."""
    return folded(spark, sf_dir).groupBy("fold").agg(F.count("*").alias("n_rows"), F.count_distinct("task").alias("n_tasks"), F.count_distinct("flow").alias("n_flows"))


@query("""
WITH c AS (SELECT ts, count(*) AS n FROM events GROUP BY ts), r AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i, sum(n) OVER (ORDER BY ts) AS cum, sum(n) OVER () AS total, count(*) OVER () AS m FROM c),
b1 AS (SELECT i FROM r WHERE i < m ORDER BY abs(cum - 0.2 * total), i LIMIT 1), b2 AS (SELECT r.i FROM r, b1 WHERE r.i > b1.i AND r.i < m ORDER BY abs(cum - 0.4 * total), r.i LIMIT 1),
b3 AS (SELECT r.i FROM r, b2 WHERE r.i > b2.i AND r.i < m ORDER BY abs(cum - 0.6 * total), r.i LIMIT 1), b4 AS (SELECT r.i FROM r, b3 WHERE r.i > b3.i AND r.i < m ORDER BY abs(cum - 0.8 * total), r.i LIMIT 1),
x AS (SELECT e.ts, 1 + CAST(r.i > b1.i AS INT) + CAST(r.i > b2.i AS INT) + CAST(r.i > b3.i AS INT) + CAST(r.i > b4.i AS INT) AS block FROM events e JOIN r USING (ts), b1, b2, b3, b4)
SELECT block, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM x GROUP BY block""")
def temporal_blocks(spark, sf_dir):
    """Five blocks of events in order of time."""
    return splits.temporal_blocks(table(spark, sf_dir, "events"), "ts").groupBy("block").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""
WITH RECURSIVE g AS (SELECT l_suppkey AS task, count(*) AS support FROM lineitem GROUP BY 1),
o AS (SELECT task, support, row_number() OVER (ORDER BY support DESC, sha256('datagauge|' || task), task) AS i FROM g),
s(i, task, support, fold, loads, counts) AS (
SELECT i, task, support, 0, [support, 0, 0, 0, 0], [1, 0, 0, 0, 0] FROM o WHERE i = 1
UNION ALL SELECT i, task, support, f, [CASE WHEN k = f THEN loads[k + 1] + support ELSE loads[k + 1] END FOR k IN range(5)], [CASE WHEN k = f THEN counts[k + 1] + 1 ELSE counts[k + 1] END FOR k IN range(5)]
FROM (SELECT o.i, o.task, o.support, loads, counts, list_sort([{'a': loads[k + 1], 'b': counts[k + 1], 'c': k} FOR k IN range(5)])[1].c AS f FROM s JOIN o ON o.i = s.i + 1))
SELECT task, support, CAST(fold AS INT) AS fold FROM s""")
def balanced_folds(spark, sf_dir):
    """Tasks dealt to five folds, each to the least loaded."""
    return splits.balanced_folds(observations(spark, sf_dir), "task", NAMESPACE)


@query(f"""
WITH {FOLDED}, tasks AS (SELECT DISTINCT task FROM obs), tf AS (SELECT task, CAST((row_number() OVER (ORDER BY sha256('datagauge|' || task), task) - 1) % 5 AS INT) AS tfold FROM tasks),
x AS (SELECT held, CAST(fold = held AS INT) + CAST(tfold = held AS INT) AS k FROM obs JOIN tf USING (task), (SELECT CAST(unnest(range(5)) AS INT) AS held))
SELECT held AS fold_id, CASE k WHEN 2 THEN 'TEST' WHEN 1 THEN 'EMBARGO' ELSE 'TRAIN' END AS role, count(*) AS n FROM x GROUP BY ALL""")
def embargo_roles(spark, sf_dir):
    """Rows by role where both the run's and the task's fold must be held out."""
    rows = folded(spark, sf_dir)
    tasks = splits.hashed_fold(rows.select("task").distinct(), "task", NAMESPACE).withColumnRenamed("fold", "tfold")
    return splits.embargo_folds(rows.join(tasks, "task"), "run", "fold", "tfold").groupBy("fold_id", "role").agg(F.count("*").alias("n"))


@query("""
WITH x AS (SELECT event_type AS grp, value AS y, CAST(user_id AS DOUBLE) AS p FROM events),
r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY y) + (count(*) OVER (PARTITION BY grp, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY grp ORDER BY p) + (count(*) OVER (PARTITION BY grp, p) - 1) / 2.0 AS rp FROM x)
SELECT grp, count(*) AS n, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) ** 2)), 6) AS rmse, round(1 - sum((p - y) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(corr(y, p), 6) AS pearson, round(corr(ry, rp), 6) AS spearman FROM r GROUP BY grp""")
def regression_metrics(spark, sf_dir):
    """Errors and correlations of each type of event."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("grp"), F.col("value").alias("y"), F.col("user_id").cast("double").alias("p"))
    return rounded(baselines.regression_metrics(rows, "y", "p", ["grp"]))


@query("""
WITH c AS (SELECT p_brand AS grp, CAST(p_size AS DOUBLE) AS y, CAST(floor(p_retailprice / 50) AS DOUBLE) AS p FROM part),
a AS (SELECT *, row_number() OVER (ORDER BY grp, y, p) AS i FROM c),
s AS (SELECT x.grp, sum(sign(x.y - z.y) * sign(x.p - z.p)) AS s, count(*) AS pairs, count(*) FILTER (x.y = z.y) AS ty, count(*) FILTER (x.p = z.p) AS tp FROM a x JOIN a z ON x.grp = z.grp AND x.i < z.i GROUP BY x.grp)
SELECT grp, CASE WHEN (pairs - ty) * (pairs - tp) > 0 THEN round(s / sqrt((pairs - ty) * CAST(pairs - tp AS DOUBLE)), 6) END AS kendall FROM s""")
def kendall(spark, sf_dir):
    """Rank agreement of size and price class of each brand's parts."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), F.col("p_size").cast("double").alias("y"), F.floor(F.col("p_retailprice") / 50).cast("double").alias("p"))
    return rounded(baselines.kendall(rows, "y", "p", ["grp"]))


@query("""
WITH x AS (SELECT event_type AS grp, floor(value) AS y, CAST(user_id % 50 AS DOUBLE) AS p, unnest(range(event_id % 4)) FROM events WHERE event_id % 4 > 0),
r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY y) + (count(*) OVER (PARTITION BY grp, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY grp ORDER BY p) + (count(*) OVER (PARTITION BY grp, p) - 1) / 2.0 AS rp FROM x)
SELECT grp, count(*) AS n, round(avg(abs(p - y)), 6) AS mae, round(1 - sum((p - y) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(corr(ry, rp), 6) AS spearman FROM r GROUP BY grp""")
def weighted_metrics(spark, sf_dir):
    """The same with whole-number weights; the SQL repeats the rows instead."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("grp"), F.floor("value").cast("double").alias("y"), (F.col("user_id") % 50).cast("double").alias("p"), (F.col("event_id") % 4).alias("w"))
    return rounded(baselines.weighted_metrics(rows, "y", "p", "w", ["grp"]))


@query("""
SELECT o_orderpriority AS grp, 'DEFINED' AS status, round(quantile_cont(o_totalprice, 0.025), 6) AS low, round(quantile_cont(o_totalprice, 0.975), 6) AS high FROM orders GROUP BY 1""")
def interval(spark, sf_dir):
    """Linear percentiles."""
    return rounded(inference.interval(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), "o_totalprice"), "o_totalprice", ["grp"]))


@query("""
WITH p AS (SELECT l_suppkey AS k, l_returnflag AS grp, round(abs(avg(l_discount) - 0.05) * 20, 9) AS p FROM lineitem GROUP BY ALL),
a AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY grp) - row_number() OVER (PARTITION BY grp ORDER BY p, k) + 1) * p) AS adj FROM p),
h AS (SELECT k, grp, max(adj) OVER (PARTITION BY grp ORDER BY p, k ROWS UNBOUNDED PRECEDING) AS holm_p FROM a)
SELECT k, grp, round(holm_p, 6) AS holm_p, holm_p <= 0.05 AS reject FROM h""")
def holm(spark, sf_dir):
    """Family-wise correction within groups."""
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("grp")).agg(F.round(F.abs(F.avg("l_discount") - 0.05) * 20, 9).alias("p"))
    return rounded(inference.holm(p, "k", "p", ["grp"]).select("k", "grp", "holm_p", "reject"))


@query("""
WITH d AS (SELECT s_suppkey AS pos, round(s_acctbal / 1000, 3) AS d FROM supplier), o AS (SELECT avg(d) AS observed FROM d),
m AS (SELECT rep, avg(d * CASE WHEN substr(sha256('datagauge|' || rep || '|' || pos), 1, 1) < '8' THEN -1 ELSE 1 END) AS m FROM d, (SELECT unnest(range(200)) AS rep) GROUP BY rep)
SELECT round(observed, 6) AS observed, round((count(*) FILTER (abs(m) >= abs(observed) - 1e-15) + 1) / 201.0, 6) AS p FROM m, o GROUP BY observed""")
def sign_randomisation(spark, sf_dir):
    """A paired test by hashed signs."""
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), F.round(F.col("s_acctbal") / 1000, 3).alias("d"))
    return rounded(inference.sign_randomisation(d, "pos", "d", NAMESPACE, 200))


@query("""
WITH x AS (SELECT b, j, sha256('datagauge|n=97|replicate=' || b || '|draw=' || j) AS h FROM (SELECT unnest(range(20)) AS b), (SELECT unnest(range(97)) AS j)),
i AS (SELECT b, j, list_reduce([CAST(instr('0123456789abcdef', substr(h, k, 1)) - 1 AS BIGINT) FOR k IN range(1, 65)], lambda s, c: (s * 16 + c) % 97, CAST(0 AS BIGINT)) AS idx FROM x)
SELECT b AS replicate, idx AS position, count(*) AS weight FROM i GROUP BY ALL""")
def hashed_bootstrap(spark, sf_dir):
    """Bootstrap draws as hashes modulo n."""
    grid = spark.range(20).select(F.col("id").alias("replicate")).crossJoin(F.broadcast(spark.range(97).select(F.col("id").alias("j"))))
    drawn = grid.withColumn("position", inference.hashed_index(NAMESPACE, 97, F.col("replicate"), F.col("j")))
    return drawn.groupBy("replicate", "position").agg(F.count("*").alias("weight"))


@query("""
WITH x AS (SELECT count(*) AS n, avg(CAST(quality = toxic AS DOUBLE)) AS a, avg(quality) AS pa, avg(toxic) AS pb FROM labels)
SELECT 'flag' AS label, n, round(a, 6) AS agreement, round((a - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM x""")
def rater_agreement(spark, sf_dir):
    """Agreement of two columns of labels as two raters."""
    rows = table(spark, sf_dir, "labels")
    long = rows.select("doc_id", F.explode(F.create_map(F.lit("a"), "quality", F.lit("b"), "toxic")).alias("rater", "flag"))
    return rounded(inference.rater_agreement(long, "doc_id", "rater", ["flag"]))


@query("""
SELECT c_custkey, round((coalesce(0.7 * ln(1 + greatest(c_acctbal, 0)) * CAST(c_acctbal >= 0 AS INT), 0) + 0.3 * ln(1 + c_nationkey) - min(0.7 * ln(1 + greatest(c_acctbal, 0)) * CAST(c_acctbal >= 0 AS INT) + 0.3 * ln(1 + c_nationkey)) OVER ()) / (max(0.7 * ln(1 + greatest(c_acctbal, 0)) * CAST(c_acctbal >= 0 AS INT) + 0.3 * ln(1 + c_nationkey)) OVER () - min(0.7 * ln(1 + greatest(c_acctbal, 0)) * CAST(c_acctbal >= 0 AS INT) + 0.3 * ln(1 + c_nationkey)) OVER ()), 6) AS popularity,
round((CASE WHEN c_name IS NULL OR lower(trim(c_name)) IN ('', 'nan', 'none', '[]', '{}') THEN 0 ELSE 1 END + CASE WHEN nullif(c_mktsegment, 'BUILDING') IS NULL THEN 0 ELSE 1 END) / 2.0, 6) AS completeness FROM customer""")
def popularity(spark, sf_dir):
    """Popularity and completeness of records."""
    rows = table(spark, sf_dir, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    out = accounting.popularity(rows, "c_acctbal", "c_nationkey").withColumn("completeness", accounting.completeness(["c_name", "segment"]))
    return rounded(out.select("c_custkey", "popularity", "completeness"))


@query("""
WITH x AS (SELECT p_partkey, CASE WHEN p_retailprice < 950 THEN NULL ELSE p_retailprice END AS price, CAST(p_size AS DOUBLE) AS size, p_name FROM part)
SELECT p_partkey, round((price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()), 6) AS z_price, round((size - min(size) OVER ()) / (max(size) OVER () - min(size) OVER ()), 6) AS z_size,
CASE WHEN size <= 10 THEN 'tiny' WHEN size <= 100 THEN 'small' END AS size_class, CAST(least(floor((size - min(size) OVER ()) / (max(size) OVER () - min(size) OVER ()) * 10), 9) AS INT) AS tenth,
CASE WHEN price IS NULL THEN 'Size: ' || CAST(size AS BIGINT) ELSE 'Price: ' || CASE WHEN price = floor(price) THEN CAST(CAST(price AS BIGINT) AS VARCHAR) ELSE CAST(price AS VARCHAR) END || chr(10) || 'Size: ' || CAST(size AS BIGINT) END AS lines, round(size / nullif(size - 1, 0), 6) AS ratio FROM x""")
def representation(spark, sf_dir):
    """Scaled coordinates, classes and labelled text of parts, with missing prices."""
    x = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_retailprice") < 950, None).otherwise(F.col("p_retailprice")).alias("price"), F.col("p_size").cast("double").alias("size"))
    x = accounting.with_scaled(x, ["price", "size"])
    lines = scalars.labelled_lines(Price=scalars.lossless_text(F.col("price")), Size=scalars.lossless_text(F.col("size")))
    return rounded(x.select("p_partkey", "z_price", "z_size", scalars.size_class(F.col("size")).alias("size_class"), scalars.tenth(F.col("z_size")).alias("tenth"), lines.alias("lines"), accounting.safe_ratio(F.col("size"), F.col("size") - 1).alias("ratio")))


@query("""
WITH v AS (SELECT l_suppkey AS source, l_returnflag AS method, avg(l_discount) AS value FROM lineitem WHERE l_quantity > 20 + 5 * (l_suppkey % 7) GROUP BY ALL),
c AS (SELECT unnest(['A', 'N', 'R', 'X']) AS method), s AS (SELECT source FROM v GROUP BY 1 HAVING count(DISTINCT method) = 4)
SELECT c.method, coalesce(n, 0) AS n, round(coalesce(n, 0) / 1000.0, 6) AS coverage, round(mean, 6) AS mean, coalesce(cn, 0) AS common_n, round(cm, 6) AS common_mean FROM c
LEFT JOIN (SELECT method, count(*) AS n, avg(value) AS mean FROM v GROUP BY 1) a USING (method) LEFT JOIN (SELECT method, count(*) AS cn, avg(value) AS cm FROM v SEMI JOIN s USING (source) GROUP BY 1) b USING (method)""")
def coverage_summaries(spark, sf_dir):
    """Coverage and means of cells, one of which has nothing."""
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 20 + 5 * (l_suppkey % 7)")
    v = rows.groupBy(F.col("l_suppkey").alias("source"), F.col("l_returnflag").alias("method")).agg(F.avg("l_discount").alias("value"))
    cells = spark.createDataFrame([(m,) for m in "ANRX"], "method string")
    return rounded(accounting.summaries(v, cells, "source", "method", "value", 1000))


@query("""
WITH w AS (SELECT s_suppkey AS source, m, seed FROM supplier, (SELECT 'det' AS m, CAST(NULL AS INT) AS seed UNION ALL SELECT 'rnd', unnest([1, 2, 3]))),
h AS (SELECT * FROM w WHERE NOT (source % 7 = 0 AND coalesce(seed, 0) = 2) UNION ALL SELECT * FROM w WHERE source % 11 = 0 AND seed IS NULL UNION ALL SELECT source, 'odd', NULL FROM w WHERE source % 13 = 0 AND seed = 1)
SELECT problem, count(*) AS n FROM (SELECT 'absent' AS problem FROM w WHERE source % 7 = 0 AND seed = 2 UNION ALL SELECT 'unexpected' FROM h WHERE m = 'odd' UNION ALL SELECT 'twice' FROM h GROUP BY source, m, seed HAVING count(*) > 1) GROUP BY problem""")
def accounting_gaps(spark, sf_dir):
    """Cells that are absent, unexpected or there twice."""
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"))
    cells = spark.createDataFrame([("det", False), ("rnd", True)], "m string, stochastic boolean")
    wanted = accounting.expected(sources, cells, spark.createDataFrame([(1,), (2,), (3,)], "seed int"))
    have = wanted.where("not (source % 7 = 0 and coalesce(seed, 0) = 2)").unionByName(wanted.where("source % 11 = 0 and seed is null")).unionByName(sources.where("source % 13 = 0").select("source", F.lit("odd").alias("m"), F.lit(None).cast("int").alias("seed")))
    return accounting.accounting_gaps(have, wanted, ["source", "m", "seed"]).groupBy("problem").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT lang, source, count(*) AS support FROM documents GROUP BY ALL), j AS (SELECT *, '{"conditions":[{"field":"lang","value":"' || lang || '"},{"field":"source","value":"' || source || '"}],"operator":"AND"}' AS intent_json FROM c)
SELECT intent_json, sha256(intent_json) AS sha256, 'intent_' || substr(sha256(intent_json), 1, 16) AS intent_id, 2 AS complexity, 'lang|source' AS "group", support, sha256('datagauge|' || sha256(intent_json)) AS sampling_key FROM j""")
def intents(spark, sf_dir):
    """Intents of two conditions given in the wrong order."""
    c = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("support"))
    listed = c.select("support", F.array(F.struct(F.lit("source").alias("field"), F.col("source").alias("value")), F.struct(F.lit("lang").alias("field"), F.col("lang").alias("value"))).alias("conditions"))
    return workload.intents(listed, ["lang", "source"], NAMESPACE)


@query("""
WITH x AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t, sha256('datagauge|' || doc_id) AS k FROM documents),
f AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY k, doc_id) AS first FROM x)
SELECT doc_id, first, CASE WHEN first = doc_id THEN 'KEPT' ELSE 'DUPLICATE' END AS status FROM f""")
def text_duplicates(spark, sf_dir):
    """The earliest of each normalised text in order of hash."""
    from datagauge.functions.identity import hash_key

    rows = table(spark, sf_dir, "documents").select("doc_id", "text", hash_key(NAMESPACE, F.col("doc_id")).alias("sampling_key"), F.lit(0).alias("support"), F.lit("").alias("sha256"))
    return workload.duplicates(rows, "text", "doc_id").select("doc_id", "first", "status")


@query("""
WITH s AS (SELECT s_suppkey AS slot, s_nationkey % 3 AS grp, s_suppkey % 2 AS stratum, row_number() OVER (PARTITION BY s_nationkey % 3, s_suppkey % 2 ORDER BY s_suppkey) AS r FROM supplier WHERE s_acctbal < 3000),
p AS (SELECT c_custkey, c_nationkey % 3 AS grp, c_custkey % 2 AS stratum, row_number() OVER (PARTITION BY c_nationkey % 3, c_custkey % 2 ORDER BY sha256('datagauge|' || c_custkey), c_custkey) AS r FROM customer WHERE c_acctbal < -800)
SELECT slot, s.grp AS "group", s.stratum, c_custkey AS replacement, CASE WHEN c_custkey IS NULL THEN 'STRUCTURAL_NA' ELSE 'REPLACED' END AS status FROM s LEFT JOIN p USING (grp, stratum, r)""")
def replacements(spark, sf_dir):
    """Failed slots that take the next unused record of their stratum, as far as there are any."""
    from datagauge.functions.identity import hash_key

    slots = table(spark, sf_dir, "supplier").where("s_acctbal < 3000").select(F.col("s_suppkey").alias("slot"), (F.col("s_nationkey") % 3).alias("group"), (F.col("s_suppkey") % 2).alias("stratum"), F.col("s_suppkey").alias("slot_order"))
    pool = table(spark, sf_dir, "customer").where("c_acctbal < -800").select("c_custkey", (F.col("c_nationkey") % 3).alias("group"), (F.col("c_custkey") % 2).alias("stratum"), hash_key(NAMESPACE, F.col("c_custkey")).alias("sampling_key"), F.col("c_custkey").alias("support"), F.lit("").alias("sha256"))
    return workload.replacements(slots, pool, "c_custkey", keep_missing=True)


@query("""
WITH f AS (SELECT doc_id, lang AS field_value, 'lang' AS field, n_chars > 1000 AS d FROM documents UNION ALL SELECT doc_id, source, 'source', n_chars > 1000 FROM documents UNION ALL SELECT doc_id, 'all', 'all', n_chars > 1000 FROM documents)
SELECT field, field_value AS value, count(*) AS n, count(*) FILTER (d) AS done, count(*) FILTER (NOT d) AS missing, round(avg(CAST(d AS DOUBLE)), 6) AS share FROM f GROUP BY ALL""")
def coverage_table(spark, sf_dir):
    """Done and missing rows by field."""
    return rounded(accounting.coverage(table(spark, sf_dir, "documents"), ["lang", "source"], F.col("n_chars") > 1000))


@query("""
WITH t AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem WHERE l_orderkey % 5 > 0), m AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy FROM t)
SELECT l_returnflag, round(avg(my + sxy / (sxx + 10) * (l_quantity - mx)), 5) AS mean_prediction, count(*) AS n FROM lineitem, m WHERE l_orderkey % 5 = 0 GROUP BY 1""")
def ridge_regression(spark, sf_dir):
    """Ridge with one column, on held-out rows."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    scored = ridge(rows.where("l_orderkey % 5 > 0"), rows.where("l_orderkey % 5 = 0").drop("y"), ["x"], "y", 10.0)
    return rounded(scored.groupBy("l_returnflag").agg(F.avg("prediction").alias("mean_prediction"), F.count("*").alias("n")), 5)


@query("""
WITH x AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('datagauge|' || lang || '|' || doc_id), doc_id) AS rank FROM documents)
SELECT size, doc_id, rank FROM x, (SELECT CAST(unnest([20, 50]) AS INT) AS size) WHERE rank <= size""")
def hash_prefixes(spark, sf_dir):
    """Literal prefixes of a hashed order within languages."""
    ordered = splits.hash_order(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", NAMESPACE, ["lang"])
    return splits.prefixes(ordered, (20, 50)).select("size", "doc_id", "rank")


@query("""
WITH p AS (SELECT s_suppkey AS u, s_acctbal / 100 AS a, s_nationkey AS b FROM supplier)
SELECT count(*) AS n, round(avg(a - b), 6) AS mean, round(median(a - b), 6) AS median, round(avg(CAST(a > b AS DOUBLE)), 6) AS win, round(avg(CAST(a = b AS DOUBLE)), 6) AS tie, round(avg(CAST(a < b AS DOUBLE)), 6) AS loss FROM p""")
def paired_difference(spark, sf_dir):
    """The observed part of a paired effect; its interval comes from random streams that SQL hasn't."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("u"), (F.col("s_acctbal") / 100).alias("a"), F.col("s_nationkey").cast("double").alias("b"))
    weights = inference.bootstrap_weights(spark, {"namespace": NAMESPACE}, 50, rows.count())
    return rounded(inference.paired_effect(rows, "u", "a", "b", weights, 50).select("n", "mean", "median", "win", "tie", "loss"))

