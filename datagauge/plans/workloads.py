"""Queries on cohorts, coalitions and metadata, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from datagauge.functions import identity
from datagauge.operators import cohort as cohorts
from datagauge.operators import games, splits
from datagauge.plans.adapters import NAMESPACE, observations, rounded, table
from datagauge.plans.ranking import GAME, fold_scores

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""
WITH x AS (SELECT event_id AS row, event_id AS run_id, user_id AS task_id, user_id + 1000 AS dataset_id, length(event_type) AS flow_id, ts AS timestamp, round((value - floor(value)), 6) AS accuracy FROM events)
SELECT 'obs_' || sha256('{"artifact_sha256":"a","namespace":"datagauge","source_row_index":' || row || '}') AS observation_uid, 'td_' || sha256('{"dataset_id":' || dataset_id || ',"task_id":' || task_id || '}') AS task_dataset_uid,
'flow_' || sha256('{"flow_id":' || flow_id || '}') AS flow_uid, row, run_id, task_id, dataset_id, CAST(flow_id AS BIGINT) AS flow_id, timestamp, accuracy FROM x""")
def cohort(spark, sf_dir):
    """Events as observations under contract."""
    e = table(spark, sf_dir, "events")
    source = e.select(F.col("event_id").alias("row"), F.col("event_id").alias("run_id"), F.col("user_id").alias("task_id"), (F.col("user_id") + 1000).alias("dataset_id"), F.length("event_type").alias("flow_id"), F.col("ts").alias("upload_time"), F.round(F.col("value") - F.floor("value"), 6).alias("predictive_accuracy"))
    return rounded(cohorts.cohort(source, "a", NAMESPACE))


@query("""
WITH p AS (SELECT p_partkey, list_transform(string_split(lower(p_type || ', ' || p_brand || '; unknown |' || p_type || '.'), ','), lambda x: x) AS a, lower(p_type) AS t, lower(p_brand) AS b FROM part)
SELECT p_partkey, CASE WHEN t = b THEN [t] ELSE [t, b] END AS parts FROM p""")
def metadata_values(spark, sf_dir):
    """Values of a delimited text: repeats, nothings and punctuation are out."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", cohorts.normalise_values(F.concat("p_type", F.lit(", "), "p_brand", F.lit("; unknown |"), "p_type", F.lit("."))).alias("parts"))


@query(f"""WITH {GAME}, v AS (SELECT player, sum(gain * sh) AS a FROM g JOIN w USING (k) GROUP BY player), r AS (SELECT player, row_number() OVER (ORDER BY round(a, 9) DESC, player) AS rank FROM v),
c AS (SELECT 'addition' AS direction, k, player FROM r, range(1, 9) t(k) WHERE rank <= k UNION ALL SELECT 'removal', k, player FROM r, range(1, 9) t(k) WHERE rank > k UNION ALL SELECT 'reverse_addition', k, player FROM r, range(1, 9) t(k) WHERE rank > 8 - k)
SELECT direction, CAST(k AS INT) AS k, round(avg(score), 6) AS utility FROM c JOIN s USING (player) GROUP BY ALL""")
def consequence(spark, sf_dir):
    """Utilities of coalitions that follow the Shapley order."""
    scores = fold_scores(spark, sf_dir)
    values = games.exact_values(games.mean_utility(games.coalitions(spark, 8), scores, 8), 8)
    ranked = values.select("player", F.row_number().over(Window.orderBy(F.desc(F.round("shapley", 9)), "player")).alias("rank"))
    return rounded(cohorts.consequence_coalitions(ranked).join(scores, "player").groupBy("direction", "k").agg(F.avg("score").alias("utility")))


@query("""
WITH p AS (SELECT l_suppkey AS task, count(*) AS observations FROM lineitem GROUP BY 1)
SELECT task, observations, CAST(row_number() OVER (ORDER BY task) AS INT) AS number FROM p""")
def player_registry(spark, sf_dir):
    """Players in canonical order with their counts; the fold is the greedy one of balanced_folds."""
    return splits.players(observations(spark, sf_dir), ["task"], NAMESPACE).select("task", "observations", "number")


@query("""
WITH x AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256('datagauge|' || c_custkey), c_custkey) AS rank FROM customer)
SELECT c_custkey, CAST(rank AS INT) AS rank, CAST(floor((rank - 1) / 8) AS INT) AS "group" FROM x WHERE rank <= 24""")
def interaction_groups(spark, sf_dir):
    """Three groups of eight in order of hash."""
    ordered = splits.hash_order(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", NAMESPACE)
    return splits.interaction_groups(ordered).select("c_custkey", F.col("rank").cast("int").alias("rank"), "group")


@query("""
SELECT s_suppkey, 'p_' || sha256('{"name":"' || s_name || '","nation":' || s_nationkey || '}') AS uid, CAST((('0x' || substr(sha256(s_name), 1, 15))::BIGINT) AS BIGINT) AS prefix FROM supplier""")
def canonical_identity(spark, sf_dir):
    """Hash identities of records."""
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", identity.canonical_uid("p_", nation=F.col("s_nationkey"), name=F.col("s_name")).alias("uid"), F.conv(F.substring(identity.sha256_text(F.col("s_name")), 1, 15), 16, 10).cast("bigint").alias("prefix"))


@query("""
WITH d AS (SELECT doc_id, lang, source, regexp_extract_all(lower(lang || ' of ' || source), '[\\p{L}\\p{N}]+') AS w, CASE WHEN doc_id % 3 = 0 THEN 'about ' || source ELSE 'a ' || lang || ' text' END AS q FROM documents),
x AS (SELECT doc_id, regexp_extract_all(q, '[\\p{L}\\p{N}]+') AS a, lang, source FROM d),
y AS (SELECT doc_id, (CAST(list_contains(a, lang) AS INT) + CAST(list_contains(a, source) AS INT)) / 2 AS r, CAST(list_contains(a, lang) AS INT) + CAST(list_contains(a, source) AS INT) AS phrases FROM x)
SELECT doc_id, round(r, 6) AS recall, phrases, CASE WHEN r < 1.0 / 3 THEN 'Low' WHEN r < 2.0 / 3 THEN 'Medium' ELSE 'High' END AS class FROM y""")
def query_realisation(spark, sf_dir):
    """How much of two values a query says."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("v"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("about "), "source")).otherwise(F.concat(F.lit("a "), "lang", F.lit(" text"))).alias("q"))
    return rounded(d.select("doc_id", cohorts.realisation(F.col("q"), F.col("v")).alias("r")).select("doc_id", "r.*"))


