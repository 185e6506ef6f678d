"""Cohort of observations under contract, and small workload relations around it."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datagauge.functions.identity import flow_uid, observation_uid_artifact, task_dataset_uid
from datagauge.functions.scalars import words
from datagauge.operators.contracts import check, finite, one_to_one


def cohort(source: DataFrame, artifact: str, namespace: str, rows: int | None = None, tasks: int | None = None, flows: int | None = None) -> DataFrame:
    """Observations with uids from (row, run_id, task_id, dataset_id, flow_id, upload_time, predictive_accuracy).

    Task and dataset are one to one, accuracies finite and within [0, 1], rows a key; given
    cardinalities must hold. What breaks a rule raises.
    """
    needed = ["row", "run_id", "task_id", "dataset_id", "flow_id", "upload_time", "predictive_accuracy"]
    y = F.col("predictive_accuracy")
    sizes = {k: v for k, v in (("task_id", tasks), ("flow_id", flows)) if v is not None}
    check(source, needed, {"finite": finite(y), "domain": (y >= 0) & (y <= 1)}, ["row"], rows, sizes)
    one_to_one(source, "task_id", "dataset_id")
    return source.select(
        observation_uid_artifact(F.lit(artifact), namespace, F.col("row").cast("bigint")).alias("observation_uid"),
        task_dataset_uid(F.col("task_id").cast("bigint"), F.col("dataset_id").cast("bigint")).alias("task_dataset_uid"),
        flow_uid(F.col("flow_id").cast("bigint")).alias("flow_uid"),
        *[F.col(c).cast("bigint") for c in ("row", "run_id", "task_id", "dataset_id", "flow_id")],
        F.col("upload_time").cast("timestamp_ntz").alias("timestamp"), y.cast("double").alias("accuracy"),
    )


def normalise_values(value: Column) -> Column:
    """Set of a metadata text's values: lower case, parts at commas, bars and semicolons, punctuation at their ends off, nothings and repeats out."""
    parts = F.transform(F.split(F.lower(F.coalesce(value, F.lit(""))), "[,|;]"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[\p{Punct}\s]+|[\p{Punct}\s]+$", "")))
    return F.array_distinct(F.filter(parts, lambda x: ~x.isin("", "nan", "none", "null", "unknown", "n/a", "na")))


def realisation(query: Column, values: Column) -> Column:
    """(recall, phrases, class): mean share of values' words that a query has, values that it holds word for word, and Low, Medium or High."""
    asked = words(query)
    share = lambda v: F.coalesce(F.try_divide(F.size(F.array_intersect(F.array_distinct(words(v)), asked)).cast("double"), F.size(F.array_distinct(words(v)))), F.lit(0.0))
    recall = F.aggregate(values, F.lit(0.0), lambda s, v: s + share(v)) / F.greatest(F.size(values), F.lit(1))
    padded = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    phrases = F.size(F.filter(values, lambda v: padded(asked).contains(padded(words(v)))))
    return F.struct(recall.alias("recall"), phrases.alias("phrases"), F.when(recall < 1 / 3, "Low").when(recall < 2 / 3, "Medium").otherwise("High").alias("class"))


def prompt(conditions: Column) -> Column:
    """One line for each (field, value) condition, in the given order."""
    return F.array_join(F.transform(conditions, lambda c: F.concat(c["field"], F.lit(" = "), c["value"])), "\n")


def representative_coalitions(spark: SparkSession, ordered: list, folds: dict, sizes: tuple[int, ...] = (2, 5, 12, 24, 42, 63)) -> DataFrame:
    """(name, player): the first, the last, all, each fold, and prefixes of an order; the empty coalition has no rows."""
    named = {"first": ordered[:1], "last": ordered[-1:], "all": ordered}
    named |= {f"fold{f}": [p for p in ordered if folds[p] == f] for f in sorted(set(folds.values()))}
    named |= {f"prefix{n}": ordered[:n] for n in sizes if n <= len(ordered)}
    kind = "bigint" if isinstance(ordered[0], int) else "string"
    return spark.createDataFrame([(n, p) for n, ps in named.items() for p in ps], f"name string, player {kind}")


def consequence_coalitions(ranked: DataFrame) -> DataFrame:
    """(direction, k, player) for (player, rank): the best k added, what is left when the best k are removed, and the worst k added."""
    n = F.max("rank").over(Window.partitionBy())
    every = ranked.withColumn("_n", n).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return every.select("k", "player", F.explode(F.array(
        F.when(F.col("rank") <= F.col("k"), "addition"), F.when(F.col("rank") > F.col("k"), "removal"), F.when(F.col("rank") > F.col("_n") - F.col("k"), "reverse_addition"),
    )).alias("direction")).where("direction is not null")


def stream_seed(namespace: str, seed: int) -> int:
    """A 128-bit seed of a named stream; a name is four parts between slashes."""
    if len(namespace.split("/")) != 4 or not all(namespace.split("/")):
        raise ValueError("a stream is named by four parts")
    return int.from_bytes(hashlib.sha256(f"{namespace}|raw_seed={int(seed)}".encode()).digest()[:16], "big")
