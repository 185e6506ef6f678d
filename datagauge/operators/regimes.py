"""Outer and inner splits of all regimes over one relation of observations.

G0, GD and GF hold out groups (runs, tasks, flows), GT later times, GDF tasks and flows at once, DRR rows by hash.
A split is (regime, condition, fold_id, uid, role).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datagauge.operators.contracts import require
from datagauge.operators.splits import balanced_folds, embargo_folds, expanding_split, hashed_fold, long_folds, temporal_blocks

#: Regimes that hold out groups, and the column of the group.
GROUPS = {"G0": "run", "GD": "task", "GF": "flow"}
INNER_ROLE = {"TEST": "VALIDATION"}


def _assigned(rows: DataFrame, group: str, namespace: str, folds: int, capacities: list[int] | None, name: str = "fold") -> DataFrame:
    fold = balanced_folds(rows, group, namespace, folds, capacities=capacities).select(group, F.col("fold").alias(name))
    return rows.join(fold, group)


def _labelled(split: DataFrame, regime: str, condition: str | None = None) -> DataFrame:
    return split.select(F.lit(regime).alias("regime"), F.lit(condition or regime).alias("condition"), "fold_id", "uid", "role")


def outer_splits(rows: DataFrame, namespace: str, capacities: dict[str, list[int]] | None = None, folds: int = 5) -> DataFrame:
    """All regimes' splits of rows (uid, run, task, flow, time). capacities bounds the groups of each fold of GD or GF.

    Each regime and group has a namespace of its own. GT has one fold and a condition for each share of training blocks.
    """
    capacities = capacities or {}
    parts = []
    for regime, group in GROUPS.items():
        own = _assigned(rows, group, f"{namespace}|{regime}", folds, capacities.get(regime))
        parts.append(_labelled(long_folds(own, "uid", folds), regime))
    steps = expanding_split(temporal_blocks(rows, "time"), "uid")
    shares = F.concat(F.lit("GT"), (F.col("fold_id") * 20).cast("string"))
    parts.append(steps.select(F.lit("GT").alias("regime"), shares.alias("condition"), F.lit(0).alias("fold_id"), "uid", "role"))
    both = _assigned(_assigned(rows, "task", f"{namespace}|GD", folds, capacities.get("GD"), "a"), "flow", f"{namespace}|GF", folds, capacities.get("GF"), "b")
    parts.append(_labelled(embargo_folds(both, "uid", "a", "b", folds), "GDF"))
    parts.append(_labelled(long_folds(hashed_fold(rows, "uid", f"{namespace}|DRR", folds), "uid", folds), "DRR"))
    return reduce(DataFrame.unionByName, parts)


def inner_splits(rows: DataFrame, outer: DataFrame, regime: str, condition: str, fold: int, namespace: str, capacities: dict[str, list[int]] | None = None) -> DataFrame:
    """(fold_id, uid, role) of three folds inside one outer training set, with the regime's own way of holding out.

    GT trains on ever more blocks of a quarter and validates on the next; GDF holds out tasks and flows; others their groups.
    """
    capacities = capacities or {}
    name = f"{namespace}|inner|{regime}|{condition}|{fold}"
    chosen = outer.where((F.col("regime") == regime) & (F.col("condition") == condition) & (F.col("fold_id") == fold) & (F.col("role") == "TRAIN")).select("uid")
    train = rows.join(chosen, "uid", "left_semi")
    if regime == "GT":
        split = expanding_split(temporal_blocks(train, "time", (0.25, 0.5, 0.75)), "uid", 3).withColumn("fold_id", F.col("fold_id") - 1)
    elif regime == "GDF":
        both = _assigned(_assigned(train, "task", f"{name}|task", 3, capacities.get("task"), "a"), "flow", f"{name}|flow", 3, capacities.get("flow"), "b")
        split = embargo_folds(both, "uid", "a", "b", 3)
    else:
        require(regime in GROUPS, f"{regime} has no inner splits")
        split = long_folds(_assigned(train, GROUPS[regime], name, 3, capacities.get(GROUPS[regime])), "uid", 3)
    return split.withColumn("role", F.coalesce(F.create_map(*[F.lit(x) for pair in INNER_ROLE.items() for x in pair])[F.col("role")], F.col("role")))


def chronological(split: DataFrame, rows: DataFrame) -> DataFrame:
    """(fold_id, strict): whether all training times are before all validation times; null where a side is empty."""
    both = split.join(rows.select("uid", "time"), "uid").groupBy("fold_id")
    return both.agg((F.max(F.when(F.col("role") == "TRAIN", F.col("time"))) < F.min(F.when(F.col("role") == "VALIDATION", F.col("time")))).alias("strict"))


def supported(split: DataFrame, rows: DataFrame, role: str = "TEST", least_rows: int = 1000, least_tasks: int = 10, least_flows: int = 50) -> DataFrame:
    """(fold_id, n_rows, n_tasks, n_flows, enough) of the held-out part of each fold."""
    got = split.where(F.col("role") == role).join(rows, "uid").groupBy("fold_id").agg(F.count("*").alias("n_rows"), F.count_distinct("task").alias("n_tasks"), F.count_distinct("flow").alias("n_flows"))
    return got.withColumn("enough", (F.col("n_rows") >= least_rows) & (F.col("n_tasks") >= least_tasks) & (F.col("n_flows") >= least_flows))
