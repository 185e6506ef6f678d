"""Declared rules on tables, checked in one aggregate pass; a broken rule raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    pass


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ContractError(message)


def check(df: DataFrame, columns: list[str] = (), rules: dict[str, Column] | None = None, unique: list[str] = (), rows: int | None = None, distinct: dict[str, int] | None = None) -> DataFrame:
    """df itself, if it has the columns and rows and each rule holds for every row (null counts as broken).

    unique names a key; distinct gives exact numbers of distinct values of columns.
    """
    absent = [c for c in columns if c not in df.columns]
    require(not absent, f"columns are missing: {absent}")
    rules, distinct = rules or {}, distinct or {}
    sums = [F.count("*").alias("_rows")]
    sums += [F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"_rule{i}") for i, rule in enumerate(rules.values())]
    sums += [F.count_distinct(F.col(c)).alias(f"_distinct_{c}") for c in distinct]
    if unique:
        sums.append(F.count_distinct(F.struct(*unique)).alias("_key"))
    if len(sums) > 1 or rows is not None:
        got = df.agg(*sums).first()
        for i, name in enumerate(rules):
            require(got[f"_rule{i}"] == 0, f"{name}: broken in {got[f'_rule{i}']} rows")
        for c, n in distinct.items():
            require(got[f"_distinct_{c}"] == n, f"{c} has {got[f'_distinct_{c}']} values, not {n}")
        require(rows is None or got["_rows"] == rows, f"{got['_rows']} rows, not {rows}")
        require(not unique or got["_key"] == got["_rows"], f"{list(unique)} is no key")
    return df


#: Rows of a side that is sent to all tasks, at most.
MOST_SENT = 200_000


def small(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """df, marked to be sent to all tasks if it has few enough rows (which are counted first); else as it is, and Spark shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def one_to_one(df: DataFrame, a: str, b: str) -> DataFrame:
    """df itself, if each value of a goes with one of b and the other way round."""
    got = df.select(a, b).distinct().agg(F.count("*").alias("n"), F.count_distinct(a).alias("a"), F.count_distinct(b).alias("b")).first()
    require(got["n"] == got["a"] == got["b"], f"{a} and {b} aren't one to one")
    return df


def outside(df: DataFrame, forbidden: str) -> DataFrame:
    """df itself, if it lacks a column that a fit or prediction must not see."""
    require(forbidden not in df.columns, f"{forbidden} must not be seen here")
    return df


#: Which settings' artifacts another setting may use. Intrinsic ones need equal hashes, derived ones never pass.
LINEAGE = {"same": True, "derived": False}


def lineage_allowed(source: str, target: str, kind: str, source_hash: str = "", target_hash: str = "") -> bool:
    """Whether an artifact of one setting may be used in another."""
    if source == target:
        return LINEAGE["same"]
    if kind == "intrinsic":
        return bool(source_hash) and source_hash == target_hash
    return LINEAGE.get(kind, False)
