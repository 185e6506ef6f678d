"""Registered queries of the engine and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from datagauge.plans import evaluation, ranking, regimes, workloads

FLAGSHIP = "frequency_baseline"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = evaluation.QUERIES | ranking.QUERIES | workloads.QUERIES | regimes.QUERIES
ORACLES: dict[str, str] = evaluation.ORACLES | ranking.ORACLES | workloads.ORACLES | regimes.ORACLES
