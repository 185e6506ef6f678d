"""The abstract relations of the operators on the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMESPACE = "datagauge"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, task, flow, accuracy): line items, whose discount of 0 to 0.1 stands for an accuracy of 0 to 1."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_suppkey").alias("task"), F.col("l_partkey").alias("flow"), (F.col("l_discount") * 10).alias("accuracy"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of parallel sums can't show; -0 is 0."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
