"""Sources and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datagauge.operators.contracts import ContractError, check, require


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header; doubles keep their exact values. Rows that don't fit the schema raise."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def json_document(spark: SparkSession, path: str):
    """A whole JSON file as a driver-side value."""
    rows = spark.read.text(path, wholetext=True).head(2)
    require(len(rows) == 1, f"{path} isn't one document")
    return json.loads(rows[0].value)


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(position, vector) of the rows of .npy files, without pickles."""

    def rows(batches):
        import io

        import numpy as np
        import pandas as pd

        for b in batches:
            for raw in b["content"]:
                m = np.load(io.BytesIO(raw), allow_pickle=False)
                for at in range(0, len(m), 1000):
                    yield pd.DataFrame({"position": np.arange(at, min(at + 1000, len(m))), "vector": [x.astype(float).tolist() for x in m[at : at + 1000]]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "position bigint, vector array<double>")


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(token, vector) of a word2vec text file, whose first line gives the number and length of vectors; a file that differs raises."""
    lines = spark.read.text(path).withColumn("value", F.trim("value")).where("value <> ''")
    parts = F.split("value", r"\s+")
    header = lines.where(F.size(parts) == 2).head(2)
    require(len(header) == 1, "no header, or several")
    count, width = map(int, header[0].value.split())
    rows = lines.where(F.size(parts) != 2)
    vectors = rows.select(parts[0].alias("token"), F.transform(F.slice(parts, 2, 1_000_000), lambda x: x.cast("double")).alias("vector"))
    return check(vectors, rules={"width": (F.size("vector") == width) & ~F.exists("vector", lambda x: x.isNull())}, unique=["token"], rows=count)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def integrity(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status) of files that a manifest (path, sha256) names: ok, changed or absent."""
    both = manifest.alias("m").join(files.alias("f"), F.endswith(F.col("f.path"), F.col("m.path")), "left")
    status = F.when(F.col("f.sha256").isNull(), "absent").when(F.col("f.sha256") == F.col("m.sha256"), "ok").otherwise("changed")
    return both.select("m.path", status.alias("status"))


def support_lists(rows: DataFrame, group: str, position: str, value: str) -> DataFrame:
    """(group, values in order of position); positions must be 0, 1, 2 and so on without a gap."""
    got = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(position, value))).alias("s"), F.min(position).alias("lo"), F.max(position).alias("hi"), F.count("*").alias("n"))
    check(got, rules={"positions": (F.col("lo") == 0) & (F.col("hi") + 1 == F.col("n"))})
    return got.select(group, F.col(f"s.{value}").alias("members"))


def write_new(df: DataFrame, path: str) -> None:
    """Write JSON; a path that exists raises."""
    df.write.mode("errorifexists").json(path)


__all__ = ["ContractError", "checksums", "csv", "integrity", "json_document", "json_lines", "matrix", "parquet", "support_lists", "word_vectors", "write_new"]
