"""Small DataFrame helpers of this subpackage."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from datagauge.llm.kernels import given_back

#: Spark's own switch: shuffle files are deleted at the end of a query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set only where the session has none, which raises on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        found = f"file://{tempfile.gettempdir()}/datagauge-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it again. Shuffle files of the write go when it is done."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._datagauge_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark's file systems have it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    path = getattr(df, "_datagauge_path", None)
    if path:
        remove(df.sparkSession, path)


def widened(kept: list, fields: list[tuple[str, str]]) -> StructType:
    """A schema of fields that are kept and new ones of (name, type)."""
    return StructType([StructField(f.name, f.dataType) for f in kept] + [StructField(n, StructType.fromDDL(f"x {t}")["x"].dataType) for n, t in fields])


def map_text(df: DataFrame, column: str, fields: list[tuple[str, str]], make, keep: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Append columns worked out from a text column, in Arrow batches of bounded bytes (`most`, if given).

    make() runs once per task and gives a function from a RecordBatch to the list of
    new arrays. Columns of `df` with the name of a new one are replaced.
    """
    new = [name for name, _ in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    read = list(dict.fromkeys([*kept, column]))
    source = df.select(*[f"`{c}`" for c in read])
    schema = widened([source.schema[c] for c in kept], fields)

    def run(batches):
        import pyarrow as pa

        from datagauge.llm.kernels import SLICE_BYTES, slices

        work = make()
        for part in slices(batches, column, most or SLICE_BYTES):
            arrays = [part.column(c) for c in kept] + list(work(part))
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *new])

    return source.mapInArrow(lambda batches: given_back(run(batches)), schema)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no live DataFrame reads."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
