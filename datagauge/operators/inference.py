"""Bootstrap designs, intervals, paired effects, family-wise correction, rater agreement."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datagauge.functions.identity import hash_key
from datagauge.operators.contracts import check, finite, require


def draw(payload: bytes, count: int, size: int):
    """size indices below count, from a PCG64DXSM stream seeded by the first 16 bytes of the payload's SHA-256."""
    import numpy as np

    seed = int.from_bytes(hashlib.sha256(payload).digest()[:16], "big")
    return np.random.Generator(np.random.PCG64DXSM(seed)).integers(0, count, size=size, dtype=np.int64)


def canonical(payload: dict) -> bytes:
    return json.dumps(payload, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()


def bootstrap_weights(spark: SparkSession, payload: dict, replicates: int, count: int) -> DataFrame:
    """(replicate, position, weight): how often each of `count` units is drawn in each replicate; units not drawn have no row."""

    def rows(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            for r in b["id"]:
                w = np.bincount(draw(canonical(payload | {"replicate": int(r)}), count, count), minlength=count)
                at = np.flatnonzero(w)
                yield pd.DataFrame({"replicate": int(r), "position": at, "weight": w[at]})

    return spark.range(replicates).repartition(max(1, min(replicates, spark.sparkContext.defaultParallelism))).mapInPandas(rows, "replicate bigint, position bigint, weight bigint")


def interval(draws: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """The 2.5 and 97.5 percentiles (linear) of draws; undefined if a draw is null or NaN, and an infinite draw raises."""
    check(draws, rules={"finite or undefined": F.col(value).isNull() | F.isnan(value) | (F.abs(value) < float("inf"))})
    gap = F.count_if(F.col(value).isNull() | F.isnan(value)) > 0
    p = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return draws.groupBy(*by).agg(F.when(gap, "UNDEFINED").otherwise("DEFINED").alias("status"), F.when(~gap, p[0]).alias("low"), F.when(~gap, p[1]).alias("high"))


def paired_effect(pairs: DataFrame, unit: str, a: str, b: str, weights: DataFrame, replicates: int, by: list[str] = ()) -> DataFrame:
    """Mean and median difference a - b over units, its interval, win, tie and loss shares, and p of a centred null.

    pairs has a row for each unit (and group `by`), numbered in order of unit to meet the positions of `weights`.
    """
    by = list(by)
    check(pairs, rules={"finite": finite(F.col(a)) & finite(F.col(b))}, unique=[*by, unit])
    delta = pairs.select(*by, unit, (F.col(a) - F.col(b)).alias("d")).withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(unit)).cast("bigint") - 1)
    observed = delta.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("d").alias("mean"), F.median("d").alias("median"),
        F.avg((F.col("d") > 0).cast("double")).alias("win"), F.avg((F.col("d") == 0).cast("double")).alias("tie"), F.avg((F.col("d") < 0).cast("double")).alias("loss"),
    )
    means = delta.join(weights, "position").groupBy(*by, "replicate").agg((F.sum(F.col("weight") * F.col("d")) / F.sum("weight")).alias("m"))
    ci = interval(means, "m", by).drop("status")
    joined = means.join(observed.select(*by, "mean"), by) if by else means.crossJoin(F.broadcast(observed.select("mean")))
    p = joined.groupBy(*by).agg(((F.count_if(F.abs(F.col("m") - F.col("mean")) >= F.abs("mean")) + 1) / F.lit(replicates + 1)).alias("p"))
    return observed.join(ci, by).join(p, by) if by else observed.crossJoin(ci).crossJoin(p)


def holm(pvalues: DataFrame, key: str, p: str = "p", by: list[str] = (), level: float = 0.05) -> DataFrame:
    """pvalues with holm_p (running maximum of min(1, (m - i) p) by p, then key) and reject."""
    order = Window.partitionBy(*by).orderBy(p, key)
    m = F.count("*").over(Window.partitionBy(*by))
    raw = pvalues.withColumn("_a", F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p)))
    return raw.withColumn("holm_p", F.max("_a").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_a").withColumn("reject", F.col("holm_p") <= level)


def hashed_index(namespace: str, n: int, replicate: Column, j: Column) -> Column:
    """SHA-256 of `namespace|n|replicate|draw`, as a whole number, modulo n: digit by digit, so no number grows beyond 16 n."""
    digest = F.sha2(F.concat_ws("|", F.lit(namespace), F.lit(f"n={n}"), F.concat(F.lit("replicate="), replicate.cast("string")), F.concat(F.lit("draw="), j.cast("string"))), 256)
    digits = F.transform(F.split(digest, ""), lambda c: F.conv(c, 16, 10).cast("bigint"))
    return F.aggregate(F.filter(digits, lambda x: x.isNotNull()), F.lit(0).cast("bigint"), lambda s, x: (s * 16 + x) % n)


def random_sign(namespace: str, *parts: Column) -> Column:
    """-1 if the first hexadecimal digit of the hash is below 8, else 1."""
    return F.when(F.substring(hash_key(namespace, *parts), 1, 1) < "8", -1).otherwise(1)


def sign_randomisation(delta: DataFrame, position: str, d: str, namespace: str, replicates: int) -> DataFrame:
    """(observed, p): two-sided p of the mean of d under hashed signs."""
    spark = delta.sparkSession
    flipped = delta.crossJoin(F.broadcast(spark.range(replicates).withColumnRenamed("id", "replicate"))).groupBy("replicate").agg(F.avg(F.col(d) * random_sign(namespace, F.col("replicate"), F.col(position))).alias("m"))
    return flipped.crossJoin(F.broadcast(delta.agg(F.avg(d).alias("observed")))).groupBy("observed").agg(((F.count_if(F.abs("m") >= F.abs("observed") - 1e-15) + 1) / F.lit(replicates + 1)).alias("p"))


def rater_agreement(rows: DataFrame, item: str, rater: str, labels: list[str]) -> DataFrame:
    """(label, n, agreement, kappa) of two raters; kappa is null where chance agreement is 1. Other than two raters raise."""
    raters = [r[0] for r in rows.select(rater).distinct().orderBy(rater).limit(3).collect()]
    require(len(raters) == 2, "two raters are needed")
    stacked = rows.select(item, rater, F.explode(F.create_map(*[x for c in labels for x in (F.lit(c), F.col(c).cast("int"))])).alias("label", "v"))
    a, b = (stacked.where(F.col(rater) == r).select(item, "label", F.col("v").alias(f"v{i}")) for i, r in enumerate(raters))
    both = a.join(b, [item, "label"])
    got = both.groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("v0") == F.col("v1")).cast("double")).alias("agreement"), F.avg("v0").alias("pa"), F.avg("v1").alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return got.select("label", "n", "agreement", F.when(chance < 1, (F.col("agreement") - chance) / (1 - chance)).alias("kappa"))
