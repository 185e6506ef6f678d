"""Complete accounting of evaluated cells, common support, coverage; qualities of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datagauge.functions.scalars import missing, nonnegative
from datagauge.operators.contracts import check, finite


def expected(sources: DataFrame, cells: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every source with every cell; a stochastic cell once for each seed, others once with a null seed. Cells and seeds are short lists."""
    every = sources.crossJoin(F.broadcast(cells))
    noisy = every.where("stochastic").crossJoin(F.broadcast(seeds.select("seed")))
    return noisy.unionByName(every.where("not stochastic").withColumn("seed", F.lit(None).cast(seeds.schema["seed"].dataType))).drop("stochastic")


def accounting_gaps(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """(key, problem): cells that are absent, unexpected or occur twice; null keys match null keys."""
    have = rows.groupBy(*key).agg(F.count("*").alias("n"))
    same = reduce(lambda a, b: a & b, [F.col(f"h.{k}").eqNullSafe(F.col(f"w.{k}")) for k in key])
    absent = wanted.alias("w").join(have.alias("h"), same, "left_anti").select(*[F.col(f"w.{k}") for k in key], F.lit("absent").alias("problem"))
    extra = have.alias("h").join(wanted.alias("w"), same, "left_anti").select(*[F.col(f"h.{k}") for k in key], F.lit("unexpected").alias("problem"))
    return absent.unionByName(extra).unionByName(have.where("n > 1").select(*key, F.lit("twice").alias("problem")))


def seed_means(rows: DataFrame, key: list[str], seed: str, values: list[str], seeds: int) -> DataFrame:
    """Means of values over the seeds of each key; a key without all seeds, with one twice or a value that isn't finite raises."""
    got = rows.groupBy(*key).agg(F.count_distinct(seed).alias("_d"), F.count("*").alias("_n"), F.count_if(~reduce(lambda a, b: a & b, [F.coalesce(finite(F.col(v)), F.lit(False)) for v in values])).alias("_bad"), *[F.avg(v).alias(v) for v in values])
    return check(got, rules={"complete": (F.col("_d") == seeds) & (F.col("_n") == seeds), "finite": F.col("_bad") == 0}).drop("_d", "_n", "_bad")


def common_support(values: DataFrame, source: str, method: str, methods: int) -> DataFrame:
    """Sources for which all compared methods have a value."""
    return values.groupBy(source).agg(F.count_distinct(method).alias("_m")).where(F.col("_m") == methods).select(source)


def summaries(values: DataFrame, cells: DataFrame, source: str, method: str, value: str, sources: int) -> DataFrame:
    """Each cell's coverage and mean, and its mean on the support that all cells share; null where a cell has none."""
    methods = cells.count()
    shared = values.join(common_support(values, source, method, methods), source, "left_semi").groupBy(method).agg(F.avg(value).alias("common_mean"), F.count("*").alias("common_n"))
    own = values.groupBy(method).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    out = cells.select(method).join(own, method, "left").join(shared, method, "left")
    return out.select(method, F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.lit(sources)).alias("coverage"), "mean", F.coalesce("common_n", F.lit(0)).alias("common_n"), "common_mean")


def coverage(rows: DataFrame, by: list[str], done: Column) -> DataFrame:
    """All, done and missing rows and the done share, for each value of each field and in all."""
    parts = []
    for f in [None, *by]:
        key = [F.lit(f or "all").alias("field"), (F.col(f).cast("string") if f else F.lit("all")).alias("value")]
        parts.append(rows.select(*key, done.alias("_d")).groupBy("field", "value").agg(F.count("*").alias("n"), F.count_if("_d").alias("done"), F.count_if(~F.col("_d")).alias("missing"), F.avg(F.col("_d").cast("double")).alias("share")))
    return reduce(DataFrame.unionByName, parts)


def with_scaled(rows: DataFrame, columns: list[str], constant: float = 0.5, prefix: str = "z_") -> DataFrame:
    """rows with scaled columns, from one aggregate row that is broadcast (a window over all rows would be one task)."""
    range_ = rows.agg(*[F.min(c).alias(f"_l{i}") for i, c in enumerate(columns)], *[F.max(c).alias(f"_h{i}") for i, c in enumerate(columns)])
    both = rows.crossJoin(F.broadcast(range_))
    for i, c in enumerate(columns):
        low, high = F.col(f"_l{i}"), F.col(f"_h{i}")
        both = both.withColumn(f"{prefix}{c}", F.when(F.col(c).isNull(), F.lit(None).cast("double")).when(high > low, (F.col(c) - low) / (high - low)).otherwise(F.lit(constant)))
    return both.drop(*[f"_{x}{i}" for i in range(len(columns)) for x in "lh"])


def popularity(rows: DataFrame, downloads: str, likes: str) -> DataFrame:
    """0.7 log(1 + downloads) + 0.3 log(1 + likes), invalid and negative as 0, over its range; 0 where all are equal."""
    raw = 0.7 * F.log1p(F.coalesce(nonnegative(F.col(downloads)), F.lit(0.0))) + 0.3 * F.log1p(F.coalesce(nonnegative(F.col(likes)), F.lit(0.0)))
    return with_scaled(rows.withColumn("popularity", raw), ["popularity"], 0.0, "_z").withColumn("popularity", F.col("_zpopularity")).drop("_zpopularity")


def completeness(fields: list[str]) -> Column:
    """Share of fields that hold something."""
    return sum((F.when(missing(F.col(f)), 0.0).otherwise(1.0) for f in fields), F.lit(0.0)) / len(fields)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b where b > 0, else null."""
    return F.when(b > 0, a / b)


#: Derived qualities: shares of one quality in another, or in a product.
SHARES = {
    "NumericFeatureFraction": ("NumberOfNumericFeatures", ["NumberOfFeatures"]), "SymbolicFeatureFraction": ("NumberOfSymbolicFeatures", ["NumberOfFeatures"]),
    "MissingValueFraction": ("NumberOfMissingValues", ["NumberOfInstances", "NumberOfFeatures"]), "InstancesWithMissingFraction": ("NumberOfInstancesWithMissingValues", ["NumberOfInstances"]),
    "MajorityClassFraction": ("MajorityClassSize", ["NumberOfInstances"]), "MinorityClassFraction": ("MinorityClassSize", ["NumberOfInstances"]),
}
LOGS = ("NumberOfInstances", "NumberOfFeatures", "NumberOfClasses", "MaxNominalAttDistinctValues")


def intrinsic(ids: DataFrame, metadata: DataFrame, key: str, shares: dict[str, tuple[str, list[str]]] | None = None, logs: tuple[str, ...] = LOGS) -> DataFrame:
    """A row for each distinct key of ids: metadata's qualities (null unless a number of 0 or more), log1p_<quality>s and shares.

    A share is null where a quality is or a divisor isn't above 0; keys without metadata have nulls.
    """
    shares = SHARES if shares is None else shares
    qualities = list(dict.fromkeys([*logs, *[q for top, below in shares.values() for q in (top, *below)]]))
    clean = check(metadata, [key, *qualities], unique=[key]).select(key, *[nonnegative(F.col(q)).alias(q) for q in qualities])
    out = ids.select(key).distinct().join(clean, key, "left")
    guarded = lambda top, below: F.when(reduce(lambda a, b: a & b, [F.col(q) > 0 for q in below]), F.col(top) / reduce(lambda a, b: a * b, [F.col(q) for q in below]))
    return out.select("*", *[F.log1p(q).alias(f"log1p_{q}") for q in logs], *[guarded(*x).alias(name) for name, x in shares.items()])
