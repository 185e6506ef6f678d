"""Mean baselines with explicit fallbacks, and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datagauge.operators.contracts import outside, require

NATIVE, FALLBACK, MIXED = "NATIVE", "FALLBACK", "MIXED_COMPONENT_FALLBACK"


def global_mean(train: DataFrame, test: DataFrame, y: str, within: list[str] = ()) -> DataFrame:
    """test with prediction, the mean of y in train (in its group `within`) and status."""
    outside(test, y)
    if not within:
        return test.crossJoin(F.broadcast(train.agg(F.avg(y).alias("prediction")))).withColumn("status", F.lit(NATIVE))  # one row
    return test.join(train.groupBy(*within).agg(F.avg(y).alias("prediction")), list(within)).withColumn("status", F.lit(NATIVE))


def grouped_mean(train: DataFrame, test: DataFrame, y: str, keys: list[str], within: list[str] = ()) -> DataFrame:
    """test with the mean of its keys; keys that train hasn't get the mean of all, and say so."""
    outside(test, y)
    within = list(within)
    means = train.groupBy(*within, *keys).agg(F.avg(y).alias("_mean"))
    both = global_mean(train, test, y, within).join(means, [*within, *keys], "left")
    status = F.when(F.col("_mean").isNull(), FALLBACK).otherwise(NATIVE)
    return both.withColumn("status", status).withColumn("prediction", F.coalesce("_mean", "prediction")).drop("_mean")


def additive_mean(train: DataFrame, test: DataFrame, y: str, task: str, flow: str, within: list[str] = ()) -> DataFrame:
    """The task's mean plus the flow's mean residual; an unseen task gets the mean of all, an unseen flow 0."""
    outside(test, y)
    within = list(within)
    tasks = train.groupBy(*within, task).agg(F.avg(y).alias("_task"))
    residual = train.join(tasks, [*within, task]).groupBy(*within, flow).agg(F.avg(F.col(y) - F.col("_task")).alias("_flow"))
    both = global_mean(train, test, y, within).join(tasks, [*within, task], "left").join(residual, [*within, flow], "left")
    absent = F.col("_task").isNull().cast("int") + F.col("_flow").isNull().cast("int")
    status = F.when(absent == 0, NATIVE).when(absent == 1, MIXED).otherwise(FALLBACK)
    return both.withColumn("status", status).withColumn("prediction", F.coalesce("_task", "prediction") + F.coalesce("_flow", F.lit(0.0))).drop("_task", "_flow")


def baseline(name: str, train: DataFrame, test: DataFrame, y: str, task: str, flow: str, within: list[str] = ()) -> DataFrame:
    """One of GM, TD_MEAN, FLOW_MEAN, FREQ, TF_ADD."""
    keys = {"TD_MEAN": [task], "FLOW_MEAN": [flow], "FREQ": [task, flow]}
    if name == "GM":
        return global_mean(train, test, y, within)
    if name == "TF_ADD":
        return additive_mean(train, test, y, task, flow, within)
    require(name in keys, f"no baseline {name}")
    return grouped_mean(train, test, y, keys[name], within)


def fold_sums(rows: DataFrame, keys: list[str], fold: str, y: str, folds: int = 5) -> DataFrame:
    """keys with n and s: counts and sums of y of all rows with the keys that are outside each fold (arrays by fold, from 0)."""
    inside = lambda k: F.col(fold) == k
    counts = F.array(*[F.count_if(~inside(k)) for k in range(folds)]).alias("n")
    sums = F.array(*[F.coalesce(F.sum(F.when(~inside(k), F.col(y))), F.lit(0.0)) for k in range(folds)]).alias("s")
    return rows.groupBy(*keys).agg(counts, sums)


def held_out_means(rows: DataFrame, facts: DataFrame, keys: list[str], fold: str, y: str, name: str, folds: int = 5) -> DataFrame:
    """rows with `name`: the mean of y over facts of their keys in other folds; null if there are none. Sums are made once for each key."""
    at = lambda c: F.element_at(c, F.col(fold) + 1)
    mean = F.try_divide(at("_s"), at("_n").cast("double"))
    totals = fold_sums(facts, keys, fold, y, folds).withColumnsRenamed({"n": "_n", "s": "_s"})
    joined = rows.join(totals, keys) if keys else rows.crossJoin(F.broadcast(totals))  # one row
    return joined.withColumn(name, mean).drop("_n", "_s")


def held_out_residuals(rows: DataFrame, facts: DataFrame, task: str, flow: str, fold: str, y: str, name: str, folds: int = 5) -> DataFrame:
    """rows with `name`: the mean over facts of their flow in other folds of y less the task's mean in other folds; null if there are none.

    Residuals are summed over (task, flow) cells: a cell's sum outside a fold less its count there times the task's mean.
    """
    cells = fold_sums(facts, [task, flow], fold, y, folds)
    tasks = fold_sums(facts, [task], fold, y, folds).select(task, F.zip_with("s", "n", lambda s, n: F.try_divide(s, n.cast("double"))).alias("_t"))
    both = cells.join(tasks, task)
    item = lambda c, k: F.col(c)[k]
    left = F.array(*[F.sum(F.when(item("n", k) > 0, item("s", k) - item("n", k) * item("_t", k))) for k in range(folds)]).alias("_s")
    flows = both.groupBy(flow).agg(left, F.array(*[F.sum(item("n", k)) for k in range(folds)]).alias("_n"))
    at = lambda c: F.element_at(c, F.col(fold) + 1)
    return rows.join(flows, flow).withColumn(name, F.when(at("_n") > 0, at("_s") / at("_n"))).drop("_n", "_s")


def midrank(value: str, within: list[str], weight: Column | None = None) -> Column:
    """Average rank of a value; with whole-number weights, as if rows stood there so many times."""
    if weight is None:
        over = Window.partitionBy(*within).orderBy(value)
        return F.rank().over(over) + (F.count("*").over(Window.partitionBy(*within, value)) - 1) / 2
    upto = F.sum(weight).over(Window.partitionBy(*within).orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    return upto - (F.sum(weight).over(Window.partitionBy(*within, value)) - 1) / 2


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation; null where a side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def regression_metrics(rows: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    """MAE, RMSE, R2, Pearson and Spearman of each group; null where a side is constant or a row stands alone.

    R2 is null for a constant y. Ranks are averages over ties.
    """
    by = list(by)
    ranked = rows.withColumn("_ry", midrank(y, by)).withColumn("_rp", midrank(p, by))
    spread = lambda c: (F.max(c) > F.min(c)) & (F.count("*") > 1)
    both = spread(y) & spread(p)
    error = F.col(p) - F.col(y)
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(spread(y), 1 - F.sum(error * error) / (F.var_pop(y) * F.count("*"))).alias("r2"),
        F.when(both, correlation(y, p)).alias("pearson"), F.when(both, correlation("_ry", "_rp")).alias("spearman"),
    )


def kendall(rows: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    """Kendall's tau-b of each group; null where a side is constant.

    Pairs are counted over distinct (y, p) cells and their masses, so ties cost nothing; the join is
    quadratic in distinct cells, for values on a grid or short lists.
    """
    by = list(by)
    cells = rows.groupBy(*by, y, p).agg(F.count("*").alias("m"))
    a, b = (cells.select(*by, F.col(y).alias(f"y{i}"), F.col(p).alias(f"p{i}"), F.col("m").alias(f"m{i}")) for i in (1, 2))
    pairs = (a.join(b, by) if by else a.crossJoin(b)).where("struct(y1, p1) < struct(y2, p2)")
    sign = F.signum(F.col("y2") - F.col("y1")) * F.signum(F.col("p2") - F.col("p1"))
    score = pairs.groupBy(*by).agg(F.sum(sign * F.col("m1") * F.col("m2")).alias("s"))
    tied = lambda c, name: cells.groupBy(*by, c).agg(F.sum("m").alias("t")).groupBy(*by).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(name))
    size = cells.groupBy(*by).agg(F.sum("m").alias("n"))
    out = size.join(tied(y, "ty"), by).join(tied(p, "tp"), by).join(score, by, "left") if by else size.crossJoin(tied(y, "ty")).crossJoin(tied(p, "tp")).crossJoin(score)
    pairs_of = F.col("n") * (F.col("n") - 1) / 2
    root = F.sqrt((pairs_of - F.col("ty")) * (pairs_of - F.col("tp")))
    return out.select(*by, F.when(root > 0, F.coalesce("s", F.lit(0.0)) / root).alias("kendall"))


def weighted_metrics(rows: DataFrame, y: str, p: str, weight: str, by: list[str] = ()) -> DataFrame:
    """MAE, R2 and Spearman as if each row stood there `weight` times; rows of weight 0 don't."""
    by, w = list(by), F.col(weight)
    own = rows.where(w > 0)
    ranked = own.withColumn("_ry", midrank(y, by, w)).withColumn("_rp", midrank(p, by, w))
    total = F.sum(w)
    mean = lambda x: F.sum(w * x) / total
    error = F.col(p) - F.col(y)
    cy, cp, mid = F.col("_ry"), F.col("_rp"), (total + 1) / 2
    cov, vy, vp = mean(cy * cp) - mid * mid, mean(cy * cy) - mid * mid, mean(cp * cp) - mid * mid
    some = (F.max(y) > F.min(y)) & (F.max(p) > F.min(p))
    return ranked.groupBy(*by).agg(
        total.alias("n"), mean(F.abs(error)).alias("mae"),
        F.when(F.max(y) > F.min(y), 1 - F.sum(w * error * error) / (F.sum(w * F.col(y) * F.col(y)) - F.sum(w * F.col(y)) * F.sum(w * F.col(y)) / total)).alias("r2"),
        F.when(some, cov / F.sqrt(vy * vp)).alias("spearman"),
    )


def status_report(rows: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    """Rows, MAE and RMSE of each status and its share of the group."""
    by, error = list(by), F.col(p) - F.col(y)
    out = rows.groupBy(*by, "status").agg(F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def unique_best(records: DataFrame, error: str, tolerance: float = 1e-12):
    """The record of the least error; several within the tolerance raise."""
    best = records.agg(F.min(error)).first()[0]
    require(best is not None, "no records")
    near = records.where(F.col(error) <= best + tolerance).head(2)
    require(len(near) == 1, "the best configuration is ambiguous")
    return near[0]
