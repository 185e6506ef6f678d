"""Learned estimators: representations fitted on training rows only, ridge, trees, inductive matrix completion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datagauge.operators.contracts import outside, require

ALPHAS = tuple(10.0**e for e in range(-4, 4))


def standardised(train: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with columns imputed by train's medians (0 where it has none), standardised by its population deviations, then scaled to length 1 in all."""
    medians = train.agg(*[F.coalesce(F.median(c), F.lit(0.0)).alias(c) for c in columns]).first()
    filled = train.select(*[F.coalesce(c, F.lit(medians[c])).alias(c) for c in columns])
    facts = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    scaled = rows
    for c in columns:
        s = facts[f"s_{c}"]
        scaled = scaled.withColumn(c, (F.coalesce(c, F.lit(medians[c])) - facts[f"m_{c}"]) / (s if s and s > 0 else 1.0))
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0)))
    scaled = scaled.withColumn("_l", F.when(length > 0, length).otherwise(1.0))
    return scaled.withColumns({c: F.col(c) / F.col("_l") for c in columns}).drop("_l")


def gram(train: DataFrame, columns: list[str], y: str) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, and the matrix of summed products of 1, columns and y: one aggregate, whatever the rows."""
    names = ["_one", *columns, y]
    one = train.withColumn("_one", F.lit(1.0))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = one.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i, j in pairs]).first()
    g = np.zeros((len(names), len(names)))
    for i, j in pairs:
        g[i, j] = g[j, i] = got[f"g{i}_{j}"] or 0
    return g[0, 0], g[:-1, :-1], g[:-1, -1]


def ridge(train: DataFrame, test: DataFrame, columns: list[str], y: str, alpha: float) -> DataFrame:
    """test with prediction, by least squares with an L2 penalty on all but the intercept, from summed normal equations."""
    outside(test, y)
    require(any(abs(alpha - a) < 1e-12 * a for a in ALPHAS), f"alpha must be one of {ALPHAS}")
    n, g, b = gram(train, columns, y)
    require(n > 0, "no training rows")
    penalty = alpha * np.eye(len(g))
    penalty[0, 0] = 0
    w = np.linalg.lstsq(g + penalty, b, rcond=None)[0]
    return test.withColumn("prediction", sum((F.lit(float(c)) * F.col(x) for c, x in zip(w[1:], columns, strict=True)), F.lit(float(w[0]))))


def one_hot_ridge(train: DataFrame, test: DataFrame, keys: list[str], y: str, alpha: float) -> DataFrame:
    """Ridge on one-hot identities; identities that train hasn't give zeros. Sparse, by the ML library's normal or quasi-Newton solver."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    outside(test, y)
    require(any(abs(alpha - a) < 1e-12 * a for a in ALPHAS), f"alpha must be one of {ALPHAS}")
    text = lambda df: df.withColumns({f"_{k}": F.col(k).cast("string") for k in keys})
    facts = train.agg(F.stddev_pop(y).alias("s"), F.count("*").alias("n")).first()
    stages = [StringIndexer(inputCols=[f"_{k}" for k in keys], outputCols=[f"_i{k}" for k in keys], handleInvalid="keep", stringOrderType="alphabetAsc")]
    stages += [OneHotEncoder(inputCols=[f"_i{k}" for k in keys], outputCols=[f"_o{k}" for k in keys], dropLast=True), VectorAssembler(inputCols=[f"_o{k}" for k in keys], outputCol="_x")]
    stages += [LinearRegression(featuresCol="_x", labelCol=y, regParam=alpha * facts["s"] / facts["n"], elasticNetParam=0.0, standardization=False, tol=1e-10, maxIter=200)]
    model = Pipeline(stages=stages).fit(text(train))
    return model.transform(text(test)).select(*test.columns, "prediction")


def forest(train: DataFrame, test: DataFrame, columns: list[str], y: str, trees: int = 20, depth: int = 5, seed: int = 0, boosted: bool = False) -> DataFrame:
    """Random forest or gradient-boosted trees of the ML library: the same families as the usual packages, with other numbers."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    outside(test, y)
    assemble = VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="keep")
    kind = GBTRegressor(maxIter=trees, maxDepth=depth, seed=seed) if boosted else RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed)
    kind = kind.setFeaturesCol("_x").setLabelCol(y)
    return kind.fit(assemble.transform(train)).transform(assemble.transform(test)).select(*test.columns, "prediction")


def matrix_completion(cells: DataFrame, task_features: DataFrame, flow_features: DataFrame, test: DataFrame, rank: int = 2, penalty: float = 1e-2, rounds: int = 20, seed: int = 0) -> DataFrame:
    """test (task, flow) with prediction x_task' U V' z_flow, fitted to cell means weighted by counts, by alternating least squares.

    cells (task, flow, mean, n); features (task, x array) and (flow, z array), which are small and held on the driver.
    Each half step's normal equations are summed on the executors.
    """
    require(rank in (1, 2, 4, 8), "rank must be 1, 2, 4 or 8")
    spark = cells.sparkSession
    x = {r.task: np.array(r.x, float) for r in task_features.collect()}
    z = {r.flow: np.array(r.z, float) for r in flow_features.collect()}
    dx, dz = len(next(iter(x.values()))), len(next(iter(z.values())))
    rng = np.random.default_rng(seed)
    u, v = rng.normal(0, 0.1, (dx, rank)), rng.normal(0, 0.1, (dz, rank))
    shared = spark.sparkContext.broadcast((x, z))
    mean = cells.agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n"))).first()[0] or 0.0
    held = cells.select("task", "flow", F.col("mean").alias("y"), "n").coalesce(8).cache()

    def half(left: bool, other: np.ndarray) -> np.ndarray:
        size = (dx if left else dz) * rank

        def run(batches):
            import pandas as pd

            x, z = shared.value
            a, b = np.zeros((size, size)), np.zeros(size)
            for pdf in batches:
                if len(pdf):
                    own = np.array([(x if left else z)[k] for k in pdf["task" if left else "flow"]])
                    far = np.array([(z if left else x)[k] for k in pdf["flow" if left else "task"]]) @ other
                    f = (own[:, :, None] * far[:, None, :]).reshape(len(pdf), -1)
                    w = pdf["n"].to_numpy(float)
                    a += (f * w[:, None]).T @ f
                    b += f.T @ (w * (pdf["y"].to_numpy(float) - mean))
            yield pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()]})

        parts = held.mapInPandas(run, "a binary, b binary").collect()
        a, b = sum(np.frombuffer(r.a).reshape(size, size) for r in parts), sum(np.frombuffer(r.b) for r in parts)
        return np.linalg.solve(a + penalty * np.eye(size), b).reshape(-1, rank)

    try:
        for _ in range(rounds):
            u = half(True, v)
            v = half(False, u)
    finally:
        held.unpersist()
    t = spark.createDataFrame([(k, (a @ u).tolist()) for k, a in x.items()], f"task {task_features.schema['task'].dataType.simpleString()}, _u array<double>")
    f = spark.createDataFrame([(k, (a @ v).tolist()) for k, a in z.items()], f"flow {flow_features.schema['flow'].dataType.simpleString()}, _v array<double>")
    from datagauge.functions.scalars import dot

    return test.join(t, "task", "left").join(f, "flow", "left").withColumn("prediction", F.lit(mean) + F.coalesce(dot(F.col("_u"), F.col("_v")), F.lit(0.0))).drop("_u", "_v")


def ngrams(text: Column, most: int = 2) -> tuple[Column, Column]:
    """Words of two characters or more, in lower case, and, of such words in a column _w, all runs of up to `most`."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    run = lambda n: F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), lambda i: F.array_join(F.slice("_w", i, n), " "))
    runs = [run(n) for n in range(1, most + 1)]
    guarded = [F.when(F.size("_w") >= n, run).otherwise(F.array().cast("array<string>")) for n, run in enumerate(runs, 1)]
    return words, F.concat(*guarded)


def text_block(train: DataFrame, rows: DataFrame, key: str, text: str, most: int = 2) -> DataFrame:
    """(key, term, weight) of rows by a TF-IDF fitted on train's texts: logarithmic counts, smooth idf, rows of length 1.

    Equal texts of train count once; terms that train hasn't are left out, and a row without any has no row.
    """

    def counted(df: DataFrame, name: str) -> DataFrame:
        words, runs = ngrams(F.col(text), most)
        each = df.select(F.col(name).alias("_k"), words.alias("_w")).select("_k", F.explode(runs).alias("term"))
        return each.groupBy("_k", "term").agg(F.count("*").alias("tf"))

    fitted = train.select(text).distinct().withColumn("_id", F.xxhash64(text))
    n = fitted.count()
    idf = counted(fitted, "_id").groupBy("term").agg((F.log((1.0 + n) / (1 + F.count("*"))) + 1).alias("idf"))
    raw = counted(rows, key).join(idf, "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("_k")))
    return raw.select(F.col("_k").alias(key), "term", (F.col("w") / length).alias("weight"))
