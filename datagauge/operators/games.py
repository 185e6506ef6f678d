"""Cooperative games: utilities over coalitions, exact values by masks, estimators by designs, rank agreement.

Utilities are relations: a batch of coalitions in, (coalition, utility) out.
"""

from __future__ import annotations

import hashlib
from math import comb

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datagauge.operators.baselines import correlation, midrank
from datagauge.operators.contracts import require

#: Exact values enumerate 2 ** players coalitions.
MOST_PLAYERS = 20


def coalitions(spark: SparkSession, players: int) -> DataFrame:
    """(mask, size) of all coalitions of players 0 and up, as bits."""
    require(0 < players <= MOST_PLAYERS, f"exact values are for 1 to {MOST_PLAYERS} players")
    return spark.range(1 << players).withColumnRenamed("id", "mask").withColumn("size", F.bit_count("mask"))


def members(masks: DataFrame, players: int) -> DataFrame:
    """(mask, player)."""
    at = F.explode(F.sequence(F.lit(0), F.lit(players - 1)))
    return masks.select("mask", at.alias("player")).where(F.expr("getbit(mask, player) = 1"))


def mean_utility(masks: DataFrame, scores: DataFrame, players: int) -> DataFrame:
    """(mask, utility): the mean of members' scores (player, score); 0 for the empty coalition."""
    got = members(masks, players).join(scores, "player").groupBy("mask").agg(F.avg("score").alias("utility"))
    return masks.select("mask").join(got, "mask", "left").withColumn("utility", F.coalesce("utility", F.lit(0.0)))


def crossfit_utility(membership: DataFrame, stats: DataFrame, registry: DataFrame) -> DataFrame:
    """(coalition, utility): how well members predict all players' flows across folds.

    stats is (player, flow, n, total) of observations' counts and sums; registry (player, fold); membership
    (coalition, player). For each fold, flow means come from members outside it, a flow they lack gets their mean, and each
    player of the fold has 1 - the mean absolute error over its observations' flow means; no members outside a
    fold give 0. The utility is the mean over all players. Coalitions without members have no row.
    """
    own = stats.join(registry, "player")
    folds = F.broadcast(registry.select(F.col("fold").alias("held")).distinct())
    evidence = membership.join(own, "player").crossJoin(folds).where("fold <> held")
    flows = evidence.groupBy("coalition", "held", "flow").agg((F.sum("total") / F.sum("n")).alias("mean"))
    whole = evidence.groupBy("coalition", "held").agg((F.sum("total") / F.sum("n")).alias("whole"))
    asked = membership.select("coalition").distinct().crossJoin(F.broadcast(own.select("player", "flow", "n", (F.col("total") / F.col("n")).alias("y"), F.col("fold").alias("held"))))
    held = asked.join(whole, ["coalition", "held"], "left").join(flows, ["coalition", "held", "flow"], "left")
    error = F.sum(F.col("n") * F.abs(F.col("y") - F.coalesce("mean", "whole"))) / F.sum("n")
    per = held.groupBy("coalition", "player").agg(F.coalesce(1 - error, F.lit(0.0)).alias("u"))
    return per.groupBy("coalition").agg(F.avg("u").alias("utility"))


def beta_weights(m: int, a: int = 4, b: int = 1) -> list[float]:
    """Weights of marginals by the size of the coalition that a player joins, for the semivalue of Beta(a, b); they sum to 1."""
    raw = []
    for k in range(m):  # C(m-1, k) * B(k + b, m - 1 - k + a), by products
        value = float(comb(m - 1, k))
        up, down = k + b, m - 1 - k + a
        for i in range(1, up):
            value *= i / (down + i - 1)
        value /= down + up - 1
        raw.append(value)
    return [x / sum(raw) for x in raw]


def exact_values(utilities: DataFrame, players: int) -> DataFrame:
    """standalone, loo, shapley, banzhaf and beta41 of each player from (mask, utility) of all coalitions."""
    spark = utilities.sparkSession
    m = players
    weights = spark.createDataFrame([(k, 1.0 / (m * comb(m - 1, k)), w / comb(m - 1, k)) for k, w in enumerate(beta_weights(m))], "size int, shapley double, beta double")
    joined = utilities.select(F.col("mask").alias("base"), F.col("utility").alias("before"))
    pairs = joined.select("*", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("player")).where(F.expr("getbit(base, player) = 0"))
    pairs = pairs.withColumn("mask", F.expr("base | shiftleft(1L, player)")).join(utilities, "mask").withColumn("gain", F.col("utility") - F.col("before"))
    sized = pairs.withColumn("size", F.bit_count("base").cast("int")).join(F.broadcast(weights), "size")
    return sized.groupBy("player").agg(
        F.max(F.when(F.col("size") == 0, F.col("gain"))).alias("standalone"), F.max(F.when(F.col("size") == m - 1, F.col("gain"))).alias("loo"),
        F.sum(F.col("gain") * F.col("shapley")).alias("shapley"), F.avg("gain").alias("banzhaf"), F.sum(F.col("gain") * F.col("beta")).alias("beta41"),
    )


def stream(namespace: str, seed: int):
    """A random stream that namespace and seed name."""
    import numpy as np

    digest = hashlib.sha256(f"{namespace}|{seed}".encode()).digest()
    return np.random.Generator(np.random.PCG64DXSM(int.from_bytes(digest[:16], "big")))


def permutations(namespace: str, seed: int, players: int, count: int) -> list[list[int]]:
    rng = stream(namespace, seed)
    return [rng.permutation(players).tolist() for _ in range(count)]


def bernoulli_rows(namespace: str, seed: int, players: int, count: int, rate: float = 0.5) -> list[list[int]]:
    rng = stream(namespace, seed)
    return [rng.binomial(1, rate, players).tolist() for _ in range(count)]


def permutation_design(spark: SparkSession, namespace: str, seed: int, players: int, count: int) -> DataFrame:
    """(permutation, k, player): orders drawn from a stream seeded by namespace and seed, k from 1."""
    rows = list(enumerate(permutations(namespace, seed, players, count)))
    return spark.createDataFrame(rows, "permutation int, players array<int>").select("permutation", F.posexplode("players").alias("k", "player")).withColumn("k", F.col("k") + 1)


def bernoulli_design(spark: SparkSession, namespace: str, seed: int, players: int, count: int, rate: float = 0.5) -> DataFrame:
    """(row, player, inside) for each row of a random design."""
    rows = list(enumerate(bernoulli_rows(namespace, seed, players, count, rate)))
    return spark.createDataFrame(rows, "row int, d array<int>").select("row", F.posexplode("d").alias("player", "inside"))


def standalone_and_last(players: int) -> list[tuple[str, list[int]]]:
    """Names and members of the coalitions that standalone and leave-one-out values need: each player alone, all, and all but each."""
    every = list(range(players))
    return [(f"only{i}", [i]) for i in every] + [("all", every)] + [(f"without{i}", [j for j in every if j != i]) for i in every]


def isolated_values(utilities: DataFrame, players: int) -> DataFrame:
    """(player, standalone, loo, utilities) from the utilities (coalition, utility) of standalone_and_last, for any number of players; utilities counts the coalitions asked for."""
    whole = utilities.where("coalition = 'all'").select(F.col("utility").alias("_all"))
    own = utilities.where("coalition <> 'all'").withColumn("player", F.regexp_extract("coalition", r"(\d+)$", 1).cast("int"))
    each = own.groupBy("player").agg(F.max(F.when(F.col("coalition").startswith("only"), F.col("utility"))).alias("standalone"), F.max(F.when(F.col("coalition").startswith("without"), F.col("utility"))).alias("_rest"))
    return each.crossJoin(F.broadcast(whole)).select("player", "standalone", (F.col("_all") - F.col("_rest")).alias("loo"), F.lit(2 * players + 1).alias("utilities"))


def prefix_coalitions(design: DataFrame) -> DataFrame:
    """(permutation, k, player, coalition): the coalition of the first k players, named by its sorted members."""
    over = Window.partitionBy("permutation").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return design.withColumn("coalition", F.concat_ws(",", F.sort_array(F.collect_list("player").over(over)).cast("array<string>")))


def permutation_values(prefixed: DataFrame, utilities: DataFrame, players: int, budgets: list[int], empty: float = 0.0) -> DataFrame:
    """(budget, player, shapley, beta41) from prefixes' utilities; budgets are prefixes of the stream of permutations."""
    weights = prefixed.sparkSession.createDataFrame([(k + 1, players * w) for k, w in enumerate(beta_weights(players))], "k int, w double")
    over = Window.partitionBy("permutation").orderBy("k")
    gains = prefixed.join(utilities, "coalition").withColumn("gain", F.col("utility") - F.lag("utility", 1, empty).over(over)).join(F.broadcast(weights), "k")
    each = gains.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets]))).where("permutation < budget")
    return each.groupBy("budget", "player").agg((F.sum("gain") / F.first("budget")).alias("shapley"), (F.sum(F.col("w") * F.col("gain")) / F.first("budget")).alias("beta41"))


def reuse_values(design: DataFrame, utilities: DataFrame, budgets: list[int]) -> DataFrame:
    """(budget, player, banzhaf, status): mean utility of rows with a player less that of rows without; null where a side is empty."""
    each = design.join(utilities, "row").withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets]))).where("row < budget")
    got = each.groupBy("budget", "player").agg(F.avg(F.when(F.col("inside") == 1, F.col("utility"))).alias("i"), F.avg(F.when(F.col("inside") == 0, F.col("utility"))).alias("o"))
    whole = F.col("i").isNotNull() & F.col("o").isNotNull()
    return got.select("budget", "player", (F.col("i") - F.col("o")).alias("banzhaf"), F.when(whole, "COMPLETE").otherwise("INSUFFICIENT").alias("status"))


def curve(values: DataFrame, utility_at: DataFrame) -> DataFrame:
    """(auc, normalised): trapezoids under utilities (k, utility) of growing prefixes, and over the last if it is above 0."""
    over = Window.orderBy("k")
    step = utility_at.withColumn("area", (F.col("utility") + F.lag("utility").over(over)) / 2)
    total = step.agg(F.sum("area").alias("auc"), F.max_by("utility", "k").alias("full"), (F.count("*") - 1).alias("n"))
    return total.select((F.col("auc") / F.col("n")).alias("auc"), F.when(F.col("full") > 0, F.col("auc") / F.col("n") / F.col("full")).alias("normalised"))


def value_agreement(values: DataFrame, a: str, b: str, item: str, tops: tuple[int, ...] = (3, 5)) -> DataFrame:
    """Spearman, mean and largest rank change, equal ranks, equal signs, reversed pairs, top and bottom overlaps of two value columns."""
    ranked = values.withColumn("_a", F.row_number().over(Window.orderBy(F.desc(a), item))).withColumn("_b", F.row_number().over(Window.orderBy(F.desc(b), item)))
    n = F.count("*").over(Window.partitionBy())
    ranked = ranked.withColumn("_n", n).withColumn("_ma", midrank(a, [])).withColumn("_mb", midrank(b, []))
    some = (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
    both = lambda k: ((F.col("_a") <= k) & (F.col("_b") <= k)).cast("int")
    low = lambda k: ((F.col("_a") > F.col("_n") - k) & (F.col("_b") > F.col("_n") - k)).cast("int")
    got = ranked.agg(
        F.when(some, correlation("_ma", "_mb")).alias("spearman"), F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("mean_rank_change"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_rank_change"),
        F.count_if(F.col("_a") == F.col("_b")).alias("same_rank"), F.avg((F.signum(a) == F.signum(b)).cast("double")).alias("sign_agreement"),
        *[(F.sum(both(k)) / k).alias(f"top{k}") for k in tops], *[(F.sum(low(k)) / k).alias(f"bottom{k}") for k in tops],
    )
    x, y = (ranked.select(F.col("_a").alias(f"a{i}"), F.col("_b").alias(f"b{i}")) for i in (1, 2))
    turned = x.join(y, F.expr("a1 < a2 and b1 > b2")).agg(F.count("*").alias("reversed_pairs"))  # players are few
    return got.crossJoin(turned)


def value_errors(values: DataFrame, a: str, b: str) -> DataFrame:
    """mae, median, rmse and largest error of b against a."""
    e = F.abs(F.col(a) - F.col(b))
    return values.agg(F.avg(e).alias("mae"), F.median(e).alias("median"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(e).alias("largest"))


def lasso(x, y, alphas: int = 100, folds: int = 5, tolerance: float = 1e-4, rounds: int = 1000):
    """Coefficients of a lasso whose penalty is chosen by consecutive folds: coordinate descent along a path of penalties."""
    import numpy as np

    def descend(x, y, alpha, w):
        n, norms = len(y), (x * x).sum(0)
        r = y - x @ w
        for _ in range(rounds):
            most = big = 0.0
            for j in np.flatnonzero(norms):
                old = w[j]
                rho = x[:, j] @ r + norms[j] * old
                w[j] = np.sign(rho) * max(abs(rho) - n * alpha, 0) / norms[j]
                if w[j] != old:
                    r += x[:, j] * (old - w[j])
                most, big = max(most, abs(w[j] - old)), max(big, abs(w[j]))
            if big == 0 or most / big < tolerance:
                break
        return w

    def centred(x, y):
        return x - x.mean(0), y - y.mean(), x.mean(0), y.mean()

    x, y = np.asarray(x, float), np.asarray(y, float)
    cx, cy, _, _ = centred(x, y)
    top = np.abs(cx.T @ cy).max() / len(y)
    if top == 0:
        return np.zeros(x.shape[1])
    path = np.geomspace(top, top * 1e-3, alphas)
    error = np.zeros(alphas)
    for part in np.array_split(np.arange(len(y)), folds):
        keep = np.setdiff1d(np.arange(len(y)), part)
        fx, fy, mx, my = centred(x[keep], y[keep])
        w = np.zeros(x.shape[1])
        for i, alpha in enumerate(path):
            w = descend(fx, fy, alpha, w)
            error[i] += ((y[part] - my - (x[part] - mx) @ w) ** 2).mean()
    w = np.zeros(x.shape[1])
    for alpha in path[: int(error.argmin()) + 1]:
        w = descend(cx, cy, alpha, w)
    return w


def ame(design: DataFrame, utilities: DataFrame) -> DataFrame:
    """(player, value): lasso of centred utilities on rows of the design, each standardised over players (constant rows are 0)."""
    wide = design.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("player", "inside"))).alias("d")).join(utilities, "row").orderBy("row")

    def fit(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("row")
        x = np.array([[e["inside"] for e in d] for d in pdf["d"]], float)
        with np.errstate(all="ignore"):
            x = np.nan_to_num((x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True))
        return pd.DataFrame({"player": range(x.shape[1]), "value": lasso(x, pdf["utility"] - pdf["utility"].mean())})

    return wide.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fit, "player int, value double")  # a design has a few thousand rows
