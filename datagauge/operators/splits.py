"""Splits: balanced group folds, temporal blocks, hashed rows, nested splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datagauge.functions.identity import hash_key
from datagauge.operators.contracts import require

#: Groups whose fold is found by a loop on the driver, at most.
MOST_GROUPS = 1_000_000


def balanced_folds(rows: DataFrame, group: str, namespace: str, folds: int = 5, capacity: int | None = None, capacities: list[int] | None = None) -> DataFrame:
    """(group, support, fold): groups by support downwards, then hash, go to the least loaded fold that has room.

    Only supports reach the driver, a row for each group; more than MOST_GROUPS groups raise.
    """
    tie = hash_key(namespace, F.col(group))
    supports = rows.groupBy(group).agg(F.count("*").alias("support")).withColumn("tie", tie)
    listed = supports.orderBy(F.desc("support"), "tie", group).limit(MOST_GROUPS + 1).collect()
    require(len(listed) <= MOST_GROUPS, "too many groups for a balanced assignment")
    room = capacities or [capacity if capacity is not None else len(listed)] * folds
    require(sum(room) >= len(listed), "the folds haven't room for all groups")
    load, count, out = [0] * folds, [0] * folds, []
    for row in listed:
        fold = min((f for f in range(folds) if count[f] < room[f]), key=lambda f: (load[f], count[f], f))
        load[fold] += row.support
        count[fold] += 1
        out.append((row[group], row.support, fold))
    kind = rows.schema[group].dataType.simpleString()
    return rows.sparkSession.createDataFrame(out, f"`{group}` {kind}, support bigint, fold int")


def hash_rank(rows: DataFrame, uid: str, namespace: str) -> DataFrame:
    """rows with rank, from 1, by hash, then uid.

    Ranks are exact and global without one sorted partition: hashes are ranked within the 4,096 ranges of their
    first three digits, and each range starts where the counts of those before it end.
    """
    keyed = rows.withColumn("_h", hash_key(namespace, F.col(uid))).withColumn("_g", F.substring("_h", 1, 3))
    starts = keyed.groupBy("_g").agg(F.count("*").alias("_n"))
    starts = starts.withColumn("_start", F.sum("_n").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)))  # 4096 rows at most
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy("_h", uid)))
    ranked = ranked.join(F.broadcast(starts.select("_g", F.coalesce("_start", F.lit(0)).alias("_start"))), "_g")
    return ranked.withColumn("rank", F.col("_r") + F.col("_start")).drop("_h", "_g", "_r", "_start")


def hashed_fold(rows: DataFrame, uid: str, namespace: str, folds: int = 5) -> DataFrame:
    """rows with fold: the rank of a row's hash, from 0, modulo folds. Ties go by uid."""
    return hash_rank(rows, uid, namespace).withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(folds)).cast("int")).drop("rank")


def long_folds(assigned: DataFrame, uid: str, folds: int = 5) -> DataFrame:
    """(fold_id, uid, role): for each fold k, rows assigned to k are TEST and all others TRAIN."""
    ks = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    return assigned.select(uid, "fold", ks.alias("fold_id")).select("fold_id", uid, F.when(F.col("fold") == F.col("fold_id"), "TEST").otherwise("TRAIN").alias("role"))


def embargo_folds(rows: DataFrame, uid: str, a: str, b: str, folds: int = 5) -> DataFrame:
    """(fold_id, uid, role) over two assignments: TEST if both are k, TRAIN if neither is, EMBARGO between."""
    ks = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    same = (F.col(a) == F.col("fold_id")).cast("int") + (F.col(b) == F.col("fold_id")).cast("int")
    return rows.select(uid, a, b, ks.alias("fold_id")).select("fold_id", uid, F.when(same == 2, "TEST").when(same == 1, "EMBARGO").otherwise("TRAIN").alias("role"))


def temporal_boundaries(rows: DataFrame, time: str, fractions: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)) -> list:
    """The last times of blocks: those whose running counts are nearest to the fractions of all rows.

    A time is never split; ties go to the earlier; each is sought after the one before, never the last
    time. Running counts are made within hours, which begin where the counts of those before end; the driver gets one row.
    """
    counts = rows.groupBy(time).agg(F.count("*").alias("n")).withColumn("_h", F.date_trunc("hour", time))
    hours = counts.groupBy("_h").agg(F.sum("n").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each hour
    hours = hours.select("_h", before.alias("_before"))
    upto = F.sum("n").over(Window.partitionBy("_h").orderBy(time).rowsBetween(Window.unboundedPreceding, 0))
    running = counts.join(hours, "_h").select(time, (upto + F.col("_before")).alias("_c"))
    total, end = rows.agg(F.count(time), F.max(time)).first()
    nearest = lambda f: F.min_by(time, F.struct(F.abs(F.col("_c") - f * total), F.col(time)))
    inside = running.where(F.col(time) < F.lit(end))
    out = list(inside.agg(*[nearest(f).alias(f"_{i}") for i, f in enumerate(fractions)]).first())
    for i, f in enumerate(fractions):  # seldom: a nearest time that isn't after the boundary before
        if i and out[i] is not None and out[i] <= out[i - 1]:
            out[i] = inside.where(F.col(time) > F.lit(out[i - 1])).agg(nearest(f)).first()[0]
        require(out[i] is not None, "too few different times for the blocks")
    return out


def temporal_blocks(rows: DataFrame, time: str, fractions: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """rows with block, 1 and up."""
    block = F.lit(1)
    for edge in temporal_boundaries(rows, time, fractions):
        block = block + (F.col(time) > F.lit(edge)).cast("int")
    return rows.withColumn("block", block)


def expanding_split(blocked: DataFrame, uid: str, steps: int = 4) -> DataFrame:
    """(fold_id, uid, role) for steps f = 1 and up: blocks to f are TRAIN, f + 1 is TEST, later ones UNUSED."""
    ks = F.explode(F.sequence(F.lit(1), F.lit(steps)))
    role = F.when(F.col("block") <= F.col("fold_id"), "TRAIN").when(F.col("block") == F.col("fold_id") + 1, "TEST").otherwise("UNUSED")
    return blocked.select(uid, "block", ks.alias("fold_id")).select("fold_id", uid, role.alias("role"))


def inner_splits(train: DataFrame, uid: str, group: str, namespace: str, capacities: list[int] | None = None) -> DataFrame:
    """Three-fold grouped splits of an outer training set: (fold_id, uid, role)."""
    folds = balanced_folds(train, group, namespace, 3, capacities=capacities)
    return long_folds(train.join(folds.select(group, "fold"), group), uid, 3)


def split_is_valid(split: DataFrame, uid: str, group: str) -> DataFrame:
    """(fold_id, valid): no uid twice, and no group with rows in both TRAIN and TEST."""
    twice = split.groupBy("fold_id", uid).agg(F.count("*").alias("n")).groupBy("fold_id").agg(F.max("n").alias("most"))
    roles = split.where("role in ('TRAIN', 'TEST')").groupBy("fold_id", group).agg(F.count_distinct("role").alias("n")).groupBy("fold_id").agg(F.max("n").alias("roles"))
    return twice.join(roles, "fold_id", "left").select("fold_id", ((F.col("most") == 1) & (F.coalesce("roles", F.lit(1)) == 1)).alias("valid"))


def fold_support(split: DataFrame, rows: DataFrame, uid: str, task: str, flow: str) -> DataFrame:
    """Rows, tasks and flows of each fold's TEST part."""
    test = split.where("role = 'TEST'").join(rows, uid)
    return test.groupBy("fold_id").agg(F.count("*").alias("n_rows"), F.count_distinct(task).alias("n_tasks"), F.count_distinct(flow).alias("n_flows"))


def players(rows: DataFrame, key: list[str], namespace: str, folds: int = 5, capacity: int | None = None) -> DataFrame:
    """A registry of distinct keys with counts, fold and canonical number from 1, in order of the key."""
    counts = rows.groupBy(*key).agg(F.count("*").alias("observations"))
    named = rows.withColumn("_p", F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    assigned = balanced_folds(named, "_p", namespace, folds, capacity)
    numbered = counts.withColumn("_p", F.concat_ws("|", *[F.col(k).cast("string") for k in key])).join(assigned.select("_p", "fold"), "_p").drop("_p")
    return numbered.withColumn("number", F.row_number().over(Window.orderBy(*key)))


def crosswalk(rows: DataFrame, registry: DataFrame, key: list[str]) -> DataFrame:
    """rows with the fold and number of their player; a row without one raises."""
    joined = rows.join(registry.select(*key, "fold", "number"), key, "left")
    number = F.when(F.col("number").isNull(), F.raise_error(F.lit("a row has no player")).cast("int")).otherwise(F.col("number"))
    return joined.withColumn("number", number)


def hash_order(rows: DataFrame, uid: str, namespace: str, within: list[str] = ()) -> DataFrame:
    """rows with rank: their order by hash, then uid, within groups, or of all rows."""
    if not within:
        return hash_rank(rows, uid, namespace)
    key = hash_key(namespace, *[F.col(c) for c in within], F.col(uid))
    return rows.withColumn("_h", key).withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy("_h", uid))).drop("_h")


def prefixes(ranked: DataFrame, sizes: tuple[int, ...] = (20, 50, 100, 200)) -> DataFrame:
    """(size, row) for each literal prefix of a ranking."""
    return ranked.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).where("rank <= size")


def interaction_groups(ordered: DataFrame, groups: int = 3, size: int = 8) -> DataFrame:
    """The first groups * size of a hash order, dealt to groups in turn of `size`."""
    return ordered.where(F.col("rank") <= groups * size).withColumn("group", F.floor((F.col("rank") - 1) / size).cast("int"))


def quartile_subsets(registry: DataFrame, uid: str, count: str, namespace: str, each: int = 3, replicates: int = 5) -> DataFrame:
    """(replicate, uid): the `each` hash-first members of each quartile by count, for each replicate; a subset seen before is salted anew."""
    order = Window.orderBy(count, hash_key(namespace, F.col(uid)), uid)
    n = registry.count()
    quartile = registry.select(uid, F.floor((F.row_number().over(order) - 1) * 4 / n).cast("int").alias("q"))
    seen, parts = set(), []
    for replicate in range(replicates):
        for salt in range(1000):
            key = hash_key(f"{namespace}|{replicate}|{salt}", F.col(uid))
            pick = quartile.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(key, uid))).where(F.col("_r") <= each)
            members = tuple(sorted(r[0] for r in pick.select(uid).collect()))  # 4 * each rows
            if members not in seen:
                break
        require(members not in seen, "no new subset is left")
        seen.add(members)
        parts += [(replicate, m) for m in members]
    kind = registry.schema[uid].dataType.simpleString()
    return registry.sparkSession.createDataFrame(parts, f"replicate int, `{uid}` {kind}")
