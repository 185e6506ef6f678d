"""Cohort contracts and small workload relations."""

import datetime

import pytest
from pyspark.sql import functions as F

from datagauge.operators import cohort, contracts

COLUMNS = "row bigint, run_id bigint, task_id bigint, dataset_id bigint, flow_id bigint, upload_time timestamp_ntz, predictive_accuracy double"
NOW = datetime.datetime(2024, 1, 1)


def test_cohort(spark):
    good = [(0, 1, 1, 11, 5, NOW, 0.5), (1, 1, 2, 12, 5, NOW, 1.0)]
    got = cohort.cohort(spark.createDataFrame(good, COLUMNS), "a", "n", rows=2, tasks=2, flows=1).collect()
    assert len({r.observation_uid for r in got}) == 2 and len({r.flow_uid for r in got}) == 1
    for bad in ((1, 1, 2, 12, 5, NOW, 1.1), (1, 1, 2, 12, 5, NOW, float("nan")), (0, 1, 2, 12, 5, NOW, 0.1), (1, 1, 1, 12, 5, NOW, 0.1), (1, 1, 2, 12, 5, NOW, None)):
        with pytest.raises(contracts.ContractError):
            cohort.cohort(spark.createDataFrame([good[0], bad], COLUMNS), "a", "n")
    with pytest.raises(contracts.ContractError):
        cohort.cohort(spark.createDataFrame(good, COLUMNS).drop("row"), "a", "n")
    with pytest.raises(contracts.ContractError):
        cohort.cohort(spark.createDataFrame(good, COLUMNS), "a", "n", tasks=3)


def test_values_and_realisation(spark):
    got = spark.createDataFrame([("A, b|(c);unknown;a ,,N/A",), (None,)], "v string").select(cohort.normalise_values(F.col("v"))).collect()
    assert [r[0] for r in got] == [["a", "b", "c"], []]
    r = spark.createDataFrame([("find big red cars", ["red cars", "big blue"])], "q string, v array<string>").select(cohort.realisation(F.col("q"), F.col("v")).alias("r")).first().r
    assert (r.recall, r.phrases, r["class"]) == (0.75, 1, "High")


def test_coalitions(spark):
    got = cohort.representative_coalitions(spark, [3, 1, 2], {1: 0, 2: 1, 3: 0}, (2, 5)).groupBy("name").agg(F.sort_array(F.collect_list("player")).alias("p")).collect()
    assert {r.name: r.p for r in got} == {"first": [3], "last": [2], "all": [1, 2, 3], "fold0": [1, 3], "fold1": [2], "prefix2": [1, 3]}
    ranked = spark.createDataFrame([(7, 1), (8, 2)], "player int, rank int")
    got = {(r.direction, r.k, r.player) for r in cohort.consequence_coalitions(ranked).collect()}
    assert got == {("addition", 1, 7), ("addition", 2, 7), ("addition", 2, 8), ("removal", 1, 8), ("reverse_addition", 1, 8), ("reverse_addition", 2, 7), ("reverse_addition", 2, 8)}
    with pytest.raises(ValueError):
        cohort.stream_seed("a/b", 1)
    assert cohort.stream_seed("a/b/c/d", 1) != cohort.stream_seed("a/b/c/d", 2)
