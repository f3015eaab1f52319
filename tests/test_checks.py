"""Checks cost no job of their own and see every row that is read."""

import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bindings import tables as t
from tidemark.functions.checks import refuse, unique
from tidemark.operators import calibration, clean, drift, joins, metrics
from tidemark.session import local_table

FOLDER = "/root/testdata/sf0.001"


def jobs_of(spark, action):
    """The result of an action, and how many Spark jobs it ran."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        result = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_building_runs_no_job(spark):
    keyed, wide = t.loans_keyed(spark, FOLDER), t.loans_wide(spark, FOLDER)
    pred = t.pred(spark, FOLDER)
    sample = keyed.select(F.col("id").cast("string"), F.lit(0.5).alias("p"))

    def build():
        return [
            clean.assert_binary_target(keyed, "target"), metrics.validate_scores(pred),
            metrics.brier(pred, ["model"]), calibration.reliability_table(pred, ["model"]),
            joins.checked_join(keyed, keyed.select("id"), ["id"], "inner", "one_to_one"),
            joins.join_sample_to_source(sample, keyed, "id"),
            drift.base_rate_by_year(wide.where("year < 1998"), wide.where("year > 1998"), "target"),
        ]

    tables, jobs = jobs_of(spark, build)
    assert jobs == 0
    for table in tables:
        assert table.count() > 0


def test_a_check_survives_pruning_and_later_filters(spark):
    df = local_table(spark, [(1, 0, "a"), (2, 7, "b")], "id int, y int, v string")
    checked = clean.assert_binary_target(df, "y")
    for read in (checked.select("id"), checked.groupBy().count(), checked.select(F.lit(1)), checked.limit(5)):
        with pytest.raises(PySparkException, match="found 7"):
            read.collect()
    assert refuse(df, F.lit(None).cast("boolean"), "never").count() == 2


def test_keys_are_checked_in_the_join(spark):
    rows = local_table(spark, [(i % 4, i) for i in range(8)], "k int, v int")
    with pytest.raises(PySparkException, match='several rows for .*"k":0|several rows'):
        unique(rows, ["k"]).count()
    keys = local_table(spark, [(None, 1), (0, 2), (1, 3)], "k int, w int")
    joined = joins.checked_join(rows, keys, ["k"], "left", "many_to_one")
    assert joined.count() == 8
    # the check deals rows by the key once, for the join as well
    text = joins.checked_join(rows.repartition(3, "v"), keys.hint("merge"), ["k"], "inner", "many_to_one")
    plan = text._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(k") == 2
