"""Batches that are whole or absent, periods that are counted once, sketches that merge."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindings import tables as t
from tidemark.operators import drift, histogram
from tidemark.plans.reports import drift_report
from tidemark.session import discard_scratch, local_table, scratch_mark, scratch_path, stored
from tidemark.sources.ledger import Ledger
from tidemark.streaming import resume

LOG = "llm_row_id bigint, attempt_id bigint, llm_error string, llm_default_probability double"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def score(attempt, fails=()):
    def run(rows):
        bad = F.col("llm_row_id").isin(*fails) if fails else F.lit(False)
        return rows.select(
            "llm_row_id", F.lit(attempt).alias("attempt_id"), F.when(bad, "timeout").alias("llm_error"),
            F.when(~bad, F.col("llm_row_id") / 10.0).alias("llm_default_probability"))

    return run


def test_a_killed_run_neither_loses_nor_doubles_rows(spark, tmp_path, monkeypatch):
    inputs = local_table(spark, [(i,) for i in range(10)], "llm_row_id bigint")
    log = resume.AttemptLog(spark, str(tmp_path / "log"), LOG)
    assert log.run("b1", inputs.where("llm_row_id < 6"), score(1, fails=(2, 3)))

    class Killed(BaseException):
        pass

    def killed(*_):
        raise Killed

    # killed after the rows were written and before they were committed
    with monkeypatch.context() as patch:
        patch.setattr(Ledger, "publish", killed)
        with pytest.raises(Killed):
            log.run("b2", inputs, score(2))
    # killed while writing the manifest: its draft is not a manifest
    (tmp_path / "log" / "manifests" / ".b2-draft").write_text("{")
    again = resume.AttemptLog(spark, str(tmp_path / "log"), LOG)
    assert {r[0] for r in again.pending(inputs).collect()} == {2, 3, 6, 7, 8, 9}
    assert again.attempts().count() == 6
    assert again.run("b2", inputs, score(2)) and not again.run("b2", inputs, score(3))
    assert again.pending(inputs).count() == 0 and again.attempts().count() == 12
    assert rows_of(again.results().select("llm_row_id", "attempt_id")) == [
        (i, 1 if i in (0, 1, 4, 5) else 2) for i in range(10)]
    # two runs of one batch: the second to publish loses
    ledger = again.ledger
    folders = [ledger.write("b3", score(n)(inputs)) for n in (7, 8)]
    assert [ledger.publish("b3", f) for f in folders] == [True, False]
    assert {r[0] for r in ledger.read(["b3"]).select("attempt_id").collect()} == {7}
    assert ledger.clear_unpublished() == 2 and again.attempts().count() == 22
    with pytest.raises(ValueError, match="name a batch"):
        ledger.commit("../x", inputs)


def test_a_stream_is_scored_once(spark, tmp_path):
    source = tmp_path / "in"
    log = resume.AttemptLog(spark, str(tmp_path / "log"), LOG)
    for low in (0, 5):
        spark.range(low, low + 5).withColumnRenamed("id", "llm_row_id").write.mode("append").parquet(str(source))
        arriving = spark.readStream.schema("llm_row_id bigint").parquet(str(source))
        for _ in range(2):
            resume.score_stream(arriving, log, score(low), str(tmp_path / "state")).awaitTermination(60)
        assert log.attempts().count() == low + 5
    assert rows_of(log.results().select("llm_row_id", "attempt_id")) == [(i, i // 5 * 5) for i in range(10)]


@pytest.mark.parametrize("sketches", [False, True])
def test_a_later_period_reads_only_its_rows(spark, tmp_path, sketches):
    draw = np.random.default_rng(4)
    rows = [(int(y), float(v), "abc"[int(v) % 3]) for y, v in zip(draw.integers(2010, 2015, 4000), draw.normal(9, 3, 4000))]
    path = str(tmp_path / "table")
    local_table(spark, rows, "year int, x double, c string").write.partitionBy("year").parquet(path)
    table = spark.read.parquet(path)
    train, test = table.where("year < 2012"), table.where("year >= 2012")
    periods = histogram.Periods(spark, str(tmp_path / "counts"), sketches)
    assert periods.add(train, test, ["x", "c"], [2012, 2013]) == ["train", "2012", "2013"]
    seen = []
    make = periods.make
    periods.make = lambda df, features: seen.append(df._jdf.queryExecution().executedPlan().toString()) or make(df, features)
    assert periods.add(train, test, ["x", "c"], [2012, 2013, 2014]) == ["2014"]
    assert periods.add(train, test, ["x", "c"], [2012, 2014]) == [] and len(seen) == 1
    # the training rows are not in the plan, and of the test years only the new one
    assert seen[0].count("FileScan parquet") == 1
    assert "= 2014)" in seen[0].split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(ValueError, match="other features"):
        periods.add(train, test, ["x"], [2015])
    if sketches:
        whole = histogram.merged(periods.table())
        [row] = histogram.estimates(whole.withColumn("k", F.lit(1)), [0.5]).collect()
        assert row["n"] == 8000 and row["missing_rate"] == 0.0
        both = histogram.estimates(histogram.merged(periods.table(), "feature"), [0.5]).collect()
        [x] = [r for r in both if r["feature"] == "x"]
        assert abs(x["n_distinct"] / 4000 - 1) < 0.02
        assert abs(x["quantiles"][0] - np.median([r[1] for r in rows])) < 0.05
    else:
        once = drift.psi_by_feature_year(train, test, ["x", "c"])
        assert rows_of(drift.psi_from(periods.table(), train, ["x", "c"], [2012, 2013, 2014])) == rows_of(once)


def test_report_over_more_years_adds_to_its_counts(spark, tmp_path):
    whole = t.wide_split(spark, "/root/testdata/sf0.001")
    from dataclasses import replace

    fewer = replace(whole, test_years=whole.test_years[:2])
    counts = str(tmp_path / "counts")
    drift_report(fewer, t.FEATURES, t.LOANS, counts=counts)
    grown = drift_report(whole, t.FEATURES, t.LOANS, counts=counts)
    fresh = drift_report(whole, t.FEATURES, t.LOANS)
    for name, table in grown.items():
        # sums differ in their last digits with the order of their terms
        for found, expected in zip(table.orderBy(*table.columns[:2]).collect(), fresh[name].orderBy(*table.columns[:2]).collect()):
            assert tuple(found) == pytest.approx(tuple(expected), abs=1e-12)
        assert table.count() == fresh[name].count()
    about = [m["about"]["periods"] for m in Ledger(spark, counts, histogram.COUNTS).manifests().values()]
    assert sorted(about) == [["2001"], ["train", "1999", "2000"]]


def test_scratch_is_deleted_on_demand(spark):
    mark = scratch_mark(spark)
    kept = stored(spark.range(3))
    later = scratch_mark(spark)
    lost = stored(spark.range(4))
    assert discard_scratch(spark, later) == 1 and kept.count() == 3
    with pytest.raises(Exception):
        lost.count()
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert discard_scratch(spark, mark) == 3
