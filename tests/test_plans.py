"""The physical plans that the large tables depend on."""

import pytest
from pyspark.sql import functions as F

from bindings import tables as t
from tidemark.operators import calibration, dedup, drift, metrics, prompts, sampling, thresholds
from tidemark.session import stored

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def parts(spark):
    return t.wide_split(spark, FOLDER)


def builds(spark, parts):
    pred = t.pred(spark, FOLDER)
    docs = t.prompt_rows(spark, FOLDER)
    grids = thresholds.fixed_grid(pred)
    return {
        "psi": drift.psi_by_feature_year(parts.train, parts.test, t.FEATURES, years=t.TEST_YEARS),
        "base rate": drift.base_rate_by_year(parts.train, parts.test, "target"),
        "metrics": metrics.metric_table(pred, ["model", "year"], {"a": 0.5, "b": 0.5, "c": 0.5}),
        "sweep": thresholds.threshold_sweep(pred, grids),
        "reliability": calibration.reliability_table(pred, ["model"], 10, "quantile"),
        "sample": sampling.sample_per_year(t.loans_keyed(spark, FOLDER), 50),
        "prompts": prompts.prompt_table(docs, prompts.PromptConfig(context=("lang",))),
        "dedup": dedup.keep_last(t.attempts(spark, FOLDER), ["llm_row_id"], ["attempt_id"]),
    }


def test_no_python_and_no_cross_join(spark, parts):
    for name, df in builds(spark, parts).items():
        text = plan(df)
        for word in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert word not in text, (name, word)


def test_only_needed_columns_are_read(spark, parts):
    rates = plan(drift.base_rate_by_year(parts.train, parts.test, "target"))
    assert "l_extendedprice" not in rates and "l_comment" not in rates
    prompt = prompts.PromptConfig(text=("title",), context=("lang",))
    assert "text:string" not in plan(prompts.prompt_table(t.prompt_rows(spark, FOLDER), prompt))


def test_filters_reach_the_scan(spark):
    df = t.table(spark, FOLDER, "orders").where(F.col("o_orderstatus") == "F")
    assert "EqualTo(o_orderstatus,F)" in plan(df)


def test_years_skip_files_by_date(parts):
    assert "LessThan(l_shipdate,1998-01-01T00:00)" in plan(parts.train)
    assert "GreaterThanOrEqual(l_shipdate,1999-01-01T00:00)" in plan(parts.test)
    assert "Or(" in plan(parts.tagged())


def test_small_tables_with_known_size_are_broadcast(spark):
    tuned = metrics.with_threshold(t.pred(spark, FOLDER), {"a": 0.1, "b": 0.2, "c": 0.3})
    text = plan(tuned)
    assert "LocalTableScan" in text and "SortMergeJoin" not in text


def test_ranking_is_spread_over_cells(spark):
    pred = t.pred(spark, FOLDER)
    text = plan(metrics.metric_table(pred, ["model"], 0.5, cells=16))
    assert "[model" in text and "cell" in text
    first_window = [line for line in text.splitlines() if "Window [" in line][-1]
    assert "cell" in first_window.split("],")[-2]


@pytest.mark.parametrize("build", [
    lambda spark: sampling.sample_per_year(t.loans_keyed(spark, FOLDER), 50),
    lambda spark: sampling.eval_batch(
        t.keyed_split(spark, FOLDER), lambda df: df.select("id", "year"), 1, n=50, roles=t.LOANS, warn=False),
])
def test_sampling_reads_its_table_twice(spark, monkeypatch, build):
    written = []
    monkeypatch.setattr(sampling, "stored", lambda df, *name: written.append(plan(df)) or stored(df, *name))
    rows = build(spark)
    rows.collect()
    [keys], read = written, plan(rows).split("Initial Plan")[0]
    assert keys.count("orders.parquet") == read.count("orders.parquet") == 1
    # every task keeps n keys of a year before they are shuffled, and only keys are
    assert keys.count("Partial") == 2 and "c_name" not in keys.split("WindowGroupLimit")[0]


def test_values_are_counted_before_the_shuffle(parts):
    bins = drift.fit_bins(parts.train, t.FEATURES)
    text = plan(drift.bin_counts(drift.stack_periods(parts.train, parts.test, t.FEATURES, "year"), bins))
    assert "partial_count" in text
