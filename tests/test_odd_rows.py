"""Rows that earlier versions lost, misread or let pass."""

import pytest
from pyspark.errors import PySparkException

from tidemark.operators import clean, drift, metrics, sampling, tables, thresholds
from tidemark.session import local_table
from tidemark.sources.scan import load_predictions, load_table


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_header_order_and_absent_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("b,a\n1,x\n2,NA\n")
    (tmp_path / "b.csv").write_text("a\nz\n")
    schema = "a string, b int"
    assert rows_of(load_table(spark, str(tmp_path / "a.csv"), schema)) == sorted([("x", 1), (None, 2)], key=str)
    both = load_predictions(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], schema)
    assert rows_of(both) == sorted([("x", 1, 0), ("z", None, 1), (None, 2, 0)], key=str)


def test_more_spellings_of_dates(spark):
    texts = ["2015-12-01 10:00:00.123", "2015-12-01T10:00:00Z", "December 2015", "Dec 2015",
             "2015-12-01T10:00:00.5", "December 1, 2015", "2015-12-01 10:00"]
    df = local_table(spark, [(t,) for t in [*texts, "no date", "", None]], "d string")
    found = clean.parse_time(df, "d").selectExpr("year(d) AS y", "month(d) AS m")
    assert [tuple(r) for r in found.collect()] == [(2015, 12)] * len(texts)


def test_rows_without_a_year_are_in_no_period(spark):
    train = local_table(spark, [(1, 2010)] * 4, "y int, year int")
    test = local_table(spark, [(0, 2011), (1, 2011), (0, None), (0, None)], "y int, year int")
    [row] = drift.base_rate_by_year(train, test, "y").collect()
    assert (row["year"], row["n_rows"], row["default_rate"], row["train_default_rate"]) == (2011, 2, 0.5, 1.0)


def test_text_in_a_numeric_feature_is_missing(spark):
    train = local_table(spark, [(float(i % 20), 2010) for i in range(100)], "x double, year int")
    test = local_table(spark, [(str(i % 20) if i % 4 else "n/k", 2011) for i in range(100)],
                       "x string, year int")
    [row] = drift.psi_by_feature_year(train, test, ["x"]).collect()
    assert row["feature_type"] == "numeric" and row["year_missing_rate"] == 0.25


@pytest.mark.parametrize("score", [None, float("nan")])
def test_missing_scores_are_refused(spark, score):
    rows = [("a", 1, 0.9), ("a", 0, 0.1), ("a", 1, score)]
    pred = local_table(spark, rows, "model string, y_true int, y_prob double")
    for table in (
        lambda: metrics.auc(pred, ["model"]), lambda: metrics.evaluate(pred, ["model"]),
        lambda: thresholds.threshold_sweep(pred, {("a",): [0.5]}),
    ):
        with pytest.raises(PySparkException, match="missing scores"):
            table().collect()


def test_models_without_a_threshold_are_refused(spark):
    pred = local_table(spark, [("a", 1, 0.9), ("b", 0, 0.1)], "model string, y_true int, y_prob double")
    with pytest.raises(PySparkException, match="no threshold for b"):
        metrics.apply_threshold(pred, {"a": 0.5}).collect()


def test_rows_without_order_are_refused(spark):
    df = local_table(spark, [(1,), (None,)], "k int")
    with pytest.raises(PySparkException, match="no place"):
        sampling.row_ids(df, "k").collect()


def test_stacking_ordering_and_classes(spark):
    a = local_table(spark, [("a", 2), ("b", 1)], "model string, year int")
    b = local_table(spark, [(3, "c")], "year int, model string")
    assert rows_of(tables.stack([a, b])) == [("a", 2), ("b", 1), ("c", 3)]
    with pytest.raises(ValueError, match="columns"):
        tables.stack([a, b.drop("year")])
    assert rows_of(tables.in_order(a, ["year"])) == [("a", 2, 2), ("b", 1, 1)]
    assert rows_of(tables.classes(a, "year", "model")) == [("a", True), ("b", True)]
