"""Score metrics against their definitions on small random tables."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions.scores import add_cells
from tidemark.operators import calibration, metrics, thresholds
from tidemark.session import local_table

SCHEMA = "model string, year int, y_true int, y_prob double"


def auc_by_pairs(y, p):
    pos, neg = p[y == 1], p[y == 0]
    if not len(pos) or not len(neg):
        return None
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def f1_of(y, guess):
    hits = int((y * guess).sum())
    total = int(y.sum() + guess.sum())
    return 2 * hits / total if total else 0.0


def ece_of(y, p, n_bins=10):
    edges = np.linspace(0, 1, n_bins + 1)
    bins = np.searchsorted(edges[1:-1], p, side="right")
    inside = (p >= 0) & (p <= 1)
    return sum(
        abs(y[m].mean() - p[m].mean()) * m.mean()
        for m in ((bins == b) & inside for b in range(n_bins)) if m.any()
    )


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(11)
    n = 1500
    model = rng.choice(["a", "b"], n, p=[0.85, 0.15])
    year = rng.choice([2000, 2001], n)
    y = (rng.random(n) < 0.3).astype(int)
    p = np.round(np.clip(rng.beta(2, 5, n) + 0.1 * y, 0, 1), 3)
    # a third of the rows share one score
    p = np.where(rng.random(n) < 0.33, 0.25, p)
    return model, year, y, p


@pytest.fixture(scope="module")
def pred(spark, sample):
    rows = [(str(m), int(t), int(y), float(p)) for m, t, y, p in zip(*sample)]
    return local_table(spark, rows, SCHEMA).repartition(3).persist()


@pytest.mark.parametrize("cells", [1, 2, 17, 400])
def test_auc_does_not_depend_on_the_cells(pred, sample, cells):
    model, year, y, p = sample
    for row in metrics.auc(pred, ["model", "year"], cells).collect():
        pick = (model == row["model"]) & (year == row["year"])
        assert row["auc"] == pytest.approx(auc_by_pairs(y[pick], p[pick]), abs=1e-12)


def test_auc_of_reversed_scores(pred):
    there = {r["model"]: r["auc"] for r in metrics.auc(pred, ["model"], 5).collect()}
    back = metrics.auc(pred.withColumn("y_prob", 1 - F.col("y_prob")), ["model"], 5)
    for row in back.collect():
        assert row["auc"] == pytest.approx(1 - there[row["model"]], abs=1e-12)


@pytest.mark.parametrize("cells", [1, 30])
def test_metric_table(pred, sample, cells):
    model, year, y, p = sample
    tuned = {"a": 0.25, "b": 0.4}
    table = metrics.metric_table(pred, ["model", "year"], tuned, cells=cells).collect()
    assert len(table) == 4
    for row in table:
        pick = (model == row["model"]) & (year == row["year"])
        ys, ps = y[pick], p[pick]
        guess = (ps >= tuned[row["model"]]).astype(int)
        assert row["n_rows"] == len(ys)
        assert row["threshold"] == tuned[row["model"]]
        assert row["auc"] == pytest.approx(auc_by_pairs(ys, ps))
        assert row["f1"] == pytest.approx(f1_of(ys, guess))
        assert row["accuracy"] == pytest.approx((ys == guess).mean())
        assert row["brier_score"] == pytest.approx(((ps - ys) ** 2).mean())
        assert row["ece"] == pytest.approx(ece_of(ys, ps))
        assert row["default_rate"] == pytest.approx(ys.mean())
        assert row["mean_pred"] == pytest.approx(ps.mean())
        assert row["pred_positive_rate"] == pytest.approx(guess.mean())


def test_single_metrics_agree_with_the_table(pred):
    by = ["model", "year"]
    whole = {tuple(r[k] for k in by): r for r in metrics.metric_table(pred, by, 0.3).collect()}
    for row in metrics.threshold_metrics(pred, by, 0.3).collect():
        same = whole[row["model"], row["year"]]
        for c in ("f1", "accuracy", "pred_positive_rate"):
            assert row[c] == pytest.approx(same[c])
    for row in calibration.plain_ece(pred, by).collect():
        assert row["ece"] == pytest.approx(whole[row["model"], row["year"]]["ece"])
    for row in metrics.brier(pred, by).collect():
        same = whole[row["model"], row["year"]]
        assert row["brier_score"] == pytest.approx(same["brier_score"])


def test_sweep_equals_evaluating_each_threshold(pred, sample):
    model, _, y, p = sample
    grids = thresholds.threshold_grid(pred)
    rows = thresholds.threshold_sweep(pred, grids).collect()
    assert len(rows) == sum(map(len, grids.values()))
    for m in "ab":
        ys, ps = y[model == m], p[model == m]
        grid = np.unique(np.clip(np.concatenate(
            [np.linspace(0.001, 0.5, 250), np.quantile(ps, np.linspace(0, 1, 250))]
        ), 1e-6, 1 - 1e-6))
        assert grids[(m,)] == grid.tolist()
        for row in (r for r in rows if r["model"] == m):
            guess = (ps >= row["threshold"]).astype(int)
            assert row["pred_positives"] == guess.sum()
            assert row["f1"] == pytest.approx(f1_of(ys, guess), abs=1e-15)
            assert row["pred_positive_rate"] == pytest.approx(guess.mean())


def test_lower_threshold_wins_a_tie(spark):
    val = local_table(spark, [("m", 1, 1, 0.9), ("m", 1, 0, 0.1)], SCHEMA)
    sweep = thresholds.threshold_sweep(val, {("m",): [0.2, 0.5, 0.8]})
    assert thresholds.best_thresholds(sweep).collect()[0]["threshold"] == 0.2
    assert thresholds.tune(val, coarse=True) == {"m": 0.11}


def test_sweep_needs_rows(spark):
    empty = local_table(spark, [], SCHEMA)
    with pytest.raises(ValueError):
        thresholds.threshold_sweep(empty, thresholds.fixed_grid(empty))


def test_one_class(spark):
    rows = local_table(spark, [("m", 1, 1, 0.3), ("m", 1, 1, 0.6)], SCHEMA)
    row = metrics.metric_table(rows, ["model"], 0.5).first()
    assert row["auc"] is None and row["f1"] == pytest.approx(2 / 3)
    assert metrics.auc(rows, ["model"]).first()["auc"] is None


def test_f1_without_positives(spark):
    rows = local_table(spark, [("m", 1, 0, 0.3), ("m", 1, 0, 0.1)], SCHEMA)
    assert metrics.metric_table(rows, ["model"], 0.5).first()["f1"] == 0.0


def test_scores_outside_the_unit_interval(spark):
    rows = local_table(spark, [("m", 1, 1, 1.2), ("m", 1, 0, 0.5)], SCHEMA)
    assert calibration.plain_ece(rows).first()["ece"] == pytest.approx(0.25)
    assert metrics.metric_table(rows, ["model"], 0.5).first()["ece"] == pytest.approx(0.25)
    with pytest.raises(PySparkException, match="outside"):
        calibration.reliability_table(rows).collect()
    with pytest.raises(PySparkException, match="outside"):
        metrics.brier(rows).collect()


@pytest.mark.parametrize("label, score, problem", [
    (None, 0.5, "missing labels"),
    (2, 0.5, "labels other"),
    (1, None, "missing scores"),
    (1, math.nan, "missing scores"),
    (1, -0.1, "outside"),
])
def test_unusable_scores(spark, label, score, problem):
    rows = local_table(spark, [("m", 1, 0, 0.2), ("m", 1, label, score)], SCHEMA)
    # whatever is read of the rows
    with pytest.raises(PySparkException, match=problem):
        metrics.validate_scores(rows).count()
    with pytest.raises(PySparkException, match=problem):
        metrics.brier(rows, ["model"]).collect()


def test_no_scores(spark):
    empty = local_table(spark, [], SCHEMA)
    with pytest.raises(PySparkException, match="no scored rows"):
        metrics.brier(empty).collect()
    assert metrics.brier(empty, ["model"]).count() == 0


def test_reliability_bins(spark):
    scores = [0.1, 0.1, 0.3, 0.95, 1.0]
    rows = local_table(spark, [("m", 1, i % 2, p) for i, p in enumerate(scores)], SCHEMA)
    bins = {r["bin_id"]: r for r in calibration.reliability_table(rows, ["model"]).collect()}
    assert sorted(bins) == list(range(10))
    # a score on an edge is in the upper bin, 1.0 in the last; 0.3 is below the third edge,
    # which is 0.30000000000000004
    assert [bins[b]["n_bin"] for b in range(10)] == [0, 2, 1, 0, 0, 0, 0, 0, 0, 2]
    assert bins[0]["mean_pred"] is None and bins[0]["weighted_gap"] == 0.0
    assert sum(b["n_bin"] for b in bins.values()) == len(scores)
    assert bins[9]["bin_upper"] == 1.0 and bins[0]["bin_lower"] == 0.0


def test_quantile_bins(spark, pred, sample):
    model, _, _, p = sample
    rows = calibration.reliability_table(pred, ["model"], 10, "quantile").collect()
    for m in "ab":
        edges = np.quantile(p[model == m], np.linspace(0, 1, 11))
        edges[0], edges[-1] = 0.0, 1.0
        edges = np.unique(edges)
        found = sorted((r for r in rows if r["model"] == m), key=lambda r: r["bin_id"])
        assert [r["bin_lower"] for r in found] == edges[:-1].tolist()
        ids = np.searchsorted(edges[1:-1], p[model == m], side="right")
        assert [r["n_bin"] for r in found] == np.bincount(ids, minlength=len(edges) - 1).tolist()


def test_quantile_bins_need_spread(spark):
    def rows(score):
        return local_table(spark, [("m", 1, i % 2, score) for i in range(4)], SCHEMA)

    for score in (0.0, 1.0):
        with pytest.raises(ValueError, match="too few"):
            calibration.bin_edges(rows(score), 10, "quantile")
    assert calibration.bin_edges(rows(0.3), 10, "quantile") == {(): [0.0, 0.3, 1.0]}
    with pytest.raises(ValueError):
        calibration.bin_edges(rows(0.3), 1)
    with pytest.raises(ValueError):
        calibration.bin_edges(rows(0.3), 10, "other")


def test_calibration_of_one_frame(pred, sample):
    _, _, y, p = sample
    row = calibration.calibration_by(pred, [])[0].first()
    assert row["ece"] == pytest.approx(ece_of(y, p))
    assert row["abs_mean_prob_minus_default_rate"] == pytest.approx(abs(p.mean() - y.mean()))


def test_cells(spark):
    values = [(-1.0,), (0.1,), (0.2,), (0.25,), (9.0,)]
    df = local_table(spark, values, "p double")
    found = [r["cell"] for r in add_cells(df, "p", [0.25, 0.1]).orderBy("p").collect()]
    assert found == [0, 1, 1, 2, 2]


def test_evaluating_nothing(spark):
    with pytest.raises(ValueError):
        metrics.evaluate(local_table(spark, [], SCHEMA), ["model"])


def test_missing_columns(spark):
    table = local_table(spark, [(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        metrics.add_time_gap(table, 2000)
    with pytest.raises(ValueError):
        metrics.year_summary(table)
    with pytest.raises(PySparkException):
        metrics.summary_columns(table).collect()
