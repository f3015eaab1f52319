"""Metrics, thresholds, calibration, and the tables built from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from bindings import tables as t
from bindings.registry import PROBS_10, define, doubles, quantile_sql, query
from tidemark.operators import calibration, matched, metrics, thresholds
from tidemark.operators.drift import base_rate_by_year, drift_summary_by_year, psi_by_feature_year
from tidemark.operators.joins import join_drift_summary, join_performance_calibration
from tidemark.plans import reports

BY = ["model", "year"]
EDGES = doubles(np.linspace(0, 1, 11))
GRID_99 = doubles(np.linspace(0.01, 0.99, 99))
GRID_EVEN = doubles(np.linspace(0.001, 0.5, 250))
PROBS_250 = doubles(np.linspace(0, 1, 250))


def sweep_sql(grid: str) -> str:
    return f"""
        SELECT g.model, thr, CAST(sum(CASE WHEN y_prob >= thr THEN 1 ELSE 0 END) AS BIGINT) AS pp,
               count(*) AS n,
               coalesce(CAST(2 * sum(CASE WHEN y_prob >= thr THEN y_true ELSE 0 END) AS DOUBLE)
                   / nullif(sum(CASE WHEN y_prob >= thr THEN 1 ELSE 0 END) + sum(y_true), 0), 0)
                   AS f1
        FROM pred_val v JOIN {grid} g ON g.model = v.model GROUP BY g.model, thr"""


def metrics_sql(source: str, best: str) -> str:
    """Every metric of every model and year, each by its definition."""
    return f"""
        SELECT m.*, auc, ece FROM (
            SELECT x.model, year, count(*) AS n_rows, any_value(thr) AS thr, avg(y_true) AS rate,
                   avg(y_prob) AS mean_pred, avg((y_prob - y_true) * (y_prob - y_true)) AS brier,
                   avg(CASE WHEN y_prob >= thr THEN 1.0e0 ELSE 0.0e0 END) AS ppr,
                   avg(CASE WHEN (y_prob >= thr) = (y_true = 1) THEN 1.0e0 ELSE 0.0e0 END) AS acc,
                   coalesce(CAST(2 * sum(CASE WHEN y_prob >= thr THEN y_true ELSE 0 END) AS DOUBLE)
                       / nullif(sum(CASE WHEN y_prob >= thr THEN 1 ELSE 0 END) + sum(y_true), 0),
                       0) AS f1
            FROM {source} x JOIN {best} b ON b.model = x.model GROUP BY x.model, year) m
        JOIN (SELECT model, year, (sum(CASE WHEN y_true = 1 THEN rk END)
                     - sum(y_true) * (sum(y_true) + 1) / 2.0e0)
                     / nullif(CAST(sum(y_true) AS DOUBLE) * sum(1 - y_true), 0) AS auc
              FROM (SELECT model, year, y_true,
                           rank() OVER (PARTITION BY model, year ORDER BY y_prob)
                           + (count(*) OVER (PARTITION BY model, year, y_prob) - 1) / 2.0e0 AS rk
                    FROM {source}) r GROUP BY model, year) a USING (model, year)
        JOIN (SELECT model, year, sum(weighted) AS ece FROM bins_raw GROUP BY model, year) e
             USING (model, year)"""


define(
    bins_raw=f"""
        SELECT g.model, g.year, g.bin, lower, upper, coalesce(n, 0) AS n, p, y, abs(p - y) AS gap,
               coalesce(abs(p - y) * n / total, 0) AS weighted
        FROM (SELECT model, year, count(*) AS total, unnest(range(10)) AS bin
              FROM pred_test GROUP BY model, year) g
        JOIN (SELECT i AS bin, {EDGES}[i + 1] AS lower, {EDGES}[i + 2] AS upper
              FROM range(10) r(i)) k ON k.bin = g.bin
        LEFT JOIN (SELECT model, year, len(list_filter({EDGES}[2:10], lambda e: e <= y_prob)) AS bin,
                          count(*) AS n, avg(y_prob) AS p, avg(y_true) AS y
                   FROM pred_test GROUP BY ALL) b
             ON b.model = g.model AND b.year = g.year AND b.bin = g.bin""",
    bins_out="""
        SELECT model, year, CAST(bin AS INTEGER) AS bin_id, round(lower, 6) AS bin_lower,
               round(upper, 6) AS bin_upper, n AS n_bin, round(p, 6) AS mean_pred,
               round(y, 6) AS frac_positive, round(gap, 6) AS abs_gap,
               round(weighted, 6) AS weighted_gap
        FROM bins_raw""",
    grid_99=f"SELECT model, unnest({GRID_99}) AS thr FROM (SELECT DISTINCT model FROM pred_val) m",
    grid_quantiles=quantile_sql("pred_val", "model", PROBS_250),
    grid_500=f"""
        SELECT DISTINCT model, least(greatest(thr, 1e-6), 1.0e0 - 1e-6) AS thr FROM (
            SELECT model, q AS thr FROM grid_quantiles
            UNION ALL SELECT model, unnest({GRID_EVEN})
            FROM (SELECT DISTINCT model FROM pred_val) m) x""",
    sweep_99=sweep_sql("grid_99"),
    sweep_500=sweep_sql("grid_500"),
    best_99="""SELECT * FROM sweep_99
        QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, thr) = 1""",
    best_500="""SELECT * FROM sweep_500
        QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, thr) = 1""",
    half="SELECT model, 0.5e0 AS thr FROM (SELECT DISTINCT model FROM pred_test) x",
    metrics_99=metrics_sql("pred_test", "best_99"),
    metrics_500=metrics_sql("pred_test", "best_500"),
    metrics_half=metrics_sql("pred_test", "half"),
    both_tables="""
        SELECT model, year, n_rows, rate AS default_rate, ppr AS pred_positive_rate, auc, f1, thr,
               year - 1998 AS time_gap, mean_pred, brier AS brier_score, ece,
               abs(mean_pred - rate) AS abs_gap
        FROM metrics_500""",
)

METRIC_COLUMNS = """model, year, n_rows, round(thr, 6) AS threshold, round(auc, 6) AS auc,
    round(f1, 6) AS f1, round(acc, 6) AS accuracy, round(brier, 6) AS brier_score,
    round(ece, 6) AS ece, round(rate, 6) AS default_rate, round(mean_pred, 6) AS mean_pred,
    round(ppr, 6) AS pred_positive_rate"""
BOTH_COLUMNS = """model, year, n_rows, round(default_rate, 6) AS default_rate,
    round(pred_positive_rate, 6) AS pred_positive_rate, round(auc, 6) AS auc, round(f1, 6) AS f1,
    round(thr, 6) AS threshold, time_gap, round(mean_pred, 6) AS mean_pred,
    round(brier_score, 6) AS brier_score, round(ece, 6) AS ece,
    round(abs_gap, 6) AS abs_mean_prob_minus_default_rate"""


@query("auc", "SELECT model, year, round(auc, 6) AS auc FROM metrics_half")
def auc(spark, folder):
    return metrics.auc(t.pred_test(spark, folder), BY)


@query("auc_labels", """
    WITH scored AS (SELECT lang, quality, n_chars FROM documents JOIN labels USING (doc_id)),
    ranked AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars)
               + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0e0 AS rk FROM scored)
    SELECT lang, round((sum(CASE WHEN quality = 1 THEN rk END)
               - sum(quality) * (sum(quality) + 1) / 2.0e0)
               / nullif(CAST(sum(quality) AS DOUBLE) * sum(1 - quality), 0), 6) AS auc
    FROM ranked GROUP BY lang""")
def auc_labels(spark, folder):
    rows = t.table(spark, folder, "documents").join(t.table(spark, folder, "labels"), "doc_id")
    return metrics.auc(
        rows.select("lang", F.col("quality").alias("y_true"),
                    F.col("n_chars").cast("double").alias("y_prob")),
        ["lang"],
    )


@query("f1", "SELECT model, year, round(f1, 6) AS f1 FROM metrics_half")
def f1(spark, folder):
    return metrics.threshold_metrics(t.pred_test(spark, folder), BY, 0.5).select(*BY, "f1")


@query("accuracy", "SELECT model, year, round(acc, 6) AS accuracy FROM metrics_half")
def accuracy(spark, folder):
    return metrics.threshold_metrics(t.pred_test(spark, folder), BY, 0.5).select(*BY, "accuracy")


@query("brier", "SELECT model, year, round(brier, 6) AS brier_score FROM metrics_half")
def brier(spark, folder):
    return metrics.brier(t.pred_test(spark, folder), BY)


@query("binary_metrics", "SELECT model, year, round(auc, 6) AS auc, round(f1, 6) AS f1 FROM metrics_half")
def binary_metrics(spark, folder):
    return metrics.evaluate(t.pred_test(spark, folder), BY).select(*BY, "auc", "f1")


@query("evaluate_frame", """
    SELECT model, count(*) AS n_rows, round(avg(y_true), 6) AS default_rate,
           round(avg(CASE WHEN y_prob >= 0.5e0 THEN 1.0e0 ELSE 0.0e0 END), 6) AS pred_positive_rate,
           round((sum(CASE WHEN y_true = 1 THEN rk END) - sum(y_true) * (sum(y_true) + 1) / 2.0e0)
               / (CAST(sum(y_true) AS DOUBLE) * sum(1 - y_true)), 6) AS auc,
           round(CAST(2 * sum(CASE WHEN y_prob >= 0.5e0 THEN y_true ELSE 0 END) AS DOUBLE)
               / (sum(CASE WHEN y_prob >= 0.5e0 THEN 1 ELSE 0 END) + sum(y_true)), 6) AS f1
    FROM (SELECT *, rank() OVER (PARTITION BY model ORDER BY y_prob)
                 + (count(*) OVER (PARTITION BY model, y_prob) - 1) / 2.0e0 AS rk FROM pred) r
    GROUP BY model""")
def evaluate_frame(spark, folder):
    return metrics.evaluate(t.pred(spark, folder), ["model"])


@query("evaluate_by_year", """SELECT model, year, n_rows, round(rate, 6) AS default_rate,
    round(ppr, 6) AS pred_positive_rate, round(auc, 6) AS auc, round(f1, 6) AS f1
    FROM metrics_half""")
def evaluate_by_year(spark, folder):
    return metrics.evaluate(t.pred_test(spark, folder), BY)


@query("validate_scores", "SELECT model, count(*) AS n_rows FROM pred GROUP BY model")
def validate_scores(spark, folder):
    checked = metrics.validate_scores(t.pred(spark, folder))
    return checked.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"))


@query("eval_predictions_by_year", f"SELECT {METRIC_COLUMNS} FROM metrics_500")
def eval_predictions_by_year(spark, folder):
    return matched.evaluate_predictions(t.pred(spark, folder), coarse=False)[0]


@query("eval_predictions_by_model_year", f"SELECT {METRIC_COLUMNS} FROM metrics_99")
def eval_predictions_by_model_year(spark, folder):
    return matched.evaluate_predictions(t.pred(spark, folder))[0]


@query("threshold_grid", "SELECT model, round(thr, 6) AS threshold FROM grid_500")
def threshold_grid(spark, folder):
    val = t.pred_val(spark, folder)
    return thresholds.grid_table(val, thresholds.threshold_grid(val), ["model"])


SWEEP = """model, round(thr, 6) AS threshold, round(f1, 6) AS f1,
    round(CAST(pp AS DOUBLE) / n, 6) AS pred_positive_rate, pp AS pred_positives"""


def _sweep(spark, folder):
    val = t.pred_val(spark, folder)
    return thresholds.threshold_sweep(val, thresholds.threshold_grid(val))


@query("threshold_sweep", f"SELECT {SWEEP} FROM sweep_500")
def threshold_sweep(spark, folder):
    return _sweep(spark, folder)


@query("threshold_sweep_99",
       "SELECT model, round(thr, 6) AS threshold, round(f1, 6) AS f1 FROM sweep_99")
def threshold_sweep_99(spark, folder):
    val = t.pred_val(spark, folder)
    sweep = thresholds.threshold_sweep(val, thresholds.fixed_grid(val))
    return sweep.select("model", "threshold", "f1")


@query("best_thresholds", f"SELECT {SWEEP} FROM best_500")
def best_thresholds(spark, folder):
    return thresholds.best_thresholds(_sweep(spark, folder))


@query("bin_edges", f"""
    SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY edge) - 1 AS INTEGER) AS
           position, round(edge, 6) AS edge
    FROM (SELECT DISTINCT model, CASE WHEN prob = 0 THEN 0 WHEN prob = 1 THEN 1 ELSE q END AS edge
          FROM ({quantile_sql("pred_test", "model", PROBS_10)}) x) y""")
def bin_edges(spark, folder):
    edges = calibration.bin_edges(t.pred_test(spark, folder), 10, "quantile", ["model"])
    rows = [(*key, i, e) for key, found in edges.items() for i, e in enumerate(found)]
    return spark.createDataFrame(rows, "model string, position int, edge double")


@query("reliability_table", "SELECT * FROM bins_out")
def reliability_table(spark, folder):
    return calibration.reliability_table(t.pred_test(spark, folder), BY)


@query("reliability_table_quantile", f"""
    WITH edges AS (SELECT model, list_sort(list(DISTINCT CASE WHEN prob = 0 THEN 0.0e0
                       WHEN prob = 1 THEN 1.0e0 ELSE q END)) AS e
                   FROM ({quantile_sql("pred_test", "model", PROBS_10)}) x GROUP BY model),
    binned AS (SELECT p.model, len(list_filter(e[2:len(e) - 1], lambda x: x <= y_prob)) AS bin,
                      y_prob, y_true FROM pred_test p JOIN edges d ON d.model = p.model)
    SELECT model, CAST(bin AS INTEGER) AS bin_id, count(*) AS n_bin, round(avg(y_prob), 6) AS
           mean_pred, round(avg(y_true), 6) AS frac_positive FROM binned GROUP BY model, bin""")
def reliability_table_quantile(spark, folder):
    rows = calibration.reliability_table(t.pred_test(spark, folder), ["model"], 10, "quantile")
    return rows.select("model", "bin_id", "n_bin", "mean_pred", "frac_positive")


@query("ece", "SELECT model, year, round(ece, 6) AS ece FROM metrics_half")
def ece(spark, folder):
    return calibration.ece(t.pred_test(spark, folder), BY)


@query("plain_ece", "SELECT model, year, round(ece, 6) AS ece FROM metrics_half")
def plain_ece(spark, folder):
    return calibration.plain_ece(t.pred_test(spark, folder), BY)


CALIBRATION = """n_rows, round(rate, 6) AS default_rate, round(mean_pred, 6) AS mean_pred,
    round(brier, 6) AS brier_score, round(ece, 6) AS ece,
    round(abs(mean_pred - rate), 6) AS abs_mean_prob_minus_default_rate"""


@query("calibration_frame", f"""
    WITH scored AS (SELECT *, len(list_filter({EDGES}[2:10], lambda e: e <= y_prob)) AS bin FROM pred),
    bins AS (SELECT bin, count(*) AS n, abs(avg(y_prob) - avg(y_true)) AS gap FROM scored GROUP BY bin)
    SELECT count(*) AS n_rows, round(avg(y_true), 6) AS default_rate, round(avg(y_prob), 6) AS mean_pred,
           round(avg((y_prob - y_true) * (y_prob - y_true)), 6) AS brier_score,
           round((SELECT sum(gap * n) / sum(n) FROM bins), 6) AS ece,
           round(abs(avg(y_prob) - avg(y_true)), 6) AS abs_mean_prob_minus_default_rate
    FROM scored""")
def calibration_frame(spark, folder):
    """All scores as one frame."""
    return calibration.calibration_by(t.pred(spark, folder), [])[0]


@query("calibration_by_year",
       f"SELECT model, year, {CALIBRATION}, year - 1998 AS time_gap FROM metrics_half")
def calibration_by_year(spark, folder):
    return calibration.calibration_by(t.pred_test(spark, folder), BY, reference_year=1998)[0]


@query("reliability_points", """SELECT model, year, bin_id, n_bin, mean_pred, frac_positive
    FROM bins_out WHERE n_bin > 0""")
def reliability_points(spark, folder):
    bins = calibration.reliability_table(t.pred_test(spark, folder), BY)
    return calibration.reliability_points(bins).select(
        *BY, "bin_id", "n_bin", "mean_pred", "frac_positive"
    )


@query("matched_model_summary", """SELECT model, count(DISTINCT year) AS n_years,
    CAST(sum(n_rows) AS BIGINT) AS total_rows, round(avg(auc), 6) AS mean_auc,
    round(avg(f1), 6) AS mean_f1, round(avg(acc), 6) AS mean_accuracy,
    round(avg(brier), 6) AS mean_brier_score, round(avg(ece), 6) AS mean_ece,
    round(avg(ppr), 6) AS mean_pred_positive_rate FROM metrics_99 GROUP BY model""")
def matched_model_summary(spark, folder):
    return metrics.model_summary(matched.evaluate_predictions(t.pred(spark, folder))[0])


def _tuned(spark, folder):
    renamed = F.when(F.col("split") == "validation", "val").otherwise(F.col("split"))
    return reports.tuned_results(t.pred(spark, folder).withColumn("split", renamed), t.VAL_YEAR)


def _both(spark, folder):
    tables = _tuned(spark, folder)
    return join_performance_calibration(tables["temporal_metrics"], tables["temporal_calibration"])


@query("join_perf_calibration", f"SELECT {BOTH_COLUMNS} FROM both_tables")
def join_perf_calibration(spark, folder):
    return _both(spark, folder)


@query("project_summary", """SELECT model, year, time_gap, round(thr, 6) AS threshold,
    round(auc, 6) AS auc, round(f1, 6) AS f1, round(pred_positive_rate, 6) AS pred_positive_rate,
    round(default_rate, 6) AS default_rate, round(mean_pred, 6) AS mean_pred,
    round(ece, 6) AS ece, round(brier_score, 6) AS brier_score,
    round(abs_gap, 6) AS abs_mean_prob_minus_default_rate FROM both_tables""")
def project_summary(spark, folder):
    return metrics.summary_columns(_both(spark, folder))


@query("year_summary", """SELECT year, n_rows, round(default_rate, 6) AS default_rate,
    round(auc, 6) AS auc, round(f1, 6) AS f1 FROM both_tables""")
def year_summary(spark, folder):
    return metrics.year_summary(_tuned(spark, folder)["temporal_metrics"])


@query("change_from_first", f"""SELECT {BOTH_COLUMNS},
    round(first_value(both_tables.auc) OVER w - both_tables.auc, 6) AS auc_drop_from_first_test_year,
    round(first_value(both_tables.f1) OVER w - both_tables.f1, 6) AS f1_drop_from_first_test_year,
    round(both_tables.ece - first_value(both_tables.ece) OVER w, 6) AS ece_change_from_first_test_year,
    round(both_tables.brier_score - first_value(both_tables.brier_score) OVER w, 6) AS
        brier_change_from_first_test_year
    FROM both_tables WINDOW w AS (PARTITION BY model ORDER BY year)""")
def change_from_first(spark, folder):
    return metrics.change_from_first(_both(spark, folder))


@query("join_drift_summary", f"""
    SELECT b.*, d.n_rows AS drift_n_rows, d.default_rate AS drift_default_rate,
           d.* EXCLUDE (year, n_rows, default_rate)
    FROM (SELECT {BOTH_COLUMNS} FROM both_tables) b
    LEFT JOIN drift_summary_out d ON d.year = b.year""")
def join_drift_summary_query(spark, folder):
    parts = t.wide_split(spark, folder)
    psi = psi_by_feature_year(parts.train, parts.test, t.FEATURES, years=t.TEST_YEARS)
    drift = drift_summary_by_year(psi, base_rate_by_year(parts.train, parts.test, "target"))
    return join_drift_summary(_both(spark, folder), drift)
