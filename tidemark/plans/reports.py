"""Whole analyses: several operators over shared intermediate tables, with results written out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import (
    calibration, drift, histogram, matched, metrics, reliance, tables, thresholds,
)
from tidemark.operators.joins import (
    join_drift_summary,
    join_performance_calibration,
    join_sample_to_source,
)
from tidemark.operators.scoring import FittedModel, score_long
from tidemark.operators.split import Split
from tidemark.roles import FeatureGroups, Roles
from tidemark.session import stored
from tidemark.sources.sink import write_metrics


# Result tables are sorted by those of these columns that they have.
ORDER = ("model", "year", "feature", "base_feature", "threshold", "bin_id", "top_k", "llm_row_id")


def _save(
    results: dict[str, DataFrame], folder: str | None, fmt: str = "parquet", keep: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """Write every table once, sorted, and hand back what was written. Tables named in ``keep`` come in
    an order of their own."""
    if folder is None:
        return results
    saved = {}
    for name, table in results.items():
        keys = [c for c in ORDER if c in table.columns]
        if keys and name not in keep:
            table = table.orderBy(*keys)
        path = write_metrics(table, f"{folder.rstrip('/')}/{name}", fmt=fmt)
        reader = table.sparkSession.read.schema(table.schema)
        saved[name] = (reader.parquet(path) if fmt == "parquet"
                       else reader.options(header=True, quote='"', escape='"').csv(path))
    return saved


def drift_report(
    split: Split,
    features: Sequence[str],
    roles: Roles = Roles(),
    folder: str | None = None,
    n_bins: int = 10,
    max_categories: int = 25,
    top_n: int = 20,
    nunique: str = "exact",
    counts: str | None = None,
    fmt: str = "parquet",
) -> dict[str, DataFrame]:
    """Base rates, PSI per feature and year, most shifted features, summary per year.

    All four come from one table of counted values. ``counts`` names a folder in which it stays: a later
    report over more years then reads the rows of the new years only. ``nunique="approx"`` keeps no
    counts and reads the table once for the bins and once for their sizes.
    """
    features = [f for f in features if f in split.table.columns]
    if nunique == "exact":
        periods = histogram.Periods(split.table.sparkSession, counts)
        labelled = [*features, roles.target]
        periods.add(split.train, split.test, labelled, split.test_years, split.year)
        counted = periods.table()
        psi = drift.psi_from(counted, split.train, features, split.test_years, n_bins, max_categories)
        base = drift.base_rate_from(counted, roles.target)
    else:
        base = drift.base_rate_by_year(split.train, split.test, roles.target, split.year)
        psi = drift.psi_by_feature_year(
            split.train, split.test, features, split.year, n_bins, max_categories, nunique,
            split.test_years,
        )
    # the three tables below read the few rows written here
    psi, base = stored(psi), stored(base)
    return _save(
        {
            "base_rate_by_year": base,
            "psi_by_feature_year": psi,
            "psi_top_features": drift.top_drift_features(psi, top_n),
            "drift_summary_by_year": drift.drift_summary_by_year(psi, base),
        },
        folder, fmt, keep=["psi_top_features"],
    )


def reliance_report(
    logistic: FittedModel, trees: FittedModel, df: DataFrame, folder: str | None = None,
    fmt: str = "parquet",
) -> dict[str, DataFrame]:
    """Slot weights and source-column importances of two models, and their overlap."""
    slots_a = reliance.logistic_weights(df, logistic)
    slots_b = reliance.tree_weights(df, trees)
    base_a = reliance.coefficient_importance(slots_a)
    base_b = reliance.tree_importance(slots_b)
    return _save(
        {
            "logreg_transformed_feature_importance": slots_a,
            "trees_transformed_feature_importance": slots_b,
            "logreg_feature_importance": base_a.orderBy(F.desc("importance_abs"), "base_feature"),
            "trees_feature_importance": base_b.orderBy(F.desc("importance_abs"), "base_feature"),
            "feature_importance_overlap": reliance.topk_overlap(base_a, base_b),
        },
        folder, fmt, keep=["logreg_feature_importance", "trees_feature_importance"],
    )


def tuned_results(
    pred: DataFrame, val_year: int, n_bins: int = 10, year: str = "year"
) -> dict[str, DataFrame]:
    """Sweep, best thresholds, performance, calibration and bins from one prediction table.

    ``pred`` is long (model, split, year, y_true, y_prob) with splits ``val`` and ``test``.
    """
    # all passes below read these narrow columns
    pred = stored(pred.select("split", "model", year, "y_true", "y_prob"), "scored")
    val = pred.where(F.col("split") == "val")
    test = metrics.validate_scores(pred.where(F.col("split") == "test"))
    by = ["model", year]
    tables.classes(val, "y_true", "model", warn=True)
    sweep = stored(thresholds.threshold_sweep(val, thresholds.threshold_grid(val)))
    best = thresholds.best_thresholds(sweep)
    tuned = {r["model"]: r["threshold"] for r in best.collect()}
    # performance, calibration and bins all come from these few rows per model and year
    profile = stored(metrics.score_profile(test, by, tuned, n_bins))
    edges = F.array(*map(F.lit, metrics.uniform_edges(n_bins)))
    sums = profile.withColumn("edges", edges)
    performance = metrics.metrics_from(profile, by).select(
        *by, "n_rows", "default_rate", "pred_positive_rate", "auc", "f1", "threshold"
    )
    calibrated = metrics.with_threshold(calibration.calibration_from(sums, by), tuned)
    bins = metrics.with_threshold(calibration.bins_from(sums, by), tuned)
    return {
        "validation_threshold_search": sweep,
        "best_thresholds": best,
        "temporal_metrics": metrics.add_time_gap(performance, val_year, year),
        "temporal_calibration": metrics.add_time_gap(calibrated, val_year, year),
        "reliability_bins": metrics.add_time_gap(bins, val_year, year),
    }


def run_tuned_models(
    split: Split,
    groups: FeatureGroups,
    fits: dict[str, Callable[..., FittedModel]],
    roles: Roles = Roles(),
    folder: str | None = None,
    fmt: str = "parquet",
) -> tuple[list[FittedModel], dict[str, DataFrame]]:
    """Fit each model, score validation and test rows once, tune, evaluate, write the tables."""
    if not split.disjoint():
        raise ValueError("validation and test years must not overlap")
    models = [fit(split.train, groups, roles=roles, name=name) for name, fit in fits.items()]
    rows = split.tagged().where(F.col("split").isin("val", "test"))
    pred = score_long(rows, models, ["split", split.year], roles.target)
    return models, _save(tuned_results(pred, split.val_years[0], year=split.year), folder, fmt)


def final_summary(
    performance: DataFrame, calibrated: DataFrame, drift_summary: DataFrame, folder: str | None = None,
    fmt: str = "parquet",
) -> dict[str, DataFrame]:
    """Performance with calibration, with drift, and as change since the first test year."""
    both = stored(join_performance_calibration(performance, calibrated))
    return _save(
        {
            "performance_calibration": both,
            "summary_table": metrics.summary_columns(both),
            "final_summary": join_drift_summary(both, drift_summary),
            "drift_comparison": metrics.change_from_first(both),
        },
        folder, fmt,
    )


def matched_comparison(
    source: DataFrame,
    scored: DataFrame,
    models: list[FittedModel],
    roles: Roles = Roles(),
    name: str | None = None,
    folder: str | None = None,
    year: str = "year",
) -> dict[str, DataFrame]:
    """All models and the external scores on the externally scored rows."""
    keys = [
        roles.id, "llm_row_id", "llm_batch", "split", "llm_model", "llm_default_probability",
        "llm_predicted_label_raw", "llm_error",
    ]
    rows = join_sample_to_source(scored.select(*keys), source, roles.id, year)
    keep = [roles.id, "llm_row_id", "llm_batch", "split", year, roles.target]
    external = matched.to_prediction_frame(
        scored, roles.target, year, model=name, id_column=roles.id
    )
    external = external.withColumn(roles.id, F.col(roles.id).cast("string"))
    pred = external
    if models:
        pred = tables.stack([score_long(rows, models, keep, roles.target), external])
    pred = stored(pred)
    table, sweep = matched.evaluate_predictions(pred, coarse=True, year=year)
    table = stored(table)
    return _save(
        {
            "sample_matched_predictions": pred,
            "sample_matched_yearly_metrics": table,
            "sample_matched_threshold_search": sweep.select("model", "threshold", "f1"),
            "sample_matched_model_summary": metrics.model_summary(table),
        },
        folder,
    )
