"""Comparing all models on the same sampled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.metrics import completed, metric_table
from tidemark.operators.tables import classes
from tidemark.operators.thresholds import (
    best_thresholds,
    fixed_grid,
    threshold_grid,
    threshold_sweep,
)
from tidemark.session import stored


def to_prediction_frame(
    scored: DataFrame,
    target: str = "Default",
    year: str = "year",
    probability: str = "llm_default_probability",
    model: str | None = None,
    id_column: str = "id",
) -> DataFrame:
    """Externally scored rows in the long form of the other models' predictions.

    Without a name, the smallest model name in the table is used, or ``llm``.
    """
    rows = scored.where(F.col(probability).isNotNull() & F.col(target).isNotNull())
    if model is None:
        model = rows.agg(F.min("llm_model")).first()[0] or "llm"
    return rows.select(
        id_column, "llm_row_id", "llm_batch", "split", year, target,
        F.lit(model).alias("model"),
        F.col(target).cast("int").alias("y_true"),
        F.col(probability).cast("double").alias("y_prob"),
    )


def evaluate_predictions(
    pred: DataFrame, coarse: bool = True, n_bins: int = 10, year: str = "year"
) -> tuple[DataFrame, DataFrame]:
    """Tune a threshold per model on validation rows, then all metrics per model and test year.

    ``coarse`` tunes on the 99-point grid, otherwise on even points and score quantiles.
    Returns the metrics and the sweep.
    """
    # all passes below read these narrow columns
    pred = stored(completed(pred.select("split", "model", year, "y_true", "y_prob")), "scored")
    val = pred.where(F.col("split") == "validation")
    test = pred.where(F.col("split") == "test")
    grids = fixed_grid(val) if coarse else threshold_grid(val)
    models = {r[0] for r in pred.select("model").distinct().collect()}
    untuned = sorted(models - {key[0] for key in grids})
    if untuned or not models:
        raise ValueError(f"no validation rows for models {untuned}")
    classes(val, "y_true", "model", warn=True)
    sweep = threshold_sweep(val, grids)
    tuned = {r["model"]: r["threshold"] for r in best_thresholds(sweep).collect()}
    return metric_table(test, ["model", year], tuned, n_bins), sweep
