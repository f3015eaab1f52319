"""Choosing the decision threshold with the best F1 on validation rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.scores import add_cells, f1, ratio
from tidemark.operators.metrics import present
from tidemark.operators.quantiles import exact_quantiles
from tidemark.session import local_table

# The even part of the default grid, and the coarse grid of matched comparisons.
GRID_LOW, GRID_HIGH, GRID_FIXED, GRID_QUANTILES = 0.001, 0.50, 250, 250
COARSE_GRID = tuple(float(t) for t in np.linspace(0.01, 0.99, 99))


def threshold_grid(
    val: DataFrame,
    by: Sequence[str] = ("model",),
    low: float = GRID_LOW,
    high: float = GRID_HIGH,
    n_fixed: int = GRID_FIXED,
    n_quantiles: int = GRID_QUANTILES,
) -> dict[tuple, list[float]]:
    """Even thresholds and score quantiles of each group, clipped, sorted, without repeats."""
    probs = [float(p) for p in np.linspace(0.0, 1.0, n_quantiles)]
    even = [float(t) for t in np.linspace(low, high, n_fixed)]
    grids = {}
    for key, quantiles in exact_quantiles(val, ["y_prob"], probs, by).items():
        clipped = {min(max(t, 1e-6), 1 - 1e-6) for t in (*even, *quantiles)}
        grids[key[:-1]] = sorted(clipped)
    return grids


def fixed_grid(
    val: DataFrame, by: Sequence[str] = ("model",), grid: Sequence[float] = COARSE_GRID
) -> dict[tuple, list[float]]:
    """The same thresholds for every group present."""
    return {tuple(r): list(grid) for r in val.select(*by).distinct().collect()}


def grid_table(val: DataFrame, grids: dict[tuple, list[float]], by: Sequence[str]) -> DataFrame:
    rows = [(*key, t) for key, grid in grids.items() for t in grid]
    schema = val.select(*by).schema.add("threshold", "double")
    return local_table(val.sparkSession, rows, schema)


def threshold_sweep(
    val: DataFrame, grids: dict[tuple, list[float]], by: Sequence[str] = ("model",)
) -> DataFrame:
    """F1 and predicted positives at every threshold of every group.

    Scores are counted between neighbouring thresholds in one pass; running sums from the top
    over these counts give the result of evaluating each threshold on its own. Missing scores are
    refused in the same pass.
    """
    if not grids:
        raise ValueError("there are no validation rows to tune a threshold on")
    by = list(by)
    edges = sorted({t for grid in grids.values() for t in grid})
    counts = (
        add_cells(val.select(*by, "y_true", present("y_prob").alias("y_prob")), "y_prob", edges)
        .groupBy(*by, "cell")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y_true").cast("bigint")).alias("pos"))
        .withColumn("threshold", F.lit(None).cast("double"))
    )
    marks = add_cells(grid_table(val, grids, by), "threshold", edges).select(
        *by, "cell", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("pos"),
        "threshold",
    )
    # one row per cell and threshold from here on
    above = Window.partitionBy(*by).orderBy(F.desc("cell"))
    group = Window.partitionBy(*by)
    swept = (
        counts.unionByName(marks)
        .withColumn("pred_positives", F.sum("n").over(above))
        .withColumn("hits", F.sum("pos").over(above))
        .withColumn("rows", F.sum("n").over(group))
        .withColumn("positives", F.sum("pos").over(group))
        .where(F.col("threshold").isNotNull())
    )
    return swept.select(
        *by,
        "threshold",
        f1(F.col("hits"), F.col("pred_positives"), F.col("positives")).alias("f1"),
        ratio(F.col("pred_positives"), F.col("rows")).alias("pred_positive_rate"),
        "pred_positives",
    )


def best_thresholds(sweep: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """The row with the highest F1 of each group; the lower threshold wins a tie."""
    row = F.struct("threshold", "f1", "pred_positive_rate", "pred_positives")
    best = F.max_by(row, F.struct("f1", -F.col("threshold")))
    return sweep.groupBy(*by).agg(best.alias("best")).select(*by, "best.*")


def tune(val: DataFrame, by: str = "model", coarse: bool = False) -> dict:
    """Best threshold per model, read to the driver: ``{model: threshold}``."""
    grids = fixed_grid(val, [by]) if coarse else threshold_grid(val, [by])
    best = best_thresholds(threshold_sweep(val, grids, [by]), [by])
    return {r[by]: r["threshold"] for r in best.collect()}
