"""How well scores match observed rates: reliability bins, expected calibration error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.functions.scores import left_closed_bin
from tidemark.operators.metrics import (
    add_time_gap,
    calibration_error,
    uniform_edges,
    validate_scores,
)
from tidemark.operators.quantiles import exact_quantiles
from tidemark.session import local_table


def bin_edges(
    pred: DataFrame, n_bins: int = 10, strategy: str = "uniform", by: Sequence[str] = ()
) -> dict[tuple, list[float]]:
    """Edges per group: even, or the group's score quantiles with the ends at 0 and 1."""
    if strategy == "uniform":
        return {(): uniform_edges(n_bins)}
    if strategy != "quantile":
        raise ValueError("strategy must be 'uniform' or 'quantile'")
    probs = uniform_edges(n_bins)
    edges = {}
    for key, quantiles in exact_quantiles(pred, ["y_prob"], probs, by).items():
        distinct = sorted({0.0, 1.0, *quantiles[1:-1]})
        if len(distinct) < 3:
            raise ValueError("the scores have too few distinct values for quantile bins")
        edges[key[:-1]] = distinct
    return edges


def _assign_bins(pred, by, n_bins, strategy):
    """Add the bin number, and the group's edges as an array."""
    edges = bin_edges(pred, n_bins, strategy, by)
    score = F.col("y_prob")
    if strategy == "uniform" or not by:
        values = edges[()]
        pred = pred.withColumn("bin_id", left_closed_bin(score, values[1:-1]))
        return pred.withColumn("edges", F.array(*map(F.lit, values)))
    rows = [(*key, values) for key, values in edges.items()]
    schema = pred.select(*by).schema.add("edges", T.ArrayType(T.DoubleType()))
    pred = pred.join(local_table(pred.sparkSession, rows, schema), list(by))
    bin_id = F.lit(0)
    for i in range(1, n_bins):
        inner = F.when(F.size("edges") > i + 1, F.get("edges", F.lit(i)))
        bin_id = bin_id + F.coalesce((score >= inner).cast("int"), F.lit(0))
    return pred.withColumn("bin_id", bin_id)


def bin_sums(
    pred: DataFrame, by: Sequence[str] = (), n_bins: int = 10, strategy: str = "uniform"
) -> DataFrame:
    """Rows, positives, score sum and squared errors per group and bin, with the group's edges.

    Fails on unusable scores in the same pass. Rows are summed where they are read, before any
    shuffle.
    """
    by = list(by)
    pred = validate_scores(pred.select(*by, "y_true", "y_prob"))
    pred = _assign_bins(pred, by, n_bins, strategy)
    gap = F.col("y_prob") - F.col("y_true")
    return pred.groupBy(*by, "bin_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("y_true").cast("bigint")).alias("pos"),
        F.sum("y_prob").alias("score"),
        F.sum(gap * gap).alias("squares"),
        F.first("edges").alias("edges"),
    )


def bins_from(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per group and bin, bins without rows included."""
    # at most n_bins entries per group
    grouped = sums.where(F.col("bin_id").isNotNull()).groupBy(*by).agg(
        F.sum("n").alias("total"),
        F.first("edges").alias("edges"),
        F.map_from_entries(
            F.collect_list(F.struct("bin_id", F.struct("n", "pos", "score")))
        ).alias("bins"),
    )
    rows = grouped.select(
        *by, "total", "edges", "bins",
        F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin_id"),
    ).withColumn("bin", F.try_element_at("bins", F.col("bin_id")))
    mean_pred = F.col("bin.score") / F.col("bin.n")
    frac = F.col("bin.pos") / F.col("bin.n")
    gap = F.abs(mean_pred - frac)
    return rows.select(
        *by,
        "bin_id",
        F.get("edges", F.col("bin_id")).alias("bin_lower"),
        F.get("edges", F.col("bin_id") + 1).alias("bin_upper"),
        F.coalesce("bin.n", F.lit(0)).cast("bigint").alias("n_bin"),
        mean_pred.alias("mean_pred"),
        frac.alias("frac_positive"),
        gap.alias("abs_gap"),
        F.coalesce(gap * (F.col("bin.n") / F.col("total")), F.lit(0.0)).alias("weighted_gap"),
    )


def calibration_from(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Calibration metrics per group."""
    total = F.sum("n")
    rate, mean = F.sum("pos") / total, F.sum("score") / total
    return sums.groupBy(*by).agg(
        total.alias("n_rows"),
        rate.alias("default_rate"),
        mean.alias("mean_pred"),
        (F.sum("squares") / total).alias("brier_score"),
        calibration_error().alias("ece"),
        F.abs(mean - rate).alias("abs_mean_prob_minus_default_rate"),
    )


def reliability_table(
    pred: DataFrame, by: Sequence[str] = (), n_bins: int = 10, strategy: str = "uniform"
) -> DataFrame:
    return bins_from(bin_sums(pred, by, n_bins, strategy), by)


def ece(pred: DataFrame, by: Sequence[str] = (), n_bins: int = 10, strategy: str = "uniform"):
    """Expected calibration error: the weighted gaps of the reliability bins."""
    return bin_sums(pred, by, n_bins, strategy).groupBy(*by).agg(calibration_error().alias("ece"))


def plain_ece(pred: DataFrame, by: Sequence[str] = (), n_bins: int = 10) -> DataFrame:
    """The same on even bins without checks: a score outside [0, 1] counts in no bin but in N."""
    score = F.col("y_prob")
    inside = (score >= 0) & (score <= 1)
    inner = uniform_edges(n_bins)[1:-1]
    sums = (
        pred.withColumn("bin_id", F.when(inside, left_closed_bin(score, inner)))
        .groupBy(*by, "bin_id")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("pos"), F.sum("y_prob").alias("score")
        )
    )
    return sums.groupBy(*by).agg(calibration_error().alias("ece"))


def calibration_by(
    pred: DataFrame,
    by: Sequence[str],
    n_bins: int = 10,
    strategy: str = "uniform",
    reference_year: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Metrics per group, and the reliability bins behind them, from the same sums."""
    sums = bin_sums(pred, by, n_bins, strategy)
    metrics, bins = calibration_from(sums, by), bins_from(sums, by)
    if reference_year is not None:
        metrics, bins = add_time_gap(metrics, reference_year), add_time_gap(bins, reference_year)
    return metrics, bins


def reliability_points(bins: DataFrame) -> DataFrame:
    """The bins that hold rows, for a chart."""
    return bins.where(F.col("n_bin") > 0)
