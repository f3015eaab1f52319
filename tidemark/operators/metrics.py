"""Quality of 0/1 scores, for any grouping of a long prediction table.

The table has ``y_true`` (0/1), ``y_prob`` and grouping columns such as model and year.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.checks import refuse
from tidemark.functions.scores import add_cells, f1, left_closed_bin, predicted, ratio
from tidemark.operators.quantiles import cut_points
from tidemark.session import local_table

UNIFORM_BINS = 10


def uniform_edges(n_bins: int) -> list[float]:
    """Edges ``i * (1 / n)``, whose last digits follow the usual even spacing."""
    if n_bins < 2:
        raise ValueError("n_bins must be at least 2")
    return [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]


def completed(pred: DataFrame, score: str = "y_prob", label: str = "y_true") -> DataFrame:
    """Rows with a label and a score."""
    return pred.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))


def validate_scores(pred: DataFrame, score: str = "y_prob", label: str = "y_true") -> DataFrame:
    """The same rows; reading one fails unless its label is 0 or 1 and its score lies in [0, 1]."""
    y, p = F.col(label), F.col(score).cast("double")
    problem = (
        F.when(y.isNull(), "missing labels")
        .when(~y.isin(0, 1), "labels other than 0 and 1")
        .when(p.isNull() | F.isnan(p), "missing scores")
        .when((p < 0) | (p > 1), "scores outside [0, 1]")
    )
    return refuse(pred, problem.isNotNull(), F.concat(F.lit("unusable scores: "), problem))


def mean_of_rows(value: Column, by: Sequence[str]) -> Column:
    """The mean; without groups, an error if there are no rows. Groups have rows by themselves."""
    if by:
        return F.avg(value)
    nothing = F.raise_error(F.lit("there are no scored rows")).cast("double")
    return F.when(F.count(F.lit(1)) == 0, nothing).otherwise(F.avg(value))


def present(column: str) -> Column:
    """The score, or an error in the same pass if a row has none."""
    score = F.col(column).cast("double")
    missing = score.isNull() | F.isnan(score)
    return F.when(missing, F.raise_error(F.lit("missing scores")).cast("double")).otherwise(score)


def score_cells(pred: DataFrame, cells: int | None = None, score: str = "y_prob") -> list[float]:
    """Scores that cut the table into parts of about equal size, eight for each shuffle partition; ties
    stay in one part.

    They only decide how ranking work is spread, so a sketch's quantiles will do.
    """
    if cells is None:
        cells = 8 * int(pred.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_points(pred, score, cells)


def score_counts(pred: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows and positives per distinct score. A missing score is refused."""
    return pred.withColumn("y_prob", present("y_prob")).groupBy(*by, "y_prob").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y_true").cast("bigint")).alias("pos")
    )


def ranked_cells(counts: DataFrame, by: Sequence[str], edges: Sequence[float]) -> DataFrame:
    """Score counts with ``area``: pairs (positive, lower negative) inside the cell, ties half.

    Every cell is sorted on its own, so a group of any size is spread over many tasks.
    """
    negative = F.col("n") - F.col("pos")
    within = Window.partitionBy(*by, "cell").orderBy("y_prob")
    lower = F.sum(negative).over(within) - negative
    return add_cells(counts, "y_prob", edges).withColumn(
        "area", F.col("pos").cast("double") * (lower + negative / 2)
    )


def add_cell_offsets(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add to ``area`` the pairs with negatives of lower cells. Few rows per group."""
    lower = Window.partitionBy(*by).orderBy("cell").rangeBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum(F.col("n") - F.col("pos")).over(lower), F.lit(0))
    return cells.withColumn("area", F.col("area") + F.col("pos").cast("double") * below)


def auc_value() -> Column:
    """AUC from summed areas; NULL when a class is absent."""
    pos, neg = F.sum("pos").cast("double"), F.sum(F.col("n") - F.col("pos")).cast("double")
    return ratio(F.sum("area"), pos * neg)


def auc(pred: DataFrame, by: Sequence[str], cells: int | None = None) -> DataFrame:
    """Exact area under the ROC curve per group."""
    pred = pred.select(*by, "y_true", "y_prob")
    ranked = ranked_cells(score_counts(pred, by), by, score_cells(pred, cells))
    summed = ranked.groupBy(*by, "cell").agg(*[F.sum(c).alias(c) for c in ("n", "pos", "area")])
    return add_cell_offsets(summed, by).groupBy(*by).agg(auc_value().alias("auc"))


def with_threshold(pred: DataFrame, threshold: float | dict, column: str = "model") -> DataFrame:
    """Add ``threshold``: one number, or one per value of ``column``."""
    if not isinstance(threshold, dict):
        return pred.withColumn("threshold", F.lit(float(threshold)))
    rows = [(k, float(v)) for k, v in threshold.items()]
    schema = pred.select(column).schema.add("threshold", "double")
    table = local_table(pred.sparkSession, rows, schema)
    unknown = F.raise_error(F.concat(F.lit("no threshold for "), F.col(column).cast("string")))
    return pred.join(table, column, "left").withColumn(
        "threshold", F.when(F.col("threshold").isNull(), unknown.cast("double")).otherwise(
            F.col("threshold")))


def apply_threshold(pred: DataFrame, threshold: float | dict) -> DataFrame:
    labelled = with_threshold(pred, threshold)
    return labelled.withColumn("y_pred", predicted(F.col("y_prob"), F.col("threshold")))


def threshold_metrics(
    pred: DataFrame, by: Sequence[str], threshold: float | dict
) -> DataFrame:
    """F1, accuracy and share of predicted positives per group, without ranking."""
    y, guess = F.col("y_true"), F.col("y_pred")
    return apply_threshold(pred, threshold).groupBy(*by).agg(
        f1(F.sum(y * guess), F.sum(guess), F.sum(y)).alias("f1"),
        F.avg((y == guess).cast("int")).alias("accuracy"),
        F.avg(guess).alias("pred_positive_rate"),
    )


def brier(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared distance of score and label; fails on unusable scores. One pass."""
    gap = F.col("y_prob") - F.col("y_true")
    return validate_scores(pred).groupBy(*by).agg(mean_of_rows(gap * gap, by).alias("brier_score"))


def score_profile(
    pred: DataFrame,
    by: Sequence[str],
    threshold: float | dict,
    n_bins: int = UNIFORM_BINS,
    cells: int | None = None,
) -> DataFrame:
    """Sums per group and calibration bin, from one pass over the distinct scores.

    All metrics of a group follow from its few rows here. Scores outside [0, 1] are in a bin NULL.
    """
    pred = pred.select(*by, "y_true", F.col("y_prob").cast("double").alias("y_prob"))
    edges = uniform_edges(n_bins)
    counts = with_threshold(score_counts(pred, by), threshold)
    n, pos, p = F.col("n"), F.col("pos"), F.col("y_prob")
    inside = (p >= 0) & (p <= 1)
    positive = p >= F.col("threshold")
    ranked = ranked_cells(counts, by, score_cells(pred, cells)).withColumn(
        "bin_id", F.when(inside, left_closed_bin(p, edges[1:-1]))
    )
    cell_rows = ranked.groupBy(*by, "cell", "bin_id").agg(
        F.sum("n").alias("n"),
        F.sum("pos").alias("pos"),
        F.sum("area").alias("area"),
        F.sum(n * p).alias("score"),
        F.sum(pos * (p - 1) * (p - 1) + (n - pos) * p * p).alias("squares"),
        F.sum(F.when(positive, n).otherwise(0)).alias("predicted"),
        F.sum(F.when(positive, pos).otherwise(0)).alias("hits"),
        F.max("threshold").alias("threshold"),
    )
    sums = ("n", "pos", "area", "score", "squares", "predicted", "hits")
    return add_cell_offsets(cell_rows, by).groupBy(*by, "bin_id").agg(
        *[F.sum(c).alias(c) for c in sums], F.max("threshold").alias("threshold")
    )


def calibration_error() -> Column:
    """A bin contributes its share of rows times the gap of mean label and mean score."""
    gap = F.when(F.col("bin_id").isNotNull(), F.abs(F.col("pos") - F.col("score")))
    return F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("n")


def metrics_from(profile: DataFrame, by: Sequence[str]) -> DataFrame:
    """All metrics of every group, from a score profile."""
    total = F.sum("n")
    right = F.sum("hits") + (total - F.sum("pos") - F.sum("predicted") + F.sum("hits"))
    return profile.groupBy(*by).agg(
        total.alias("n_rows"),
        F.max("threshold").alias("threshold"),
        auc_value().alias("auc"),
        f1(F.sum("hits"), F.sum("predicted"), F.sum("pos")).alias("f1"),
        (right / total).alias("accuracy"),
        (F.sum("squares") / total).alias("brier_score"),
        calibration_error().alias("ece"),
        (F.sum("pos") / total).alias("default_rate"),
        (F.sum("score") / total).alias("mean_pred"),
        (F.sum("predicted") / total).alias("pred_positive_rate"),
    )


def metric_table(
    pred: DataFrame,
    by: Sequence[str],
    threshold: float | dict,
    n_bins: int = UNIFORM_BINS,
    cells: int | None = None,
) -> DataFrame:
    return metrics_from(score_profile(pred, by, threshold, n_bins, cells), by)


def evaluate(pred: DataFrame, by: Sequence[str], threshold: float | dict = 0.5) -> DataFrame:
    """Rows, label rate, share of predicted positives, AUC and F1 of each group."""
    if pred.isEmpty():
        raise ValueError("there are no rows to evaluate")
    return metric_table(pred, by, threshold).select(
        *by, "n_rows", "default_rate", "pred_positive_rate", "auc", "f1"
    )


def add_time_gap(df: DataFrame, reference_year: int, year: str = "year") -> DataFrame:
    if year not in df.columns:
        raise ValueError(f"the table has no column '{year}'")
    return df.withColumn("time_gap", F.col(year) - F.lit(reference_year))


def change_from_first(metrics: DataFrame) -> DataFrame:
    """Loss of AUC and F1 and rise of ECE and Brier since the model's first test year."""
    by_year = Window.partitionBy("model").orderBy("year")

    def first(column):
        return F.first(column).over(by_year)

    return metrics.withColumns({
        "auc_drop_from_first_test_year": first("auc") - F.col("auc"),
        "f1_drop_from_first_test_year": first("f1") - F.col("f1"),
        "ece_change_from_first_test_year": F.col("ece") - first("ece"),
        "brier_change_from_first_test_year": F.col("brier_score") - first("brier_score"),
    })


def summary_columns(df: DataFrame) -> DataFrame:
    """The columns of the final report, in order."""
    return df.select(
        "model", "year", "time_gap", "threshold", "auc", "f1", "pred_positive_rate",
        "default_rate", "mean_pred", "ece", "brier_score", "abs_mean_prob_minus_default_rate",
    ).orderBy("model", "year")


def year_summary(df: DataFrame) -> DataFrame:
    columns = ["year", "n_rows", "default_rate", "auc", "f1"]
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"the metric table lacks columns: {missing}")
    return df.select(*columns).orderBy("year")


def model_summary(metrics: DataFrame) -> DataFrame:
    """Per model: years, rows, and unweighted means over years; best mean AUC first."""
    averaged = ("auc", "f1", "accuracy", "brier_score", "ece", "pred_positive_rate")
    return (
        metrics.groupBy("model")
        .agg(
            F.countDistinct("year").alias("n_years"),
            F.sum("n_rows").alias("total_rows"),
            *[F.avg(c).alias(f"mean_{c}") for c in averaged],
        )
        .orderBy(F.desc("mean_auc"), "model")
    )
