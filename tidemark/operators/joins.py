"""Joins with checked cardinality. Which side is broadcast is left to the optimizer, by size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.checks import refuse, shown, unique

def checked_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str, validate: str
) -> DataFrame:
    """Equi join that fails unless it is ``one_to_one``, ``many_to_one`` or ``one_to_many``. The check
    is part of the join."""
    if validate not in ("one_to_one", "many_to_one", "one_to_many"):
        raise ValueError(f"unknown cardinality '{validate}'")
    if validate != "one_to_many":
        right = unique(right, on, "right side")
    if validate != "many_to_one":
        left = unique(left, on, "left side")
    return left.join(right, list(on), how)


def keep_listed(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(*values))


def keep_in_table(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    return df.join(keys.select(column).distinct(), column, "left_semi")


def exclude_ids(df: DataFrame, used: DataFrame, column: str) -> DataFrame:
    """Rows whose id, compared as text, is not among the used ones."""
    ids = used.select(F.col(column).cast("string").alias("used_id")).distinct()
    return df.join(ids, F.col(column).cast("string") == F.col("used_id"), "left_anti")


def join_sample_to_source(
    sample: DataFrame, source: DataFrame, id_column: str, year: str = "year"
) -> DataFrame:
    """Scored rows with the source columns behind their id.

    The source is read once and first reduced to the sampled ids; the optimizer broadcasts these if
    their size allows it. Fails, in the same pass, if an id is twice in the source or not there at all.
    """
    sample = sample.withColumn(id_column, F.col(id_column).cast("string"))
    source = source.withColumn(id_column, F.col(id_column).cast("string"))
    clash = [c for c in sample.columns if c in source.columns and c != id_column]
    ids = sample.select(id_column).distinct()
    reduced = source.drop(*clash).withColumn("in_source", F.lit(True))
    reduced = unique(reduced.join(ids, id_column, "left_semi"), [id_column], "source")
    joined = sample.join(reduced, id_column, "left")
    missed = F.concat(F.lit("a sampled row was not found in the source: "), shown([id_column]))
    return refuse(joined, F.col("in_source").isNull(), missed).drop("in_source")


def join_performance_calibration(performance: DataFrame, calibration: DataFrame) -> DataFrame:
    keys = ["model", "year", "time_gap", "threshold"]
    extra = ["mean_pred", "brier_score", "ece", "abs_mean_prob_minus_default_rate"]
    if "default_rate" not in performance.columns:
        extra.insert(0, "default_rate")
    return checked_join(performance, calibration.select(*keys, *extra), keys, "inner", "one_to_one")


def join_drift_summary(performance: DataFrame, drift: DataFrame) -> DataFrame:
    """Metrics of all models with the drift of their year."""
    drift = drift.withColumnsRenamed(
        {"n_rows": "drift_n_rows", "default_rate": "drift_default_rate"}
    )
    return checked_join(performance, drift, ["year"], "left", "many_to_one")
