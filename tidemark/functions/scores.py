"""Expressions over scores, labels and bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

INF = float("inf")


def ratio(part: Column, whole: Column, default: float | None = None) -> Column:
    """``part / whole``; ``default`` (NULL if not given) when ``whole`` is zero."""
    value = F.try_divide(part.cast("double"), whole.cast("double"))
    return value if default is None else F.coalesce(value, F.lit(default))


def f1(true_positive: Column, predicted: Column, actual: Column) -> Column:
    """F1 of class 1 from three counts; 0 when nothing is positive."""
    return ratio(2 * true_positive, predicted + actual, 0.0)


def predicted(score: Column, threshold: Column | float) -> Column:
    """The 0/1 label: a score equal to the threshold is positive."""
    return (score >= threshold).cast("int")


def left_closed_bin(score: Column, inner: Sequence[float]) -> Column:
    """Number of inner edges at or below the score: bins ``[a, b)``, used for calibration."""
    total = F.lit(0)
    for edge in inner:
        total = total + (score >= F.lit(float(edge))).cast("int")
    return total


def right_closed_bin(value: Column, inner: Sequence[float]) -> Column:
    """Number of inner edges below the value: bins ``(a, b]``, used for drift."""
    total = F.lit(0)
    for edge in inner:
        total = total + (value > F.lit(float(edge))).cast("int")
    return total


def add_cells(df: DataFrame, column: str, edges: Sequence[float], name: str = "cell") -> DataFrame:
    """Find the half-open cell of each value by binary search among any number of edges."""
    inner = sorted({float(e) for e in edges if -INF < e < INF})
    if not inner:
        return df.withColumn(name, F.lit(0))
    cells = Bucketizer(
        splits=[-INF, *inner, INF], inputCol=column, outputCol=name, handleInvalid="keep"
    ).transform(df)
    return cells.withColumn(name, F.col(name).cast("int"))
