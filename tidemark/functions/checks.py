"""Checks that run inside the pass that does the work.

A check is a filter that keeps every row or fails the query with a message. It costs no job, sees the
rows that the query reads, and stays in the plan however few columns are used later.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def holds(bad: Column, message: Column | str, keep: Column | None = None) -> Column:
    """True (or ``keep``) for a row, an error if it is bad; a NULL verdict is not bad."""
    message = F.lit(message) if isinstance(message, str) else message
    fine = F.lit(True) if keep is None else keep
    return F.when(bad, F.raise_error(message).cast("boolean")).otherwise(fine)


def refuse(df: DataFrame, bad: Column, message: Column | str) -> DataFrame:
    """The same rows; reading a bad one fails."""
    return df.where(holds(bad, message))


def shown(columns: Sequence[str]) -> Column:
    """The values of some columns, for a message."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def unique(df: DataFrame, keys: Sequence[str], side: str = "table") -> DataFrame:
    """The same rows; a second row of a key fails. Rows are dealt and sorted by the key as the join
    that follows needs them anyway, and none is held back."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    message = F.concat(F.lit(f"the {side} has several rows for "), shown(keys))
    return refuse(df.withColumn("__place", place), F.col("__place") > 1, message).drop("__place")
