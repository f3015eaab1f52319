"""Stacking result tables, their order, and the classes present in a label."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import stored

log = logging.getLogger(__name__)


def stack(tables: Sequence[DataFrame]) -> DataFrame:
    """The rows of several tables with the same columns, in any order of these."""
    if not tables:
        raise ValueError("there are no tables to stack")
    for table in tables[1:]:
        if set(table.columns) != set(tables[0].columns):
            raise ValueError(f"the tables have other columns: {tables[0].columns}, {table.columns}")
    return reduce(DataFrame.unionByName, tables)


def in_order(table: DataFrame, by: Sequence[str], name: str = "position") -> DataFrame:
    """A table in a fixed order, with each row's position from 1.

    Rows are dealt to ranges, sorted there and written; a row's position is its place in the range and
    the sizes of the ranges before, so no task sees more than a range. Rows that are equal in ``by``
    share a range, in any order.
    """
    placed = stored(
        table.repartitionByRange(*by).sortWithinPartitions(*by)
        .withColumn("__place", F.monotonically_increasing_id())
        .withColumn("__range", F.shiftright("__place", 33)),
        "in-order",
    )
    before = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range
    shift = placed.groupBy("__range").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n")).select(
        "__range", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    return placed.join(shift, "__range").select(
        *[F.col(f"`{c}`") for c in table.columns], (F.col("__place") + F.col("__shift")).cast("int").alias(name)
    ).orderBy(name)


def classes(table: DataFrame, target: str, *by: str, warn: bool = False) -> DataFrame:
    """Per group: whether there is one label value only, from the least and the greatest. Thresholds
    tuned on one class, and AUC over one, mean nothing."""
    found = table.groupBy(*by).agg(
        F.coalesce(F.min(target) == F.max(target), F.lit(True)).alias("one_class"))
    if warn:
        for row in found.where("one_class").collect():
            log.warning("only one label value in %s", {k: row[k] for k in by})
    return found
