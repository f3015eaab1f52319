"""Counts of values per feature and period: one table that all drift measures read.

Each row says how often a feature has a value in a period: ``(feature, period, number, text, n)``, both
value columns NULL for missing. Periods are ``train`` and test years. The table is made in one scan of the
input and kept as a ledger whose batches are partitioned by period; a later period adds a batch, and the
periods already there are not scanned again. It is as long as the features have distinct values; where
continuous features make that too long, ``sketches`` below keeps a bounded state per feature and period
that is merged in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidemark.operators.features import numeric_columns
from tidemark.operators.quantiles import SKETCH, exact_quantiles, finite, sketch_points
from tidemark.roles import MISSING
from tidemark.session import scratch_path
from tidemark.sources.ledger import Ledger

TRAIN = "train"
COUNTS = "feature string, number double, text string, n bigint, period string"
SKETCHES = "feature string, n bigint, n_missing bigint, total double, numbers binary, texts binary, period string"
HLL_SIZE = 14


def stack_periods(train: DataFrame, test: DataFrame, columns: Sequence[str], year: str) -> DataFrame:
    """Training rows with a NULL period above the test rows with their year.

    Test rows without a year belong to no period. The training column decides what is a number;
    text in a number's place counts as missing.
    """
    past = train.select(F.lit(None).cast("int").alias("period"), *columns)
    numeric = set(numeric_columns(train, columns))
    later = [F.col(c).try_cast("double").alias(c)
             if c in numeric and isinstance(test.schema[c].dataType, T.StringType) else c
             for c in columns]
    test = test.where(F.col(year).isNotNull())
    return past.unionByName(test.select(F.col(year).cast("int").alias("period"), *later))


def stacked(train: DataFrame, test: DataFrame | None, columns: Sequence[str], year: str) -> DataFrame:
    """The same with periods as text: ``train``, or the year."""
    if test is None:
        return train.select(F.lit(TRAIN).alias("period"), *columns)
    both = stack_periods(train, test, columns, year)
    return both.withColumn("period", F.coalesce(F.col("period").cast("string"), F.lit(TRAIN)))


def long_values(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows ``(period, feature, number, text)``; a NaN is missing."""
    numeric, cells = set(numeric_columns(rows, features)), []
    for f in features:
        number = F.nanvl(F.col(f).cast("double"), F.lit(None)) if f in numeric else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if f in numeric else F.col(f).cast("string")
        cells.append(F.struct(F.lit(f).alias("feature"), number.alias("number"), text.alias("text")))
    return rows.select("period", F.inline(F.array(*cells)))


def value_counts(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """The counts, summed where the rows are read. The value is part of the shuffle's key, so a
    frequent feature or period spreads over all tasks."""
    keys = ["feature", "period", "number", "text"]
    return long_values(rows, features).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def sketched(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature and period: rows, missing ones, sum, a quantile sketch of the numbers and a distinct
    sketch of all values. Only these few rows are shuffled."""
    number, text = F.col("number"), F.col("text")
    # zero has two signs that count as one value
    value = F.when(number.isNotNull(), F.xxhash64(number + F.lit(0.0))).otherwise(
        F.when(text.isNotNull(), F.xxhash64(text)))
    return long_values(rows, features).groupBy("feature", "period").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(number.isNull() & text.isNull()).alias("n_missing"),
        F.sum(finite(number)).alias("total"),
        F.kll_sketch_agg_double(finite(number), F.lit(SKETCH)).alias("numbers"),
        F.hll_sketch_agg(value, F.lit(HLL_SIZE)).alias("texts"),
    )


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of several periods, or of several parts of one, as one for each group."""
    return sketches.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("n", "n_missing", "total")],
        F.kll_merge_agg_double("numbers").alias("numbers"), F.hll_union_agg("texts").alias("texts"),
    )


def estimates(sketches: DataFrame, probs: Sequence[float] = ()) -> DataFrame:
    """Rows, share of missing values, estimated distinct values and quantiles of each sketch."""
    rest = [c for c in sketches.columns if c not in ("n", "n_missing", "total", "numbers", "texts")]
    quantiles = [sketch_points(F.col("numbers"), probs).alias("quantiles")] if probs else []
    return sketches.select(
        *rest, "n", (F.col("n_missing") / F.col("n")).alias("missing_rate"),
        F.hll_sketch_estimate("texts").alias("n_distinct"), *quantiles,
    )


class Periods:
    """A ledger of counts, or of sketches, that grows by periods."""

    def __init__(self, spark: SparkSession, path: str | None = None, sketches: bool = False):
        self.make = sketched if sketches else value_counts
        schema = SKETCHES if sketches else COUNTS
        self.ledger = Ledger(spark, path or scratch_path(spark, "periods"), schema)

    def add(
        self, train: DataFrame, test: DataFrame, features: Sequence[str], years: Sequence[int],
        year: str = "year",
    ) -> list[str]:
        """Count the periods that are not there yet, in one scan of their rows, and return them.

        Whatever was counted before must have the same features. Rows of counted periods are not read.
        """
        known, features = set(), list(features)
        for batch, entry in self.ledger.manifests().items():
            if entry["about"]["features"] != features:
                raise ValueError(f"batch '{batch}' counts other features: {entry['about']['features']}")
            known.update(entry["about"]["periods"])
        late = [y for y in sorted(years) if str(y) not in known]
        new = [TRAIN] * (TRAIN not in known) + [str(y) for y in late]
        if not new:
            return []
        past = train if TRAIN in new else train.where("false")
        rows = stacked(past, test.where(F.col(year).isin(*late)) if late else None, features, year)
        about = {"periods": new, "features": features}
        self.ledger.commit("+".join(new), self.make(rows, features), about, ["period"])
        return new

    def table(self) -> DataFrame:
        return self.ledger.read()


def in_period(period: str | int) -> Column:
    return F.col("period") == str(period)


def profile(counts: DataFrame) -> DataFrame:
    """Rows, missing rate and number of distinct values per feature and period."""
    present = F.col("number").isNotNull() | F.col("text").isNotNull()
    return counts.groupBy("feature", "period").agg(
        F.sum("n").alias("n_rows"),
        (F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)) / F.sum("n")).alias("missing_rate"),
        F.count_if(present).alias("n_distinct"),
    )


def rates(counts: DataFrame, target: str) -> DataFrame:
    """Rows and mean of a counted label per period."""
    value, n = F.col("number"), F.col("n")
    return counts.where(F.col("feature") == target).groupBy("period").agg(
        F.sum(n).alias("n_rows"),
        (F.sum(value * n) / F.sum(F.when(value.isNotNull(), n))).alias("rate"),
    )


def top_values(counts: DataFrame, features: Sequence[str], k: int) -> dict[str, list[str]]:
    """The ``k`` most frequent training values per feature, missing counted as a value; equal counts by
    value. A rank filter keeps ``k`` rows per feature in every task before they meet."""
    rows = counts.where(in_period(TRAIN) & F.col("feature").isin(*features)).select(
        "feature", F.coalesce("text", F.lit(MISSING)).alias("value"), "n")
    # a text that spells the missing mark is counted with the missing ones
    rows = rows.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = {f: [] for f in features}
    for row in sorted(ranked.collect(), key=lambda r: r["rank"]):
        found[row["feature"]].append(row["value"])
    return found


def edges(counts: DataFrame, features: Sequence[str], n_bins: int) -> dict[str, tuple[float, ...]]:
    """Distinct training quantiles of each number, by rank over the counts."""
    probs = [float(p) for p in np.linspace(0.0, 1.0, n_bins + 1)]
    rows = counts.where(in_period(TRAIN) & F.col("feature").isin(*features) & F.col("number").isNotNull())
    found = exact_quantiles(rows, ["number"], probs, ["feature"], weight="n") if features else {}
    return {f: tuple(sorted(set(found.get((f, "number"), ())))) for f in features}
