"""Drift of labels and features between the training period and later years."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.functions.checks import holds
from tidemark.functions.scores import right_closed_bin
from tidemark.operators import histogram
from tidemark.operators.features import categorical_columns, melt, numeric_columns
from tidemark.operators.histogram import stack_periods
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.split import years_present
from tidemark.roles import EPS, MISSING, OTHER
from tidemark.session import local_table


@dataclass(frozen=True)
class Bins:
    """Bins of one feature, learnt from the training rows."""

    feature: str
    kind: str  # numeric, numeric_constant or categorical
    edges: tuple[float, ...] = ()  # numeric: distinct quantiles, lowest to highest
    top: tuple[str, ...] = ()  # categorical: most frequent values

    @property
    def inner(self) -> tuple[float, ...]:
        return self.edges[1:-1]

    def code(self, value: Column | None = None) -> Column:
        """Bin number of a row, or of the given value; 0 holds missing numbers and rare categories."""
        value = F.col(self.feature) if value is None else value
        if self.kind == "numeric_constant":
            return F.lit(0)
        if self.kind == "categorical":
            value = F.coalesce(value.cast("string"), F.lit(MISSING))
            return F.array_position(F.array(*map(F.lit, self.top)), value).cast("int")
        value = value.cast("double")
        finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
        return F.when(finite, right_closed_bin(value, self.inner) + 1).otherwise(0)

    def label(self, code: int) -> str:
        if self.kind == "categorical":
            return self.top[code - 1] if code else OTHER
        if not code:
            return MISSING
        ends = [-float("inf"), *self.inner, float("inf")]
        return f"({ends[code - 1]}, {ends[code]}]"


def distinct_edges(quantiles: Sequence[float]) -> tuple[float, ...]:
    return tuple(sorted(set(quantiles)))


def numeric_edges(
    train: DataFrame, features: Sequence[str], n_bins: int = 10
) -> dict[str, tuple[float, ...]]:
    """Distinct training quantiles of each feature."""
    probs = [float(p) for p in np.linspace(0.0, 1.0, n_bins + 1)]
    found = exact_quantiles(train, features, probs) if features else {}
    return {f: distinct_edges(found.get((f,), ())) for f in features}


def top_categories(train: DataFrame, features: Sequence[str], k: int = 25) -> DataFrame:
    """The ``k`` most frequent training values per feature, missing counted as a value.

    Equal counts are ordered by value. A rank filter keeps ``k`` rows per feature in every task
    before they meet.
    """
    counts = (
        melt(train, features)
        .withColumn("value", F.coalesce("value", F.lit(MISSING)))
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fit_bins(
    train: DataFrame, features: Iterable[str], n_bins: int = 10, max_categories: int = 25
) -> list[Bins]:
    """Learn the bins of all features; the kind of a feature follows its type."""
    features = list(features)
    edges = numeric_edges(train, numeric_columns(train, features), n_bins)
    texts = categorical_columns(train, features)
    top = {f: [] for f in texts}
    if texts:
        for row in top_categories(train, texts, max_categories).orderBy("feature", "rank").collect():
            top[row["feature"]].append(row["value"])
    return _bins(features, edges, top)


def bins_of(
    counts: DataFrame, train: DataFrame, features: Sequence[str], n_bins: int = 10, max_categories: int = 25
) -> list[Bins]:
    """The same bins from counted values; only the types of the training table are looked at."""
    edges = histogram.edges(counts, numeric_columns(train, features), n_bins)
    texts = categorical_columns(train, features)
    return _bins(features, edges, histogram.top_values(counts, texts, max_categories) if texts else {})


def _bins(features, edges, top):
    bins = []
    for f in features:
        if f in top:
            bins.append(Bins(f, "categorical", top=tuple(top[f])))
        elif len(edges[f]) < 3:
            bins.append(Bins(f, "numeric_constant"))
        else:
            bins.append(Bins(f, "numeric", edges=edges[f]))
    return bins


def bin_counts(stacked: DataFrame, bins: Sequence[Bins], nunique: str = "exact") -> DataFrame:
    """Rows ``(feature, bin, period, n, n_missing, n_distinct)`` from one scan.

    Distinct values are counted exactly by a first aggregation per value, which spreads a frequent
    feature or period over all tasks. ``nunique="approx"`` uses sketches and shuffles bins only.
    """
    if nunique not in ("exact", "approx"):
        raise ValueError("nunique must be 'exact' or 'approx'")
    cells = []
    for b in bins:
        col = F.col(b.feature)
        numeric = isinstance(stacked.schema[b.feature].dataType, (T.NumericType, T.BooleanType))
        number = F.nanvl(col.cast("double"), F.lit(None)) if numeric else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if numeric else col.cast("string")
        cells.append(
            F.struct(
                F.lit(b.feature).alias("feature"),
                b.code().alias("bin"),
                number.alias("number"),
                text.alias("text"),
            )
        )
    rows = stacked.select("period", F.inline(F.array(*cells)))
    present = F.col("number").isNotNull() | F.col("text").isNotNull()
    keys = ["feature", "bin", "period"]
    if nunique == "approx":
        return rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(~present).alias("n_missing"),
            F.approx_count_distinct(
                F.when(present, F.xxhash64("number", "text")), 0.01
            ).alias("n_distinct"),
        )
    values = rows.groupBy(*keys, "number", "text").agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count_if(present).alias("n_distinct"),
    )


def counted_bins(counts: DataFrame, bins: Sequence[Bins]) -> DataFrame:
    """The rows of ``bin_counts`` from counted values."""
    code = F.lit(None).cast("int")
    for b in bins:
        value = F.col("text" if b.kind == "categorical" else "number")
        code = F.when(F.col("feature") == b.feature, b.code(value)).otherwise(code)
    present = F.col("number").isNotNull() | F.col("text").isNotNull()
    period = F.when(~histogram.in_period(histogram.TRAIN), F.col("period")).cast("int")
    return counts.withColumns({"bin": code, "period": period}).where(
        F.col("feature").isin(*[b.feature for b in bins])
    ).groupBy("feature", "bin", "period").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count_if(present).alias("n_distinct"),
    )


def safe_share(n: Column, total: Column, n_bins: Column) -> Column:
    """Share of a bin, at least ``EPS``; equal shares when there are no rows."""
    return F.when(total > 0, F.greatest(n / total, F.lit(EPS))).otherwise(F.lit(1.0) / n_bins)


def psi_term(expected: Column, actual: Column) -> Column:
    return (actual - expected) * F.log(actual / expected)


def bin_shares(counts: DataFrame, years: Sequence[int]) -> DataFrame:
    """Expected and actual share of every bin that occurs in training or in the year."""

    def of(column, period):
        match = F.col("period").isNull() if period is None else F.col("period") == period
        return F.coalesce(F.sum(F.when(match, F.col(column))), F.lit(0))

    measures = ("n", "n_missing", "n_distinct")
    wide = counts.groupBy("feature", "bin").agg(
        *[of(m, None).alias(f"train_{m}") for m in measures],
        *[of(m, y).alias(f"{m}_{y}") for y in years for m in measures],
    )
    per_year = [
        F.struct(F.lit(y).alias("year"), *[F.col(f"{m}_{y}").alias(f"year_{m}") for m in measures])
        for y in years
    ]
    rows = wide.select(
        "feature", "bin", *[f"train_{m}" for m in measures], F.inline(F.array(*per_year))
    )
    rows = rows.where((F.col("train_n") > 0) | (F.col("year_n") > 0))
    group = Window.partitionBy("feature", "year")
    return (
        rows.withColumn("train_total", F.sum("train_n").over(group))
        .withColumn("year_total", F.sum("year_n").over(group))
        .withColumn("n_bins", F.count(F.lit(1)).over(group))
        .withColumn("expected", safe_share(F.col("train_n"), F.col("train_total"), F.col("n_bins")))
        .withColumn("actual", safe_share(F.col("year_n"), F.col("year_total"), F.col("n_bins")))
    )


def psi_by_feature_year(
    train: DataFrame,
    test: DataFrame,
    features: Iterable[str],
    year: str = "year",
    n_bins: int = 10,
    max_categories: int = 25,
    nunique: str = "exact",
    years: Sequence[int] | None = None,
) -> DataFrame:
    """PSI, missing rates and distinct counts of every feature in every test year.

    Features absent from either table are skipped. ``years`` saves the pass that looks them up. The
    table is read once, to count its values; bins, shares and distinct values come from the counts.
    ``nunique="approx"`` writes no counts: it learns the bins first and shuffles bins only.
    """
    if year not in test.columns:
        raise ValueError(f"the test table has no column '{year}'")
    features = [f for f in features if f in train.columns and f in test.columns]
    if not features:
        raise ValueError("no feature is present in both tables")
    years = years_present(test, year) if years is None else sorted(years)
    if nunique == "exact":
        periods = histogram.Periods(train.sparkSession)
        periods.add(train, test, features, years, year)
        return psi_from(periods.table(), train, features, years, n_bins, max_categories)
    bins = fit_bins(train, features, n_bins, max_categories)
    return _psi_of(bin_counts(stack_periods(train, test, features, year), bins, nunique), bins, years)


def psi_from(
    counts: DataFrame, train: DataFrame, features: Sequence[str], years: Sequence[int],
    n_bins: int = 10, max_categories: int = 25,
) -> DataFrame:
    """The same from counted values. Of the training table only the types are looked at."""
    bins = bins_of(counts, train, features, n_bins, max_categories)
    return _psi_of(counted_bins(counts, bins), bins, sorted(years))


def _psi_of(counts, bins, years):
    kind = F.lit(None).cast("string")
    for b in bins:
        kind = F.when(F.col("feature") == b.feature, F.lit(b.kind)).otherwise(kind)
    shares = bin_shares(counts, years).where(F.col("year_total") > 0)
    term = psi_term(F.col("expected"), F.col("actual"))
    return (
        shares.groupBy("year", "feature")
        .agg(
            F.sum(term).alias("psi"),
            (F.sum("train_n_missing") / F.sum("train_n")).alias("train_missing_rate"),
            (F.sum("year_n_missing") / F.sum("year_n")).alias("year_missing_rate"),
            F.sum("train_n_distinct").alias("train_nunique"),
            F.sum("year_n_distinct").alias("year_nunique"),
        )
        .withColumn("feature_type", kind)
        .withColumn("psi", F.when(F.col("feature_type") != "numeric_constant", F.col("psi")))
        .select(
            "year", "feature", "feature_type", "psi", "train_missing_rate", "year_missing_rate",
            "train_nunique", "year_nunique",
        )
    )


def feature_psi(
    train: DataFrame,
    actual: DataFrame,
    feature: str,
    n_bins: int = 10,
    max_categories: int = 25,
) -> DataFrame:
    """One row ``(feature, feature_type, psi)``; the type is ``missing`` if a side lacks it."""
    if feature not in train.columns or feature not in actual.columns:
        schema = "feature string, feature_type string, psi double"
        return local_table(train.sparkSession, [(feature, "missing", None)], schema)
    one_year = actual.select(feature, F.lit(0).alias("year"))
    table = psi_by_feature_year(
        train, one_year, [feature], "year", n_bins, max_categories, "approx", [0]
    )
    return table.select("feature", "feature_type", "psi")


def base_rate_by_year(
    train: DataFrame, test: DataFrame, target: str = "Default", year: str = "year"
) -> DataFrame:
    """Label rate of each test year against the training rate and the first test year's."""
    for name, df in (("training", train), ("test", test)):
        if target not in df.columns:
            raise ValueError(f"the {name} table has no column '{target}'")
    rates = (
        stack_periods(train, test, [target], year)
        .groupBy("period")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.avg(target).alias("rate"))
    )
    return _shifts(rates)


def base_rate_from(counts: DataFrame, target: str = "Default") -> DataFrame:
    """The same from counted values, of which the label is one feature."""
    period = F.when(~histogram.in_period(histogram.TRAIN), F.col("period")).cast("int")
    return _shifts(histogram.rates(counts, target).withColumn("period", period))


def _shifts(rates):
    # one row per period from here on
    whole = Window.partitionBy(F.lit(0))
    first = F.min_by("rate", F.col("period")).over(whole)
    return (
        rates.withColumn("train_rate", F.max(F.when(F.col("period").isNull(), F.col("rate"))).over(whole))
        .withColumn("first_rate", first)
        .withColumn("n_later", F.count("period").over(whole))
        .where(holds(F.col("n_later") == 0, "the test table is empty", F.col("period").isNotNull()))
        .select(
            F.col("period").alias("year"),
            "n_rows",
            F.col("rate").alias("default_rate"),
            F.col("train_rate").alias("train_default_rate"),
            (F.col("rate") - F.col("train_rate")).alias("default_rate_shift_from_train"),
            F.col("first_rate").alias("first_test_year_default_rate"),
            (F.col("rate") - F.col("first_rate")).alias("default_rate_shift_from_first_test_year"),
        )
    )


def drift_summary_by_year(psi: DataFrame, base_rate: DataFrame) -> DataFrame:
    """Base rates with the mean, median and highest PSI of the year and counts above two marks."""
    value = F.col("psi")
    summary = (
        psi.where(value.isNotNull())
        .groupBy("year")
        .agg(
            F.avg(value).alias("mean_psi"),
            F.median(value).alias("median_psi"),
            F.max(value).alias("max_psi"),
            F.countDistinct("feature").alias("num_features"),
            F.count_if(value > 0.10).alias("num_features_psi_gt_0_10"),
            F.count_if(value > 0.25).alias("num_features_psi_gt_0_25"),
        )
    )
    return base_rate.join(summary, "year", "left")


def top_drift_features(psi: DataFrame, n: int = 20) -> DataFrame:
    """Features by their highest PSI in any year; equal ones by name."""
    return (
        psi.where(F.col("psi").isNotNull())
        .groupBy("feature", "feature_type")
        .agg(F.max("psi").alias("max_psi"), F.avg("psi").alias("mean_psi"))
        .orderBy(F.desc("max_psi"), "feature")
        .limit(n)
    )


def psi_matrix(psi: DataFrame, years: Sequence[int], n: int = 20) -> DataFrame:
    """Mean PSI with features as rows and years as columns, for the ``n`` most shifted features."""
    wide = (
        psi.where(F.col("psi").isNotNull())
        .groupBy("feature")
        .pivot("year", list(years))
        .agg(F.avg("psi"))
    )
    highest = F.greatest(*[F.col(f"`{y}`") for y in years]) if len(years) > 1 else F.col(f"`{years[0]}`")
    top = top_drift_features(psi, n).select("feature")
    return wide.join(top, "feature", "left_semi").orderBy(F.desc_nulls_last(highest), "feature")
