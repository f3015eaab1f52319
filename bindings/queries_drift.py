"""Drift of labels and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import tables as t
from bindings.registry import PROBS_10, define, quantile_sql, query
from tidemark.operators import drift, histogram
from tidemark.operators.tables import stack
from tidemark.plans import reports
from tidemark.session import scratch_path

PERIOD = "CASE WHEN year > 1998 THEN year ELSE 0 END"


def _long(columns, cast):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {PERIOD} AS period, CAST({c} AS {cast}) AS v "
        "FROM loans_wide WHERE year <> 1998" for c in columns
    )


define(
    num_long=_long(t.NUMERIC, "DOUBLE"),
    num_train="SELECT feature, v AS number FROM num_long WHERE period = 0 AND v IS NOT NULL",
    num_edges=f"""
        SELECT feature, list_sort(list(DISTINCT q)) AS edges
        FROM ({quantile_sql("num_train", "feature", PROBS_10, "number")}) x GROUP BY feature""",
    num_binned="""
        SELECT feature, period, v, CASE WHEN v IS NULL OR len(edges) < 3 THEN 0
               ELSE 1 + len(list_filter(edges[2:len(edges) - 1], lambda e: e < v)) END AS bin
        FROM num_long JOIN num_edges USING (feature)""",
    cat_long=_long(t.CATEGORICAL, "VARCHAR"),
    cat_top="""
        SELECT feature, value, row_number() OVER (
               PARTITION BY feature ORDER BY count(*) DESC, value) AS bin
        FROM (SELECT feature, coalesce(v, '__MISSING__') AS value FROM cat_long WHERE period = 0) x
        GROUP BY feature, value QUALIFY bin <= 25""",
    cat_binned="""
        SELECT l.feature, period, v, coalesce(bin, 0) AS bin,
               coalesce(value, '__OTHER__') AS label
        FROM cat_long l LEFT JOIN cat_top c
             ON l.feature = c.feature AND coalesce(v, '__MISSING__') = c.value""",
    bin_n="""
        SELECT feature, period, bin, count(*) AS n FROM num_binned GROUP BY ALL
        UNION ALL SELECT feature, period, bin, count(*) FROM cat_binned GROUP BY ALL""",
    bin_grid="""
        SELECT y.feature, y.period, b.bin
        FROM (SELECT DISTINCT feature, period FROM bin_n WHERE period > 0) y
        JOIN (SELECT DISTINCT feature, bin FROM bin_n) b ON y.feature = b.feature""",
    bin_share="""
        SELECT g.feature, g.period AS year, g.bin,
               greatest(coalesce(e.n, 0) / sum(coalesce(e.n, 0)) OVER w, 1e-6) AS expected,
               greatest(coalesce(a.n, 0) / sum(coalesce(a.n, 0)) OVER w, 1e-6) AS actual
        FROM bin_grid g
        LEFT JOIN bin_n e ON e.feature = g.feature AND e.bin = g.bin AND e.period = 0
        LEFT JOIN bin_n a ON a.feature = g.feature AND a.bin = g.bin AND a.period = g.period
        WHERE e.n IS NOT NULL OR a.n IS NOT NULL
        WINDOW w AS (PARTITION BY g.feature, g.period)""",
    psi_raw="""
        SELECT feature, year, CASE WHEN feature <> 'is_later_line'
               THEN sum((actual - expected) * ln(actual / expected)) END AS psi
        FROM bin_share GROUP BY feature, year""",
    feature_profile="""
        SELECT feature, period, avg(CASE WHEN v IS NULL THEN 1.0e0 ELSE 0.0e0 END) AS missing,
               count(DISTINCT v) AS n_distinct
        FROM (SELECT feature, period, CAST(v AS VARCHAR) AS v FROM num_long
              UNION ALL SELECT feature, period, v FROM cat_long) x GROUP BY feature, period""",
    base_rate="""
        SELECT year, n_rows, rate, train_rate, first_value(rate) OVER (ORDER BY year) AS first_rate
        FROM (SELECT year, count(*) AS n_rows, avg(target) AS rate FROM loans_wide
              WHERE year > 1998 GROUP BY year) y
        JOIN (SELECT avg(target) AS train_rate FROM loans_wide WHERE year <= 1997) z ON true""",
    base_rate_out="""
        SELECT year, n_rows, round(rate, 6) AS default_rate,
               round(train_rate, 6) AS train_default_rate,
               round(rate - train_rate, 6) AS default_rate_shift_from_train,
               round(first_rate, 6) AS first_test_year_default_rate,
               round(rate - first_rate, 6) AS default_rate_shift_from_first_test_year
        FROM base_rate""",
    psi_summary="""
        SELECT year, round(avg(psi), 6) AS mean_psi, round(median(psi), 6) AS median_psi,
               round(max(psi), 6) AS max_psi, count(DISTINCT feature) AS num_features,
               CAST(sum(CASE WHEN psi > 0.10 THEN 1 ELSE 0 END) AS BIGINT) AS
               num_features_psi_gt_0_10,
               CAST(sum(CASE WHEN psi > 0.25 THEN 1 ELSE 0 END) AS BIGINT) AS
               num_features_psi_gt_0_25
        FROM psi_raw WHERE psi IS NOT NULL GROUP BY year""",
    drift_summary_out="SELECT * FROM base_rate_out LEFT JOIN psi_summary USING (year)",
    top_drift="""
        SELECT feature, CASE WHEN feature IN ('p_type', 'brand_n') THEN 'categorical'
               ELSE 'numeric' END AS feature_type, max(psi) AS max_psi, avg(psi) AS mean_psi
        FROM psi_raw WHERE psi IS NOT NULL GROUP BY feature""",
)


def _psi(spark, folder):
    parts = t.wide_split(spark, folder)
    return drift.psi_by_feature_year(parts.train, parts.test, t.FEATURES, years=t.TEST_YEARS)


def _base_rate(spark, folder):
    parts = t.wide_split(spark, folder)
    return drift.base_rate_by_year(parts.train, parts.test, "target")


def _counts(spark, folder, columns):
    parts = t.wide_split(spark, folder)
    bins = drift.fit_bins(parts.train, columns)
    stacked = drift.stack_periods(parts.train, parts.test, columns, "year")
    return bins, drift.bin_counts(stacked, bins, "approx")


@query("base_rate_by_year", "SELECT * FROM base_rate_out")
def base_rate_by_year(spark, folder):
    return _base_rate(spark, folder)


@query("shift_from_first_period", """SELECT year, default_rate,
    default_rate_shift_from_first_test_year FROM base_rate_out""")
def shift_from_first_period(spark, folder):
    return _base_rate(spark, folder).select(
        "year", "default_rate", "default_rate_shift_from_first_test_year"
    )


@query("psi_numeric_edges", """SELECT feature, CAST(i AS INTEGER) AS position, round(edges[i + 1], 6) AS edge
    FROM num_edges, range(11) r(i) WHERE i < len(edges)""")
def psi_numeric_edges(spark, folder):
    edges = drift.numeric_edges(t.wide_split(spark, folder).train, t.NUMERIC)
    rows = [(f, i, e) for f, found in edges.items() for i, e in enumerate(found)]
    return spark.createDataFrame(rows, "feature string, position int, edge double")


@query("psi_numeric_bins", """SELECT feature, CAST(period AS INTEGER) AS period,
    CAST(bin AS INTEGER) AS bin, count(*) AS n FROM num_binned GROUP BY ALL""")
def psi_numeric_bins(spark, folder):
    _, counts = _counts(spark, folder, t.NUMERIC)
    return counts.select("feature", F.coalesce("period", F.lit(0)).alias("period"), "bin", "n")


@query("psi_categorical_bins", """SELECT feature, CAST(period AS INTEGER) AS period, label,
    count(*) AS n FROM cat_binned GROUP BY ALL""")
def psi_categorical_bins(spark, folder):
    bins, counts = _counts(spark, folder, t.CATEGORICAL)
    label = F.lit(None).cast("string")
    for b in bins:
        for code in range(len(b.top) + 1):
            match = (F.col("feature") == b.feature) & (F.col("bin") == code)
            label = F.when(match, F.lit(b.label(code))).otherwise(label)
    return counts.select(
        "feature", F.coalesce("period", F.lit(0)).alias("period"), label.alias("label"), "n"
    )


@query("psi_proportions", """SELECT feature, CAST(year AS INTEGER) AS year, CAST(bin AS INTEGER) AS bin,
    round(expected, 6) AS expected, round(actual, 6) AS actual FROM bin_share""")
def psi_proportions(spark, folder):
    _, counts = _counts(spark, folder, t.FEATURES)
    return drift.bin_shares(counts, t.TEST_YEARS).select(
        "feature", "year", "bin", "expected", "actual"
    )


@query("psi", """SELECT feature, CAST(year AS INTEGER) AS year, round(psi, 6) AS psi
    FROM (SELECT feature, year, sum((actual - expected) * ln(actual / expected)) AS psi
          FROM bin_share GROUP BY feature, year) x""")
def psi(spark, folder):
    """Of every feature; one with a single bin has none to speak of, 0."""
    bins, counts = _counts(spark, folder, t.FEATURES)
    term = drift.psi_term(F.col("expected"), F.col("actual"))
    shares = drift.bin_shares(counts, t.TEST_YEARS)
    return shares.groupBy("feature", "year").agg(F.sum(term).alias("psi"))


@query("feature_psi", """
    WITH share AS (
        SELECT feature, bin,
               greatest(coalesce(sum(n) FILTER (WHERE period = 0), 0) / sum(sum(n) FILTER (WHERE period = 0))
                   OVER (PARTITION BY feature), 1e-6) AS expected,
               greatest(coalesce(sum(n) FILTER (WHERE period > 0), 0) / sum(sum(n) FILTER (WHERE period > 0))
                   OVER (PARTITION BY feature), 1e-6) AS actual
        FROM bin_n GROUP BY feature, bin)
    SELECT feature, CASE WHEN feature = 'is_later_line' THEN 'numeric_constant'
               WHEN feature IN ('p_type', 'brand_n') THEN 'categorical' ELSE 'numeric' END AS feature_type,
           round(CASE WHEN feature <> 'is_later_line'
                 THEN sum((actual - expected) * ln(actual / expected)) END, 6) AS psi
    FROM share GROUP BY feature
    UNION ALL SELECT 'absent', 'missing', NULL""")
def feature_psi(spark, folder):
    """Each feature, all test rows as one sample; and one that no table has."""
    parts = t.wide_split(spark, folder)
    return stack([drift.feature_psi(parts.train, parts.test, f) for f in (*t.FEATURES, "absent")])


PSI_SQL = """
    SELECT CAST(p.year AS INTEGER) AS year, p.feature,
           CASE WHEN p.feature = 'is_later_line' THEN 'numeric_constant'
                WHEN p.feature IN ('p_type', 'brand_n') THEN 'categorical'
                ELSE 'numeric' END AS feature_type,
           round(psi, 6) AS psi, round(e.missing, 6) AS train_missing_rate,
           round(a.missing, 6) AS year_missing_rate, e.n_distinct AS train_nunique,
           a.n_distinct AS year_nunique
    FROM psi_raw p JOIN feature_profile e ON e.feature = p.feature AND e.period = 0
    JOIN feature_profile a ON a.feature = p.feature AND a.period = p.year"""


@query("psi_by_feature_year", PSI_SQL)
def psi_by_feature_year(spark, folder):
    return _psi(spark, folder)


DISTINCT_CLOSE = """SELECT feature, CAST(period AS INTEGER) AS period, n_rows,
    round(missing, 6) AS missing_rate, n_distinct AS exact, true AS close
    FROM feature_profile JOIN (SELECT feature, period, count(*) AS n_rows FROM (
        SELECT feature, period FROM num_long UNION ALL SELECT feature, period FROM cat_long) x
        GROUP BY feature, period) r USING (feature, period)"""


@query("distinct_sketches", DISTINCT_CLOSE)
def distinct_sketches(spark, folder):
    """Distinct values from written sketches, beside the exact number: within 2 % of it."""
    parts = t.wide_split(spark, folder)
    sketches = histogram.Periods(spark, sketches=True)
    sketches.add(parts.train, parts.test, t.FEATURES, t.TEST_YEARS)
    rough = histogram.estimates(sketches.table())
    counts = histogram.Periods(spark)
    counts.add(parts.train, parts.test, t.FEATURES, t.TEST_YEARS)
    exact = histogram.profile(counts.table()).select("feature", "period", F.col("n_distinct").alias("exact"))
    return rough.join(exact, ["feature", "period"]).select(
        "feature", F.when(histogram.in_period("train"), 0).otherwise(F.col("period").try_cast("int"))
        .alias("period"), F.col("n").alias("n_rows"), "missing_rate", "exact",
        (F.abs(F.col("n_distinct") - F.col("exact")) <= 0.02 * F.col("exact")).alias("close"))


@query("quantile_sketches", """
    SELECT feature, 9 AS n_points, true AS close FROM (SELECT DISTINCT feature FROM num_long) x""")
def quantile_sketches(spark, folder):
    """Deciles of all test years from the merged sketches of the years: the share of rows at or below an
    estimate, and below it, enclose its rank to one hundredth."""
    parts = t.wide_split(spark, folder)
    sketches = histogram.Periods(spark, sketches=True)
    sketches.add(parts.train, parts.test, t.NUMERIC, t.TEST_YEARS)
    probs = [i / 10 for i in range(1, 10)]
    years = histogram.merged(sketches.table().where(~histogram.in_period("train")), "feature")
    points = histogram.estimates(years, probs).select("feature", F.posexplode("quantiles").alias("at", "point"))
    counts = histogram.Periods(spark)
    counts.add(parts.train, parts.test, t.NUMERIC, t.TEST_YEARS)
    values = counts.table().where("period <> 'train' AND number IS NOT NULL").groupBy("feature", "number").agg(
        F.sum("n").alias("n"))
    ranks = values.join(points, "feature").groupBy("feature", "at").agg(
        (F.sum(F.when(F.col("number") < F.col("point"), F.col("n")).otherwise(0)) / F.sum("n")).alias("below"),
        (F.sum(F.when(F.col("number") <= F.col("point"), F.col("n")).otherwise(0)) / F.sum("n")).alias("upto"))
    wanted = (F.col("at") + 1) / 10
    good = (F.col("below") <= wanted + 0.01) & (F.col("upto") >= wanted - 0.01)
    return ranks.groupBy("feature").agg(
        F.count(F.lit(1)).cast("int").alias("n_points"), F.every(good).alias("close"))


@query("drift_summary_by_year", "SELECT * FROM drift_summary_out")
def drift_summary_by_year(spark, folder):
    return drift.drift_summary_by_year(_psi(spark, folder), _base_rate(spark, folder))


@query("join_baserate_psi", "SELECT year, n_rows, default_rate, max_psi FROM drift_summary_out")
def join_baserate_psi(spark, folder):
    summary = drift.drift_summary_by_year(_psi(spark, folder), _base_rate(spark, folder))
    return summary.select("year", "n_rows", "default_rate", "max_psi")


@query("top_drift_features", """SELECT feature, feature_type, round(max_psi, 6) AS max_psi,
    round(mean_psi, 6) AS mean_psi FROM top_drift""")
def top_drift_features(spark, folder):
    return drift.top_drift_features(_psi(spark, folder))


@query("topk", """SELECT feature, round(max_psi, 6) AS max_psi FROM top_drift
    ORDER BY top_drift.max_psi DESC, feature LIMIT 3""")
def topk(spark, folder):
    return drift.top_drift_features(_psi(spark, folder), 3).select("feature", "max_psi")


@query("psi_matrix", """SELECT feature,
    round(max(CASE WHEN year = 1999 THEN psi END), 6) AS "1999",
    round(max(CASE WHEN year = 2000 THEN psi END), 6) AS "2000",
    round(max(CASE WHEN year = 2001 THEN psi END), 6) AS "2001"
    FROM psi_raw WHERE feature IN (SELECT feature FROM top_drift) GROUP BY feature""")
def psi_matrix(spark, folder):
    return drift.psi_matrix(_psi(spark, folder), t.TEST_YEARS)


def _report(spark, folder, fmt="parquet"):
    return reports.drift_report(
        t.wide_split(spark, folder), t.FEATURES, t.LOANS, scratch_path(spark, "drift"), fmt=fmt
    )


@query("drift_report", "SELECT * FROM drift_summary_out")
def drift_report(spark, folder):
    return _report(spark, folder)["drift_summary_by_year"]


@query("drift_report_base_rates", "SELECT * FROM base_rate_out")
def drift_report_base_rates(spark, folder):
    return _report(spark, folder, "csv")["base_rate_by_year"]


@query("drift_report_psi", PSI_SQL)
def drift_report_psi(spark, folder):
    return _report(spark, folder, "csv")["psi_by_feature_year"]


@query("drift_report_top_features", """SELECT feature, feature_type, round(max_psi, 6) AS max_psi,
    round(mean_psi, 6) AS mean_psi FROM top_drift""")
def drift_report_top_features(spark, folder):
    return _report(spark, folder, "csv")["psi_top_features"]
