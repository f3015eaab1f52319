"""Preparation, models, scoring, feature reliance."""

from __future__ import annotations

from dataclasses import replace
from functools import partial

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from bindings import tables as t
from bindings.registry import define, query
from tidemark.functions.names import strip_prefix
from tidemark.operators import matched, metrics, prepare, reliance, scoring
from tidemark.operators.foreign import ForeignModel
from tidemark.operators.split import temporal_split_tvt
from tidemark.operators.thresholds import best_thresholds, threshold_grid, threshold_sweep
from tidemark.plans import reports
from tidemark.roles import FeatureGroups
from tidemark.session import scratch_path, stored

GROUPS = FeatureGroups(tuple(t.FEATURES), tuple(t.NUMERIC), tuple(t.CATEGORICAL))
NEURAL = scoring.NeuralConfig(components=16, hidden=(16, 8))
SEGMENTS = ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY")

define(
    gappy="""
        SELECT id, year, o_totalprice, c_mktsegment,
               CASE WHEN id % 7 <> 0 THEN c_acctbal END AS c_acctbal,
               CASE WHEN id % 5 <> 0 THEN n_name END AS n_name FROM loans_keyed""",
    gap_fill="""
        SELECT (SELECT median(c_acctbal) FROM gappy WHERE year <= 1997) AS middle,
               (SELECT n_name FROM gappy WHERE year <= 1997 AND n_name IS NOT NULL
                GROUP BY n_name ORDER BY count(*) DESC, n_name LIMIT 1) AS common""",
    filled="""
        SELECT id, year, o_totalprice, coalesce(c_acctbal, middle) AS c_acctbal,
               coalesce(n_name, common) AS n_name, c_mktsegment
        FROM gappy JOIN gap_fill ON true""",
    scaled="""
        SELECT id, year, (o_totalprice - pm) / ps AS o_totalprice,
               (c_acctbal - am) / a_s AS c_acctbal
        FROM filled JOIN (SELECT avg(o_totalprice) AS pm, stddev_pop(o_totalprice) AS ps,
                                 avg(c_acctbal) AS am, stddev_pop(c_acctbal) AS a_s
                          FROM filled WHERE year <= 1997) z ON true""",
    slot_base="""
        SELECT model, transformed_feature, weight,
               regexp_replace(transformed_feature, '^(num|cat)__', '') AS clean,
               CASE WHEN transformed_feature LIKE 'cat\\_\\_p\\_type\\_%' ESCAPE '\\' THEN 'p_type'
                    WHEN transformed_feature LIKE 'cat\\_\\_p\\_brand\\_%' ESCAPE '\\' THEN 'p_brand'
                    ELSE 'p' END AS base FROM importances""",
)


def gappy(spark, folder):
    return t.loans_keyed(spark, folder).withColumns({
        "c_acctbal": F.when(F.col("id") % 7 != 0, F.col("c_acctbal")),
        "n_name": F.when(F.col("id") % 5 != 0, F.col("n_name")),
    })


def past(df):
    return df.where(F.col("year") <= t.TRAIN_END)


@query("impute_median", "SELECT id, round(c_acctbal, 6) AS c_acctbal FROM filled")
def impute_median(spark, folder):
    df = gappy(spark, folder)
    fill = prepare.medians(past(df), ["c_acctbal"])
    return prepare.impute_median(df, fill).select("id", "c_acctbal")


@query("impute_mode", "SELECT id, n_name FROM filled")
def impute_mode(spark, folder):
    df = gappy(spark, folder)
    common = prepare.modes(prepare.level_counts(past(df), ["n_name"]))
    return prepare.impute_mode(df, common).select("id", "n_name")


@query("standardize", "SELECT id, round(o_totalprice, 6) AS o_totalprice, "
       "round(c_acctbal, 6) AS c_acctbal FROM scaled")
def standardize(spark, folder):
    df = gappy(spark, folder)
    numeric = ["o_totalprice", "c_acctbal"]
    learnt = prepare.fit_preparation(past(df), numeric, [])
    filled = prepare.impute_median(df, learnt.medians)
    return prepare.standardize(filled, learnt.stats).select("id", *numeric)


@query("one_hot", "SELECT id, " + ", ".join(
    f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS c_mktsegment_{s}" for s in SEGMENTS
) + " FROM loans_keyed")
def one_hot(spark, folder):
    df = t.loans_keyed(spark, folder)
    known = df.where(F.col("c_mktsegment") != "BUILDING")
    return prepare.one_hot(df, prepare.categories(prepare.level_counts(known, ["c_mktsegment"])), ["id"])


@query("tabular_preprocessor", """
    WITH levels AS (
        SELECT part, value, 1 + row_number() OVER (ORDER BY part, value) AS slot FROM (
            SELECT DISTINCT 1 AS part, n_name AS value FROM gappy WHERE year <= 1997 AND n_name IS NOT NULL
            UNION ALL SELECT DISTINCT 2, c_mktsegment FROM gappy
            WHERE year <= 1997 AND c_mktsegment IS NOT NULL) x)
    SELECT s.id, CAST((SELECT count(*) + 2 FROM levels) AS INTEGER) AS n_slots,
           round(s.o_totalprice, 6) AS o_totalprice, round(s.c_acctbal, 6) AS c_acctbal,
           concat_ws(',', a.slot, b.slot) AS slots_of_one
    FROM scaled s JOIN filled f ON f.id = s.id
    LEFT JOIN levels a ON a.part = 1 AND a.value = f.n_name
    LEFT JOIN levels b ON b.part = 2 AND b.value = f.c_mktsegment""")
def tabular_preprocessor(spark, folder):
    """All slots: two numbers, and the places that hold a one; the others hold nothing."""
    df = gappy(spark, folder)
    numeric, texts = ["o_totalprice", "c_acctbal"], ["n_name", "c_mktsegment"]
    prepared = prepare.preparation_stages(past(df), numeric, texts).transform(df)
    slots = vector_to_array("features")
    hot = F.filter(
        F.transform(slots, lambda x, i: F.when((i >= 2) & (x != 0), F.concat(
            i.cast("string"), F.when(x != 1, F.concat(F.lit("="), x.cast("string"))).otherwise("")))),
        lambda s: s.isNotNull())
    return prepared.select(
        "id", F.size(slots).alias("n_slots"), slots[0].alias("o_totalprice"),
        slots[1].alias("c_acctbal"), F.array_join(hot, ",").alias("slots_of_one"),
    )


def _levels(column):
    return (f"SELECT 'cat__{column}_' || {column} AS name FROM loans_wide "
            f"WHERE year <= 1997 AND {column} IS NOT NULL GROUP BY {column} ORDER BY {column}")


@query("transformed_names", f"""
    SELECT CAST(row_number() OVER (ORDER BY part, name) - 1 AS INTEGER) AS slot, name FROM (
        SELECT 1 AS part, 'num__qty_shifted' AS name UNION ALL SELECT 2, 'num__l_extendedprice'
        UNION ALL SELECT 3, 'num__discount_n' UNION ALL SELECT 4, 'num__is_later_line'
        UNION ALL SELECT 5, name FROM ({_levels("p_type")}) x
        UNION ALL SELECT 6, name FROM ({_levels("brand_n")}) y) z""")
def transformed_names(spark, folder):
    train = t.wide_split(spark, folder).train
    stages = prepare.preparation_stages(train, t.NUMERIC, t.CATEGORICAL)
    names = prepare.slot_names(stages.transform(train))
    return spark.createDataFrame(list(enumerate(names)), "slot int, name string")


def _by_year(model, parts):
    """Quality of a fitted model on validation and test rows."""
    rows = parts.tagged().where(F.col("split") != "train")
    pred = scoring.score_long(rows, [model], ["split", "year"], "target")
    return metrics.evaluate(stored(pred), ["model", "year"])


def _logistic(spark, folder):
    return scoring.fit_logistic(t.wide_split(spark, folder).train, GROUPS, t.LOANS)


@query("fit_logistic")
def fit_logistic(spark, folder):
    parts = t.wide_split(spark, folder)
    return _by_year(scoring.fit_logistic(parts.train, GROUPS, t.LOANS), parts)


@query("fit_logistic_balanced")
def fit_logistic_balanced(spark, folder):
    parts = t.wide_split(spark, folder)
    config = scoring.LogisticConfig(class_weight="balanced")
    return _by_year(scoring.fit_logistic(parts.train, GROUPS, t.LOANS, config), parts)


@query("fit_boosted_trees")
def fit_boosted_trees(spark, folder):
    parts = t.wide_split(spark, folder)
    return _by_year(scoring.fit_boosted_trees(parts.train, GROUPS, t.LOANS), parts)


@query("fit_mlp")
def fit_mlp(spark, folder):
    parts = t.wide_split(spark, folder)
    return _by_year(scoring.fit_mlp(parts.train, GROUPS, t.LOANS, NEURAL), parts)


@query("score")
def score(spark, folder):
    rows = t.wide_split(spark, folder).test
    return _logistic(spark, folder).score(rows).select("year", "target", "y_prob")


@query("score_by_year", """SELECT year, count(*) AS n_rows, CAST(sum(target) AS BIGINT) AS positives,
    CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS outside
    FROM loans_wide WHERE year BETWEEN 1999 AND 2001 GROUP BY year""")
def score_by_year(spark, folder):
    """Every row of the test years has one score, and it is a probability."""
    p = F.col("y_prob")
    return score(spark, folder).where(F.col("year").isin(*t.TEST_YEARS)).groupBy("year").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("target").cast("long").alias("positives"),
        F.count_if(p.isNull() | F.isnan(p)).alias("missing"),
        F.count_if((p < 0) | (p > 1)).alias("outside"),
    )


ONE_COLUMN = FeatureGroups(("p_type",), (), ("p_type",))


@query("fit_logistic_rates", """SELECT p_type, count(*) AS n_rows, true AS near, true AS near_balanced
    FROM loans_wide WHERE year <= 1997 AND p_type IS NOT NULL GROUP BY p_type""")
def fit_logistic_rates(spark, folder):
    """With one categorical column and next to no penalty, scores are the label rates of the values,
    or their rates under balanced weights."""
    train = t.wide_split(spark, folder).train.where(F.col("p_type").isNotNull())
    scored = train
    for column, weight in (("plain", None), ("balanced", "balanced")):
        config = scoring.LogisticConfig(c=1e9, class_weight=weight)
        scored = scoring.fit_logistic(train, ONE_COLUMN, t.LOANS, config).score(scored, column)
    share = train.agg(F.avg("target")).first()[0]
    rate = F.avg("target")
    balanced = rate / share / (rate / share + (1 - rate) / (1 - share))
    return scored.groupBy("p_type").agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.abs(F.avg("plain") - rate) < 0.002).alias("near"),
        (F.abs(F.avg("balanced") - balanced) < 0.002).alias("near_balanced"),
    )


@query("predict_label_rows", """SELECT year, count(*) AS n_rows FROM loans_wide
    WHERE year BETWEEN 1999 AND 2001 GROUP BY year""")
def predict_label_rows(spark, folder):
    """Each row of the test years has exactly one label."""
    found = predict_label(spark, folder).where(F.col("y_pred").isin(0, 1))
    return found.where(F.col("year").isin(*t.TEST_YEARS)).groupBy("year").agg(
        F.sum("n_rows").alias("n_rows"))


@query("predict_label")
def predict_label(spark, folder):
    rows = t.wide_split(spark, folder).test
    labelled = scoring.predict_label(_logistic(spark, folder), rows, 0.33)
    return labelled.groupBy("year", "y_pred").agg(F.count(F.lit(1)).alias("n_rows"))


class Linear:
    """A foreign model: a logistic function of two columns, with gaps at their middle."""

    middle, weights, shift = (150_000.0, 4_500.0), (0.00001, -0.0002), -0.25

    def predict_proba(self, rows):
        z = np.full(len(rows), self.shift)
        for column, middle, weight in zip(rows.columns, self.middle, self.weights):
            z += weight * (rows[column].fillna(middle).to_numpy() - middle)
        p = 1.0 / (1.0 + np.exp(-z))
        return np.column_stack([1 - p, p])


def _foreign():
    return ForeignModel("foreign", Linear(), {"o_totalprice": "double", "c_acctbal": "double"})


define(foreign_scores="""
    SELECT id, year, target, 1.0e0 / (1.0e0 + exp(0.25e0 - 0.00001e0 * (o_totalprice - 150000.0e0)
           + 0.0002e0 * (coalesce(c_acctbal, 4500.0e0) - 4500.0e0))) AS y_prob
    FROM (SELECT id, year, target, o_totalprice, CASE WHEN id % 7 <> 0 THEN c_acctbal END AS c_acctbal
          FROM loans_keyed) x""")


@query("score_foreign", "SELECT id, year, target, round(y_prob, 6) AS y_prob FROM foreign_scores")
def score_foreign(spark, folder):
    """A model that no operator here fitted, on every row."""
    return _foreign().score(gappy(spark, folder)).select("id", "year", "target", "y_prob")


@query("score_long_foreign", """SELECT model, year, count(*) AS n_rows, CAST(sum(y_true) AS BIGINT) AS positives,
    round(avg(y_prob), 6) AS mean_pred FROM (
        SELECT 'foreign' AS model, year, target AS y_true, y_prob FROM foreign_scores
        UNION ALL SELECT 'again', year, target, y_prob FROM foreign_scores) x GROUP BY model, year""")
def score_long_foreign(spark, folder):
    """Foreign models stand wherever fitted ones can."""
    models = [_foreign(), replace(_foreign(), name="again")]
    pred = scoring.score_long(gappy(spark, folder), models, ["year"], "target")
    return pred.groupBy("model", "year").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("y_true").alias("positives"),
        F.avg("y_prob").alias("mean_pred"))


def _two_models(parts):
    trees = scoring.fit_boosted_trees(parts.train, GROUPS, t.LOANS)
    return [scoring.fit_logistic(parts.train, GROUPS, t.LOANS), trees]


@query("score_long")
def score_long(spark, folder):
    parts = t.wide_split(spark, folder)
    return scoring.score_long(parts.test, _two_models(parts), ["year"], "target")


@query("tune_on_validation")
def tune_on_validation(spark, folder):
    val = t.wide_split(spark, folder).val
    pred = scoring.score_long(val, [_logistic(spark, folder)], ["year"], "target")
    pred = stored(pred)
    return best_thresholds(threshold_sweep(pred, threshold_grid(pred)))


@query("run_tuned_model")
def run_tuned_model(spark, folder):
    split = t.wide_split(spark, folder)
    fits = {
        "logreg": scoring.fit_logistic,
        "trees": scoring.fit_boosted_trees,
        "mlp": partial(scoring.fit_mlp, config=NEURAL),
    }
    _, tables = reports.run_tuned_models(split, GROUPS, fits, t.LOANS, scratch_path(spark, "tuned"))
    drift = reports.drift_report(split, t.FEATURES, t.LOANS)["drift_summary_by_year"]
    return reports.final_summary(
        tables["temporal_metrics"], tables["temporal_calibration"], drift
    )["final_summary"]


# --- reliance


@query("strip_prefix", "SELECT DISTINCT transformed_feature, clean AS clean_feature FROM slot_base")
def strip(spark, folder):
    names = t.importances(spark, folder).select("transformed_feature").distinct()
    return names.withColumn("clean_feature", strip_prefix(F.col("transformed_feature")))


def _slots(spark, folder):
    rows = t.importances(spark, folder)
    return reliance.add_base_features(rows, ["p_size"], ["p", "p_type", "p_brand"])


@query("base_feature", "SELECT model, transformed_feature, base AS base_feature FROM slot_base")
def base_feature(spark, folder):
    return _slots(spark, folder).select("model", "transformed_feature", "base_feature")


@query("coef_importance", """SELECT model, base AS base_feature,
    round(sum(abs(weight)), 6) AS importance_abs, round(avg(abs(weight)), 6) AS mean_abs_coefficient,
    round(max(abs(weight)), 6) AS max_abs_coefficient, count(*) AS n_transformed_features
    FROM slot_base GROUP BY model, base""")
def coef_importance(spark, folder):
    return reliance.coefficient_importance(_slots(spark, folder))


@query("tree_importance", """SELECT model, base AS base_feature, round(sum(weight), 6) AS importance,
    round(sum(abs(weight)), 6) AS importance_abs, round(avg(weight), 6) AS mean_importance,
    round(max(weight), 6) AS max_importance, count(*) AS n_transformed_features
    FROM slot_base GROUP BY model, base""")
def tree_importance(spark, folder):
    return reliance.tree_importance(_slots(spark, folder))


def overlap_sql(name, weight):
    return f"""
        WITH summed AS (SELECT model, {name} AS name, {weight} AS w FROM slot_base GROUP BY ALL),
        ranked AS (SELECT model, name, row_number() OVER (
            PARTITION BY model ORDER BY w DESC, name) AS place FROM summed),
        tops AS (SELECT k, model, name FROM ranked,
                 (SELECT unnest([5, 10, 20]) AS k) ks WHERE place <= k),
        shared AS (SELECT k, name, count(*) AS n FROM tops GROUP BY k, name)
        SELECT CAST(k AS INTEGER) AS top_k, count(*) FILTER (WHERE n = 2) AS overlap_count,
               round(CAST(count(*) FILTER (WHERE n = 2) AS DOUBLE) / count(*), 6) AS jaccard_overlap,
               coalesce(string_agg(name, ', ' ORDER BY name) FILTER (WHERE n = 2), '') AS
               overlapping_features
        FROM shared GROUP BY k"""


@query("topk_overlap", overlap_sql("base", "sum(abs(weight))"))
def topk_overlap(spark, folder):
    base = reliance.coefficient_importance(_slots(spark, folder))
    return reliance.topk_overlap(
        base.where(F.col("model") == "a"), base.where(F.col("model") == "b")
    )


@query("set_overlap", overlap_sql("clean", "sum(abs(weight))"))
def set_overlap(spark, folder):
    slots = _slots(spark, folder).select(
        "model", F.col("clean_feature").alias("base_feature"),
        F.abs("weight").alias("importance_abs"),
    )
    return reliance.topk_overlap(
        slots.where(F.col("model") == "a"), slots.where(F.col("model") == "b")
    )


@query("reliance_report")
def reliance_report(spark, folder):
    parts = t.wide_split(spark, folder)
    logistic, trees = _two_models(parts)
    return reports.reliance_report(logistic, trees, parts.table)["feature_importance_overlap"]


# --- matched comparison

KEYED = FeatureGroups(
    ("o_totalprice", "c_acctbal", "o_orderpriority", "c_mktsegment"),
    ("o_totalprice", "c_acctbal"),
    ("o_orderpriority", "c_mktsegment"),
)


def _external(spark, folder):
    """Model a as if an outside service had scored every validation and test row."""
    rows = t.pred(spark, folder).where((F.col("model") == "a") & (F.col("split") != "train"))
    return rows.select(
        "id", F.col("id").alias("llm_row_id"), F.lit(1).alias("llm_batch"), "split", "year",
        F.col("y_true").alias("target"), F.lit("outside").alias("llm_model"),
        F.col("y_prob").alias("llm_default_probability"),
        (F.col("y_prob") >= 0.5).cast("int").alias("llm_predicted_label_raw"),
        F.lit(None).cast("string").alias("llm_error"),
    )


@query("to_prediction_frame", """SELECT id, id AS llm_row_id, CAST(1 AS INTEGER) AS llm_batch, split,
    year, y_true AS target, 'outside' AS model, y_true, round(y_prob, 6) AS y_prob
    FROM pred WHERE model = 'a' AND split <> 'train'""")
def to_prediction_frame(spark, folder):
    return matched.to_prediction_frame(_external(spark, folder), "target")


@query("matched_comparison", """SELECT 'outside' AS model, year, n_rows, round(thr, 6) AS threshold,
    round(auc, 6) AS auc, round(f1, 6) AS f1, round(acc, 6) AS accuracy,
    round(brier, 6) AS brier_score, round(ece, 6) AS ece, round(rate, 6) AS default_rate,
    round(mean_pred, 6) AS mean_pred, round(ppr, 6) AS pred_positive_rate
    FROM metrics_99 WHERE model = 'a'""")
def matched_comparison(spark, folder):
    source = t.loans_keyed(spark, folder).where(F.col("year") >= t.VAL_YEAR)
    tables = reports.matched_comparison(source, _external(spark, folder), [], t.LOANS)
    return tables["sample_matched_yearly_metrics"]


@query("matched_comparison_models")
def matched_comparison_models(spark, folder):
    parts = temporal_split_tvt(
        t.loans_keyed(spark, folder), t.TRAIN_END, t.VAL_YEAR, t.TEST_YEARS, t.LOANS
    )
    models = [
        scoring.fit_logistic(parts.train, KEYED, t.LOANS),
        scoring.fit_boosted_trees(parts.train, KEYED, t.LOANS),
        scoring.fit_mlp(parts.train, KEYED, t.LOANS, NEURAL),
    ]
    tables = reports.matched_comparison(
        parts.table.where(F.col("year") >= t.VAL_YEAR), _external(spark, folder), models, t.LOANS
    )
    return tables["sample_matched_model_summary"]
