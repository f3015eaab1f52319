"""Scans, cleaning, splits, joins, aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import tables as t
from bindings.registry import define, query
from tidemark.operators import (
    clean, dedup, drift, features, histogram, joins, metrics, split, tables,
)
from tidemark.operators.thresholds import best_thresholds, fixed_grid, threshold_sweep
from tidemark.roles import Roles
from tidemark.session import scratch_path
from tidemark.sources import scan, sink
from tidemark.streaming import resume

RAW = Roles(target="Default", time="issue_d", id="id", text=("title",))

define(
    orders_out="""
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
               strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders""",
    clean_out="""
        SELECT o_orderkey AS id,
               CASE WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%Y-%m-01')
                    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS issue_d,
               CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS "Default",
               CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS title,
               CAST(year(o_orderdate) AS INTEGER) AS year,
               CAST(month(o_orderdate) AS INTEGER) AS month
        FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 4 <> 3""",
    wide_test="SELECT * FROM loans_wide WHERE year IN (1999, 2000, 2001)",
    wide_train="SELECT * FROM loans_wide WHERE year <= 1997",
)


def day(column):
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def raw_loans(spark, folder):
    """Orders as a raw loans table: dates in several spellings, status texts, padded titles."""
    date, key = F.col("o_orderdate"), F.col("o_orderkey")
    spelled = (
        F.when(key % 4 == 0, F.date_format(date, "yyyy-MM-dd"))
        .when(key % 4 == 1, F.date_format(date, "MMM-yyyy"))
        .when(key % 4 == 2, F.date_format(date, "MM/dd/yyyy"))
        .otherwise("not a date")
    )
    status = F.when(F.col("o_orderstatus") == "F", "Charged Off").when(
        F.col("o_orderstatus") == "O", "Fully Paid"
    ).otherwise("Current")
    title = F.when(key % 3 != 0, F.concat(F.lit(" \t"), F.col("o_orderpriority"), F.lit("\n ")))
    return t.table(spark, folder, "orders").select(
        key.alias("id"), spelled.alias("issue_d"), status.alias("Default"), title.alias("title"),
        "o_totalprice",
    )


# --- scans and sinks


@query("scan_table", "SELECT * FROM orders_out")
def scan_table(spark, folder):
    df = t.table(spark, folder, "orders")
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("scan_csv", "SELECT * FROM orders_out")
def scan_csv(spark, folder):
    path = scratch_path(spark, "orders") + ".csv"
    sink.write_metrics(scan_table(spark, folder), path)
    return scan.load_table(spark, path)


@query("validate_schema", "SELECT count(*) AS n_rows FROM loans_keyed")
def validate_schema(spark, folder):
    df = scan.validate_schema(t.loans_keyed(spark, folder), t.LOANS)
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


@query("load_clean", "SELECT * FROM clean_out")
def load_clean(spark, folder):
    path = scratch_path(spark, "raw-loans") + ".csv"
    sink.write_metrics(raw_loans(spark, folder), path)
    schema = "id bigint, issue_d string, `Default` string, title string, o_totalprice double"
    df = clean.load_clean(spark, path, RAW, schema=schema)
    return df.select("id", day("issue_d"), "Default", "title", "year", "month")


@query("sink_metrics_csv", "SELECT year, count(*) AS n_rows, round(avg(target), 6) AS default_rate "
       "FROM loans_keyed GROUP BY year")
def sink_metrics_csv(spark, folder):
    periods = split.describe_periods(t.loans_keyed(spark, folder), t.LOANS)
    path = sink.write_metrics(periods, scratch_path(spark, "periods") + ".csv", one_file=True)
    schema = "year int, n_rows bigint, default_rate double"
    return scan.load_table(spark, path, schema, multi_line=False)


@query("sink_jsonl", """
    SELECT doc_id, text, lang, CASE WHEN source <> 'src0' THEN source END AS source FROM documents""")
def sink_jsonl(spark, folder):
    rows = t.table(spark, folder, "documents").select(
        "doc_id", "text", "lang", F.when(F.col("source") != "src0", F.col("source")).alias("source")
    )
    path = sink.write_json_lines(rows, scratch_path(spark, "documents"))
    return spark.read.schema(rows.schema).json(path)


@query("scan_predictions", """
    SELECT id, model, round(y_prob, 6) AS y_prob, CASE WHEN split = 'test' THEN y_true END AS y_true,
           CASE WHEN split = 'test' AND id % 3 = 0 THEN 'timeout, again' END AS llm_error,
           CAST(CASE WHEN split = 'test' THEN 1 ELSE 0 END AS INTEGER) AS file_order
    FROM pred WHERE split <> 'train'""")
def scan_predictions(spark, folder):
    """Two files: one lacks a column, and has no error where the other has some."""
    val, test = t.pred_val(spark, folder), t.pred_test(spark, folder)
    paths = [scratch_path(spark, "scored") + ".csv" for _ in range(2)]
    none, some = F.lit(None).cast("string"), F.when(F.col("id") % 3 == 0, "timeout, again")
    sink.write_metrics(val.select("id", "model", "y_prob", none.alias("llm_error")), paths[0])
    sink.write_metrics(test.select("id", "model", "y_prob", "y_true", some.alias("llm_error")), paths[1])
    rows = scan.load_predictions(spark, paths)
    return rows.withColumn("y_true", F.col("y_true").cast("int"))


@query("period_layout", """SELECT year, count(*) AS n_rows, round(avg(target), 6) AS default_rate,
    min(id) AS first_id FROM loans_keyed WHERE year >= 1999 GROUP BY year""")
def period_layout(spark, folder):
    """Test years of a table written by year and sorted by id."""
    path = scratch_path(spark, "by-year") + ".parquet"
    sink.write_by_period(t.loans_keyed(spark, folder), path, "year", ["id"])
    parts = split.temporal_split(scan.load_table(spark, path), 1997, [1998], roles=t.LOANS)
    return parts.test.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("target").alias("default_rate"),
        F.min("id").alias("first_id"))


@query("rows_in_order", """SELECT id, year, CAST(row_number() OVER (ORDER BY year, id) AS INTEGER) AS position
    FROM loans_keyed""")
def rows_in_order(spark, folder):
    """Positions in the order of two columns, over the whole table."""
    return tables.in_order(t.loans_keyed(spark, folder).select("id", "year"), ["year", "id"])


# --- projections and filters


@query("parse_time", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 1 "
       "THEN strftime(o_orderdate, '%Y-%m-01') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS issue_d "
       "FROM orders WHERE o_orderkey % 4 <> 3")
def parse_time(spark, folder):
    return clean.parse_time(raw_loans(spark, folder), "issue_d").select("id", day("issue_d"))


@query("derive_time_parts", "SELECT id, year, CAST(month(issue_d) AS INTEGER) AS month FROM loans_keyed")
def derive_time_parts(spark, folder):
    df = t.loans_keyed(spark, folder).drop("year")
    return clean.derive_time_parts(df, "issue_d").select("id", "year", "month")


@query("normalize_target", """SELECT o_orderkey AS id,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS "Default" FROM orders WHERE o_orderstatus <> 'P'""")
def normalize_target(spark, folder):
    return clean.normalize_target(raw_loans(spark, folder), "Default").select("id", "Default")


@query("assert_binary_target", "SELECT target, count(*) AS n_rows FROM loans_keyed GROUP BY target")
def assert_binary_target(spark, folder):
    df = clean.assert_binary_target(t.loans_keyed(spark, folder), "target")
    return df.groupBy("target").agg(F.count(F.lit(1)).alias("n_rows"))


@query("clean_text_cols", r"""SELECT doc_id, coalesce(regexp_replace(regexp_replace(
    concat(chr(10), ' ', text, chr(9), ' '), '^\s+', ''), '\s+$', ''), '') AS text FROM documents""")
def clean_text_cols(spark, folder):
    padded = F.concat(F.lit("\n "), F.col("text"), F.lit("\t "))
    rows = t.table(spark, folder, "documents").select("doc_id", padded.alias("text"))
    return clean.clean_text_columns(rows, ["text", "absent"])


@query("select_features", """SELECT round(o_totalprice, 6) AS o_totalprice,
    round(c_acctbal, 6) AS c_acctbal, o_orderpriority, c_mktsegment, n_name FROM loans_keyed""")
def select_features(spark, folder):
    df = t.loans_keyed(spark, folder)
    return df.select(*features.select_features(df, t.LOANS, extra_drop=["c_name"]))


@query("type_split", """
    SELECT 'numeric' AS kind, 'o_totalprice' AS feature, count(o_totalprice) AS n FROM loans_keyed
    UNION ALL SELECT 'numeric', 'c_acctbal', count(c_acctbal) FROM loans_keyed
    UNION ALL SELECT 'categorical', 'o_orderpriority', count(o_orderpriority) FROM loans_keyed
    UNION ALL SELECT 'categorical', 'c_mktsegment', count(c_mktsegment) FROM loans_keyed
    UNION ALL SELECT 'categorical', 'n_name', count(n_name) FROM loans_keyed
    UNION ALL SELECT 'text', 'c_name', count(c_name) FROM loans_keyed""")
def type_split(spark, folder):
    df = t.loans_keyed(spark, folder)
    roles = Roles("target", "issue_d", "id", ("c_name", "absent"))
    chosen = features.select_features(df, roles)
    kinds = {
        **{c: "numeric" for c in features.numeric_columns(df, chosen)},
        **{c: "categorical" for c in features.categorical_columns(df, chosen)},
        **{c: "text" for c in features.text_columns(df, roles)},
    }
    return _kind_counts(df, kinds)


def _kind_counts(df, kinds):
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    counts = features.melt(df, list(kinds)).groupBy("feature").agg(F.count("value").alias("n"))
    return counts.select(kind[F.col("feature")].alias("kind"), "feature", "n")


_DISTINCT = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {limit} AS most, count(DISTINCT {c}) AS n_distinct FROM loans_keyed"
    for c, limit in [("o_totalprice", 10**12), ("c_acctbal", 10**12), ("o_orderpriority", 50),
                     ("c_mktsegment", 50), ("n_name", 50), ("c_name", 50)]
)


@query("drop_high_cardinality",
       f"SELECT feature, n_distinct FROM ({_DISTINCT}) x WHERE n_distinct <= most")
def drop_high_cardinality(spark, folder):
    df = t.loans_keyed(spark, folder)
    kept = features.drop_high_cardinality(df, features.select_features(df, t.LOANS))
    return features.melt(df, kept).groupBy("feature").agg(
        F.countDistinct("value").alias("n_distinct")
    )


@query("feature_groups", """
    SELECT 'numeric' AS kind, 'o_totalprice' AS feature, count(o_totalprice) AS n FROM loans_keyed
    UNION ALL SELECT 'numeric', 'c_acctbal', count(c_acctbal) FROM loans_keyed
    UNION ALL SELECT 'categorical', 'o_orderpriority', count(o_orderpriority) FROM loans_keyed
    UNION ALL SELECT 'categorical', 'c_mktsegment', count(c_mktsegment) FROM loans_keyed
    UNION ALL SELECT 'categorical', 'n_name', count(n_name) FROM loans_keyed""")
def feature_groups(spark, folder):
    df = t.loans_keyed(spark, folder)
    groups = features.feature_groups(df, t.LOANS)
    kinds = {**dict.fromkeys(groups.numeric, "numeric"),
             **dict.fromkeys(groups.categorical, "categorical")}
    return _kind_counts(df, kinds)


@query("summarize_feature_groups", f"""
    SELECT 'all_features' AS "group", CAST(count(*) AS INTEGER) AS count FROM ({_DISTINCT}) x
    WHERE n_distinct <= most
    UNION ALL SELECT 'numeric', CAST(count(*) AS INTEGER) FROM ({_DISTINCT}) x WHERE most > 50
    UNION ALL SELECT 'categorical', CAST(count(*) AS INTEGER) FROM ({_DISTINCT}) x
    WHERE most = 50 AND n_distinct <= 50
    UNION ALL SELECT 'text', 0""")
def summarize_feature_groups(spark, folder):
    df = t.loans_keyed(spark, folder)
    return features.summarize_feature_groups(df, features.feature_groups(df, t.LOANS))


@query("split_xy", """SELECT 'x' AS part, round(o_totalprice, 6) AS o_totalprice, n_name, NULL AS target
    FROM loans_keyed UNION ALL SELECT 'y', NULL, NULL, target FROM loans_keyed""")
def split_xy(spark, folder):
    """Both halves."""
    x, y = split.split_xy(t.loans_keyed(spark, folder), ["o_totalprice", "n_name"], t.LOANS)
    return x.withColumn("part", F.lit("x")).unionByName(
        y.withColumn("part", F.lit("y")), allowMissingColumns=True)


@query("temporal_split", """SELECT id, CASE WHEN year <= 1997 THEN 'train' WHEN year = 1998 THEN 'val'
    ELSE 'test' END AS split FROM loans_keyed""")
def temporal_split(spark, folder):
    df = t.loans_keyed(spark, folder)
    parts = split.temporal_split(df, 1997, [1998], roles=t.LOANS, year_of_time=True)
    return parts.tagged().select("id", "split")


@query("temporal_split_tvt", """
    SELECT id, 'train' AS split FROM loans_keyed WHERE year <= 1997
    UNION ALL SELECT id, 'val' FROM loans_keyed WHERE year = 1999
    UNION ALL SELECT id, 'test' FROM loans_keyed WHERE year IN (1999, 2001)""")
def temporal_split_tvt(spark, folder):
    parts = split.temporal_split_tvt(
        t.loans_keyed(spark, folder), 1997, 1999, (1999, 2001), t.LOANS
    )
    rows = [parts.view(p).select("id", F.lit(p).alias("split")) for p in split.SPLITS]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("validate_split_input", "SELECT year, count(*) AS n_rows FROM loans_keyed GROUP BY year")
def validate_split_input(spark, folder):
    df = t.loans_keyed(spark, folder).withColumn("year", F.col("year").cast("string"))
    checked, _ = split.validate_split_input(df, t.LOANS)
    return checked.groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"))


@query("period_subsets", """SELECT id, year, target FROM loans_keyed
    WHERE year IN (1999, 2000, 2001)""")
def period_subsets(spark, folder):
    views = split.period_subsets(t.keyed_split(spark, folder).test)
    rows = None
    for view in views.values():
        part = view.select("id", "year", "target")
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query("apply_threshold", """SELECT id, model, CASE WHEN y_prob >= 0.45e0 THEN 1 ELSE 0 END AS y_pred
    FROM pred""")
def apply_threshold(spark, folder):
    return metrics.apply_threshold(t.pred(spark, folder), 0.45).select("id", "model", "y_pred")


@query("completed_filter", """SELECT llm_row_id, attempt_id,
    round(llm_default_probability, 6) AS llm_default_probability FROM replies
    WHERE llm_error IS NULL AND llm_default_probability IS NOT NULL""")
def completed_filter(spark, folder):
    return resume.completed_rows(t.replies(spark, folder)).select(
        "llm_row_id", "attempt_id", "llm_default_probability"
    )


@query("add_time_gap", "SELECT id, year, year - 1998 AS time_gap FROM loans_keyed")
def add_time_gap(spark, folder):
    return metrics.add_time_gap(t.loans_keyed(spark, folder), 1998).select("id", "year", "time_gap")


# --- joins

@query("join_sample_to_source", """SELECT id, llm_row_id, round(max(llm_default_probability), 6) AS
    llm_default_probability, any_value(year) AS year, any_value(target) AS target,
    any_value(n_name) AS n_name FROM (
        SELECT CAST(r.llm_row_id AS VARCHAR) AS id, r.llm_row_id, r.llm_default_probability,
               l.year, l.target, l.n_name
        FROM replies r JOIN loans_keyed l ON l.id = r.llm_row_id WHERE r.llm_error IS NULL) x
    GROUP BY id, llm_row_id""")
def join_sample_to_source(spark, folder):
    best = resume.completed_rows(t.replies(spark, folder)).groupBy("llm_row_id").agg(
        F.max("llm_default_probability").alias("llm_default_probability")
    )
    sample = best.withColumn("id", F.col("llm_row_id"))
    source = t.loans_keyed(spark, folder)
    return joins.join_sample_to_source(sample, source, "id").select(
        "id", "llm_row_id", "llm_default_probability", "year", "target", "n_name"
    )


@query("semi_in_list", """SELECT id, year, n_name FROM loans_keyed WHERE year IN (1999, 2001)
    AND n_name IN (SELECT n_name FROM nation WHERE n_regionkey = 1)""")
def semi_in_list(spark, folder):
    rows = joins.keep_listed(t.loans_keyed(spark, folder), "year", [1999, 2001])
    listed = t.table(spark, folder, "nation").where(F.col("n_regionkey") == 1)
    return joins.keep_in_table(rows, listed, "n_name").select("id", "year", "n_name")


@query("anti_exclude_ids", """SELECT id, year FROM loans_keyed
    WHERE id NOT IN (SELECT llm_row_id FROM attempts)""")
def anti_exclude_ids(spark, folder):
    used = t.attempts(spark, folder).select(F.col("llm_row_id").alias("id"))
    return joins.exclude_ids(t.loans_keyed(spark, folder), used, "id").select("id", "year")


@query("anti_pending_rows", """SELECT event_id AS llm_row_id FROM events WHERE event_id NOT IN (
    SELECT llm_row_id FROM replies
    WHERE llm_error IS NULL AND llm_default_probability IS NOT NULL)""")
def anti_pending_rows(spark, folder):
    return resume.pending_rows(t.scoring_inputs(spark, folder), t.replies(spark, folder))


@query("assert_cardinality", """SELECT l_orderkey AS id, l_linenumber, year FROM lineitem
    JOIN loans_keyed ON l_orderkey = id""")
def assert_cardinality(spark, folder):
    lines = t.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("id"), "l_linenumber"
    )
    loans = t.loans_keyed(spark, folder).select("id", "year")
    return joins.checked_join(lines, loans, ["id"], "inner", "many_to_one")


# --- aggregations


@query("summarize_dataset", """SELECT count(*) AS n_rows, CAST(10 AS INTEGER) AS n_cols,
    round(avg(target), 6) AS target_mean, min(year) AS min_year, max(year) AS max_year
    FROM loans_keyed""")
def summarize_dataset(spark, folder):
    return clean.summarize_dataset(t.loans_keyed(spark, folder), t.LOANS)


@query("describe_split", """
    SELECT 'train_df' AS split, count(*) AS n_rows, min(year) AS min_year, max(year) AS max_year,
           round(avg(target), 6) AS default_rate FROM loans_keyed WHERE year <= 1997
    UNION ALL SELECT 'val_df', count(*), min(year), max(year), round(avg(target), 6)
    FROM loans_keyed WHERE 1 = 0
    UNION ALL SELECT 'test_df', count(*), min(year), max(year), round(avg(target), 6)
    FROM loans_keyed WHERE year > 1997""")
def describe_split(spark, folder):
    parts = split.temporal_split(t.loans_keyed(spark, folder), 1997, roles=t.LOANS)
    return split.describe_split(parts, t.LOANS)


@query("describe_periods", """SELECT year, count(*) AS n_rows, round(avg(target), 6) AS default_rate
    FROM loans_keyed WHERE year IN (1999, 2000, 2001) GROUP BY year""")
def describe_periods(spark, folder):
    return split.describe_periods(t.keyed_split(spark, folder).test, t.LOANS)


@query("sample_balance", """SELECT split, year, count(y_true) AS count,
    round(avg(y_true), 6) AS sample_default_rate FROM pred GROUP BY split, year""")
def sample_balance(spark, folder):
    return split.sample_balance(t.pred(spark, folder), "y_true")


ALL_VALUES = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CASE WHEN year > 1998 THEN year END AS period, CAST({c} AS VARCHAR) AS value "
    "FROM loans_wide WHERE year <> 1998" for c in t.FEATURES)


@query("missing_rate", """
    SELECT feature, period, round(avg(CASE WHEN value IS NULL THEN 1.0e0 ELSE 0.0e0 END), 6) AS
           missing_rate
    FROM (""" + ALL_VALUES + """) x GROUP BY feature, period""")
def missing_rate(spark, folder):
    return _profile(spark, folder).select("feature", "period", "missing_rate")


@query("nunique", """
    SELECT feature, period, count(DISTINCT value) AS n_distinct
    FROM (""" + ALL_VALUES + """) x GROUP BY feature, period""")
def nunique(spark, folder):
    return _profile(spark, folder).select("feature", "period", "n_distinct")


def _profile(spark, folder):
    parts = t.wide_split(spark, folder)
    counts = histogram.Periods(spark)
    counts.add(parts.train, parts.test, t.FEATURES, t.TEST_YEARS)
    return histogram.profile(counts.table()).withColumn("period", F.col("period").try_cast("int"))


@query("top_categories", """
    SELECT feature, value, n, CAST(rank AS INTEGER) AS rank FROM (
        SELECT feature, value, count(*) AS n,
               row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) AS rank
        FROM (SELECT 'n_name' AS feature, coalesce(n_name, '__MISSING__') AS value FROM loans_keyed
              UNION ALL SELECT 'c_name', coalesce(c_name, '__MISSING__') FROM loans_keyed) x
        GROUP BY feature, value) y WHERE rank <= 25""")
def top_categories(spark, folder):
    return drift.top_categories(t.loans_keyed(spark, folder), ["n_name", "c_name"])


@query("distinct_labels", """SELECT model, year, min(y_true) <> max(y_true) AS both_classes
    FROM pred GROUP BY model, year""")
def distinct_labels(spark, folder):
    found = tables.classes(t.pred(spark, folder), "y_true", "model", "year")
    return found.select("model", "year", (~F.col("one_class")).alias("both_classes"))


@query("dedup_keep_last", """SELECT llm_row_id, max(attempt_id) AS attempt_id,
    arg_max(coalesce(raw, llm_error), attempt_id) AS outcome FROM attempts GROUP BY llm_row_id""")
def dedup_keep_last(spark, folder):
    rows = t.attempts(spark, folder)
    return dedup.keep_last(rows, ["llm_row_id"], ["attempt_id"]).select(
        "llm_row_id", "attempt_id", F.coalesce("raw", "llm_error").alias("outcome")
    )


@query("dedup_keep_first", """SELECT user_id, min(event_id) AS event_id,
    arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id""")
def dedup_keep_first(spark, folder):
    rows = t.table(spark, folder, "events").select("user_id", "event_id", "event_type", "value")
    return dedup.keep_first(rows, ["user_id"], ["event_id"]).select(
        "user_id", "event_id", "event_type"
    )


@query("combine_predictions", """SELECT id, arg_min(model, model) AS model,
    round(arg_min(y_prob, model), 6) AS y_prob FROM pred GROUP BY id""")
def combine_predictions(spark, folder):
    rows = t.pred(spark, folder).select("id", "model", "y_prob")
    return resume.combine_predictions(rows, "id", ["model"])


@query("count_dup_keys", """SELECT CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT user_id) AS n_keys,
    CAST(count(*) - count(DISTINCT user_id) AS BIGINT) AS n_duplicates FROM events""")
def count_dup_keys(spark, folder):
    return dedup.count_duplicates(t.table(spark, folder, "events"), ["user_id"])


@query("best_first", """SELECT model, threshold FROM (
    SELECT model, round(thr, 6) AS threshold,
           row_number() OVER (PARTITION BY model ORDER BY f1 DESC, thr) AS place
    FROM sweep_99) x WHERE place = 1""")
def best_first(spark, folder):
    val = t.pred_val(spark, folder)
    return best_thresholds(threshold_sweep(val, fixed_grid(val))).select("model", "threshold")


@query("sorted_output", """SELECT year, n_rows, default_rate,
        CAST(row_number() OVER (ORDER BY year) AS INTEGER) AS position FROM (
    SELECT year, count(*) AS n_rows, round(avg(target), 6) AS default_rate
    FROM loans_keyed GROUP BY year) x ORDER BY year""")
def sorted_output(spark, folder):
    return tables.in_order(split.describe_periods(t.loans_keyed(spark, folder), t.LOANS), ["year"])


@query("union_all", """SELECT id, model, split FROM pred_val UNION ALL SELECT id, model, split
    FROM pred_test""")
def union_all(spark, folder):
    columns = ["id", "model", "split"]
    return tables.stack([
        t.pred_val(spark, folder).select(*columns), t.pred_test(spark, folder).select(*columns)])
