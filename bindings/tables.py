"""Views on the test tables in the shape that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.prompts import parse_reply
from tidemark.operators.split import temporal_split_tvt
from tidemark.roles import Roles
from tidemark.sources.scan import load_table

LOANS = Roles(target="target", time="issue_d", id="id", text=())
TRAIN_END, VAL_YEAR, TEST_YEARS = 1997, 1998, (1999, 2000, 2001)
NUMERIC = ["qty_shifted", "l_extendedprice", "discount_n", "is_later_line"]
CATEGORICAL = ["p_type", "brand_n"]
FEATURES = NUMERIC + CATEGORICAL


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return load_table(spark, f"{folder}/{name}.parquet")


def loans_keyed(spark, folder):
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    nation = table(spark, folder, "nation")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderdate").alias("issue_d"),
            F.year("o_orderdate").alias("year"),
            (F.col("o_orderstatus") == "F").cast("int").alias("target"),
            "o_totalprice", "c_acctbal", "o_orderpriority", "c_mktsegment", "n_name", "c_name",
        )
    )


def loans_wide(spark, folder):
    lineitem, part = table(spark, folder, "lineitem"), table(spark, folder, "part")
    year = F.year("l_shipdate")
    hidden = (year >= 2000) & (F.col("l_linenumber") == 2)
    return lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_shipdate").alias("issue_d"),
        year.alias("year"),
        (F.col("l_returnflag") == "R").cast("int").alias("target"),
        (F.col("l_quantity") + (year - 1995)).alias("qty_shifted"),
        "l_extendedprice",
        F.nullif("l_discount", F.lit(0.05)).alias("discount_n"),
        (F.col("l_linenumber") > 1).cast("int").alias("is_later_line"),
        "p_type",
        F.when(~hidden, F.col("p_brand")).alias("brand_n"),
    )


def wide_split(spark, folder):
    df = loans_wide(spark, folder)
    return temporal_split_tvt(df, TRAIN_END, VAL_YEAR, TEST_YEARS, LOANS, year_of_time=True)


def keyed_split(spark, folder):
    df = loans_keyed(spark, folder)
    return temporal_split_tvt(df, TRAIN_END, VAL_YEAR, TEST_YEARS, LOANS, year_of_time=True)


def pred(spark, folder):
    """Scores of three made-up models, in whole thousandths, from one scan."""
    loans = loans_keyed(spark, folder)
    key, hit = F.col("id"), F.col("target")
    milli = {
        "a": (key * 7919) % 800 + 150 * hit,
        "b": (key * 104729) % 900 + 60 * hit,
        "c": (key * 1299709) % 1001,
    }
    scored = [
        F.struct(F.lit(m).alias("model"), (v.cast("double") / 1000.0).alias("y_prob"))
        for m, v in milli.items()
    ]
    split = F.when(F.col("year") <= TRAIN_END, "train").when(
        F.col("year") == VAL_YEAR, "validation"
    ).otherwise("test")
    return loans.select(
        "id", "year", hit.alias("y_true"), split.alias("split"), F.inline(F.array(*scored))
    ).select("id", "year", "model", "y_true", "y_prob", "split")


def pred_val(spark, folder):
    return pred(spark, folder).where(F.col("split") == "validation")


def pred_test(spark, folder):
    return pred(spark, folder).where(F.col("split") == "test")


def attempts(spark, folder):
    failed = F.col("event_type") == "error"
    key = F.col("event_id")
    return table(spark, folder, "events").select(
        (key - key % 2).alias("llm_row_id"),
        key.alias("attempt_id"),
        F.col("ts").alias("attempt_ts"),
        F.when(failed, "failed").alias("llm_error"),
        F.when(~failed, F.col("props")).alias("raw"),
    )


def replies(spark, folder):
    parsed = parse_reply(attempts(spark, folder), "raw", "llm_error", "$.k", None, 50.0)
    return parsed.select(
        "llm_row_id", "attempt_id", "attempt_ts", "llm_error", "llm_default_probability"
    )


def scoring_inputs(spark, folder):
    return table(spark, folder, "events").select(F.col("event_id").alias("llm_row_id"))


def prompt_rows(spark, folder):
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("desc"),
        "lang", "n_chars",
    )


def importances(spark, folder):
    part = table(spark, folder, "part")

    def slots(model, prefix, column, weight):
        return part.groupBy(column.alias("level")).agg(weight.cast("double").alias("w")).select(
            F.lit(model).alias("model"),
            F.concat(F.lit(prefix), F.col("level").cast("string")).alias("transformed_feature"),
            (F.col("w") / 1000.0).alias("weight"),
        )

    rows = F.count(F.lit(1))
    return (
        slots("a", "cat__p_type_", F.col("p_type"), rows - 300)
        .unionByName(slots("a", "cat__p_brand_", F.col("p_brand"), rows - 80))
        .unionByName(slots("b", "num__p_size_", F.col("p_size") % 7, rows))
        .unionByName(slots("b", "cat__p_type_", F.col("p_type"), F.sum("p_size")))
    )
