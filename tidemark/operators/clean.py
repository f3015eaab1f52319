"""Cleaning a raw table: dates, label, text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions import text
from tidemark.functions.checks import refuse
from tidemark.roles import Roles
from tidemark.sources.scan import load_table

# Date spellings tried in turn, and the status texts that stand for a label.
TIME_FORMATS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy",
    "MMM-yyyy", "MMM d, yyyy", "d MMM yyyy", "yyyy-MM", "yyyyMMdd", "MMMM yyyy", "MMM yyyy",
    "MMMM d, yyyy", "d MMMM yyyy", "yyyy-MM-dd HH:mm", "MM/dd/yyyy HH:mm:ss",
)
# Dates and times in the usual order, with fractions of seconds or zones.
ISO = r"^\d{4}-\d{1,2}-\d{1,2}([T ].+)?$"
STATUS_LABELS = {"Fully Paid": 0, "Default": 1, "Charged Off": 1}


# What the letters of a date format stand for.
LETTERS = {
    "yyyy": r"\d{4}", "MMMM": "[A-Za-z]{3,9}", "MMM": "[A-Za-z]{3}", "MM": r"\d{2}", "M": r"\d{1,2}", "dd": r"\d{2}",
    "d": r"\d{1,2}", "HH": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}", "'T'": "T",
}


def date_shape(fmt: str) -> str | None:
    """A pattern that every text of a date format has; None for letters not known here."""
    shape = []
    for match in re.finditer(r"'[^']*'|([A-Za-z])\1*|[^A-Za-z']", fmt):
        token = match.group()
        if token in LETTERS:
            shape.append(LETTERS[token])
        elif token[0].isalpha():
            return None
        else:
            shape.append(re.escape(token.strip("'")))
    return f"^{''.join(shape)}$"


def parse_text(value: Column, formats: Sequence[str]) -> Column:
    """The first format that fits. Formats of another shape are skipped, as a failed parse is slow.

    Texts in ISO order that no format fits are read by Spark's own rules; a zone is applied.
    """
    tries = []
    for fmt in formats:
        shape, parsed = date_shape(fmt), F.try_to_timestamp(value, F.lit(fmt))
        tries.append(parsed if shape is None else F.when(value.rlike(shape), parsed))
    return F.coalesce(*tries, F.when(value.rlike(ISO), F.try_to_timestamp(value)))


def parse_time(df: DataFrame, column: str, formats: Sequence[str] = TIME_FORMATS) -> DataFrame:
    """Text to timestamp; rows whose date is missing or unreadable are dropped."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.StringType):
        df = df.withColumn(column, parse_text(text.strip(F.col(column)), formats))
    elif isinstance(dtype, T.DateType):
        df = df.withColumn(column, F.col(column).cast("timestamp_ntz"))
    elif not isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"column '{column}' holds {dtype.simpleString()}, not dates")
    return df.where(F.col(column).isNotNull())


def derive_time_parts(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns({"year": F.year(column), "month": F.month(column)})


def normalize_target(df: DataFrame, column: str) -> DataFrame:
    """Label as integer. Known status texts map to 0 or 1; rows with other texts are dropped.

    Numbers are truncated. Any text that is not a known status, "0" and "1" included, is unusable.
    """
    value = F.col(column)
    if isinstance(df.schema[column].dataType, (T.NumericType, T.BooleanType)):
        label = F.nanvl(value.cast("double"), F.lit(None)).cast("int")
    else:
        label = F.lit(None).cast("int")
        for status, code in STATUS_LABELS.items():
            label = F.when(value == status, F.lit(code)).otherwise(label)
    return df.withColumn(column, label).where(F.col(column).isNotNull())


def assert_binary_target(df: DataFrame, column: str) -> DataFrame:
    """The same rows; reading one whose label is neither 0 nor 1 fails."""
    found = F.concat(F.lit("the target must be 0 or 1, found "), F.col(column).cast("string"))
    return refuse(df, ~F.col(column).isin(0, 1), found)


def clean_text_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: text.clean(F.col(c)) for c in present}) if present else df


def clean_table(
    df: DataFrame, roles: Roles = Roles(), formats: Sequence[str] = TIME_FORMATS
) -> DataFrame:
    """Dates, year and month, label, text; rows without a usable date or label are dropped."""
    df = parse_time(df, roles.time, formats)
    df = derive_time_parts(df, roles.time)
    df = normalize_target(df, roles.target)
    df = assert_binary_target(df, roles.target)
    return clean_text_columns(df, roles.text)


def load_clean(spark: SparkSession, path: str, roles: Roles = Roles(), **scan) -> DataFrame:
    return clean_table(load_table(spark, path, required=(roles.time, roles.target), **scan), roles)


def summarize_dataset(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """One row: rows, columns, mean label, first and last year."""
    year = F.col("year") if "year" in df.columns else F.lit(None).cast("int")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_cols"),
        F.avg(roles.target).alias("target_mean"),
        F.min(year).alias("min_year"),
        F.max(year).alias("max_year"),
    )
