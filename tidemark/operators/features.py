"""Choosing and typing feature columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.roles import FeatureGroups, Roles
from tidemark.session import local_table


def feature_columns(
    df: DataFrame,
    roles: Roles = Roles(),
    drop: Iterable[str] = (),
    include_text: bool = False,
    include_id: bool = False,
) -> list[str]:
    """All columns but the label, dates, id, text and ``drop``, in table order."""
    hidden = {roles.target, roles.time, "year", "month", *drop}
    if not include_id:
        hidden.add(roles.id)
    if not include_text:
        hidden.update(roles.text)
    return [c for c in df.columns if c not in hidden]


def select_features(
    df: DataFrame,
    roles: Roles = Roles(),
    extra_drop: Sequence[str] = (),
    drop_zip_code: bool = True,
    include_text: bool = False,
    include_id: bool = False,
) -> list[str]:
    drop = [*extra_drop, "zip_code"] if drop_zip_code else extra_drop
    return feature_columns(df, roles, drop, include_text, include_id)


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.NumericType, T.BooleanType))


def numeric_columns(df: DataFrame, columns: Iterable[str]) -> list[str]:
    return [c for c in columns if is_numeric(df, c)]


def categorical_columns(df: DataFrame, columns: Iterable[str]) -> list[str]:
    return [c for c in columns if not is_numeric(df, c)]


def text_columns(df: DataFrame, roles: Roles = Roles()) -> list[str]:
    return [c for c in roles.text if c in df.columns]


def melt(df: DataFrame, columns: Sequence[str], keys: Sequence = (), cast: str = "string"):
    """Rows ``(keys, feature, value)``, one per input row and column, from a single scan."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast(cast).alias("value")) for c in columns]
    return df.select(*keys, F.inline(F.array(*cells)))


def drop_high_cardinality(df: DataFrame, columns: Sequence[str], limit: int = 50) -> list[str]:
    """Keep numeric columns, and others with at most ``limit`` distinct values.

    Values are first counted as hashes in a fixed number of buckets. More than ``limit`` buckets in use
    are proof of more than ``limit`` values; only the other columns, whose values are few but for
    collisions, are counted exactly. Neither step shuffles a column's whole value list.
    """
    others = categorical_columns(df, columns)
    if not others:
        return list(columns)
    bucket = F.pmod(F.xxhash64("value"), F.lit(max(4096, 64 * limit)))
    near = _at_most(melt(df, others).where(F.col("value").isNotNull()).select("feature", bucket.alias("value")), others, limit)
    kept = set(_at_most(melt(df, near).where(F.col("value").isNotNull()), near, limit)) if near else set()
    return [c for c in columns if c in kept or c not in others]


def _at_most(values: DataFrame, names: Sequence[str], limit: int) -> list[str]:
    counts = values.distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    found = {r["feature"]: r["n"] for r in counts.collect()}
    return [c for c in names if found.get(c, 0) <= limit]


def feature_groups(
    df: DataFrame,
    roles: Roles = Roles(),
    max_cardinality: int = 50,
    include_text: bool = False,
    **selection,
) -> FeatureGroups:
    """Features of the whole table, split into numeric, categorical and text columns."""
    chosen = select_features(df, roles, include_text=include_text, **selection)
    kept = drop_high_cardinality(df, chosen, max_cardinality)
    return FeatureGroups(
        features=tuple(kept),
        numeric=tuple(numeric_columns(df, kept)),
        categorical=tuple(categorical_columns(df, kept)),
        text=tuple(text_columns(df, roles)) if include_text else (),
    )


def summarize_feature_groups(df: DataFrame, groups: FeatureGroups) -> DataFrame:
    rows = [
        ("all_features", len(groups.features)),
        ("numeric", len(groups.numeric)),
        ("categorical", len(groups.categorical)),
        ("text", len(groups.text)),
    ]
    return local_table(df.sparkSession, rows, "`group` string, count int")
