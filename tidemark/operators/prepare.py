"""Preparing features for a model: fill gaps, scale, one-hot encode, assemble."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.features import melt
from tidemark.operators.quantiles import medians


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per feature and value, without missing values."""
    return (
        melt(df, columns)
        .where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def level_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, int]]:
    """Rows per value of each feature, read to the driver: one number for each slot of the encoding.

    ``drop_high_cardinality`` bounds the values of the features that are encoded.
    """
    found = {c: {} for c in columns}
    for row in value_counts(df, columns).collect():
        found[row["feature"]][row["value"]] = row["n"]
    empty = [c for c, values in found.items() if not values]
    if empty:
        raise ValueError(f"columns without any value: {empty}")
    return found


def modes(counts: dict[str, dict[str, int]]) -> dict[str, str]:
    """Most frequent value per feature; the smallest of equally frequent ones."""
    return {c: min(values, key=lambda v: (-values[v], v)) for c, values in counts.items()}


def categories(counts: dict[str, dict[str, int]]) -> dict[str, list[str]]:
    """Sorted values per feature."""
    return {c: sorted(values) for c, values in counts.items()}


def impute_median(df: DataFrame, fill: dict[str, float]) -> DataFrame:
    """Numeric columns as doubles, gaps filled with the given medians."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fill.items()})


def impute_mode(df: DataFrame, fill: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(v)) for c, v in fill.items()})


def scale_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; deviation 1 for a constant column."""
    if not columns:
        return {}
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
        *[F.max(c).eqNullSafe(F.min(c)).alias(f"k{i}") for i, c in enumerate(columns)],
    ).first()
    # a constant column is only centred, whatever rounding leaves of its deviation
    return {
        c: (row[f"m{i}"], 1.0 if row[f"k{i}"] or not row[f"s{i}"] else row[f"s{i}"])
        for i, c in enumerate(columns)
    }


def standardize(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


def one_hot(df: DataFrame, levels: dict[str, list[str]], keep: Sequence[str]) -> DataFrame:
    """A 0/1 column per category, ``column_value``; a value not seen before is 0 everywhere."""
    slots = [
        F.coalesce((F.col(c).cast("string") == v).cast("int"), F.lit(0)).alias(f"{c}_{v}")
        for c, values in levels.items()
        for v in values
    ]
    return df.select(*keep, *slots)


@dataclass(frozen=True)
class Preparation:
    """What was learnt from the training rows."""

    medians: dict[str, float]
    stats: dict[str, tuple[float, float]]
    modes: dict[str, str]
    levels: dict[str, list[str]]


def fit_preparation(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], scale: bool = True
) -> Preparation:
    fill = {}
    if numeric:
        fill = medians(train, numeric)
        unknown = [c for c in numeric if c not in fill]
        if unknown:
            raise ValueError(f"columns without any value: {unknown}")
    stats = {}
    if scale and numeric:
        stats = scale_stats(impute_median(train.select(*numeric), fill), numeric)
    counts = level_counts(train, categorical) if categorical else {}
    return Preparation(fill, stats, modes(counts), categories(counts))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def preparation_stages(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], scale: bool = True
) -> PipelineModel:
    """A saveable ML model that adds ``features``; slots are named ``num__col`` and ``cat__col_value``."""
    learnt = fit_preparation(train, numeric, categorical, scale)
    added = []
    for c in numeric:
        value = f"coalesce(cast(`{c}` as double), {learnt.medians[c]!r}D)"
        if c in learnt.stats:
            mean, deviation = learnt.stats[c]
            value = f"({value} - ({mean!r}D)) / ({deviation!r}D)"
        added.append(f"{value} AS `num__{c}`")
    for c in categorical:
        added.append(
            f"coalesce(cast(`{c}` as string), {_quoted(learnt.modes[c])}) AS `text__{c}`"
        )
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(added)} FROM __THIS__")]
    inputs = [f"num__{c}" for c in numeric]
    if categorical:
        stages += [
            StringIndexerModel.from_labels(
                learnt.levels[c], inputCol=f"text__{c}", outputCol=f"index__{c}",
                handleInvalid="keep",
            )
            for c in categorical
        ]
        # the last index stands for unseen values; dropping it leaves them all zero
        encoder = OneHotEncoder(
            inputCols=[f"index__{c}" for c in categorical],
            outputCols=[f"cat__{c}" for c in categorical],
            dropLast=True,
        )
        stages.append(encoder.fit(PipelineModel(stages).transform(train)))
        inputs += [f"cat__{c}" for c in categorical]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return PipelineModel(stages=stages)


def prepared_columns(numeric: Sequence[str], categorical: Sequence[str]) -> list[str]:
    """Helper columns that the stages add besides ``features``."""
    return [f"num__{c}" for c in numeric] + [
        f"{kind}__{c}" for c in categorical for kind in ("text", "index", "cat")
    ]


def slot_names(prepared: DataFrame, column: str = "features") -> list[str]:
    """Names behind the vector positions, from the column's metadata."""
    groups = prepared.schema[column].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a["name"]) for attrs in groups.values() for a in attrs)
    return [name for _, name in slots]
