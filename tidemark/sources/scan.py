"""Reading tables: parquet and delimited text, with one notion of a missing value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.roles import Roles

# The texts that a delimited file uses for "missing".
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Use NULL as the only missing value; a NaN would poison averages and count as present."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floats}) if floats else df


def tokens_to_null(df: DataFrame) -> DataFrame:
    """Replace the usual spellings of a missing value in text columns by NULL."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(c).isin(*MISSING_TOKENS), F.col(c)) for c in texts})


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Type text columns by one pass over the data: long, double, boolean, or still text."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    texts = [c for c in texts if columns is None or c in columns]
    if not texts:
        return df
    checks = []
    for i, c in enumerate(texts):
        col = F.col(c)
        checks += [
            F.count(col).alias(f"n{i}"),
            F.count_if(col.isNull()).alias(f"null{i}"),
            F.count(F.when(col.rlike(r"^[+-]?\d+$"), col.try_cast("bigint"))).alias(f"long{i}"),
            F.count(col.try_cast("double")).alias(f"double{i}"),
            F.count_if(col.isin("True", "False", "true", "false", "TRUE", "FALSE")).alias(f"bool{i}"),
        ]
    seen = df.agg(*checks).first()
    typed = {}
    for i, c in enumerate(texts):
        n = seen[f"n{i}"]
        if n == 0 or (seen[f"long{i}"] == n and seen[f"null{i}"]):
            typed[c] = F.col(c).cast("double")
        elif seen[f"long{i}"] == n:
            typed[c] = F.col(c).cast("bigint")
        elif seen[f"double{i}"] == n:
            typed[c] = F.col(c).cast("double")
        elif seen[f"bool{i}"] == n and not seen[f"null{i}"]:
            typed[c] = F.col(c).cast("boolean")
    return df.withColumns(typed) if typed else df


def typed(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Text columns taken by name and cast; a column that the file lacks is NULL. Reading a text that
    does not fit its type fails."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = []
    for field in schema:
        if field.name not in df.columns:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        text = F.col(f"`{field.name}`")
        value = text.try_cast(field.dataType)
        message = F.concat(F.lit(f"column '{field.name}' holds no {field.dataType.simpleString()}: "), text)
        unfit = F.raise_error(message).cast(field.dataType)
        columns.append(F.when(text.isNotNull() & value.isNull(), unfit).otherwise(value).alias(field.name))
    return df.select(*columns)


def _read_texts(spark, path, multi_line):
    """A delimited file with every column as text."""
    reader = spark.read.options(header=True, quote='"', escape='"', multiLine=multi_line)
    return tokens_to_null(reader.csv(path))


def _format(path: str) -> str:
    suffix = str(path).rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in ("parquet", "csv", "txt"):
        raise ValueError(f"cannot read '.{suffix}' tables; use parquet, csv or txt")
    return "parquet" if suffix == "parquet" else "text"


def _raw(spark, path, multi_line):
    try:
        if _format(path) == "parquet":
            return spark.read.parquet(str(path))
        return _read_texts(spark, str(path), multi_line)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no table at {path}") from error
        raise


def load_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    multi_line: bool = True,
    required: Sequence[str] = (),
) -> DataFrame:
    """Read one table, choosing the format by the suffix.

    Quoted fields may hold line breaks, so delimited files are read whole, one file per task.
    Give ``multi_line=False`` for files without such fields: they are then split into blocks.
    A schema saves the pass that finds out the types. Columns that are ``required`` must be in the file
    itself, whatever the schema.
    """
    found = _raw(spark, path, multi_line)
    missing = [c for c in required if c not in found.columns]
    if missing:
        raise ValueError(f"the table lacks required columns: {missing}")
    if _format(path) == "text":
        found = infer_types(found) if schema is None else typed(found, schema)
    return nan_to_null(found)


def load_predictions(
    spark: SparkSession,
    paths: Sequence[str],
    schema: T.StructType | str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Stack several files of scored rows; a column absent from one file is NULL there.

    Types are found once, from the rows of all files, so a column that is empty in one file has the
    type it has in the others. Where files have types of their own, numbers of different kinds become
    the wider one and a column that is text in any file is text. The column ``file_order`` is the
    position of the file in ``paths``.
    """
    if not paths:
        raise ValueError("no prediction files were given")
    parts = [_raw(spark, path, multi_line) for path in paths]
    known = [p for p, path in zip(parts, paths) if _format(path) == "parquet"]
    if schema is not None:
        parts = [typed(p, schema) if _format(path) == "text" else p for p, path in zip(parts, paths)]
        known = parts
    kinds = {}
    for part in known:
        for field in part.schema:
            if not isinstance(field.dataType, T.NullType):
                kinds.setdefault(field.name, set()).add(field.dataType)
    texts = {c for c, found in kinds.items() if T.StringType() in found}
    stacked = None
    for order, part in enumerate(parts):
        part = part.withColumns({
            f.name: F.col(f"`{f.name}`").cast("string") for f in part.schema
            if f.name in texts or isinstance(f.dataType, T.NullType)
        }).withColumn("file_order", F.lit(order))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    open_columns = [c for c in stacked.columns if c not in kinds and c != "file_order"]
    if schema is None and open_columns:
        stacked = infer_types(stacked, open_columns)
    return nan_to_null(stacked)


def validate_schema(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Fail unless the target and time columns exist. Runs no job."""
    missing = [c for c in (roles.time, roles.target) if c not in df.columns]
    if missing:
        raise ValueError(f"the table lacks required columns: {missing}")
    return df
