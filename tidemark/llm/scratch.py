"""Intermediate tables in the shared folder, so that a lost executor costs no earlier step."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.session import scratch_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back. The shuffles that led to the table are freed as soon as it is written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns besides those an operator handles itself, for a struct that goes along whole."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns if c not in names]
