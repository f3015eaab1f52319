"""The shared folder for intermediate tables, and small tables held by the driver."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# What this process has written below the shared folder, by application.
_WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; for a local master without one, a folder that goes with the
    process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    path = f"{shared_folder(spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def scratch_mark(spark: SparkSession) -> int:
    """How many paths have been given out, for ``discard_scratch`` to keep these."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def discard_scratch(spark: SparkSession, since: int = 0) -> int:
    """Delete the intermediate tables of this application, or those given out after a mark. Call it
    when the results that read them have been written; returns how many paths there were."""
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    gone, paths[since:] = paths[since:], []
    for path in gone:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return len(gone)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write once as parquet to the shared folder, read back: later passes neither recompute nor
    depend on executors, and read only their columns. The shuffles that led to the table are freed
    as soon as it is written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def local_table(
    spark: SparkSession, rows: Iterable[Sequence], schema: T.StructType | str
) -> DataFrame:
    """A table from rows known to the driver.

    Arrow data becomes a local relation whose size the optimizer knows, so that a join with it is
    broadcast if it is small and shuffled if it is not.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    names = schema.names
    table = pa.Table.from_pylist(
        [dict(zip(names, row)) for row in rows], schema=to_arrow_schema(schema)
    )
    return spark.createDataFrame(table, schema)
