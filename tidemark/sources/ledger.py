"""An append-only table of batches, each of which is there as a whole or not at all.

A batch's rows are written to a folder of their own; then a manifest that names the folder is put in
place by a rename that fails if the batch has one already. Readers list the manifests and read the
folders that these name. A run killed at any point leaves at most a folder without manifest, which
nobody reads; running the batch again neither loses nor doubles rows, and of two runs that commit the
same batch one wins. The rename must be atomic, as it is on HDFS and local disks; on an object store
without such a rename, one writer per batch is assumed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, types as T


class Ledger:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)

    def _manifest(self, batch: str) -> str:
        if not batch or "/" in batch or batch.startswith("."):
            raise ValueError(f"'{batch}' cannot name a batch")
        return f"{self.path}/manifests/{batch}.json"

    def manifests(self) -> dict[str, dict]:
        """What each committed batch says about itself, in the order of their names."""
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return {}
        found = {}
        for status in self._fs.listStatus(folder):
            name = status.getPath().getName()
            if name.endswith(".json") and not name.startswith("."):
                stream = self._fs.open(status.getPath())
                try:
                    body = bytes(stream.readAllBytes())
                finally:
                    stream.close()
                found[name.removesuffix(".json")] = json.loads(body)
        return dict(sorted(found.items()))

    def write(self, batch: str, rows: DataFrame, partition_by: Sequence[str] = ()) -> str:
        """Write a batch's rows to a folder that nobody reads yet, and return it."""
        self._manifest(batch)
        folder = f"data/{batch}-{uuid.uuid4().hex}"
        rows = rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in self.schema])
        rows.write.partitionBy(*partition_by).parquet(f"{self.path}/{folder}")
        return folder

    def publish(self, batch: str, folder: str, about: dict | None = None) -> bool:
        """Make a written folder the batch. False if the batch was there already."""
        final = self._manifest(batch)
        draft = f"{self.path}/manifests/.{batch}-{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(draft), False)
        stream.write(bytearray(json.dumps({"folder": folder, "about": about or {}}).encode()))
        stream.close()
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(self._path(draft), self._path(final), options)
        except Exception as error:
            self._fs.delete(self._path(draft), False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def commit(
        self, batch: str, rows: DataFrame, about: dict | None = None, partition_by: Sequence[str] = ()
    ) -> bool:
        """Write and publish a batch. A batch that is there already is neither computed nor written."""
        if self._fs.exists(self._path(self._manifest(batch))):
            return False
        return self.publish(batch, self.write(batch, rows, partition_by), about)

    def read(self, batches: Sequence[str] | None = None) -> DataFrame:
        """The rows of committed batches, of all or of those named."""
        found = self.manifests()
        tables = [
            self.spark.read.schema(self.schema).parquet(f"{self.path}/{entry['folder']}")
            for batch, entry in found.items() if batches is None or batch in batches
        ]
        if not tables:
            return self.spark.createDataFrame([], self.schema)
        whole = tables[0]
        for table in tables[1:]:
            whole = whole.unionByName(table)
        return whole

    def clear_unpublished(self) -> int:
        """Delete folders without a manifest. Only while no run is writing; returns their number."""
        named = {entry["folder"].rpartition("/")[2] for entry in self.manifests().values()}
        data = self._path(f"{self.path}/data")
        if not self._fs.exists(data):
            return 0
        lost = [s.getPath() for s in self._fs.listStatus(data) if s.getPath().getName() not in named]
        for path in lost:
            self._fs.delete(path, True)
        return len(lost)
