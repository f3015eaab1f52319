"""Scoring with a model that was fitted elsewhere: any object with ``predict_proba``."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import DataFrame, functions as F

MOST_BYTES = 256 << 20


@dataclass
class ForeignModel:
    """A scorer over Arrow batches that can stand wherever a fitted model can.

    ``inputs`` names the columns that the model takes, in order, with their types; columns are cast to
    these, so that the model sees the same types whatever the table. Missing numbers are NaN, missing
    texts None, for the model to handle; a score of NaN is NULL. The model is broadcast once if its pickled size allows it, and
    a batch is all that is held besides it.
    """

    name: str
    model: object
    inputs: Mapping[str, str]
    most_bytes: int = MOST_BYTES
    _shared: dict = field(default_factory=dict, repr=False, compare=False)

    def _broadcast(self, spark):
        application = spark.sparkContext.applicationId
        if application not in self._shared:
            body = CloudPickleSerializer().dumps(self.model)
            if len(body) > self.most_bytes:
                raise ValueError(
                    f"model '{self.name}' takes {len(body)} bytes, more than {self.most_bytes} to be broadcast")
            self._shared[application] = spark.sparkContext.broadcast(body)
        return self._shared[application]

    def score(self, df: DataFrame, column: str = "y_prob") -> DataFrame:
        """The table with the probability of class 1, and nothing else added."""
        lacking = [c for c in self.inputs if c not in df.columns]
        if lacking:
            raise ValueError(f"the table lacks columns of model '{self.name}': {lacking}")
        shared = self._broadcast(df.sparkSession)

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            model = CloudPickleSerializer().loads(shared.value)
            for rows in batches:
                found = np.asarray(model.predict_proba(rows), dtype=float) if len(rows) else np.empty((0, 2))
                if found.shape != (len(rows), 2):
                    raise ValueError(f"predict_proba gave {found.shape} for {len(rows)} rows of two classes")
                yield pd.Series(found[:, 1])

        taken = F.struct(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in self.inputs.items()])
        return df.withColumn("__score", scored(taken)).select(
            *[f"`{c}`" for c in df.columns], F.col("__score").alias(column))
