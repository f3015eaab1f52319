"""Resumable scoring: which rows are still to do, and merging new results with old ones.

Running a step again with the same inputs gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.operators.dedup import keep_first, keep_last
from tidemark.sources.ledger import Ledger


def completed_rows(
    attempts: DataFrame,
    probability: str = "llm_default_probability",
    error: str = "llm_error",
    retry_errors: bool = True,
) -> DataFrame:
    """Attempts that need no repetition; without ``retry_errors`` these are all of them."""
    if not retry_errors or error not in attempts.columns:
        return attempts
    return attempts.where(F.col(error).isNull() & F.col(probability).isNotNull())


def pending_rows(inputs: DataFrame, attempts: DataFrame, key: str = "llm_row_id", **which):
    """Input rows that no completed attempt covers."""
    done = completed_rows(attempts, **which).select(key).distinct()
    return inputs.join(done, key, "left_anti")


def merge_attempts(
    old: DataFrame,
    new: DataFrame,
    order: Sequence[str],
    key: str = "llm_row_id",
    **which,
) -> DataFrame:
    """Completed old rows and new results, the last attempt of each row."""
    rows = completed_rows(old, **which).unionByName(new, allowMissingColumns=True)
    return keep_last(rows, [key], order)


def combine_predictions(stacked: DataFrame, key: str = "id", order: Sequence[str] = ()) -> DataFrame:
    """One row per id from several files of scored rows: the first by file, then row."""
    return keep_first(stacked, [key], list(order) or ["file_order", "llm_row_id"])


class AttemptLog:
    """Attempts of an outside scorer, batch by batch, each batch there as a whole or not at all.

    A run that is killed at any point is run again: committed batches are neither scored nor written a
    second time, and rows of a batch that was not committed are still pending.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType | str,
        key: str = "llm_row_id", order: Sequence[str] = ("attempt_id",),
    ):
        self.ledger = Ledger(spark, path, schema)
        self.key, self.order = key, list(order)

    def attempts(self) -> DataFrame:
        """All committed attempts."""
        return self.ledger.read()

    def pending(self, inputs: DataFrame, **which) -> DataFrame:
        return pending_rows(inputs, self.attempts(), self.key, **which)

    def commit(self, batch: str, attempts: DataFrame) -> bool:
        """Add a batch of attempts. False, and no work, if the batch is there already."""
        return self.ledger.commit(batch, attempts, {"key": self.key})

    def run(self, batch: str, inputs: DataFrame, score: Callable[[DataFrame], DataFrame], **which) -> bool:
        """Score the rows of ``inputs`` that are still pending, as one batch."""
        if batch in self.ledger.manifests():
            return False
        return self.commit(batch, score(self.pending(inputs, **which)))

    def results(self, **which) -> DataFrame:
        """One row per key: its last completed attempt, or else its last one."""
        rows, good = self.attempts(), F.lit(True)
        if which.get("retry_errors", True):
            good = F.col(which.get("error", "llm_error")).isNull() & F.col(
                which.get("probability", "llm_default_probability")).isNotNull()
        chosen = keep_last(rows.withColumn("__good", good), [self.key], ["__good", *self.order])
        return chosen.drop("__good")


def score_stream(
    arriving: DataFrame, log: AttemptLog, score: Callable[[DataFrame], DataFrame], checkpoint: str,
    name: str = "stream",
):
    """Score a stream of input rows into a log: every micro-batch is a batch of its own, so a restart
    that repeats the last one changes nothing. Ends when all that has arrived is scored."""

    def one(rows: DataFrame, number: int) -> None:
        log.run(f"{name}-{number:09d}", rows, score)

    return (
        arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
