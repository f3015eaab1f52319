"""Labelled rows for fitting: a bounded sample, or all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SAMPLE_ROWS = 12_000


def held_out(id_column: str) -> Column:
    """Rows that no model may learn from."""
    digits = F.col(id_column).cast("long").cast("string").cast("binary")
    return F.coalesce(F.crc32(digits) % 5 == 0, F.lit(False))


def sample(
    docs: DataFrame, labels: DataFrame, label: str, id_column: str = "doc_id",
    text_column: str = "text", rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents that are not held out.

    They are the first by a hash of the id, so they are the same on any cluster. Rows without id,
    text or label are none. The list of ids is bounded by ``rows`` and broadcast; if labels repeat an
    id, one of its labels counts, the largest.
    """
    chosen = (
        labels.where(~held_out(id_column))
        .select(F.col(id_column).cast("long").alias("key"), F.col(label).cast("double").alias("label"))
        .dropna()
        .groupBy("key").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(rows)
    )
    texts = docs.select(
        F.col(id_column).cast("long").alias("key"), F.col(text_column).cast("string").alias("text")
    ).dropna()
    found = texts.join(F.broadcast(chosen), "key")
    return found.groupBy("key").agg(F.max(F.struct("text", "label")).alias("r")).select(
        "key", "r.text", "r.label"
    )


def learnable(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(key, mark, text) of all rows that are not held out and have both; ``mark`` is the text's hash."""
    return docs.where(~held_out(id_column)).select(
        F.col(id_column).cast("long").alias("key"), F.xxhash64(F.col(text_column).cast("string")).alias("mark"),
        F.col(text_column).cast("string").alias("text"),
    ).dropna()


def with_labels(
    rows: DataFrame, labels: DataFrame, label: str, id_column: str = "doc_id"
) -> DataFrame:
    """All the rows (key, mark, others) that have a label, one per key: that with the largest mark, and
    the largest label if labels repeat an id."""
    known = labels.select(
        F.col(id_column).cast("long").alias("key"), F.col(label).cast("double").alias("label")
    ).dropna().groupBy("key").agg(F.max("label").alias("label"))
    others = [c for c in rows.columns if c not in ("key", "mark")]
    once = rows.groupBy("key").agg(F.max_by(F.struct(*others), "mark").alias("r")).select("key", "r.*")
    return once.join(known, "key")
