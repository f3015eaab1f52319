"""Cleaning of a corpus in five stages: toxicity, near duplicates, repeated passages, benchmark
passages, tokens.

Each stage reads what the one before has written to the shared folder, works on all of it, and
returns the columns of ``documents``; the last one adds the tokens. Rows without an id or text pass
the filters: nothing speaks against them. Empty tables give empty ones. Columns besides ``doc_id``,
``text`` and ``n_chars`` go along unchanged, whatever their names; where one has the name of a column
that the last stage adds, the added one gets underscores behind its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import bpe, labelled, toxicity
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.queries import default_vocabulary, table
from tidemark.llm.scratch import stored
from tidemark.llm.substring import remove_repeated_passages

TOXIC = 0.5
# Chunks that a worker of the last stage knows; it shares the executor's memory with all stages before.
REMEMBERED = 1 << 15


def _unpacked(found: DataFrame, like: DataFrame, text, *more: str) -> DataFrame:
    """The columns of ``like`` in order, from a row struct and a text; ``n_chars`` follows the text."""
    columns = []
    for name in like.columns:
        if name == "text":
            columns.append(F.expr(text).alias("text"))
        elif name == "n_chars":
            kind = like.schema["n_chars"].dataType
            columns.append(F.expr(f"char_length({text})").cast(kind).alias("n_chars"))
        else:
            columns.append(F.col("row").getField(name).alias(name))
    return found.select(*columns, *more)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the classifier, learnt from the labelled ones, calls toxic."""
    model = toxicity.fit(labelled.sample(docs, table(spark, sf_dir, "labels"), "toxic"))
    found = toxicity.score(docs, model).where(F.col("score") < TOXIC)
    return _unpacked(found, docs, "text")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that an earlier document, or place, has in a window of 20; other
    texts stay as they are. A text that is repeated throughout goes with its document."""
    found = remove_repeated_passages(docs).where("n_removed = 0 OR n_removed < n_words")
    return _unpacked(found, docs, "CASE WHEN n_removed = 0 THEN text ELSE kept END")


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark windows; documents that are mostly such windows go."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).where("NOT rejected")
    return _unpacked(found, docs, "clean")


def add_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its ids and their number, and whether they decode to the text."""
    vocabulary = bpe.load_vocabulary(spark, default_vocabulary())
    found = bpe.encode(docs, vocabulary, decoded=True, remembered=REMEMBERED)
    return found.select(
        *("text" if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns),
        F.col("ids").alias(_free("ids", docs)),
        F.size("ids").cast("long").alias(_free("n_tokens", docs)),
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias(_free("round_trip", docs)),
    )


def _free(name: str, docs: DataFrame) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", keep_one_of_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", cut_benchmark_passages),
    ("bpe", add_tokens),
]

# The first stage is a learnt classifier and the last a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
