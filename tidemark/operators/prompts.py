"""Prompt texts for rows that an outside model scores, and reading its replies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import text
from tidemark.operators.sampling import sample_per_year
from tidemark.roles import Roles

# The wording of the prompt, and the usual context columns.
PROMPT_HEAD = """You are evaluating the risk that a consumer loan will default.

Use the borrower-provided text and optional structured loan context below.
Estimate the probability of default as a number between 0 and 1.
Then briefly explain the reasoning using only the provided information.

Structured context:
"""
PROMPT_MIDDLE = """

Borrower text:
"""
PROMPT_TAIL = """

Respond in JSON with keys:
- default_probability
- rationale"""
NO_CONTEXT = "(none provided)"
NO_TEXT = "(no text provided)"
CONTEXT_COLUMNS = (
    "loan_amnt", "term", "int_rate", "annual_inc", "dti", "fico_range_low", "fico_range_high",
    "purpose", "home_ownership", "emp_length",
)


@dataclass(frozen=True)
class PromptConfig:
    text: tuple[str, ...] = ("title", "desc")
    context: tuple[str, ...] = CONTEXT_COLUMNS
    id: str = "id"
    year: str = "year"
    max_chars: int = 600
    with_context: bool = True
    with_target: bool = True


def existing_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def text_block(df: DataFrame, columns: Sequence[str], max_chars: int) -> Column:
    """A line ``column: text`` for every text that is not empty."""
    lines = []
    for c in columns:
        value = text.clean(text.as_text(F.col(c), df.schema[c].dataType))
        cut = text.truncate(value, max_chars)
        lines.append(F.when(value != "", F.concat(F.lit(f"{c}: "), cut)))
    return text.strip(F.concat_ws("\n", *lines)) if lines else F.lit("")


def context_block(df: DataFrame, columns: Sequence[str]) -> Column:
    """A line ``column: value`` for every value that is not missing."""
    lines = []
    for c in columns:
        value = text.as_text(F.col(c), df.schema[c].dataType)
        lines.append(F.concat(F.lit(f"{c}: "), value))
    return text.strip(F.concat_ws("\n", *lines)) if lines else F.lit("")


def render_prompt(context: Column, block: Column) -> Column:
    """The full prompt, with stand-ins for a missing context or text."""
    return text.strip(
        F.concat(
            F.lit(PROMPT_HEAD),
            F.when(context != "", context).otherwise(NO_CONTEXT),
            F.lit(PROMPT_MIDDLE),
            F.when(block != "", block).otherwise(NO_TEXT),
            F.lit(PROMPT_TAIL),
        )
    )


def prompt_table(
    df: DataFrame,
    config: PromptConfig = PromptConfig(),
    roles: Roles = Roles(),
    years: Sequence[int] | None = None,
    sample: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Id, year, text block, context block, prompt and label of the chosen rows."""
    if years is not None or sample is not None:
        if config.year not in df.columns:
            raise ValueError(f"the table has no column '{config.year}'")
    if years is not None:
        df = df.where(F.col(config.year).isin(*years))
    if sample is not None:
        df = sample_per_year(df, sample, seed, years, config.id, config.year)
    texts = existing_columns(df, config.text)
    if not texts:
        raise ValueError(f"none of the text columns {list(config.text)} is in the table")
    context = F.lit("")
    if config.with_context:
        context = context_block(df, existing_columns(df, config.context))
    rows = df.withColumns({
        "text_block": text_block(df, texts, config.max_chars), "structured_context": context,
    })
    rows = rows.withColumn(
        "llm_prompt", render_prompt(F.col("structured_context"), F.col("text_block"))
    )
    columns = [
        *existing_columns(df, [config.id, config.year]),
        "text_block", "structured_context", "llm_prompt",
        *(existing_columns(df, [roles.target]) if config.with_target else []),
    ]
    return rows.select(*columns)


def parse_reply(
    df: DataFrame,
    raw: str,
    error: str | None = None,
    probability_path: str = "$.default_probability",
    label_path: str | None = "$.predicted_label",
    scale: float = 1.0,
) -> DataFrame:
    """Add probability (clamped to [0, 1]), label and error from the JSON reply in ``raw``.

    A reply without a readable probability and label is an error row, to be tried again.
    """
    # inside a list, text after the object is an error rather than ignored
    reply = F.try_parse_json(F.concat(F.lit("["), F.col(raw), F.lit("]")))

    def field(path):
        return F.try_variant_get(reply, f"$[0]{path.removeprefix('$')}", "double")

    alone = F.try_variant_get(reply, "$[1]", "variant").isNull()
    p = F.nanvl(field(probability_path) / F.lit(scale), F.lit(None))
    readable = p.isNotNull() & alone
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    label = F.lit(None).cast("int")
    if label_path is not None:
        label = field(label_path).try_cast("int")
        readable = readable & label.isNotNull()
    failed = F.when(~readable, F.lit("unreadable reply"))
    if error is not None:
        failed = F.coalesce(F.col(error), failed)
    return df.withColumn("llm_error", failed).withColumns({
        "llm_default_probability": F.when(F.col("llm_error").isNull(), p),
        "llm_predicted_label_raw": F.when(F.col("llm_error").isNull(), label),
    })


def error_counts(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("n_rows"), F.count("llm_error").alias("n_errors"))
