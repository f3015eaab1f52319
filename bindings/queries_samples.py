"""Sampling, prompt texts, replies, resumable scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import tables as t
from bindings.registry import define, query
from tidemark.functions import text
from tidemark.operators import prompts, sampling
from tidemark.operators.features import melt
from tidemark.roles import Roles
from tidemark.session import scratch_path
from tidemark.streaming import resume

CONFIG = prompts.PromptConfig(text=("title", "desc"), context=("lang", "n_chars"), max_chars=500)
LOAN_PROMPTS = prompts.PromptConfig(
    text=("o_orderpriority", "absent", "c_mktsegment"), context=("n_name", "id"), max_chars=8
)


def stripped(value: str) -> str:
    return rf"regexp_replace(regexp_replace({value}, '^\s+', ''), '\s+$', '')"


def cut(value: str, limit: int) -> str:
    head = rf"regexp_replace(substr({value}, 1, {limit - 3}), '\s+$', '')"
    return f"CASE WHEN length({value}) <= {limit} THEN {value} ELSE concat({head}, '...') END"


def drawn(source: str, seed: str) -> str:
    return f"""SELECT *, md5(concat(CAST({seed} AS VARCHAR), ':', CAST(id AS VARCHAR))) AS draw,
               row_number() OVER (PARTITION BY year ORDER BY
                   md5(concat(CAST({seed} AS VARCHAR), ':', CAST(id AS VARCHAR))),
                   CAST(id AS VARCHAR)) AS place
               FROM {source}"""


def literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


define(
    unused="SELECT * FROM loans_keyed WHERE id NOT IN (SELECT llm_row_id FROM attempts)",
    drawn_42=drawn("loans_keyed", "42"),
    drawn_123=drawn("unused", "123 + year"),
    prompt_parts=f"""
        SELECT doc_id AS id, {stripped("source")} AS title, {stripped("text")} AS desc_text,
               concat('lang: ', lang, chr(10), 'n_chars: ', CAST(n_chars AS VARCHAR)) AS context
        FROM documents""",
    prompt_blocks=f"""
        SELECT id, context, {stripped(f'''concat_ws(chr(10),
               CASE WHEN title <> '' THEN concat('title: ', {cut("title", 500)}) END,
               CASE WHEN desc_text <> '' THEN concat('desc: ', {cut("desc_text", 500)}) END)''')}
               AS block FROM prompt_parts""",
    prompt_full=f"""
        SELECT id, block, context, concat({literal(prompts.PROMPT_HEAD)},
               CASE WHEN context <> '' THEN context ELSE '(none provided)' END,
               {literal(prompts.PROMPT_MIDDLE)},
               CASE WHEN block <> '' THEN block ELSE '(no text provided)' END,
               {literal(prompts.PROMPT_TAIL)}) AS prompt FROM prompt_blocks""",
    merged="""
        SELECT * FROM (
            SELECT * FROM replies WHERE attempt_id % 2 = 0 AND llm_error IS NULL
            UNION ALL SELECT * FROM replies WHERE attempt_id % 2 = 1) x
        QUALIFY row_number() OVER (PARTITION BY llm_row_id ORDER BY attempt_id DESC) = 1""",
)


@query("sample_per_year", "SELECT id, year, target, n_name FROM drawn_42 WHERE place <= 500")
def sample_per_year(spark, folder):
    rows = sampling.sample_per_year(t.loans_keyed(spark, folder), 500)
    return rows.select("id", "year", "target", "n_name")


@query("sample_per_year_large",
       "SELECT id, year, target FROM drawn_42 WHERE place <= 2000")
def sample_per_year_large(spark, folder):
    rows = sampling.sample_per_year(t.loans_keyed(spark, folder), 2000)
    return rows.select("id", "year", "target")


@query("sample_per_year_excluding",
       "SELECT id, year, target FROM drawn_123 WHERE place <= 500 AND year IN (1999, 2000, 2001)")
def sample_per_year_excluding(spark, folder):
    used = t.attempts(spark, folder).select(F.col("llm_row_id").alias("id"))
    rows = sampling.sample_excluding(
        t.loans_keyed(spark, folder), t.TEST_YEARS, 500, used=used, warn=False
    )
    return rows.select("id", "year", "target")


@query("sample_shortfall", """SELECT CAST(y AS INTEGER) AS year, count(id) AS n_rows
    FROM (SELECT unnest([1999, 2001, 2050]) AS y) w
    LEFT JOIN (SELECT * FROM drawn_123 WHERE place <= 800) d ON d.year = y
    GROUP BY y HAVING count(id) < 800""")
def sample_shortfall(spark, folder):
    used = t.attempts(spark, folder).select(F.col("llm_row_id").alias("id"))
    years = [1999, 2001, 2050]
    rows = sampling.sample_excluding(
        t.loans_keyed(spark, folder), years, 800, used=used, warn=False
    )
    return sampling.shortfall(rows, years, 800)


@query("eval_batch", f"""
    SELECT row_number() OVER (ORDER BY split DESC,
               md5(concat('123:', CAST(id AS VARCHAR))), CAST(id AS VARCHAR)) + 99 AS llm_row_id,
           split, id, year, concat('o_orderpriority: ', {cut("o_orderpriority", 8)}, chr(10),
               'c_mktsegment: ', {cut("c_mktsegment", 8)}) AS text_block,
           concat('n_name: ', n_name, chr(10), 'id: ', CAST(id AS VARCHAR)) AS structured_context,
           target, CAST(3 AS INTEGER) AS llm_batch
    FROM (SELECT *, CASE WHEN year = 1998 THEN 'validation' ELSE 'test' END AS split
          FROM drawn_123 WHERE place <= 200 AND year >= 1998) x""")
def eval_batch(spark, folder):
    parts = t.keyed_split(spark, folder)
    used = t.attempts(spark, folder).select(F.col("llm_row_id").alias("id"))
    rows = sampling.eval_batch(
        parts, lambda df: prompts.prompt_table(df, LOAN_PROMPTS, t.LOANS),
        batch=3, n=200, used=used, start_row_id=100, roles=t.LOANS, warn=False,
    )
    return rows.drop("llm_prompt")


@query("row_ids", "SELECT id, year, row_number() OVER (ORDER BY id) + 99 AS row_id FROM loans_keyed")
def row_ids(spark, folder):
    rows = sampling.row_ids(t.loans_keyed(spark, folder).select("id", "year"), "id", start=100)
    return rows.withColumn("row_id", F.col("row_id").cast("bigint"))


# --- prompts


@query("existing_cols", """SELECT 'lang' AS feature, count(lang) AS n FROM documents
    UNION ALL SELECT 'n_chars', count(n_chars) FROM documents""")
def existing_cols(spark, folder):
    df = t.prompt_rows(spark, folder)
    found = prompts.existing_columns(df, ["lang", "absent", "n_chars"])
    return melt(df, found).groupBy("feature").agg(F.count("value").alias("n"))


@query("truncate_text", f"SELECT doc_id AS id, {cut('text', 500)} AS text FROM documents")
def truncate_text(spark, folder):
    return t.prompt_rows(spark, folder).select(
        "id", text.truncate(F.col("desc"), 500).alias("text")
    )


@query("text_block", "SELECT id, block AS text_block FROM prompt_blocks")
def text_block(spark, folder):
    df = t.prompt_rows(spark, folder)
    return df.select("id", prompts.text_block(df, CONFIG.text, 500).alias("text_block"))


@query("context_block", "SELECT id, context AS structured_context FROM prompt_blocks")
def context_block(spark, folder):
    df = t.prompt_rows(spark, folder)
    return df.select("id", prompts.context_block(df, CONFIG.context).alias("structured_context"))


@query("render_prompt", "SELECT id, prompt AS llm_prompt FROM prompt_full")
def render_prompt(spark, folder):
    df = t.prompt_rows(spark, folder)
    context = prompts.context_block(df, CONFIG.context)
    block = prompts.text_block(df, CONFIG.text, 500)
    return df.select("id", prompts.render_prompt(context, block).alias("llm_prompt"))


@query("prompt_table", """SELECT id, block AS text_block, context AS structured_context,
    prompt AS llm_prompt FROM prompt_full""")
def prompt_table(spark, folder):
    return prompts.prompt_table(t.prompt_rows(spark, folder), CONFIG, Roles())


# --- replies


@query("parse_response", """SELECT llm_row_id, attempt_id, llm_error,
    round(llm_default_probability, 6) AS llm_default_probability FROM replies""")
def parse_response(spark, folder):
    return t.replies(spark, folder).drop("attempt_ts")


@query("parse_response_labels", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'unreadable reply' END AS llm_error,
           CASE WHEN event_type <> 'error' THEN round(least(1.0e0, greatest(0.0e0, value / 50.0e0)), 6)
           END AS llm_default_probability,
           CASE WHEN event_type <> 'error' THEN CAST(user_id % 2 AS INTEGER) END AS
           llm_predicted_label_raw
    FROM events""")
def parse_response_labels(spark, folder):
    reply = F.to_json(F.struct(
        (F.col("value") / 50.0).alias("default_probability"),
        (F.col("user_id") % 2).alias("predicted_label"),
    ))
    broken = F.substring(reply, 1, 20)
    rows = t.table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_type") == "error", broken).otherwise(reply).alias("raw")
    )
    return prompts.parse_reply(rows, "raw").drop("raw")


def _merged(spark, folder):
    rows = t.replies(spark, folder)
    first, again = rows.where(F.col("attempt_id") % 2 == 0), rows.where(F.col("attempt_id") % 2 == 1)
    return resume.merge_attempts(first, again, ["attempt_id"])


@query("merge_attempts", """SELECT llm_row_id, attempt_id, llm_error,
    round(llm_default_probability, 6) AS llm_default_probability FROM merged""")
def merge_attempts(spark, folder):
    return _merged(spark, folder).drop("attempt_ts")


LOG = "llm_row_id bigint, attempt_id bigint, attempt_ts timestamp_ntz, llm_error string, llm_default_probability double"


def _log(spark, folder):
    """The replies of four rounds, of which one is given twice and one is never published."""
    rows = t.replies(spark, folder)
    log = resume.AttemptLog(spark, scratch_path(spark, "attempts"), LOG)
    for number in (0, 1, 1, 2):
        log.commit(f"round-{number}", rows.where(F.col("attempt_id") % 4 == number))
    log.ledger.write("round-3", rows.where(F.col("attempt_id") % 4 == 3))
    return log


@query("attempt_log", """
    SELECT llm_row_id, attempt_id, llm_error, round(llm_default_probability, 6) AS llm_default_probability
    FROM replies WHERE attempt_id % 4 < 3
    QUALIFY row_number() OVER (PARTITION BY llm_row_id ORDER BY
        llm_error IS NULL AND llm_default_probability IS NOT NULL DESC, attempt_id DESC) = 1""")
def attempt_log(spark, folder):
    return _log(spark, folder).results().drop("attempt_ts")


@query("attempt_log_pending", """
    SELECT event_id AS llm_row_id FROM events WHERE event_id NOT IN (
        SELECT llm_row_id FROM replies WHERE attempt_id % 4 < 3
        AND llm_error IS NULL AND llm_default_probability IS NOT NULL)""")
def attempt_log_pending(spark, folder):
    return _log(spark, folder).pending(t.scoring_inputs(spark, folder))


@query("error_counts", "SELECT count(*) AS n_rows, count(llm_error) AS n_errors FROM merged")
def error_counts(spark, folder):
    return prompts.error_counts(_merged(spark, folder))
