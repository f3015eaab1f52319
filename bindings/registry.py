"""Collects the bound queries and their reference SQL."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

QUERIES = {}
ORACLES = {}

# The views of ``tables.py`` in SQL.
VIEWS = {
    "loans_keyed": """
        SELECT o_orderkey AS id, o_orderdate AS issue_d, CAST(year(o_orderdate) AS INTEGER) AS year,
               CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target,
               o_totalprice, c_acctbal, o_orderpriority, c_mktsegment, n_name, c_name
        FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey""",
    "loans_wide": """
        SELECT CAST(year(l_shipdate) AS INTEGER) AS year,
               CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS target,
               l_quantity + (year(l_shipdate) - 1995) AS qty_shifted,
               l_extendedprice, nullif(l_discount, CAST(0.05 AS DOUBLE)) AS discount_n,
               CASE WHEN l_linenumber > 1 THEN 1 ELSE 0 END AS is_later_line, p_type,
               CASE WHEN year(l_shipdate) >= 2000 AND l_linenumber = 2 THEN NULL
                    ELSE p_brand END AS brand_n
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "pred": """
        SELECT id, year, model, target AS y_true,
               CAST(milli AS DOUBLE) / CAST(1000 AS DOUBLE) AS y_prob,
               CASE WHEN year <= 1997 THEN 'train' WHEN year = 1998 THEN 'validation'
                    ELSE 'test' END AS split
        FROM (SELECT id, year, target, 'a' AS model, (id * 7919) % 800 + 150 * target AS milli
              FROM loans_keyed
              UNION ALL SELECT id, year, target, 'b', (id * 104729) % 900 + 60 * target
              FROM loans_keyed
              UNION ALL SELECT id, year, target, 'c', (id * 1299709) % 1001 FROM loans_keyed) x""",
    "pred_val": "SELECT * FROM pred WHERE split = 'validation'",
    "pred_test": "SELECT * FROM pred WHERE split = 'test'",
    "attempts": """
        SELECT event_id - event_id % 2 AS llm_row_id, event_id AS attempt_id, ts AS attempt_ts,
               CASE WHEN event_type = 'error' THEN 'failed' END AS llm_error,
               CASE WHEN event_type <> 'error' THEN props END AS raw
        FROM events""",
    "replies": """
        SELECT llm_row_id, attempt_id, attempt_ts, llm_error,
               CASE WHEN raw IS NOT NULL THEN least(1.0e0, greatest(0.0e0,
                   CAST(json_extract_string(raw, '$.k') AS DOUBLE) / 50.0e0)) END AS
                   llm_default_probability
        FROM attempts""",
    "importances": """
        SELECT 'a' AS model, concat('cat__p_type_', p_type) AS transformed_feature,
               CAST(count(*) - 300 AS DOUBLE) / CAST(1000 AS DOUBLE) AS weight
        FROM part GROUP BY p_type
        UNION ALL SELECT 'a', concat('cat__p_brand_', p_brand),
               CAST(count(*) - 80 AS DOUBLE) / CAST(1000 AS DOUBLE) FROM part GROUP BY p_brand
        UNION ALL SELECT 'b', concat('num__p_size_', CAST(p_size % 7 AS VARCHAR)),
               CAST(count(*) AS DOUBLE) / CAST(1000 AS DOUBLE) FROM part GROUP BY p_size % 7
        UNION ALL SELECT 'b', concat('cat__p_type_', p_type),
               CAST(sum(p_size) AS DOUBLE) / CAST(1000 AS DOUBLE) FROM part GROUP BY p_type""",
}


def define(**views: str) -> None:
    """Name further SQL fragments that queries can refer to like views."""
    VIEWS.update(views)


def with_views(body: str) -> str:
    """Put the named fragments that ``body`` needs in front of it."""
    needed: list[str] = []

    def visit(text):
        for word in re.findall(r"[a-z_0-9]+", text):
            if word in VIEWS and word not in needed:
                visit(VIEWS[word])
                if word not in needed:
                    needed.append(word)

    visit(body)
    if not needed:
        return body
    parts = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    own = body.lstrip()
    joint = "," + own[len("WITH"):] if own.startswith("WITH ") else f"\n{body}"
    return f"WITH {parts}{joint}"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, because sums depend on their order in the last ones."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, 6) for c in doubles}) if doubles else df


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL that must give the same rows if there is any."""

    def register(function):
        QUERIES[name] = lambda spark, folder: rounded(function(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def doubles(values) -> str:
    """A SQL list of exact double literals."""
    return "[" + ", ".join(f"{float(v)!r}e0" if "e" not in repr(float(v)) else repr(float(v))
                           for v in values) + "]"


# the quantile steps of ten bins, with their last digits
PROBS_10 = doubles(np.linspace(0, 1, 11))


def quantile_sql(source: str, keys: str, probs: str, value: str = "y_prob") -> str:
    """Interpolated quantiles from the sorted values, in the same arithmetic."""
    on = " AND ".join(f"{{0}}.{k} = p.{k}" for k in keys.split(", "))
    return f"""
        SELECT p.*, CASE WHEN share >= 0.5e0 THEN b.v - (b.v - a.v) * (1.0e0 - share)
               ELSE a.v + (b.v - a.v) * share END AS q
        FROM (SELECT *, (n - 1) * prob - floor((n - 1) * prob) AS share,
                     CAST(floor((n - 1) * prob) AS BIGINT) AS low
              FROM (SELECT {keys}, count(*) AS n FROM {source} GROUP BY {keys}) c,
                   (SELECT unnest({probs}) AS prob) g) p
        JOIN (SELECT {keys}, {value} AS v, row_number() OVER (
                  PARTITION BY {keys} ORDER BY {value}) - 1 AS rn FROM {source}) a
             ON a.rn = low AND {on.format("a")}
        JOIN (SELECT {keys}, {value} AS v, row_number() OVER (
                  PARTITION BY {keys} ORDER BY {value}) - 1 AS rn FROM {source}) b
             ON b.rn = least(low + 1, n - 1) AND {on.format("b")}"""
