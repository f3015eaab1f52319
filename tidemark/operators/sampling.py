"""Reproducible random rows per year.

Rows are ordered by a hash of seed and id, then by a hash of the row, so the same rows are drawn on
any cluster.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scores import add_cells
from tidemark.operators.joins import exclude_ids
from tidemark.operators.metrics import score_cells
from tidemark.operators.split import Split
from tidemark.roles import Roles
from tidemark.session import local_table, stored

log = logging.getLogger(__name__)


def draw_order(seed: Column | int, id_column: str) -> Column:
    """Rows are drawn in the order of this text; a missing id counts as an empty one."""
    own = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(seed).cast("string"), F.lit(":"), own))


def _first_keys(keys: DataFrame, year: str, n: int) -> DataFrame:
    """The first ``n`` keys of each year, with how many rows of a key are wanted.

    Every task first keeps its own ``n`` of a year, tasks that share a salt then meet, and last the
    salts: no task sees more than ``n`` keys from each of the ones before it.
    """
    order = ("__draw", "__draw_id", "__tie")
    salts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = keys.withColumn("__salt", F.spark_partition_id() % salts)
    for by in ([year, "__salt"], [year]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        salted = salted.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")
    return salted.groupBy(year, *order).agg(F.count(F.lit(1)).alias("__wanted"))


def sample_per_year(
    df: DataFrame,
    n: int,
    seed: int = 42,
    years: Sequence[int] | None = None,
    id_column: str = "id",
    year: str = "year",
    seed_plus_year: bool = False,
) -> DataFrame:
    """Up to ``n`` rows of each year, with their natural mix of labels.

    Rows are drawn in the order of their hashed id; rows that share an id, or have none, follow a
    hash of the whole row. The table is read twice: for narrow keys (year, hashes, id), of which the
    first ``n`` are found and written, and for the rows behind these. Rows equal in every column are
    interchangeable and come as often as their keys were drawn. Rows without a year are a year.
    """
    for column in (id_column, year):
        if column not in df.columns:
            raise ValueError(f"the table has no column '{column}'")
    if years is not None:
        df = df.where(F.col(year).isin(*years))
    start = F.lit(seed) + F.coalesce(F.col(year), F.lit(0)) if seed_plus_year else F.lit(seed)
    rows = df.withColumns({
        "__draw": draw_order(start, id_column), "__draw_id": F.col(id_column).cast("string"),
        "__tie": F.lpad(F.lower(F.hex(F.xxhash64(*df.columns))), 16, "0"),
    })
    keys = [year, "__draw", "__draw_id", "__tie"]
    # n keys per year, so that the optimizer knows their size when it joins
    wanted = stored(_first_keys(rows.select(*keys), year, n), "sample-keys")
    same = [F.col(f"rows.{k}").eqNullSafe(F.col(f"wanted.{k}")) for k in keys if k != "__draw"]
    found = rows.drop("__draw").alias("rows").join(wanted.alias("wanted"), same).select(
        F.struct(*[f"wanted.{k}" for k in keys]).alias("__key"), "wanted.__wanted",
        F.struct(*[F.col(f"rows.`{c}`") for c in df.columns]).alias("__row"),
    )
    one = found.groupBy("__key").agg(F.first("__row").alias("__row"), F.first("__wanted").alias("__wanted"))
    return one.select("__row", F.explode(F.sequence(F.lit(1), F.col("__wanted").cast("int")))).select("__row.*")


def sample_excluding(
    df: DataFrame,
    years: Sequence[int],
    n: int = 500,
    seed: int = 123,
    used: DataFrame | None = None,
    id_column: str = "id",
    year: str = "year",
    warn: bool = True,
) -> DataFrame:
    """The same after removing ids used before; warns about years with fewer rows."""
    if id_column not in df.columns:
        raise ValueError(f"the table has no column '{id_column}'")
    if used is not None:
        df = exclude_ids(df, used, id_column)
    rows = sample_per_year(df, n, seed, years, id_column, year, True)
    if warn:
        # n rows per year at most, read once
        rows = stored(rows)
        for row in shortfall(rows, years, n, year).collect():
            log.warning("asked for %d rows of %s, found %d", n, row[year], row["n_rows"])
    return rows


def shortfall(sample: DataFrame, years: Sequence[int], n: int, year: str = "year") -> DataFrame:
    """Years that gave fewer than ``n`` rows."""
    wanted = local_table(sample.sparkSession, [(y,) for y in years], f"`{year}` int")
    counts = sample.groupBy(F.col(year).cast("int").alias(year)).agg(F.count(F.lit(1)).alias("n"))
    return (
        wanted.join(counts, year, "left")
        .select(year, F.coalesce("n", F.lit(0)).cast("bigint").alias("n_rows"))
        .where(F.col("n_rows") < n)
    )


def row_ids(
    df: DataFrame, order: str, start: int = 0, name: str = "row_id", cells: int | None = None
) -> DataFrame:
    """Running numbers in the order of a numeric column without ties; a missing value is refused.

    The column is cut into ranges of about equal size. Each range is numbered on its own, from
    the number of rows in the lower ranges.
    """
    given = F.col(order).cast("double")
    given = F.when(given.isNull(), F.raise_error(F.lit(f"rows without {order} have no place")).cast(
        "double")).otherwise(given)
    ranges = add_cells(
        df.withColumn("__at", given),
        "__at",
        score_cells(df.select(F.col(order).cast("double").alias("y_prob")), cells),
    )
    sizes = ranges.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    lower = Window.partitionBy(F.lit(0)).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("cell", F.coalesce(F.sum("size").over(lower), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("cell").orderBy(order))
    return (
        ranges.withColumn("place", place)
        .join(before, "cell")
        .withColumn(name, F.col("before") + F.col("place") - 1 + start)
        .select(*df.columns, name)
    )


def eval_batch(
    split: Split,
    prompts,
    batch: int,
    n: int = 500,
    seed: int = 123,
    used: DataFrame | None = None,
    start_row_id: int = 0,
    roles: Roles = Roles(),
    warn: bool = True,
) -> DataFrame:
    """Rows to score: ``n`` of each validation year and ``n`` of each test year, with prompts.

    ``prompts`` turns sampled rows into the prompt table, which keeps the year. Both parts are drawn
    in the same two reads of the table. Rows are numbered validation first.
    """
    tagged = split.tagged("__part").where(F.col("__part") != "train").drop("__part")
    years = [*split.val_years, *split.test_years]
    rows = prompts(sample_excluding(tagged, years, n, seed, used, roles.id, split.year, warn))
    part = F.when(F.col(split.year).isin(*split.val_years), "validation").otherwise("test")
    return number_batch(rows.withColumn("split", part), batch, seed, start_row_id, roles)


def number_batch(
    rows: DataFrame, batch: int, seed: int = 123, start_row_id: int = 0, roles: Roles = Roles()
) -> DataFrame:
    """Prompt rows with running numbers, validation first. There are n rows per year, few enough for
    one task."""
    order = Window.partitionBy(F.lit(0)).orderBy(
        F.desc("split"), draw_order(seed, roles.id), F.col(roles.id).cast("string")
    )
    number = F.row_number().over(order) - 1 + start_row_id
    rest = [c for c in rows.columns if c != "split"]
    return rows.select(
        number.cast("bigint").alias("llm_row_id"), "split", *rest, F.lit(batch).alias("llm_batch")
    )
