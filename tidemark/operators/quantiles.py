"""Quantiles of large columns without sorting them whole: exact, or estimated from mergeable sketches.

Exact ones take three scans of the needed columns, whatever the size. The first builds a sketch per
group and column, whose quantiles cut the column into cells. The second counts the rows of each cell;
running counts then say in which cell a wanted rank lies. The third counts the distinct values of these
cells, and running counts over them give the value at each rank. Counts are summed where the rows are
read, so a value held by any share of the rows is one row in every shuffle. The sketch only chooses where
to cut, so its error cannot reach the result.
"""

from __future__ import annotations

import math
import sys
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.functions.scores import add_cells
from tidemark.session import local_table

# Cells that a column is cut into, at least MIN_CELLS for each group, and the size of its sketch.
CELLS, MIN_CELLS, SKETCH = 2048, 32, 4096
LARGEST = sys.float_info.max


def interpolate(low: float, high: float, share: float) -> float:
    """Linear interpolation that returns the ends unchanged."""
    step = high - low
    return high - step * (1 - share) if share >= 0.5 else low + step * share


def finite(column: str | Column) -> Column:
    """The value as a double; missing and infinite ones are NULL."""
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(value.between(-LARGEST, LARGEST), value)


def sketch_points(sketch: Column, probs: Sequence[float]) -> Column:
    """Estimated quantiles; NULL for a sketch of no values."""
    points = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(float(p)) for p in probs]))
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, points)


def cut_points(df: DataFrame, column: str, parts: int) -> list[float]:
    """Values that cut a column into parts of about equal size, by a sketch; fewer if values repeat."""
    if parts < 2:
        return []
    sketch = F.kll_sketch_agg_double(finite(column), F.lit(max(8, min(4 * parts, 65535))))
    probs = [i / parts for i in range(1, parts)]
    [row] = df.agg(sketch.alias("sketch")).select(sketch_points(F.col("sketch"), probs)).collect()
    return sorted(set(row[0] or ()))


def _sketched(df, columns, by, cells, weight):
    """Per group and column the number of values, and per column where to cut it."""
    probs = [i / cells for i in range(1, cells)]
    sketches = df.groupBy(*by).agg(
        *[F.sum(F.when(finite(c).isNotNull(), weight)).alias(f"__n{i}") for i, c in enumerate(columns)],
        *[F.kll_sketch_agg_double(finite(c), F.lit(SKETCH)).alias(f"__s{i}") for i, c in enumerate(columns)],
    )
    rows = sketches.select(
        *by, *[f"__n{i}" for i in range(len(columns))],
        *[sketch_points(F.col(f"__s{i}"), probs).alias(f"__q{i}") for i in range(len(columns))],
    ).collect()
    total, edges = {}, {c: set() for c in columns}
    step = max(1, min(len(rows), cells // MIN_CELLS))
    for row in rows:
        for i, c in enumerate(columns):
            if row[f"__n{i}"]:
                total[(*(row[k] for k in by), c)] = row[f"__n{i}"]
                edges[c].update(row[f"__q{i}"][step - 1 :: step])
    return total, edges


def _long(df, columns, by, edges, weight):
    """Rows (by, column, cell, value, weight) without missing or infinite values."""
    parts = []
    for i, column in enumerate(columns):
        df = add_cells(df.withColumn(f"__v{i}", finite(column)), f"__v{i}", edges[column], f"__b{i}")
        parts.append(F.struct(
            F.lit(column).alias("column"), F.col(f"__b{i}").alias("cell"), F.col(f"__v{i}").alias("value")))
    return df.select(*by, weight.alias("weight"), F.inline(F.array(*parts))).where(F.col("value").isNotNull())


def _ranks(n: int, probs: Sequence[float]) -> list[int]:
    wanted = set()
    for p in probs:
        low = math.floor((n - 1) * p)
        wanted |= {low, min(low + 1, n - 1)}
    return sorted(wanted)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    cells: int = CELLS,
    weight: str | None = None,
) -> dict[tuple, list[float]]:
    """Linearly interpolated quantiles per group and column: ``{(*group, column): [...]}``.

    Missing and infinite values are left out; a group without values or name is absent. The result has
    one list per group, so ``by`` should name models and periods rather than ids. A row counts as many
    times as the whole number in ``weight`` says.
    """
    by, columns = list(by), list(columns)
    df = df.select(*by, *columns, *([weight] if weight else []))
    times = F.col(weight) if weight else F.lit(1).cast("bigint")
    if by:
        df = df.dropna(subset=by)
    total, edges = _sketched(df, columns, by, cells, times)
    if not total:
        return {}
    rows, group = _long(df, columns, by, edges, times), [*by, "column"]
    sizes = defaultdict(list)
    for row in rows.groupBy(*group, "cell").agg(F.sum("weight").alias("n")).collect():
        sizes[tuple(row[k] for k in group)].append((row["cell"], row["n"]))
    # the cells that hold wanted ranks, and these as ranks inside the cell
    inside = defaultdict(list)
    for key, found in sizes.items():
        found.sort()
        ends = list(accumulate(n for _, n in found))
        for rank in _ranks(total[key], probs):
            at = bisect_right(ends, rank)
            inside[(*key, found[at][0])].append(rank - (ends[at] - found[at][1]))
    values = _values_at(df.sparkSession, rows, group, inside)
    result = {}
    for key, n in total.items():
        at = dict(zip(_ranks(n, probs), (v for cell, _ in sorted(sizes[key]) for v in values.get((*key, cell), ()))))
        result[key] = [
            interpolate(at[math.floor((n - 1) * p)], at[min(math.floor((n - 1) * p) + 1, n - 1)],
                        (n - 1) * p - math.floor((n - 1) * p)) for p in probs
        ]
    return result


def _values_at(spark, rows, group, inside):
    """The values at the given ranks of some cells, from running counts of their distinct values."""
    key = [*group, "cell"]
    schema = rows.select(*key).schema.add("ranks", T.ArrayType(T.LongType()))
    wanted = local_table(spark, [(*k, ranks) for k, ranks in inside.items()], schema)
    counts = rows.join(wanted.select(*key), key, "left_semi").groupBy(*key, "value").agg(
        F.sum("weight").alias("n"))
    running = F.sum("n").over(Window.partitionBy(*key).orderBy("value"))
    hit = F.filter("ranks", lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))
    found = (
        counts.withColumn("upto", running).join(wanted, key)
        .select(*key, "value", F.size(hit).alias("times"), "upto").where("times > 0")
    )
    values = defaultdict(list)
    for row in sorted(found.collect(), key=lambda r: r["upto"]):
        values[tuple(row[k] for k in key)] += [row["value"]] * row["times"]
    return values


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    return {key[-1]: q[0] for key, q in exact_quantiles(df, columns, [0.5]).items()}
