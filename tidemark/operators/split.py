"""Splitting a table by period, as views on one table rather than copies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.roles import Roles

SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class Split:
    """The years of each part. Parts may overlap if the years say so.

    ``time`` names the date column whose calendar year ``year`` is, if that is known. Ranges of
    that column then go along with the years, and files of other years are not read.
    """

    table: DataFrame
    train_end: int
    val_years: tuple[int, ...]
    test_years: tuple[int, ...]
    year: str = "year"
    time: str | None = None

    def _start_of(self, year: int) -> Column:
        return F.lit(f"{year:04d}-01-01").cast(self.table.schema[self.time].dataType)

    def span(self, part: str) -> Column:
        """The dates between the first and last year of a part."""
        time = F.col(self.time)
        if part == "train":
            return time < self._start_of(self.train_end + 1)
        years = self.val_years if part == "val" else self.test_years
        if not years:
            return F.lit(False)
        return (time >= self._start_of(min(years))) & (time < self._start_of(max(years) + 1))

    def member(self, part: str) -> Column:
        year = F.col(self.year)
        if part == "train":
            inside = year <= self.train_end
        else:
            years = self.val_years if part == "val" else self.test_years
            inside = year.isin(*years) if years else F.lit(False)
        return inside if self.time is None else inside & self.span(part)

    def view(self, part: str) -> DataFrame:
        return self.table.where(self.member(part))

    @property
    def train(self) -> DataFrame:
        return self.view("train")

    @property
    def val(self) -> DataFrame:
        return self.view("val")

    @property
    def test(self) -> DataFrame:
        return self.view("test")

    def disjoint(self) -> bool:
        later = self.val_years + self.test_years
        return len(set(later)) == len(later) and all(y > self.train_end for y in later)

    def tagged(self, column: str = "split") -> DataFrame:
        """One scan with the part as a column, without the rows of no part."""
        if not self.disjoint():
            raise ValueError("the parts share years, use the views instead")
        tag = reduce(
            lambda tag, part: tag.when(self.member(part), part), SPLITS[1:],
            F.when(self.member("train"), "train"),
        )
        table = self.table
        if self.time is not None:
            table = table.where(reduce(Column.__or__, map(self.span, SPLITS)))
        return table.withColumn(column, tag).where(F.col(column).isNotNull())


def validate_split_input(
    df: DataFrame, roles: Roles = Roles(), year: str = "year"
) -> tuple[DataFrame, list[int]]:
    """Check that target, time and a whole-numbered year without gaps exist.

    Returns the table with an integer year, and the years present. Runs one job, whose result
    has a row per year.
    """
    missing = [c for c in (roles.target, roles.time, year) if c not in df.columns]
    if missing:
        raise ValueError(f"the table lacks columns needed for splitting: {missing}")
    whole = df
    if not isinstance(df.schema[year].dataType, T.IntegralType):
        whole = df.withColumn(year, F.col(year).try_cast("int"))
    found = df.select(F.col(year).alias("given")).distinct()
    rows = found.withColumn("whole", F.col("given").try_cast("int")).collect()
    if any(r["given"] is None for r in rows):
        raise ValueError(f"column '{year}' contains missing values")
    if any(r["whole"] is None for r in rows):
        raise ValueError(f"column '{year}' must be a whole number")
    return whole, sorted({r["whole"] for r in rows})


def years_present(df: DataFrame, year: str = "year") -> list[int]:
    """The years of a table, sorted. Their number is the number of calendar years covered."""
    return sorted(r[0] for r in df.select(year).distinct().collect() if r[0] is not None)


def temporal_split(
    df: DataFrame,
    train_end: int,
    val_years: Sequence[int] = (),
    test_years: Sequence[int] | None = None,
    roles: Roles = Roles(),
    year: str = "year",
    year_of_time: bool = False,
) -> Split:
    """Train up to ``train_end``; test on the given years, else on all later unused ones."""
    df, present = validate_split_input(df, roles, year)
    val = tuple(sorted(set(val_years)))
    if test_years is None:
        test = tuple(y for y in present if y > train_end and y not in val)
    else:
        test = tuple(sorted(set(test_years)))
    if not any(y <= train_end for y in present):
        raise ValueError("the split leaves no training rows")
    if not set(test) & set(present):
        raise ValueError("the split leaves no test rows")
    return Split(df, train_end, val, test, year, roles.time if year_of_time else None)


def temporal_split_tvt(
    df: DataFrame,
    train_end: int,
    val_year: int,
    test_years: Sequence[int],
    roles: Roles = Roles(),
    year: str = "year",
    year_of_time: bool = False,
) -> Split:
    """Train, one validation year, explicit test years; none may be empty.

    ``year_of_time`` says that the year column is the calendar year of the time column.
    """
    df, present = validate_split_input(df, roles, year)
    parts = {
        "training": any(y <= train_end for y in present),
        "validation": val_year in present,
        "test": bool(set(test_years) & set(present)),
    }
    for part, found in parts.items():
        if not found:
            raise ValueError(f"the split leaves no {part} rows")
    time = roles.time if year_of_time else None
    return Split(df, train_end, (val_year,), tuple(sorted(set(test_years))), year, time)


def period_subsets(test: DataFrame, year: str = "year") -> dict[int, DataFrame]:
    if year not in test.columns:
        raise ValueError(f"the table has no column '{year}'")
    return {y: test.where(F.col(year) == y) for y in years_present(test, year)}


def split_xy(
    df: DataFrame, columns: Sequence[str], roles: Roles = Roles()
) -> tuple[DataFrame, DataFrame]:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    if roles.target not in df.columns:
        raise ValueError(f"missing target column '{roles.target}'")
    return df.select(*columns), df.select(roles.target)


def describe_split(split: Split, roles: Roles = Roles()) -> DataFrame:
    """Three rows in one pass; a part without rows has n_rows 0 and NULLs."""
    parts = []
    for part in SPLITS:
        inside = split.member(part)
        parts.append(
            F.struct(
                F.lit(f"{part}_df").alias("split"),
                F.count_if(inside).alias("n_rows"),
                F.min(F.when(inside, F.col(split.year))).alias("min_year"),
                F.max(F.when(inside, F.col(split.year))).alias("max_year"),
                F.avg(F.when(inside, F.col(roles.target))).alias("default_rate"),
            )
        )
    return split.table.agg(F.array(*parts).alias("parts")).select(F.inline("parts"))


def describe_periods(test: DataFrame, roles: Roles = Roles(), year: str = "year") -> DataFrame:
    return test.groupBy(year).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(roles.target).alias("default_rate")
    )


def sample_balance(df: DataFrame, target: str, keys: Sequence[str] = ("split", "year")) -> DataFrame:
    """Rows with a label and their mean, by part and year."""
    return df.groupBy(*keys).agg(
        F.count(target).alias("count"), F.avg(target).alias("sample_default_rate")
    )
