"""Exact quantiles against sorting, with few and many cells."""

import numpy as np
import pytest

from tidemark.operators.quantiles import exact_quantiles, interpolate, medians
from tidemark.session import local_table

PROBS = [float(p) for p in np.linspace(0, 1, 11)]


def expected(values, probs=PROBS):
    return [float(x) for x in np.quantile(np.array(values, dtype=float), probs)]


def numbers(spark, columns, schema):
    return local_table(spark, list(zip(*columns)), schema)


@pytest.mark.parametrize("cells", [2, 40, 2048])
def test_shapes(spark, cells):
    rng = np.random.default_rng(7)
    flat = rng.normal(size=3000)
    heavy = np.where(rng.random(3000) < 0.4, 5.0, rng.integers(0, 60, 3000).astype(float))
    wide = np.exp(rng.normal(size=3000) * 40)
    df = numbers(
        spark, [flat.tolist(), heavy.tolist(), wide.tolist()], "a double, b double, c double"
    )
    found = exact_quantiles(df.repartition(5), ["a", "b", "c"], PROBS, cells=cells)
    assert found[("a",)] == expected(flat)
    assert found[("b",)] == expected(heavy)
    assert found[("c",)] == expected(wide)


@pytest.mark.parametrize("cells", [2, 100, 2048])
def test_groups(spark, cells):
    rng = np.random.default_rng(3)
    group = rng.choice(["x", "y", "z"], 2000, p=[0.8, 0.19, 0.01])
    value = np.round(rng.random(2000), 2) + (group == "y")
    df = numbers(spark, [group.tolist(), value.tolist()], "g string, v double")
    probs = [float(p) for p in np.linspace(0, 1, 30)]
    found = exact_quantiles(df, ["v"], probs, ["g"], cells)
    assert set(found) == {("x", "v"), ("y", "v"), ("z", "v")}
    for g in "xyz":
        assert found[g, "v"] == expected(value[group == g], probs)


def test_groups_without_a_name_are_left_out(spark):
    df = numbers(spark, [["x", None], [1.0, 2.0]], "g string, v double")
    assert exact_quantiles(df, ["v"], [0.5], ["g"]) == {("x", "v"): [1.0]}


def test_missing_and_infinite_values_are_left_out(spark):
    inf, nan = float("inf"), float("nan")
    df = numbers(spark, [[1.0, None, nan, inf, -inf, 2.0, 4.0]], "v double")
    assert exact_quantiles(df, ["v"], [0.0, 0.5, 1.0]) == {("v",): [1.0, 2.0, 4.0]}
    assert exact_quantiles(df.where("v is null"), ["v"], [0.5]) == {}


def test_neighbouring_doubles(spark):
    low = 1.0
    high = float(np.nextafter(1.0, 2.0))
    df = numbers(spark, [[low] * 30 + [high] * 31], "v double")
    found = exact_quantiles(df, ["v"], [0.0, 0.5, 1.0], cells=2)
    assert found == {("v",): [low, high, high]}


def test_one_row_and_whole_numbers(spark):
    df = numbers(spark, [[3], [True]], "v bigint, b boolean")
    assert exact_quantiles(df, ["v", "b"], [0.3]) == {("v",): [3.0], ("b",): [1.0]}
    assert medians(numbers(spark, [[1, 2, 3, 4]], "v int"), ["v"]) == {"v": 2.5}


def test_interpolation_keeps_the_ends():
    assert interpolate(0.1, 0.1, 0.3) == 0.1
    assert interpolate(1.0, 3.0, 0.25) == 1.5
