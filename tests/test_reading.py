"""Files that earlier versions misread, tables laid out by period, orders and cardinality."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import clean, features, tables
from tidemark.operators.split import temporal_split
from tidemark.roles import Roles
from tidemark.session import local_table
from tidemark.sources import scan, sink

ROLES = Roles(target="y", time="issue_d", id="id", text=())


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_column_that_is_empty_in_one_file_has_the_type_of_the_other(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,p,llm_error\n1,0.5,\n2,0.25,\n")
    (tmp_path / "b.csv").write_text("llm_error,id,p,label\ntimeout,3,,1\n,4,1,0\n")
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv")]
    for order in (1, -1):
        found = scan.load_predictions(spark, paths[::order])
        assert dict(found.dtypes) == {
            "id": "bigint", "p": "double", "llm_error": "string", "label": "double", "file_order": "int"}
        assert rows_of(found.select("id", "p", "llm_error", "label")) == [
            (1, 0.5, None, None), (2, 0.25, None, None), (3, None, "timeout", 1.0), (4, 1.0, None, 0.0)]
    with pytest.raises(ValueError, match="no prediction files"):
        scan.load_predictions(spark, [])


def test_typed_files_beside_text_files(spark, tmp_path):
    # written with no error at all, the column has no type of its own
    for name, error in (("a", pa.nulls(2)), ("b", pa.array(["timeout", None]))):
        pq.write_table(pa.table({"id": pa.array([1, 2], pa.int32() if name == "a" else pa.int64()),
                                 "llm_error": error, "p": pa.array([0.5, None])}), tmp_path / f"{name}.parquet")
    (tmp_path / "c.csv").write_text("id,llm_error,p\n7,12,0.5\n")
    paths = [str(tmp_path / n) for n in ("a.parquet", "b.parquet", "c.csv")]
    found = scan.load_predictions(spark, paths[:2])
    assert dict(found.dtypes)["llm_error"] == "string" and dict(found.dtypes)["id"] == "bigint"
    assert rows_of(found.select("id", "llm_error")) == [(1, "timeout"), (1, None), (2, None), (2, None)]
    mixed = scan.load_predictions(spark, paths)
    assert rows_of(mixed.where("file_order = 2").select(F.col("id").cast("int"), "llm_error")) == [(7, "12")]


def test_required_columns_must_be_in_the_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,y\n1,1\n")
    schema = "id int, issue_d string, y int"
    with pytest.raises(ValueError, match="issue_d"):
        clean.load_clean(spark, str(tmp_path / "a.csv"), ROLES, schema=schema)
    (tmp_path / "b.csv").write_text("issue_d,y\n2015-01-01,1\n")
    assert clean.load_clean(spark, str(tmp_path / "b.csv"), ROLES, schema=schema).count() == 1


def test_unreadable_values_are_not_lost(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,p\n1,0.5\n2,half\n3,NA\n")
    found = scan.load_table(spark, str(tmp_path / "a.csv"), "id int, p double")
    assert found.select("id").count() == 3
    with pytest.raises(PySparkException, match="column 'p' holds no double: half"):
        found.collect()


def test_periods_are_folders_and_files_are_sorted(spark, tmp_path):
    rows = [(i, 2010 + i % 5, (i * 7919) % 1000, "v" * (i % 9)) for i in range(4000)]
    df = local_table(spark, rows, "id bigint, year int, k int, v string").repartition(7)
    path = sink.write_by_period(df, str(tmp_path / "t.parquet"), "year", ["k", "id"])
    again = scan.load_table(spark, path)
    assert rows_of(again.select(*df.columns)) == rows_of(df)
    parts = temporal_split(again.withColumns({"y": F.lit(1), "issue_d": F.lit(None)}), 2011, [2012], roles=ROLES)
    plan = parts.test._jdf.queryExecution().executedPlan().toString()
    assert "year" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # within a file keys rise, and files of a year do not overlap
    spans = {}
    for file in sorted((tmp_path / "t.parquet").glob("year=*/*.parquet")):
        keys = [(r["k"], r["id"]) for r in pq.ParquetFile(file).read(["k", "id"]).to_pylist()]
        assert keys == sorted(keys)
        spans.setdefault(file.parent.name, []).append((keys[0], keys[-1]))
    assert len(spans) == 5
    for found in spans.values():
        found.sort()
        assert all(a[1] < b[0] for a, b in zip(found, found[1:]))


def test_positions_over_many_ranges(spark):
    rows = [(i, (i * 7919) % 4001, None if i % 11 == 0 else "abc"[i % 3]) for i in range(4001)]
    df = local_table(spark, rows, "i int, k int, g string").repartition(6)
    found = tables.in_order(df, ["g", "k"], "n").collect()
    assert [r["n"] for r in found] == list(range(1, 4002))
    expected = sorted(rows, key=lambda r: (r[2] is not None, r[2] or "", r[1]))
    assert [(r["i"], r["k"], r["g"]) for r in found] == expected
    assert tables.in_order(df.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_cardinality_is_exact_at_its_limit(spark, limit):
    rows = [(str(i % limit), str(i % (limit + 1)), str(i), None, i, str(i % limit) if i % 2 else None)
            for i in range(5000)]
    df = local_table(spark, rows, "at string, above string, far string, none string, n int, gaps string")
    names = df.columns
    assert features.drop_high_cardinality(df, names, limit) == ["at", "none", "n", "gaps"]
