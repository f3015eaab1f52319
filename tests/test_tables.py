"""Scans, cleaning, feature choice, splits, joins, one row per key."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import clean, dedup, features, joins, split
from tidemark.roles import FeatureGroups, Roles
from tidemark.session import local_table, scratch_path, shared_folder
from tidemark.sources import scan, sink

ROLES = Roles()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- scans


def write(folder, text, suffix):
    path = folder / f"table{suffix}"
    path.write_text(text)
    return str(path)


def test_delimited_file(spark, tmp_path):
    text = (
        "id,rate,flag,note,empty,mixed\n"
        '1,0.5,True,"two\nlines, and ""quotes""",,1\n'
        "2,NA,False, padded ,,x\n"
        "3,nan,True,n/a,NULL,2\n"
    )
    df = scan.load_table(spark, write(tmp_path, text, ".csv"))
    assert [f.dataType.simpleString() for f in df.schema] == [
        "bigint", "double", "boolean", "string", "double", "string"
    ]
    assert rows_of(df) == [
        (1, 0.5, True, 'two\nlines, and "quotes"', None, "1"),
        (2, None, False, " padded ", None, "x"),
        (3, None, True, None, None, "2"),
    ]


def test_whole_numbers_with_gaps_are_doubles(spark, tmp_path):
    df = scan.load_table(spark, write(tmp_path, "a,b\n1,2\n,3\n", ".txt"))
    assert rows_of(df) == [(1.0, 2), (None, 3)]


def test_schema_saves_the_inference(spark, tmp_path):
    path = write(tmp_path, "a,b\n1,NaN\n2,x\n", ".csv")
    df = scan.load_table(spark, path, "a double, b string", multi_line=False)
    assert rows_of(df) == [(1.0, None), (2.0, "x")]


def test_unreadable_paths(spark):
    with pytest.raises(FileNotFoundError):
        scan.load_table(spark, "/tmp/tidemark-no-such-table.parquet")
    with pytest.raises(FileNotFoundError):
        scan.load_table(spark, "/tmp/tidemark-no-such-table.csv")
    with pytest.raises(ValueError, match="json"):
        scan.load_table(spark, "/tmp/table.json")
    with pytest.raises(ValueError):
        scan.load_predictions(spark, [])
    with pytest.raises(ValueError):
        sink.write_metrics(local_table(spark, [], "a int"), "/tmp/x", fmt="xml")


def test_nan_becomes_null(spark):
    path = scratch_path(spark, "nan") + ".parquet"
    local_table(spark, [(float("nan"),), (1.0,)], "v double").write.parquet(path)
    assert rows_of(scan.load_table(spark, path)) == [(1.0,), (None,)]


def test_required_columns(spark):
    df = local_table(spark, [], "a int")
    with pytest.raises(ValueError, match="issue_d"):
        scan.validate_schema(df)
    assert scan.validate_schema(df, Roles(target="a", time="a")) is df


def test_text_survives_csv(spark):
    df = local_table(spark, [(1, ' a,"b"\n c\\d ')], "id bigint, note string")
    path = sink.write_metrics(df, scratch_path(spark, "text") + ".csv")
    assert rows_of(scan.load_table(spark, path)) == rows_of(df)


def test_json_lines_keep_nulls(spark):
    df = local_table(spark, [(1, None), (2, "ü")], "id int, v string")
    path = sink.write_json_lines(df, scratch_path(spark, "json"))
    lines = sorted(r[0] for r in spark.read.text(path).collect())
    assert lines == ['{"id":1,"v":null}', '{"id":2,"v":"ü"}']


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


# --- cleaning


def test_dates(spark):
    texts = [
        "2015-03-04", " 2015/03/04 ", "03/04/2015", "Mar-2015", "2015-03-04 05:06:07",
        "2015-13-04", "soon", None, "20150304", "Mar 4, 2015",
    ]
    df = local_table(spark, list(enumerate(texts)), "id int, issue_d string")
    found = {r["id"]: r["issue_d"].date() for r in clean.parse_time(df, "issue_d").collect()}
    day, month = dt.date(2015, 3, 4), dt.date(2015, 3, 1)
    assert found == {0: day, 1: day, 2: day, 3: month, 4: day, 8: day, 9: day}


def test_date_types(spark):
    df = local_table(spark, [(dt.date(2015, 3, 4),), (None,)], "issue_d date")
    parsed = clean.derive_time_parts(clean.parse_time(df, "issue_d"), "issue_d")
    assert [(r["year"], r["month"]) for r in parsed.collect()] == [(2015, 3)]
    with pytest.raises(ValueError):
        clean.parse_time(local_table(spark, [], "issue_d int"), "issue_d")


def test_date_shapes():
    assert clean.date_shape("yyyy-MM-dd") == r"^\d{4}\-\d{2}\-\d{2}$"
    assert clean.date_shape("yyyy-MM-dd'T'HH") == r"^\d{4}\-\d{2}\-\d{2}T\d{2}$"
    assert clean.date_shape("EEE yyyy") is None


def test_status_labels(spark):
    texts = ["Fully Paid", "Charged Off", "Default", "Current", "1", "0", None]
    df = local_table(spark, [(t,) for t in texts], "Default string")
    assert rows_of(clean.normalize_target(df, "Default")) == [(0,), (1,), (1,)]


def test_numeric_labels_are_truncated(spark):
    df = local_table(spark, [(0.7,), (1.9,), (None,), (float("nan"),)], "Default double")
    assert rows_of(clean.normalize_target(df, "Default")) == [(0,), (1,)]
    df = local_table(spark, [(True,), (False,)], "Default boolean")
    assert rows_of(clean.normalize_target(df, "Default")) == [(0,), (1,)]


def test_labels_must_be_binary(spark):
    df = local_table(spark, [("2015-01-01", 2)], "issue_d string, Default int")
    with pytest.raises(PySparkException, match="0 or 1, found 2"):
        clean.clean_table(df).count()


def test_clean_table(spark):
    df = local_table(
        spark,
        [("2015-02-01", "Default", "  hi \n"), ("bad", "Default", "x"),
         ("2016-02-01", "Current", "x"), ("2016-02-01", "Fully Paid", None)],
        "issue_d string, Default string, title string",
    )
    found = clean.clean_table(df).select("year", "month", "Default", "title")
    assert rows_of(found) == [(2015, 2, 1, "hi"), (2016, 2, 0, "")]


# --- features


@pytest.fixture(scope="module")
def loans(spark):
    rows = [
        (i, dt.datetime(2010 + i % 5, 1, 1), 2010 + i % 5, 1, i % 2, float(i), i % 3 == 0,
         f"z{i}", "ab"[i % 2], f"n{i}", "t")
        for i in range(200)
    ]
    return local_table(
        spark, rows,
        "id int, issue_d timestamp_ntz, year int, month int, Default int, amount double, "
        "flag boolean, zip_code string, grade string, name string, title string",
    )


def test_feature_choice(loans):
    assert features.select_features(loans) == ["amount", "flag", "grade", "name"]
    assert features.select_features(loans, drop_zip_code=False, extra_drop=["name"]) == [
        "amount", "flag", "zip_code", "grade"
    ]
    assert "title" in features.select_features(loans, include_text=True)
    assert "id" in features.select_features(loans, include_id=True)
    groups = features.feature_groups(loans, max_cardinality=2, include_text=True)
    assert groups == FeatureGroups(
        ("amount", "flag", "grade", "title"), ("amount", "flag"), ("grade", "title"), ("title",)
    )
    assert features.drop_high_cardinality(loans, ["amount"], 1) == ["amount"]
    with pytest.raises(ValueError):
        FeatureGroups((), (), ()).require()


def test_cardinality_limit_is_inclusive(loans):
    assert features.drop_high_cardinality(loans, ["name"], 200) == ["name"]
    assert features.drop_high_cardinality(loans, ["name"], 199) == []


# --- splits


def test_default_test_years(loans):
    parts = split.temporal_split(loans, 2011, [2013])
    assert parts.test_years == (2012, 2014) and parts.disjoint()
    assert parts.train.count() == 80 and parts.val.count() == 40 and parts.test.count() == 80
    counts = dict(rows_of(parts.tagged().groupBy("split").count()))
    assert counts == {"train": 80, "val": 40, "test": 80}


def test_dates_go_along_with_known_years(loans):
    plain = split.temporal_split(loans, 2011, [2013])
    dated = split.temporal_split(loans, 2011, [2013], year_of_time=True)
    for part in split.SPLITS:
        assert rows_of(dated.view(part)) == rows_of(plain.view(part))
    assert rows_of(dated.tagged()) == rows_of(plain.tagged())
    assert rows_of(split.describe_split(dated)) == rows_of(split.describe_split(plain))


def test_overlapping_years(loans):
    parts = split.temporal_split_tvt(loans, 2012, 2012, (2012, 2014))
    assert not parts.disjoint()
    assert parts.val.count() == 40 and parts.test.count() == 80
    with pytest.raises(ValueError):
        parts.tagged()


@pytest.mark.parametrize("args, part", [
    ((2000, 2011, (2012,)), "training"),
    ((2010, 2030, (2012,)), "validation"),
    ((2010, 2011, (2030,)), "test"),
])
def test_empty_parts(loans, args, part):
    with pytest.raises(ValueError, match=part):
        split.temporal_split_tvt(loans, *args)


def test_empty_parts_of_the_open_split(loans):
    with pytest.raises(ValueError, match="training"):
        split.temporal_split(loans, 2000)
    with pytest.raises(ValueError, match="test"):
        split.temporal_split(loans, 2020)


def test_split_input(spark, loans):
    with pytest.raises(ValueError, match="lacks"):
        split.validate_split_input(loans.drop("Default"))
    for bad in (F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit("soon")):
        with pytest.raises(ValueError):
            split.validate_split_input(loans.withColumn("year", bad))
    df, years = split.validate_split_input(loans.withColumn("year", F.col("year").cast("string")))
    assert years == [2010, 2011, 2012, 2013, 2014]
    assert df.schema["year"].dataType.simpleString() == "int"


def test_describe_split(loans):
    rows = split.describe_split(split.temporal_split(loans, 2011)).collect()
    assert [tuple(r)[:4] for r in rows] == [
        ("train_df", 80, 2010, 2011), ("val_df", 0, None, None), ("test_df", 120, 2012, 2014)
    ]
    assert rows[1]["default_rate"] is None


def test_split_xy(loans):
    x, y = split.split_xy(loans, ["amount"])
    assert x.columns == ["amount"] and y.columns == ["Default"]
    with pytest.raises(ValueError):
        split.split_xy(loans, ["absent"])
    with pytest.raises(ValueError):
        split.split_xy(loans.drop("Default"), ["amount"])
    with pytest.raises(ValueError):
        split.period_subsets(loans.drop("year"))


# --- joins and keys


def test_checked_join(spark):
    a = local_table(spark, [(1, "x"), (1, "y"), (2, "z")], "k int, a string")
    b = local_table(spark, [(1, "p")], "k int, b string")
    assert rows_of(joins.checked_join(a, b, ["k"], "left", "many_to_one")) == [
        (1, "x", "p"), (1, "y", "p"), (2, "z", None)
    ]
    with pytest.raises(PySparkException, match="left side has several rows for .*1"):
        joins.checked_join(a, b, ["k"], "left", "one_to_one").collect()
    with pytest.raises(PySparkException, match="right side"):
        joins.checked_join(b, a, ["k"], "left", "many_to_one").count()
    assert joins.checked_join(b, a, ["k"], "left", "one_to_many").count() == 2
    with pytest.raises(ValueError):
        joins.checked_join(a, b, ["k"], "left", "some_to_some")


def test_sample_must_be_in_the_source_once(spark):
    sample = local_table(spark, [("1", 0.5), ("1", 0.7)], "id string, p double")
    source = local_table(spark, [(1, 2015, 9.0), (2, 2016, 8.0)], "id int, year int, p double")
    found = joins.join_sample_to_source(sample, source, "id")
    assert rows_of(found) == [("1", 0.5, 2015), ("1", 0.7, 2015)]
    with pytest.raises(PySparkException, match="source has several rows for .*1"):
        joins.join_sample_to_source(sample, source.unionByName(source), "id").collect()
    lost = local_table(spark, [("1", 0.5), ("7", 0.7)], "id string, p double")
    with pytest.raises(PySparkException, match="not found in the source: .*7"):
        joins.join_sample_to_source(lost, source, "id").collect()
    # a duplicate that was not sampled does no harm
    other = source.where("id = 2")
    assert joins.join_sample_to_source(sample, source.unionByName(other), "id").count() == 2


def test_excluded_ids_compare_as_text(spark):
    df = local_table(spark, [(1,), (2,), (None,)], "id int")
    used = local_table(spark, [("2",), (None,)], "id string")
    assert rows_of(joins.exclude_ids(df, used, "id")) == [(1,), (None,)]


def test_size_of_key_lists_is_left_to_the_optimizer(spark):
    keys = spark.range(50)
    plan = joins.keep_in_table(spark.range(9), keys, "id")._jdf.queryExecution().logical().toString()
    assert "hint" not in plan.lower()


def test_one_row_per_key(spark):
    rows = [(1, 3, "c", None), (1, 1, "a", 5), (2, 9, "z", 6), (1, 2, "b", 7)]
    df = local_table(spark, rows, "k int, t int, v string, n int").repartition(3)
    assert rows_of(dedup.keep_last(df, ["k"], ["t"])) == [(1, 3, "c", None), (2, 9, "z", 6)]
    assert rows_of(dedup.keep_first(df, ["k"], ["t"])) == [(1, 1, "a", 5), (2, 9, "z", 6)]
    assert rows_of(dedup.count_duplicates(df, ["k"])) == [(4, 2, 2)]


def test_unreadable_column_fails(spark):
    with pytest.raises(PySparkException):
        clean.parse_time(local_table(spark, [], "a int"), "absent")
