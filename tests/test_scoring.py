"""Sampling, prompts, replies, resumable scoring, preparation, models, reports."""

import json
import logging

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.names import base_feature
from tidemark.operators import matched, metrics, prepare, prompts, reliance, sampling, scoring
from tidemark.operators.foreign import ForeignModel
from tidemark.operators.split import temporal_split_tvt
from tidemark.plans import reports
from tidemark.roles import FeatureGroups, Roles
from tidemark.session import local_table, scratch_path
from tidemark.streaming import resume

ROLES = Roles(target="target", time="year", id="id", text=())
GROUPS = FeatureGroups(("amount", "gap", "grade"), ("amount", "gap"), ("grade",))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def loans(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(3000):
        amount, grade = float(rng.normal()), "ABC"[int(rng.integers(0, 3))]
        logit = 1.5 * amount - 1.0 + (grade == "C")
        target = int(rng.random() < 1 / (1 + np.exp(-logit)))
        gap = None if i % 10 == 0 else float(i % 7)
        rows.append((i, 2010 + i % 6, target, amount, gap, None if i % 50 == 0 else grade))
    schema = "id bigint, year int, target int, amount double, gap double, grade string"
    return local_table(spark, rows, schema).repartition(4).persist()


@pytest.fixture(scope="module")
def parts(loans):
    return temporal_split_tvt(loans, 2012, 2013, (2014, 2015), ROLES)


# --- sampling


def test_sample_is_reproducible_and_bounded(loans):
    first = rows_of(sampling.sample_per_year(loans, 30, seed=1))
    again = rows_of(sampling.sample_per_year(loans.repartition(9), 30, seed=1))
    other = rows_of(sampling.sample_per_year(loans, 30, seed=2))
    assert first == again != other
    assert len(first) == 180 and len(set(r[0] for r in first)) == 180
    assert sampling.sample_per_year(loans, 10_000).count() == 3000


def test_larger_samples_contain_smaller_ones(loans):
    drawn = [set(rows_of(sampling.sample_per_year(loans, n))) for n in (1, 30, 200, 499, 500, 501)]
    assert all(a <= b for a, b in zip(drawn, drawn[1:]))
    assert [len(d) for d in drawn] == [6, 180, 1200, 2994, 3000, 3000]


@pytest.mark.parametrize("n", [1, 300, 1000, 1001, 4999])
def test_rows_without_or_with_one_id_are_drawn_in_full(spark, n):
    rows = [(None if i % 5 == 0 else 7 if i % 5 < 3 else i, 2010, i) for i in range(5000)]
    rows += [(3, None, 1), (4, None, 2)]
    df = local_table(spark, rows, "id int, year int, v int")
    first = rows_of(sampling.sample_per_year(df.repartition(3), n))
    again = rows_of(sampling.sample_per_year(df.repartition(7), n))
    assert first == again and len(first) == n + min(n, 2)


def test_repeated_ids_do_not_exceed_the_size(spark):
    rows = [(7, 2010)] * 40 + [(i, 2010) for i in range(100, 120)]
    df = local_table(spark, rows, "id int, year int").repartition(3)
    assert sampling.sample_per_year(df, 25).count() == 25


def test_used_ids_are_not_drawn_again(loans, caplog):
    first = sampling.sample_excluding(loans, [2014, 2015], 300)
    with caplog.at_level(logging.WARNING):
        second = sampling.sample_excluding(loans, [2014, 2015], 300, used=first)
    assert first.count() == 600 and second.count() == 400
    assert not {r["id"] for r in first.collect()} & {r["id"] for r in second.collect()}
    assert "found 200" in caplog.text


def test_sampling_needs_columns(loans):
    with pytest.raises(ValueError):
        sampling.sample_per_year(loans.drop("year"), 5)
    with pytest.raises(ValueError):
        sampling.sample_excluding(loans.drop("id"), [2014], 5)


@pytest.mark.parametrize("cells", [1, 4, 50])
def test_row_ids(loans, cells):
    rows = sampling.row_ids(loans, "id", 10, cells=cells).select("id", "row_id").collect()
    assert all(r["row_id"] == r["id"] + 10 for r in rows) and len(rows) == 3000


def test_eval_batch(spark, parts):
    config = prompts.PromptConfig(text=("grade",), context=("amount",))
    rows = sampling.eval_batch(
        parts, lambda df: prompts.prompt_table(df, config, ROLES), 2, n=40, start_row_id=5,
        roles=ROLES,
    )
    found = rows.orderBy("llm_row_id").collect()
    assert [r["llm_row_id"] for r in found] == list(range(5, 125))
    assert [r["split"] for r in found] == ["validation"] * 40 + ["test"] * 80
    assert rows.columns == [
        "llm_row_id", "split", "id", "year", "text_block", "structured_context", "llm_prompt",
        "target", "llm_batch",
    ]
    # the same rows whatever the partitioning
    assert {r["id"] for r in found if r["year"] == 2013} <= {
        r["id"] for r in parts.val.select("id").collect()
    }


# --- texts


@pytest.mark.parametrize("value", [
    "", " ", " x　", "a b", "\x1c a\n\t", "x" * 500, "x" * 501, "y" * 495 + "     zzz",
    "é" * 600, "a​ ", "\r\nline\r\n",
])
def test_text_rules(spark, value):
    df = local_table(spark, [(value,)], "v string")
    row = df.select(
        text.strip(F.col("v")).alias("s"), text.rstrip(F.col("v")).alias("r"),
        text.truncate(F.col("v"), 500).alias("t"),
    ).first()
    assert row["s"] == value.strip() and row["r"] == value.rstrip()
    cut = value if len(value) <= 500 else value[:497].rstrip() + "..."
    assert row["t"] == cut


def test_numbers_as_text(spark):
    values = [
        7200.0, 0.5, 1e7, 12345678.9, 123456789012345.0, 1e16, 1.5e300, -2.5e17, 1e-4, 0.00012,
        1e-5, -1.25e-7, 0.0, -0.0, 1e15, 9007199254740993.0, 0.001, 0.1 + 0.2, 3.0000000000000004,
    ]
    df = local_table(spark, list(enumerate(values)), "i int, v double")
    shown = df.select("i", text.as_text(F.col("v"), df.schema["v"].dataType).alias("s"))
    for row in shown.collect():
        assert row["s"] == str(values[row["i"]])
    flags = local_table(spark, [(True,), (False,), (None,)], "v boolean")
    shown = flags.select(text.as_text(F.col("v"), flags.schema["v"].dataType))
    assert [r[0] for r in shown.collect()] == ["True", "False", None]


def test_prompt_stand_ins(spark):
    df = local_table(
        spark, [(1, 2010, None, " ", None, None)],
        "id int, year int, title string, desc string, amount double, kind string",
    )
    config = prompts.PromptConfig(context=("amount", "kind"))
    row = prompts.prompt_table(df, config).first()
    assert row["text_block"] == "" and row["structured_context"] == ""
    assert "Structured context:\n(none provided)\n" in row["llm_prompt"]
    assert "Borrower text:\n(no text provided)\n" in row["llm_prompt"]
    assert row["llm_prompt"].endswith("- default_probability\n- rationale")


def test_prompt_blocks(spark):
    df = local_table(
        spark, [(1, 2010, " Car \n", "fix it", 7200.0, "", 3, 1)],
        "id int, year int, title string, desc string, amount double, kind string, n int, Default int",
    )
    config = prompts.PromptConfig(context=("amount", "absent", "kind", "n"))
    row = prompts.prompt_table(df, config, years=[2010], sample=5).first()
    assert row["text_block"] == "title: Car\ndesc: fix it"
    assert row["structured_context"] == "amount: 7200.0\nkind: \nn: 3"
    assert row["Default"] == 1
    assert prompts.prompt_table(df, config, years=[2011]).count() == 0
    bare = prompts.PromptConfig(with_context=False, with_target=False)
    row = prompts.prompt_table(df, bare).first()
    assert row["structured_context"] == "" and "Default" not in row.asDict()
    with pytest.raises(ValueError, match="text columns"):
        prompts.prompt_table(df.drop("title", "desc"))
    with pytest.raises(ValueError, match="year"):
        prompts.prompt_table(df.drop("year"), years=[2010])


def test_replies(spark):
    replies = [
        json.dumps({"default_probability": 1.7, "predicted_label": 1}),
        json.dumps({"default_probability": -0.2, "predicted_label": 0}),
        json.dumps({"default_probability": "0.25", "predicted_label": "1"}),
        json.dumps({"predicted_label": 1}),
        json.dumps({"default_probability": 0.5}),
        "{not json", None,
        '{"default_probability": 0.5, "predicted_label": 1',
        '{"default_probability": 0.5, "predicted_label": 1} and more',
        '{"default_probability": 0.5, "predicted_label": 1}, {}',
        "{'default_probability': 0.5, 'predicted_label': 1}",
    ]
    df = local_table(spark, list(enumerate(replies)), "i int, raw string")
    found = {r["i"]: r for r in prompts.parse_reply(df, "raw").collect()}
    assert [found[i]["llm_default_probability"] for i in range(3)] == [1.0, 0.0, 0.25]
    assert [found[i]["llm_predicted_label_raw"] for i in range(3)] == [1, 0, 1]
    for i in range(3, len(replies)):
        assert found[i]["llm_error"] is not None
        assert found[i]["llm_default_probability"] is None
    unlabelled = prompts.parse_reply(df, "raw", label_path=None).where("i = 5").first()
    assert unlabelled["llm_error"] == "unreadable reply"


def test_resumed_scoring(spark):
    schema = "llm_row_id int, attempt int, llm_default_probability double, llm_error string"
    inputs = local_table(spark, [(i,) for i in range(5)], "llm_row_id int")
    old = local_table(spark, [(0, 1, 0.1, None), (1, 1, None, "x"), (2, 1, None, None)], schema)
    pending = resume.pending_rows(inputs, old)
    assert rows_of(pending) == [(1,), (2,), (3,), (4,)]
    assert rows_of(resume.pending_rows(inputs, old, retry_errors=False)) == [(3,), (4,)]
    new = local_table(spark, [(i, 2, 0.5, None) for i in (1, 2, 3)] + [(4, 2, None, "y")], schema)
    merged = resume.merge_attempts(old, new, ["attempt"])
    assert [(r[0], r[1]) for r in rows_of(merged)] == [(0, 1), (1, 2), (2, 2), (3, 2), (4, 2)]
    again = resume.merge_attempts(merged, new, ["attempt"])
    assert rows_of(again) == rows_of(merged)
    assert tuple(prompts.error_counts(merged).first()) == (5, 1)


def test_combined_predictions(spark):
    rows = [(1, 0, 5, "a"), (1, 0, 3, "b"), (1, 1, 1, "c"), (2, 1, 2, "d")]
    df = local_table(spark, rows, "id int, file_order int, llm_row_id int, v string")
    assert rows_of(resume.combine_predictions(df).select("id", "v")) == [(1, "b"), (2, "d")]


# --- preparation and models


def test_preparation(spark, parts):
    stages = prepare.preparation_stages(parts.train, GROUPS.numeric, GROUPS.categorical)
    ready = stages.transform(parts.train)
    assert prepare.slot_names(ready) == [
        "num__amount", "num__gap", "cat__grade_A", "cat__grade_B", "cat__grade_C"
    ]
    slots = ready.select(vector_to_array("features").alias("v"))
    stats = slots.agg(
        *[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(2)],
        *[F.stddev_pop(F.col("v")[i]).alias(f"s{i}") for i in range(2)],
    ).first()
    assert [stats["m0"], stats["m1"]] == pytest.approx([0, 0], abs=1e-9)
    assert [stats["s0"], stats["s1"]] == pytest.approx([1, 1])
    unseen = local_table(spark, [(0.0, None, "Z"), (0.0, 1.0, None)],
                         "amount double, gap double, grade string")
    codes = [r["v"][2:] for r in stages.transform(unseen).select(
        vector_to_array("features").alias("v")).collect()]
    common = prepare.modes(prepare.level_counts(parts.train, ["grade"]))["grade"]
    assert codes == [[0, 0, 0], [float(common == g) for g in "ABC"]]


def test_preparation_edges(spark):
    df = local_table(
        spark, [(2.0, "b'\\", None), (2.0, "a", None), (None, "a", None), (2.0, "b'\\", None)],
        "k double, t string, e double",
    )
    learnt = prepare.fit_preparation(df, ["k"], ["t"])
    assert learnt.stats["k"] == (2.0, 1.0) and learnt.modes["t"] == "a"
    ready = prepare.preparation_stages(df, ["k"], ["t"]).transform(df)
    assert [r["v"].toArray().tolist() for r in ready.select(F.col("features").alias("v")).collect()] == [
        [0, 0, 1], [0, 1, 0], [0, 1, 0], [0, 0, 1]
    ]
    with pytest.raises(ValueError, match="without any value"):
        prepare.fit_preparation(df, ["e"], [])


def test_all_categories_are_counted(spark):
    df = spark.range(12_000).selectExpr("concat('c', id) AS t")
    assert len(prepare.level_counts(df, ["t"])["t"]) == 12_000


@pytest.fixture(scope="module")
def logistic(parts):
    return scoring.fit_logistic(parts.train, GROUPS, ROLES)


@pytest.fixture(scope="module")
def trees(parts):
    config = scoring.BoostedTreesConfig(n_trees=10, max_depth=3, learning_rate=0.3)
    return scoring.fit_boosted_trees(parts.train, GROUPS, ROLES, config)


def test_logistic_solves_the_ridge_problem(parts, logistic):
    ready = parts.train.select(*GROUPS.features, "target")
    for stage in logistic.pipeline.stages[:-1]:
        ready = stage.transform(ready)
    rows = ready.select(vector_to_array("features").alias("x"), "target").collect()
    x = np.array([r["x"] for r in rows])
    y = np.array([r["target"] for r in rows])
    model = logistic.estimator
    w = model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ w + model.intercept)))
    # gradient of the summed loss plus half the squared weights
    assert np.abs(x.T @ (p - y) + w).max() < 0.05 * len(y) / 100
    assert abs((p - y).sum()) < 0.05 * len(y) / 100


def test_models_find_the_signal(parts, logistic, trees):
    rows = parts.tagged().where("split <> 'train'")
    pred = scoring.score_long(rows, [logistic, trees], ["split", "year"], "target")
    assert pred.count() == 2 * rows.count()
    found = metrics.metric_table(metrics.validate_scores(pred), ["model"], 0.5).collect()
    assert {r["model"] for r in found} == {"logreg", "trees"}
    assert all(r["auc"] > 0.75 for r in found)


def test_mlp(parts):
    config = scoring.NeuralConfig(components=4, hidden=(6, 4), max_iter=60)
    model = scoring.fit_mlp(parts.train, GROUPS, ROLES, config)
    pred = scoring.score_long(parts.test, [model], ["year"], "target")
    assert metrics.metric_table(pred, ["model"], 0.5).first()["auc"] > 0.7


def test_network_runs_on_the_jvm_and_survives_saving(parts, tmp_path):
    config = scoring.NeuralConfig(components=4, hidden=(6, 4), max_iter=20)
    model = scoring.fit_mlp(parts.train, GROUPS, ROLES, config)
    scored = model.score(parts.test)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Arrow", "Pandas") if w in plan]
    model.pipeline.write().save(str(tmp_path / "model"))
    again = scoring.FittedModel("again", GROUPS, PipelineModel.load(str(tmp_path / "model")), model.slots)
    both = again.score(scored, "y_again").select("y_prob", "y_again").collect()
    assert both and all(r["y_prob"] == r["y_again"] for r in both)


def test_projection_multiplies_by_the_matrix(spark):
    matrix = np.arange(12.0).reshape(6, 2)
    rows = [(Vectors.sparse(6, [1, 3], [1.0, 2.0]),), (Vectors.dense([1, 0, 0, 0, 0, 1.0]),)]
    found = scoring.projection(matrix).transform(spark.createDataFrame(rows, ["features"])).collect()
    for r in found:
        assert r["reduced"].toArray().tolist() == (r["features"].toArray() @ matrix).tolist()


def halves(**options):
    """A model whose class travels with it."""

    class Halves:
        def __init__(self, shape=None, blob=b""):
            self.shape, self.blob = shape, blob

        def predict_proba(self, rows):
            p = rows["b"].map(len).to_numpy() / 10 + rows["a"].to_numpy() * 0
            return np.zeros(self.shape) if self.shape else np.column_stack([1 - p, p])

    return Halves(**options)


def test_any_object_with_probabilities_can_score(spark):
    df = local_table(spark, [(1, "xx", 0), (2, "xyz", 1), (None, "q", 1)], "a int, b string, `y true` int")
    model = ForeignModel("f", halves(), {"a": "double", "b": "string"})
    found = model.score(df.repartition(2))
    assert found.columns == ["a", "b", "y true", "y_prob"]
    assert {(r["a"], r["y_prob"]) for r in found.where("a IS NOT NULL").collect()} == {(1, 0.2), (2, 0.3)}
    # a number the model cannot use stays its own affair: NaN in, no score out
    assert found.where("a IS NULL").first()["y_prob"] is None
    assert model.score(df.where("false")).count() == 0
    pred = scoring.score_long(df, [model, ForeignModel("g", halves(), model.inputs)], ["b"], "y true")
    assert pred.count() == 6
    with pytest.raises(ValueError, match="lacks columns"):
        model.score(df.drop("a"))
    with pytest.raises(ValueError, match="to be broadcast"):
        ForeignModel("f", halves(blob=bytes(5000)), model.inputs, most_bytes=4000).score(df)
    with pytest.raises(PySparkException, match="two classes"):
        ForeignModel("f", halves(shape=(1, 3)), model.inputs).score(df.coalesce(1)).collect()


def test_balanced_weights_raise_scores(parts, logistic):
    balanced = scoring.fit_logistic(
        parts.train, GROUPS, ROLES, scoring.LogisticConfig(class_weight="balanced")
    )
    plain = logistic.score(parts.test).agg(F.avg("y_prob")).first()[0]
    raised = balanced.score(parts.test).agg(F.avg("y_prob")).first()[0]
    assert abs(raised - 0.5) < abs(plain - 0.5)


def test_model_guards(parts):
    with pytest.raises(ValueError):
        scoring.fit_logistic(parts.train, FeatureGroups((), (), ()), ROLES)
    with pytest.raises(ValueError, match="target"):
        scoring.fit_logistic(parts.train.drop("target"), GROUPS, ROLES)


def test_labels_from_scores(parts, logistic):
    rows = scoring.predict_label(logistic, parts.test, 0.4).select("y_prob", "y_pred").collect()
    assert all(r["y_pred"] == int(r["y_prob"] >= 0.4) for r in rows)


# --- reliance


def test_longest_column_wins(spark):
    names = ["cat__home_ownership_n_RENT", "num__amount", "cat__home_x", "cat__cat__x", "other"]
    df = local_table(spark, [(n,) for n in names], "n string")
    found = df.select(base_feature(F.col("n"), ["amount"], ["home", "home_ownership_n"]))
    assert [r[0] for r in found.collect()] == ["home_ownership_n", "amount", "home", "cat__x", "other"]


def test_reliance(spark, loans, logistic, trees):
    tables = reports.reliance_report(logistic, trees, loans, scratch_path(spark, "reliance"))
    base = {r["base_feature"]: r for r in tables["logreg_feature_importance"].collect()}
    weights = np.abs(logistic.estimator.coefficients.toArray())
    assert base["grade"]["importance_abs"] == pytest.approx(weights[2:].sum())
    assert base["grade"]["n_transformed_features"] == 3
    assert sum(r["importance"] for r in tables["trees_feature_importance"].collect()) == (
        pytest.approx(1.0)
    )
    overlap = tables["feature_importance_overlap"].collect()
    assert [r["overlap_count"] for r in overlap] == [3, 3, 3]
    with pytest.raises(ValueError):
        reliance.slot_weights(loans, logistic, [1.0])


def test_overlap_of_nothing(spark):
    empty = local_table(spark, [], "base_feature string, importance_abs double")
    row = reliance.topk_overlap(empty, empty, (5,)).first()
    assert row["jaccard_overlap"] is None and row["overlapping_features"] == ""


# --- reports


def test_tuned_models(spark, parts):
    models, tables = reports.run_tuned_models(
        parts, GROUPS, {"logreg": scoring.fit_logistic}, ROLES, scratch_path(spark, "tuned")
    )
    performance = tables["temporal_metrics"].orderBy("year").collect()
    assert [(r["year"], r["time_gap"]) for r in performance] == [(2014, 1), (2015, 2)]
    assert tables["reliability_bins"].count() == 20
    assert tables["validation_threshold_search"].count() > 400
    best = tables["best_thresholds"].first()
    assert performance[0]["threshold"] == best["threshold"]
    pred = scoring.score_long(parts.test, models, ["year"], "target")
    direct = metrics.metric_table(pred, ["model", "year"], best["threshold"]).orderBy("year")
    for a, b in zip(performance, direct.collect()):
        assert a["auc"] == pytest.approx(b["auc"]) and a["f1"] == pytest.approx(b["f1"])
    drift = local_table(spark, [(2014, 1, 0.2, 0.5)], "year int, n_rows int, default_rate double, psi double")
    final = reports.final_summary(
        tables["temporal_metrics"], tables["temporal_calibration"], drift
    )
    rows = final["final_summary"].orderBy("year").collect()
    assert rows[0]["psi"] == 0.5 and rows[1]["psi"] is None and "drift_n_rows" in rows[0].asDict()
    first = final["drift_comparison"].orderBy("year").first()
    assert first["auc_drop_from_first_test_year"] == 0.0
    assert final["summary_table"].columns[0] == "model"


def test_drift_report(spark, parts):
    tables = reports.drift_report(parts, GROUPS.features, ROLES, scratch_path(spark, "drift"))
    assert tables["psi_by_feature_year"].count() == 6
    assert tables["drift_summary_by_year"].count() == 2


def test_matched_comparison(spark, loans, parts, logistic):
    rows = loans.where("year >= 2013 and id % 5 = 0")
    scored = rows.select(
        "id", F.col("id").alias("llm_row_id"), F.lit(1).alias("llm_batch"),
        F.when(F.col("year") == 2013, "validation").otherwise("test").alias("split"), "year",
        "target", F.lit("outside").alias("llm_model"),
        (F.pmod("id", F.lit(11)) / 10.0).alias("llm_default_probability"),
        F.lit(1).alias("llm_predicted_label_raw"), F.lit(None).cast("string").alias("llm_error"),
    )
    tables = reports.matched_comparison(loans.where("year >= 2013"), scored, [logistic], ROLES)
    summary = tables["sample_matched_model_summary"].collect()
    assert [r["model"] for r in summary] == ["logreg", "outside"]
    assert {r["total_rows"] for r in summary} == {rows.where("year > 2013").count()}
    assert tables["sample_matched_predictions"].count() == 2 * rows.count()
    assert tables["sample_matched_threshold_search"].count() == 2 * 99


def test_untuned_models_are_refused(spark):
    pred = local_table(
        spark, [("a", "validation", 2013, 1, 0.5), ("b", "test", 2014, 1, 0.5)],
        "model string, split string, year int, y_true int, y_prob double",
    )
    with pytest.raises(ValueError, match="'b'"):
        matched.evaluate_predictions(pred)


def test_model_name_of_external_scores(spark):
    schema = (
        "id int, llm_row_id int, llm_batch int, split string, year int, Default int, "
        "llm_model string, llm_default_probability double"
    )
    rows = [(1, 1, 1, "test", 2014, 1, None, 0.5), (2, 2, 1, "test", 2014, None, "m", 0.5)]
    frame = matched.to_prediction_frame(local_table(spark, rows, schema))
    assert [(r["id"], r["model"]) for r in frame.collect()] == [(1, "llm")]
