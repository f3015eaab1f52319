"""The model queries fit what the operators fit by default."""

import pytest

import __spark_entry__ as bound
from bindings import tables
from tidemark.operators import scoring

FOLDER = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", ["fit_boosted_trees", "score_long", "reliance_report"])
def test_trees_are_not_cut(spark, monkeypatch, name):
    def fit(train, groups, roles, config=scoring.BoostedTreesConfig(), name="trees"):
        raise Seen(config)

    monkeypatch.setattr(scoring, "fit_boosted_trees", fit)
    with pytest.raises(Seen) as seen:
        bound.queries()[name](spark, FOLDER)
    config = seen.value.args[0]
    assert (config.n_trees, config.max_depth, config.learning_rate) == (300, 6, 0.05)


@pytest.fixture
def few_trees(monkeypatch):
    """Keeps the wiring and shortens the fit."""
    whole, config = scoring.fit_boosted_trees, scoring.BoostedTreesConfig(n_trees=2, max_depth=2)

    def fit(train, groups, roles=None, name="trees"):
        return whole(train, groups, roles, config, name)

    monkeypatch.setattr(scoring, "fit_boosted_trees", fit)


def test_tuned_models_are_three_with_drift(spark, few_trees):
    rows = bound.queries()["run_tuned_model"](spark, FOLDER).collect()
    found = {(r["model"], r["year"]) for r in rows}
    assert found == {(m, y) for m in ("logreg", "trees", "mlp") for y in (1999, 2000, 2001)}
    assert all(r["num_features"] == 5 and r["mean_psi"] > 0 and r["brier_score"] > 0 for r in rows)


def test_matched_models_are_three_and_the_external(spark, few_trees):
    rows = bound.queries()["matched_comparison_models"](spark, FOLDER).collect()
    assert {r["model"] for r in rows} == {"logreg", "trees", "mlp", "outside"}
    assert len({r["total_rows"] for r in rows}) == 1


@pytest.mark.parametrize("name, fit", [
    ("fit_mlp", "fit_mlp"), ("fit_logistic", "fit_logistic"),
    ("fit_logistic_balanced", "fit_logistic"), ("fit_boosted_trees", "fit_boosted_trees"),
])
def test_fits_split_their_table_once(spark, monkeypatch, name, fit):
    whole, splits = tables.wide_split, []

    def split(*args):
        splits.append(whole(*args))
        return splits[-1]

    learner, few = scoring.fit_logistic, scoring.LogisticConfig(max_iter=2)

    def quick(train, groups, roles, config=None):
        return learner(train, groups, roles, few)

    monkeypatch.setattr(tables, "wide_split", split)
    monkeypatch.setattr(scoring, fit, quick)
    assert bound.queries()[name](spark, FOLDER).count() == 4
    assert len(splits) == 1


@pytest.mark.parametrize("name", ["score_long", "reliance_report"])
def test_two_models_share_one_split(spark, monkeypatch, few_trees, name):
    whole, splits = tables.wide_split, []

    def split(*args):
        splits.append(whole(*args))
        return splits[-1]

    monkeypatch.setattr(tables, "wide_split", split)
    assert bound.queries()[name](spark, FOLDER).count() > 0
    assert len(splits) == 1
