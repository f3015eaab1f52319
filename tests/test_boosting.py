"""Boosted trees from histograms against MLlib's own, and what their passes cost."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array

from tidemark.operators import boosting, scoring
from tidemark.roles import FeatureGroups, Roles
from tidemark.session import local_table, scratch_path

ROLES = Roles(target="target", time="year", id="id", text=())
GROUPS = FeatureGroups(("amount", "gap", "grade", "kind"), ("amount", "gap"), ("grade", "kind"))
WHOLE = scoring.BoostedTreesConfig(n_trees=6, max_depth=4, learning_rate=0.3, row_share=1.0, column_share=1.0)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    made = []
    for i in range(2500):
        amount, grade, kind = float(rng.integers(0, 20)), "ABCDE"[rng.integers(5)], "xyz"[rng.integers(3)]
        logit = 0.2 * amount - 2.5 + (grade == "C") * (1 + (kind == "x")) + rng.normal()
        made.append((i, int(logit > 0), amount, None if i % 9 == 0 else float(i % 7), grade,
                     None if i % 50 == 0 else kind))
    schema = "id bigint, target int, amount double, gap double, grade string, kind string"
    return local_table(spark, made, schema).repartition(3).persist()


def test_whole_trees_are_those_of_mllib(rows):
    """Without draws both make the same trees, so scores and importances are equal."""
    model = scoring.fit_boosted_trees(rows, GROUPS, ROLES, WHOLE)
    stages = model.pipeline.stages
    ready = rows.withColumn("label", rows["target"].cast("double"))
    for stage in stages[:-1]:
        ready = stage.transform(ready)
    other = GBTClassifier(maxIter=6, maxDepth=4, stepSize=0.3, seed=1).fit(ready)
    assert model.estimator.numFeatures == other.numFeatures == len(model.slots) == 10
    assert model.estimator.treeWeights == other.treeWeights
    a = dict(model.score(rows).select("id", "y_prob").collect())
    b = dict(other.transform(ready).select("id", vector_to_array("probability")[1]).collect())
    assert max(abs(a[i] - b[i]) for i in b) < 1e-9
    assert np.allclose(model.estimator.featureImportances.toArray(), other.featureImportances.toArray())
    path = scratch_path(rows.sparkSession, "saved")
    model.pipeline.save(path)
    again = PipelineModel.load(path)
    assert again.stages[-1].toDebugString.split("\n", 1)[1] == model.estimator.toDebugString.split("\n", 1)[1]


def test_blocks_levels_and_saved_margins_change_nothing(rows, monkeypatch):
    """Many blocks, sums added on executors and written margins give the trees of one block."""
    def found():
        return scoring.fit_boosted_trees(rows, GROUPS, ROLES, WHOLE).estimator.toDebugString.split("\n", 1)[1]

    one = found()
    for name, value in (("BLOCK", 100), ("FEWEST_ROWS", 500), ("MOST_BYTES", 0), ("CHECKPOINT", 2)):
        monkeypatch.setattr(boosting, name, value)
    many = found()
    numbers = [[float(w) for w in text.split() if w.lstrip("-").replace(".", "").isdigit()] for text in (one, many)]
    assert len(numbers[0]) == len(numbers[1]) and np.allclose(*numbers)


def test_a_tree_takes_a_job_a_level(spark, rows):
    """MLlib takes two stages for each level of a tree, and more for its draws."""
    context, jobs = spark.sparkContext, []
    for n, group in ((2, "few"), (10, "more")):
        context.setJobGroup(group, group)
        scoring.fit_boosted_trees(rows, GROUPS, ROLES, scoring.BoostedTreesConfig(n_trees=n, max_depth=3))
        jobs.append(len(context.statusTracker().getJobIdsForGroup(group)))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] <= 8 * 3


def test_odd_labels_and_constant_columns(spark, rows):
    for value in ("NULL", "2"):
        bad = rows.selectExpr("amount", "gap", "grade", "kind", f"if(id = 7, {value}, target) AS target")
        with pytest.raises(ValueError, match="labels must be 0 or 1: 1 of 2500"):
            scoring.fit_boosted_trees(bad, GROUPS, ROLES, WHOLE)
    flat = rows.selectExpr("1.0D AS amount", "2.0D AS gap", "'A' AS grade", "'x' AS kind", "target")
    model = scoring.fit_boosted_trees(flat, GROUPS, ROLES, WHOLE)
    assert len({r["y_prob"] for r in model.score(flat).collect()}) == 1


def _numbers(model):
    text = model.estimator.toDebugString.split("\n", 1)[1]
    return [float(w) for w in text.split() if w.lstrip("-").replace(".", "").isdigit()]


def test_large_tables_give_the_trees_of_small_ones(rows, monkeypatch):
    """Grouped columns, subtracted siblings, many parts and saved margins change no tree."""
    drawn = scoring.BoostedTreesConfig(n_trees=5, max_depth=5, learning_rate=0.3)
    for name, value in (("BLOCK", 100), ("FEWEST_ROWS", 500), ("MERGED", 250), ("CHECKPOINT", 2)):
        monkeypatch.setattr(boosting, name, value)
    small = [_numbers(scoring.fit_boosted_trees(rows, GROUPS, ROLES, config)) for config in (WHOLE, drawn)]
    for most_bytes in (boosting.MOST_BYTES, 0):
        monkeypatch.setattr(boosting, "LARGE", 1)
        monkeypatch.setattr(boosting, "MOST_BYTES", most_bytes)
        large = [_numbers(scoring.fit_boosted_trees(rows, GROUPS, ROLES, config)) for config in (WHOLE, drawn)]
        assert [len(x) for x in small] == [len(x) for x in large]
        assert all(np.allclose(a, b) for a, b in zip(small, large))


def test_a_small_table_takes_one_task(spark, rows):
    """More trees of a small table take no more jobs, but for what Spark plans anew."""
    context, jobs = spark.sparkContext, []
    for n, group in ((1, "one"), (9, "nine")):
        context.setJobGroup(group, group)
        scoring.fit_boosted_trees(rows, GROUPS, ROLES, scoring.BoostedTreesConfig(n_trees=n, max_depth=3))
        jobs.append(len(context.statusTracker().getJobIdsForGroup(group)))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] < 8


def test_packing_and_siblings():
    bins = [32, 3, 25, 5000, 11, 6]
    groups = boosting._packing(bins, 4096)
    assert sorted(c for g in groups for c in g) == list(range(6))
    assert all(len(g) == 1 or np.prod([bins[c] for c in g]) <= 4096 for g in groups)
    assert boosting._packing(bins, 0) == [[c] for c in range(6)]
    rng, splits = np.random.default_rng(1), {}
    codes = [rng.integers(0, n, 500) for n in bins]
    for group in groups:
        splits[tuple(group)] = np.ravel_multi_index([codes[c] for c in group], [bins[c] for c in group])
    shape = np.array([0, 3, -1, -1, -1]), np.array([12, 77, 0, 0, 0]), np.array([1, 3, 2, 3, 4])
    found = dict(boosting._parted(
        boosting._splits(shape, bins, 2, groups), [splits[tuple(g)] for g in groups], 500))
    low = codes[0] <= 12
    wanted = {2: ~low, 3: low & (codes[3] != 77), 4: low & (codes[3] == 77)}
    assert all(np.array_equal(found[node], np.flatnonzero(wanted[node])) for node in wanted)
