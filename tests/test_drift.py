"""Drift measures against their definitions, and the published tables they reproduce."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import drift, metrics, reliance
from tidemark.session import local_table

# Published PSI per feature for four years, base rates, and their summaries.
YEARS = (2015, 2016, 2017, 2018)
PSI = {
    ("dti_n", "numeric"): (0.09821459374230308, 0.08336043387808789, 0.06354775871024855, 0.06959476630120218),
    ("emp_length", "categorical"): (0.02868478180483596, 0.04052209755738924, 0.04909575786985412, 0.06356792536436615),
    ("experience_c", "numeric_constant"): (None, None, None, None),
    ("fico_n", "numeric"): (0.05500144924848066, 0.036685886502245156, 0.02007354559133849, 0.06930966115115475),
    ("home_ownership_n", "categorical"): (0.014467504715622697, 0.01954269722997598, 0.01854332449859211, 0.03471442054540533),
    ("loan_amnt", "numeric"): (0.015150362617369087, 0.017087708685266823, 0.03473139983960343, 0.06520223303191791),
    ("purpose", "categorical"): (0.10845630572721073, 0.10749264569148728, 0.13449340924242134, 0.13131710699867374),
    ("revenue", "numeric"): (0.009251287511465154, 0.030004784673358053, 0.07085887962925651, 0.11300806988242841),
}
MEAN_PSI = (0.047032326481041054, 0.04781375060254434, 0.05590629648304494, 0.07810202618216407)
MEDIAN_PSI = (0.02868478180483596, 0.036685886502245156, 0.04909575786985412, 0.06930966115115475)
ABOVE_TENTH = (1, 1, 1, 2)
TOP = ("purpose", "revenue", "dti_n", "fico_n", "loan_amnt", "emp_length", "home_ownership_n")
RATES = (0.2018463930894731, 0.23281818895300233, 0.23127184138791487, 0.15751424501424502)
# Published importances of two models by source column.
IMPORTANCE_A = {
    "purpose": 2.9255930713357956, "emp_length": 1.3518762564427877,
    "home_ownership_n": 1.028877139701359, "fico_n": 0.38648177576854076,
    "revenue": 0.3629888097907095, "loan_amnt": 0.32615051546570356,
    "dti_n": 0.11642684769382701, "experience_c": 0.0013105888686772075,
}
IMPORTANCE_B = {
    "purpose": 0.45482814, "emp_length": 0.24996911, "home_ownership_n": 0.09161566,
    "fico_n": 0.08444049, "loan_amnt": 0.04273146, "revenue": 0.04184435,
    "dti_n": 0.02756755, "experience_c": 0.007003162,
}
# Published slot coefficients of a logistic model.
COEFFICIENTS = {
    "cat__purpose_small_business": 0.625392536007007,
    "cat__purpose_credit_card": -0.5901317415613053,
    "cat__home_ownership_n_MORTGAGE": -0.409477970873444,
    "num__fico_n": -0.38648177576854076,
    "num__revenue": -0.3629888097907095,
    "cat__home_ownership_n_OWN": -0.3537663638683015,
    "cat__purpose_wedding": -0.33148231137970524,
    "num__loan_amnt": 0.32615051546570356,
    "cat__purpose_debt_consolidation": -0.3234876307604235,
    "cat__purpose_major_purchase": -0.2701224475391197,
    "cat__purpose_car": -0.2644392962396375,
    "cat__home_ownership_n_RENT": -0.26291745112907633,
    "cat__emp_length_NI": 0.161499558371054,
    "cat__emp_length_1 year": -0.14780235934760486,
    "cat__emp_length_2 years": -0.14374479878027663,
    "cat__purpose_home_improvement": -0.13608052591762784,
    "cat__emp_length_4 years": -0.13282691666749502,
    "cat__emp_length_3 years": -0.13097475428924066,
    "cat__emp_length_5 years": -0.1258965932373027,
    "num__dti_n": 0.11642684769382701,
    "cat__emp_length_10+ years": -0.1148691119855317,
    "cat__purpose_other": 0.10587270043566892,
    "cat__purpose_educational": 0.10151386921982236,
    "cat__emp_length_< 1 year": -0.08621841874851653,
    "cat__emp_length_8 years": -0.08561923204169537,
    "cat__emp_length_7 years": -0.07830412111448458,
    "cat__emp_length_9 years": -0.07491715619520913,
    "cat__purpose_medical": 0.0701390968614288,
    "cat__emp_length_6 years": -0.06920323566437664,
    "cat__purpose_house": -0.061491152120664784,
    "cat__purpose_renewable_energy": 0.033581916707931335,
    "cat__purpose_moving": 0.008155246013220343,
    "cat__purpose_vacation": 0.0037026005722331063,
    "cat__home_ownership_n_OTHER": -0.0027153538305372325,
    "num__experience_c": 0.0013105888686772075,
}
# Published AUC, F1 and accuracy of four models on 500 matched rows per year.
MATCHED = {
    "outside": (
        (0.5467940907706366, 0.3277591973244147, 0.196),
        (0.544010033136966, 0.3660130718954248, 0.224),
        (0.5078742588932806, 0.4177215189873418, 0.264),
        (0.5977411764705882, 0.2608695652173913, 0.15),
    ),
    "logreg": (
        (0.6167377398720683, 0.32, 0.66),
        (0.6631995581737851, 0.4142857142857143, 0.672),
        (0.6345932147562583, 0.3435114503816794, 0.656),
        (0.7103058823529411, 0.35294117647058826, 0.758),
    ),
    "mlp": (
        (0.5615544725352828, 0.3209169054441261, 0.526),
        (0.6409701767304861, 0.42565597667638483, 0.606),
        (0.6226737483530962, 0.41643835616438357, 0.574),
        (0.6328470588235294, 0.3082706766917293, 0.632),
    ),
    "trees": (
        (0.62960706670728, 0.3371647509578544, 0.654),
        (0.6553065169366716, 0.3970037453183521, 0.678),
        (0.626461627140975, 0.34782608695652173, 0.67),
        (0.699764705882353, 0.3314917127071823, 0.758),
    ),
}
MATCHED_MEANS = {
    "logreg": (0.6562090987887632, 0.3576845852844955, 0.6865),
    "trees": (0.6527849791668199, 0.35337157398497765, 0.69),
    "mlp": (0.6145113641105986, 0.36782047874415597, 0.5845),
    "outside": (0.5491048898178679, 0.3430908383561432, 0.2085),
}


@pytest.fixture(scope="module")
def published(spark):
    rows = [(y, f, k, v) for (f, k), values in PSI.items() for y, v in zip(YEARS, values)]
    return local_table(spark, rows, "year int, feature string, feature_type string, psi double")


def test_published_summary(spark, published):
    base = local_table(spark, list(zip(YEARS, RATES)), "year int, default_rate double")
    rows = drift.drift_summary_by_year(published, base).orderBy("year").collect()
    for row, mean, median, above in zip(rows, MEAN_PSI, MEDIAN_PSI, ABOVE_TENTH):
        assert row["mean_psi"] == pytest.approx(mean, abs=1e-12)
        assert row["median_psi"] == pytest.approx(median, abs=1e-12)
        assert row["num_features"] == 7
        assert row["num_features_psi_gt_0_10"] == above
        assert row["num_features_psi_gt_0_25"] == 0


def test_published_top_features(published):
    rows = drift.top_drift_features(published).collect()
    assert tuple(r["feature"] for r in rows) == TOP
    assert rows[0]["max_psi"] == 0.13449340924242134
    assert rows[0]["mean_psi"] == pytest.approx(0.12043986691494826, abs=1e-12)


def test_published_overlap(spark):
    def table(values):
        return local_table(
            spark, list(values.items()), "base_feature string, importance_abs double"
        )

    rows = reliance.topk_overlap(table(IMPORTANCE_A), table(IMPORTANCE_B)).collect()
    assert [(r["top_k"], r["overlap_count"]) for r in rows] == [(5, 4), (10, 8), (20, 8)]
    assert rows[0]["jaccard_overlap"] == pytest.approx(2 / 3)
    assert rows[0]["overlapping_features"] == "emp_length, fico_n, home_ownership_n, purpose"


def test_published_coefficients(spark):
    slots = local_table(
        spark, [("logreg", name, w) for name, w in COEFFICIENTS.items()],
        "model string, transformed_feature string, weight double",
    )
    numeric = ["dti_n", "experience_c", "fico_n", "loan_amnt", "revenue"]
    categorical = ["emp_length", "home_ownership_n", "purpose"]
    based = reliance.add_base_features(slots, numeric, categorical)
    rows = reliance.coefficient_importance(based).collect()
    found = {r["base_feature"]: r["importance_abs"] for r in rows}
    assert found == pytest.approx(IMPORTANCE_A, abs=1e-12)
    sizes = {r["base_feature"]: r["n_transformed_features"] for r in rows}
    assert (sizes["purpose"], sizes["emp_length"], sizes["home_ownership_n"]) == (14, 12, 4)


def test_published_model_summary(spark):
    rows = [
        (model, year, 500, auc, f1, accuracy, 0.0, 0.0, 0.0)
        for model, values in MATCHED.items()
        for year, (auc, f1, accuracy) in zip(YEARS, values)
    ]
    table = local_table(
        spark, rows,
        "model string, year int, n_rows bigint, auc double, f1 double, accuracy double, "
        "brier_score double, ece double, pred_positive_rate double",
    )
    summary = metrics.model_summary(table).collect()
    assert [r["model"] for r in summary] == list(MATCHED_MEANS)
    for row in summary:
        means = (row["mean_auc"], row["mean_f1"], row["mean_accuracy"])
        assert means == pytest.approx(MATCHED_MEANS[row["model"]], abs=1e-12)
        assert (row["n_years"], row["total_rows"]) == (4, 2000)


def test_published_changes(spark):
    rows = [("m", y, a, f, e, b) for y, a, f, e, b in (
        (2015, 0.6556791189432426, 0.39026000280548884, 0.032468362243949174, 0.1547501772910569),
        (2016, 0.6542006101015617, 0.4193009395414205, 0.06644758053650805, 0.17426869535140138),
        (2017, 0.6630320138732491, 0.42007057572388457, 0.07285798442241634, 0.1737566781684721),
    )]
    table = local_table(
        spark, rows, "model string, year int, auc double, f1 double, ece double, brier_score double"
    )
    found = metrics.change_from_first(table).orderBy("year").collect()
    assert found[1]["auc_drop_from_first_test_year"] == pytest.approx(0.0014785088416808811)
    assert found[1]["f1_drop_from_first_test_year"] == pytest.approx(-0.029040936735931666)
    assert found[2]["ece_change_from_first_test_year"] == pytest.approx(0.040389622178467165)
    assert found[2]["brier_change_from_first_test_year"] == pytest.approx(0.019006500877415206)


def psi_of(train, actual, numeric):
    """PSI of two pandas columns by definition."""
    if numeric:
        ref = train.replace([np.inf, -np.inf], np.nan).dropna()
        edges = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))
        if len(edges) < 3:
            return None
        edges[0], edges[-1] = -np.inf, np.inf

        def bins(s):
            s = s.replace([np.inf, -np.inf], np.nan)
            return pd.Series(np.searchsorted(edges[1:-1], s, side="left")).where(
                s.notna().to_numpy(), -1
            )
    else:
        filled = train.fillna("__MISSING__")
        counts = filled.value_counts().rename("n").rename_axis("v").reset_index()
        top = set(counts.sort_values(["n", "v"], ascending=[False, True])["v"].head(25))

        def bins(s):
            s = s.fillna("__MISSING__")
            return s.where(s.isin(top), "__OTHER__")
    e, a = bins(train).value_counts(), bins(actual).value_counts()
    labels = e.index.union(a.index)
    e = np.clip(e.reindex(labels, fill_value=0) / e.sum(), 1e-6, None)
    a = np.clip(a.reindex(labels, fill_value=0) / a.sum(), 1e-6, None)
    return float(((a - e) * np.log(a / e)).sum())


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(5)
    n = 4000
    year = rng.choice([2010, 2011, 2012, 2013], n, p=[0.4, 0.2, 0.33, 0.07])
    late = year > 2011
    steady = rng.normal(size=n)
    gaps = np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 15, n) + 3.0 * late)
    odd = np.where(rng.random(n) < 0.05, np.inf, rng.exponential(size=n))
    town = rng.choice([f"t{i:02d}" for i in range(40)], n, p=np.arange(1, 41) / 820)
    town = np.where(late & (rng.random(n) < 0.2), None, town)
    return pd.DataFrame({
        "year": year, "target": (rng.random(n) < 0.3).astype(int), "steady": steady, "gaps": gaps,
        "odd": odd, "flag": rng.random(n) < 0.5, "town": town,
    })


@pytest.fixture(scope="module")
def frames(spark, table):
    rows = [
        tuple(None if v is None else (v.item() if hasattr(v, "item") else v) for v in r)
        for r in table.itertuples(index=False)
    ]
    df = local_table(
        spark, rows,
        "year int, target int, steady double, gaps double, odd double, flag boolean, town string",
    ).repartition(4).persist()
    return df.where("year <= 2011"), df.where("year > 2011")


def test_psi_by_definition(table, frames):
    features = ["steady", "gaps", "odd", "flag", "town", "absent"]
    rows = drift.psi_by_feature_year(*frames, features).collect()
    assert len(rows) == 10
    train = table[table.year <= 2011]
    for row in rows:
        f, actual = row["feature"], table[table.year == row["year"]]
        kind = {"town": "categorical", "flag": "numeric_constant"}.get(f, "numeric")
        assert row["feature_type"] == kind
        if kind == "numeric_constant":
            assert row["psi"] is None
        else:
            assert row["psi"] == pytest.approx(psi_of(train[f], actual[f], kind == "numeric"))
        assert row["train_missing_rate"] == pytest.approx(train[f].isna().mean())
        assert row["year_missing_rate"] == pytest.approx(actual[f].isna().mean())
        assert row["train_nunique"] == train[f].nunique()
        assert row["year_nunique"] == actual[f].nunique()


def test_missing_category_outside_the_top_is_other(frames):
    train, test = frames
    bins = drift.fit_bins(train, ["town"])[0]
    assert "__MISSING__" not in bins.top and len(bins.top) == 25
    assert bins.label(0) == "__OTHER__"
    codes = test.where("town is null").select(bins.code().alias("c")).distinct().collect()
    assert [r["c"] for r in codes] == [0]


def test_value_on_an_edge_is_in_the_lower_bin(spark):
    bins = drift.Bins("v", "numeric", edges=(0.0, 1.0, 2.0))
    df = local_table(spark, [(-9.0,), (1.0,), (1.5,), (None,), (float("nan"),)], "v double")
    assert [r[0] for r in df.select(bins.code()).collect()] == [1, 1, 2, 0, 0]
    assert bins.label(1) == "(-inf, 1.0]" and bins.label(0) == "__MISSING__"


def test_psi_of_equal_tables_is_zero(frames):
    train, _ = frames
    same = train.withColumn("year", F.lit(2012))
    for row in drift.psi_by_feature_year(train, same, ["steady", "town"]).collect():
        assert row["psi"] == pytest.approx(0.0, abs=1e-12)


def test_sketched_distinct_counts_leave_psi_alone(frames):
    exact = drift.psi_by_feature_year(*frames, ["steady", "town"])
    rough = drift.psi_by_feature_year(*frames, ["steady", "town"], nunique="approx")
    psi = {(r["year"], r["feature"]): r for r in exact.collect()}
    for row in rough.collect():
        same = psi[row["year"], row["feature"]]
        assert row["psi"] == pytest.approx(same["psi"])
        assert row["year_nunique"] == pytest.approx(same["year_nunique"], rel=0.1)


def test_feature_psi(frames, table):
    train, test = frames
    one = test.where("year = 2013")
    row = drift.feature_psi(train, one, "gaps").first()
    actual = table[table.year == 2013]["gaps"]
    assert row["psi"] == pytest.approx(psi_of(table[table.year <= 2011]["gaps"], actual, True))
    assert drift.feature_psi(train, one, "absent").first()["feature_type"] == "missing"


def test_base_rates(frames, table):
    rows = drift.base_rate_by_year(*frames, "target").orderBy("year").collect()
    train_rate = table[table.year <= 2011].target.mean()
    first = table[table.year == 2012].target.mean()
    for row in rows:
        rate = table[table.year == row["year"]].target.mean()
        assert row["default_rate_shift_from_train"] == pytest.approx(rate - train_rate)
        assert row["default_rate_shift_from_first_test_year"] == pytest.approx(rate - first)


def test_guards(frames):
    train, test = frames
    with pytest.raises(ValueError, match="no column"):
        drift.base_rate_by_year(train, test, "nothing")
    with pytest.raises(PySparkException, match="empty"):
        drift.base_rate_by_year(train, test.where("false"), "target").collect()
    with pytest.raises(ValueError):
        drift.psi_by_feature_year(train, test, ["absent"])
    with pytest.raises(ValueError):
        drift.psi_by_feature_year(train, test.drop("year"), ["steady"])
