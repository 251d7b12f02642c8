import numpy as np
import pytest

from footfall.operators import evaluation as EV
from footfall.operators import profiling as PR
from footfall.operators import selection as SE


def test_feature_types(spark):
    rows = [(float(i), i % 9, i % 8, i % 3, i % 2, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "many double, nine int, eight int, three int, two int, one int")
    got = {r.feature: (r.n_distinct, r.feature_type) for r in PR.feature_types(df, df.columns).collect()}
    assert got == {
        "many": (200, "continuous"), "nine": (9, "continuous"), "eight": (8, "ordinal"),
        "three": (3, "ordinal"), "two": (2, "binary"), "one": (1, "binary"),
    }


def test_nulls_are_no_values(spark):
    rows = [(None if i % 9 == 8 else float(i % 9), None, i % 3 or None) for i in range(90)]
    df = spark.createDataFrame(rows, "eight double, none int, two int")
    got = {r.feature: (r.n_distinct, r.feature_type) for r in PR.feature_types(df, df.columns).collect()}
    assert got == {"eight": (8, "ordinal"), "none": (0, "binary"), "two": (2, "binary")}
    assert {r.feature: r.feature_type for r in PR.feature_kinds(df, df.columns).collect()} == {k: v for k, (_, v) in got.items()}


def test_correlations_skip_null_pairs_and_keep_all_personas(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(1e6, 1, (400, 3))
    x[:, 1] += x[:, 0] - 1e6
    x[draw.random((400, 3)) < 0.2] = np.nan
    rows = [(7 if i % 2 else 1, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)] + [(9, 1.0, 2.0, 3.0), (None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "persona int, a double, b double, c double").repartition(5)
    got = {(r.persona, r.feature_1, r.feature_2): r["corr"] for r in PR.correlations(df, ["a", "b", "c"]).collect()}
    assert len(got) == 12
    for persona in (1, 7):
        part = x[(np.arange(400) % 2 == 1) == (persona == 7)]
        for i, j in ((0, 1), (0, 2), (1, 2)):
            both = part[~np.isnan(part[:, i]) & ~np.isnan(part[:, j])]
            want = abs(np.corrcoef(both[:, i], both[:, j])[0, 1])
            assert abs(got[persona, "abc"[i], "abc"[j]] - want) < 1e-6
    with pytest.raises(Exception, match="persona is not one of"):
        PR.corr_pivot(PR.high_corr_pairs(PR.correlations(df, ["a", "b", "c"]), 0.0)).collect()


def test_keep_features_of_any_persona(spark):
    available = spark.createDataFrame([(7, "wellness_pct_shopped"), (7, "other"), (1, "other")], "persona int, feature string")
    assert sorted(map(tuple, SE.keep_features(available).collect())) == [(1, "other"), (7, "other")]


def test_correlations_and_variances(spark):
    rows = [(1, float(i), float(-i) + (i % 2) * 0.1, float((i * 7) % 11), 3.0) for i in range(50)]
    df = spark.createDataFrame(rows, "persona int, a double, b double, c double, constant double")
    features = ["a", "b", "c", "constant"]
    high = PR.high_corr_pairs(PR.correlations(df, features), 0.8).collect()
    assert {(r.feature_1, r.feature_2) for r in high} == {("a", "b"), ("b", "a")} and {r["rank"] for r in high} == {1}
    pivot = PR.corr_pivot(PR.high_corr_pairs(PR.correlations(df, features), 0.8)).first()
    assert pivot["sum"] == pivot["1"] and pivot["2"] is None
    low = PR.low_variance(df, features, 0.05).collect()
    assert [(r.feature, r.variance, r["rank"]) for r in low] == [("constant", 0.0, 1)]


def test_profile_and_alignment(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "cust_key long, x double")
    row = PR.column_profile(df, ["x"]).first()
    assert (row.min_value, row.max_value, row.n_null, row.data_type) == (2.0, 2.0, 1, "double")
    other = spark.createDataFrame([(2, 2.0), (3, 1.0)], df.schema)
    r = PR.key_alignment(df, other).first()
    assert (r.n_both, r.n_left_only, r.n_right_only, r.aligned) == (1, 1, 1, False)
    assert PR.key_alignment(df, df).first().aligned


def importances(spark, values, kind="continuous", persona=1):
    rows = [(persona, f"f{i}", v, kind) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "persona int, feature string, importance double, feature_type string")


def test_ties_across_a_quota_leave_all_out(spark):
    df = importances(spark, [0.3, 0.2, 0.2, 0.1])
    assert [r.feature for r in SE.top_stratified(df, 2).collect()] == ["f0"]
    assert SE.top_stratified(df, 10).count() == 4


def test_quotas_follow_types(spark):
    df = importances(spark, [i / 100 for i in range(1, 7)]).union(importances(spark, [0.9, 0.8, 0.7], "binary"))
    assert sorted(r.feature_type for r in SE.top_stratified(df, 3).collect()) == ["binary", "continuous", "continuous"]
    given = SE.top_stratified(df, {1: {"continuous": 1, "binary": 2}}).collect()
    assert sorted(r.feature_type for r in given) == ["binary", "binary", "continuous"]
    ranks = {r.feature_type + r.feature: r["1"] for r in SE.rank_importance(df).collect()}
    assert ranks["continuousf5"] == 1 and ranks["binaryf2"] == 3


def test_rank_from_top(spark):
    got = {r.feature: r["rank"] for r in SE.rank_from_top(importances(spark, [0.3, 0.2, 0.2]), of=35).collect()}
    assert got == {"f0": 32.0, "f1": 33.5, "f2": 33.5}


def test_bootstrap_tables(spark):
    coefs = spark.createDataFrame(
        [(1, r, f, c) for r in range(4) for f, c in (("x", 1.0 + r), ("y", 0.0 if r else -0.5), ("z", 0.0))],
        "persona int, replicate int, feature string, coef double",
    )
    summary = SE.bootstrap_summary(coefs)
    got = {r.feature: r for r in summary.collect()}
    assert (got["x"].prop_selected, got["x"].mean_coef) == (1.0, 2.5)
    assert (got["y"].prop_selected, got["y"].abs_mean_coef) == (0.25, 0.125)
    top = SE.top_bootstrapped(summary, 2, ["prop_selected", "abs_mean_coef"])
    assert sorted(r.feature for r in top.collect()) == ["x", "y"]
    assert [r.feature for r in SE.threshold_bootstrapped(summary, 0.5).collect()] == ["x"]
    assert sorted(r.feature for r in SE.threshold_bootstrapped(summary, 0.5, 2).collect()) == ["x", "y"]
    assert SE.as_lists(top) == {1: ["x", "y"]}
    assert SE.feature_membership(top).where("feature = 'x'").first()["1"] == 1


def test_narrow(spark):
    df = spark.createDataFrame([(1, 1, 0, 1.0, 2.0, 9.0), (2, 2, 1, 3.0, 4.0, 9.0)], "cust_key long, persona int, target_shopped_ind int, a double, b double, c double")
    out = SE.narrow_by_persona(df, {1: ["a"], 2: ["a", "b"]})
    assert out.columns == ["cust_key", "persona", "target_shopped_ind", "a", "b"]
    assert [tuple(r)[3:] for r in out.orderBy("cust_key").collect()] == [(1.0, None), (3.0, 4.0)]


def scored(spark, y, pred, prob):
    return spark.createDataFrame([(i, 1, *v) for i, v in enumerate(zip(y, pred, prob))], "cust_key long, persona int, y int, pred int, prob double")


def test_metrics(spark):
    y, pred = [0, 0, 0, 1, 1, 1, 1, 1, 1, 1], [0, 0, 0, 0, 1, 1, 0, 1, 0, 1]
    r = EV.score_metrics(scored(spark, y, pred, [0.5] * 10)).first()
    assert (r.recall, r.bal_accuracy, r.precision) == (pytest.approx(4 / 7), pytest.approx(11 / 14), 1.0)
    assert (r.n, r.null_accuracy, r.roc_auc) == (10, pytest.approx(0.3), 0.5)  # all scores tied
    assert {(m.y, m.pred): m.n for m in EV.confusion_matrix(scored(spark, y, pred, [0.5] * 10)).collect()} == {(0, 0): 3, (1, 0): 3, (1, 1): 4}


def test_auc_against_all_pairs(spark):
    y = [int(i % 3 == 0) for i in range(400)]
    prob = [((i * 37) % 101) / 101 + 0.2 * (i % 3 == 0) for i in range(400)]
    wins = sum((p > n) + 0.5 * (p == n) for a, p in zip(y, prob) if a for b, n in zip(y, prob) if not b)
    r = EV.roc_auc(scored(spark, y, y, prob)).first()
    assert r.roc_auc == pytest.approx(wins / (sum(y) * (400 - sum(y))))


def test_one_class_and_no_positive_guess(spark):
    r = EV.score_metrics(scored(spark, [0, 0], [0, 0], [0.1, 0.0])).first()
    assert (r.precision, r.recall, r.bal_accuracy, r.roc_auc) == (0.0, 0.0, None, None)


def test_percentile_cutoff(spark):
    prob = [i / 100 for i in range(101)]
    out = EV.percentile_cutoff(scored(spark, [0] * 101, [0] * 101, prob)).collect()
    assert sum(r.pred for r in out) == 6 and out[0].cutoff == pytest.approx(0.95)
