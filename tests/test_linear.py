"""Batched logistic models against MLlib's single fits, plain numpy and their optimality conditions."""

import random

import numpy as np
import pytest

from footfall.operators import linear as LIN
from footfall.operators import models as ML
from footfall.operators.sampling import poisson_weight, stratified_folds


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(5)
    rows = []
    for key in range(1200):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 2), rng.gauss(0, 1)
        rows.append((key, 1 + key % 2, int(2 * a - 0.3 * b + rng.gauss(0, 1) > 0.5), a, b, c, a + rng.gauss(0, 1)))
    schema = "cust_key long, persona int, target_shopped_ind int, a double, b double, c double, d double"
    return spark.createDataFrame(rows, schema).repartition(5).persist()


FEATURES = {1: ["a", "b", "c", "d"], 2: ["a", "c"]}


@pytest.mark.parametrize("alpha,l1_ratio", [(1e-3, 0.4), (1e-2, 0.0)])
def test_same_as_single_fits(planted, alpha, l1_ratio):
    found = LIN.fit_each(planted, FEATURES, alpha, l1_ratio)
    single = ML.fit_models(planted, FEATURES, lambda p, n: ML.elastic_net(alpha, l1_ratio).setTol(1e-10))
    for p, w in found.items():
        assert np.allclose(w[:-1], single[p].coefficients.toArray(), atol=1e-4) and abs(w[-1] - single[p].intercept) < 1e-4


def gradient(x, y, w, weight):
    margin = x @ w[:-1] + w[-1]
    r = weight * (1 / (1 + np.exp(-margin)) - y) / weight.sum()
    return np.append(x.T @ r, r.sum())


def test_optimality_for_every_c(planted):
    """Subgradient conditions of |w|_1 + C * summed loss, in plain numpy."""
    grid = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]
    fits = [LIN.Fit(p, c=c) for p in FEATURES for c in grid]
    fitted = LIN.fit_many(LIN.fit_rows(planted, FEATURES), FEATURES, fits)
    pdf = planted.toPandas()
    for fit, w in zip(fitted.fits, fitted.coefs, strict=True):
        own = pdf[pdf.persona == fit.persona]
        alpha = 1 / (fit.c * len(own))
        g = gradient(own[FEATURES[fit.persona]].to_numpy(), own.target_shopped_ind.to_numpy(), w, np.ones(len(own)))
        assert abs(g[-1]) < 1e-6
        for gj, wj in zip(g, w[:-1], strict=False):
            assert abs(gj + alpha * np.sign(wj)) < 1e-6 if wj else abs(gj) < alpha + 1e-6
    assert fitted.passes < 60 and fitted.violations.max() <= LIN.TOLERANCE
    assert not fitted.coefs[0][:-1].any() and all(fitted.coefs[6][:2])


def test_folds_weights_and_blocks(spark, planted, monkeypatch):
    monkeypatch.setattr(LIN, "BLOCK", 3)
    monkeypatch.setattr(LIN, "FANIN", 2)
    folded = stratified_folds(planted, 3, 7).persist()
    rows = LIN.fit_rows(folded, FEATURES, replicates=4, seed=11)
    fits = [LIN.Fit(p, 1e-2, 0.5, fold=k) for p in FEATURES for k in range(3)] + [LIN.Fit(p, 1e-2, 0.5, replicate=r) for p in FEATURES for r in range(4)]
    fitted = LIN.fit_many(rows, FEATURES, fits)
    pdf = folded.select("*", *[poisson_weight(11, r).alias(f"w{r}") for r in range(4)]).toPandas()
    losses = LIN.held_out_loss(rows, fitted)
    for i, (fit, w) in enumerate(zip(fits, fitted.coefs, strict=True)):
        own = pdf[pdf.persona == fit.persona]
        x, y = own[FEATURES[fit.persona]].to_numpy(), own.target_shopped_ind.to_numpy()
        weight = (own.fold != fit.fold).to_numpy().astype(float) if fit.replicate is None else own[f"w{fit.replicate}"].to_numpy()
        g = gradient(x, y, w, weight)
        assert np.allclose(np.where(w[:-1] != 0, g[:-1] + 0.005 * w[:-1] + 0.005 * np.sign(w[:-1]), 0), 0, atol=1e-6) and abs(g[-1]) < 1e-6
        if fit.fold is not None:
            held = (own.fold == fit.fold).to_numpy()
            p = 1 / (1 + np.exp(-(x[held] @ w[:-1] + w[-1])))
            assert abs(losses[i] + np.mean(np.where(y[held] == 1, np.log(p), np.log(1 - p)))) < 1e-9
        else:
            assert np.isnan(losses[i])
    assert len({tuple(w) for w in fitted.coefs}) == len(fits)


def test_search_same_as_single_fits(planted):
    grid = [{"alpha": 0.001, "l1_ratio": 0.4}, {"alpha": 0.3, "l1_ratio": 1.0}, {"alpha": 0.01, "l1_ratio": 0.0}]
    found = {(r.persona, r.params["alpha"]): r for r in LIN.grid_search(planted, FEATURES, grid, 3).collect()}
    single = ML.grid_search(planted, FEATURES, lambda x, p, n: ML.elastic_net(x["alpha"], x["l1_ratio"]).setTol(1e-10), grid, 3).collect()
    assert len(found) == len(single) == 6
    for want in single:
        got = found[want.persona, want.params["alpha"]]
        assert abs(got.mean_test_score - want.mean_test_score) < 1e-4 and abs(got.std_test_score - want.std_test_score) < 1e-4
        assert got.rank_test_score == want.rank_test_score


def test_scores_of_all_personas_in_one_scan(planted):
    coefs = LIN.fit_each(planted, FEATURES, 0.01, 0.5)
    scored = LIN.score(planted, FEATURES, coefs)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan
    single = ML.fit_models(planted, FEATURES, lambda p, n: ML.elastic_net(0.01, 0.5).setTol(1e-10))
    want = {r.cust_key: r for r in ML.score(planted, FEATURES, single).collect()}
    rows = scored.collect()
    assert len(rows) == len(want) == 1200
    for r in rows:
        assert abs(r.prob - want[r.cust_key].prob) < 1e-4 and (r.persona, r.y) == (want[r.cust_key].persona, want[r.cust_key].y)
        assert r.pred == int(r.prob > 0.5)


def test_nulls_and_missing_personas(spark, planted):
    holes = planted.selectExpr("cust_key", "persona", "target_shopped_ind", "if(cust_key = 4, null, a) as a")
    with pytest.raises(Exception, match="nulls"):
        LIN.fit_each(holes, {1: ["a"]}, 0.1)
    none = LIN.fit_each(planted.where("persona = 1"), {1: ["a"], 9: ["a"]}, 0.1)
    assert none[1][0] > 0 and not none[9].any()


@pytest.mark.parametrize("penalty,l1_ratio", [(1e-6, 1.0), (1e-5, 0.0), (1e-4, 0.5), (0.05, 1.0)])
def test_newton_step_of_columns_that_nearly_repeat(penalty, l1_ratio):
    """One step reaches the least quadratic plus penalty, also where coordinate descent creeps."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, 8))
    x[:, 4:] = x[:, :4] + 0.003 * draw.normal(size=(400, 4))
    x = np.column_stack([x, np.ones(400)])
    second, at = 0.2 * x.T @ x / 400, np.zeros((1, 9))
    slope = x.T @ (0.5 - (x[:, 0] - x[:, 5] + draw.normal(size=400) > 0)) / 400
    l1, l2 = np.array([penalty * l1_ratio]), np.array([penalty * (1 - l1_ratio)])
    after = LIN.newton_steps(at, slope[None], second[None], l1, l2)
    assert LIN.violations(after, slope[None] + (second @ after[0])[None], l1, l2)[0] < 1e-8


def test_rows_of_one_file_are_spread(spark, planted, monkeypatch):
    monkeypatch.setattr(LIN, "FILE_ROWS", 300)
    rows = LIN.fit_rows(planted.coalesce(1), FEATURES)
    assert len(rows.inputFiles()) >= 3 and rows.count() == 1200
    assert LIN.fit_rows(planted.where("persona = 9"), FEATURES).count() == 0
