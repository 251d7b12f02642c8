import random

import pytest

from footfall.operators import evaluation as EV
from footfall.operators import models as ML


@pytest.fixture(scope="module")
def planted(spark):
    """Two personas whose label follows one feature; the other features are noise."""
    rng = random.Random(5)
    rows = []
    for key in range(1200):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
        y = int(2 * a + rng.gauss(0, 1) > 0.5)
        rows.append((key, 1 + key % 2, y, a, b, c, None if key % 2 else 1.0))
    schema = "cust_key long, persona int, target_shopped_ind int, a double, b double, c double, only_first double"
    return spark.createDataFrame(rows, schema).repartition(4).persist()


@pytest.fixture(scope="module")
def features(planted):
    return ML.usable_features(planted, ["a", "b", "c", "only_first"])


def test_all_null_columns_are_left_out(features):
    assert features == {1: ["a", "b", "c", "only_first"], 2: ["a", "b", "c"]}


@pytest.mark.parametrize(
    "make",
    [
        lambda p, n: ML.random_forest(4, "entropy", trees=10, seed=p),
        lambda p, n: ML.elastic_net(max_iter=30),
        lambda p, n: ML.l1_logistic(n, max_iter=30),
        lambda p, n: ML.gradient_boosting(trees=5, rate=0.3, subsample=0.7),
    ],
    ids=["forest", "elastic_net", "l1", "boosting"],
)
def test_models_find_the_signal(planted, features, make):
    models = ML.fit_models(planted, features, make)
    metrics = EV.score_metrics(ML.score(planted, features, models)).collect()
    assert sorted(m.persona for m in metrics) == [1, 2]
    assert all(m.roc_auc > 0.85 and m.accuracy > m.null_accuracy for m in metrics)


def test_importance_and_l1(planted, features):
    forest = ML.fit_models(planted, features, lambda p, n: ML.random_forest(4, trees=10, seed=p))
    first = {}
    for row in ML.importances(planted, features, forest).collect():
        first.setdefault(row.persona, row.feature)
    assert first == {1: "a", 2: "a"}
    strong = ML.fit_models(planted, features, lambda p, n: ML.elastic_net(0.1, 1.0, 50))
    for persona, model in strong.items():
        coefs = dict(zip(features[persona], model.coefficients.toArray()))
        assert coefs["a"] > 0.1 and abs(coefs["b"]) < 1e-6 and abs(coefs["c"]) < 1e-6


def test_grid_search_ranks(planted, features):
    grid = [{"regParam": 0.001, "elasticNetParam": 0.4}, {"regParam": 5.0, "elasticNetParam": 1.0}]
    make = lambda x, p, n: ML.elastic_net(x["regParam"], x["elasticNetParam"], 10)
    found = ML.grid_search(planted, features, make, grid, n_folds=3)
    best = {r.persona: r.params for r in ML.best_params(found).collect()}
    assert best == {1: grid[0], 2: grid[0]}
    assert all(r.mean_test_score < 0 and r.std_test_score >= 0 for r in found.collect())


def test_penalties_on_summed_losses_can_be_searched(planted, features):
    seen = []
    makers = ML.searchable(max_iter=10)

    def make(point, persona, n):
        seen.append(n)
        return makers["l1"](point, persona, n)

    found = ML.grid_search(planted, features, make, [{"C": 0.001}, {"C": 1.0}], n_folds=3)
    assert {r.persona: r.params for r in ML.best_params(found).collect()} == {1: {"C": 1.0}, 2: {"C": 1.0}}
    assert min(seen) > 390 and max(seen) < 410  # two thirds of a persona's 600 rows


def test_bootstrap(planted, features):
    coefs = ML.bootstrap_coefs(planted, features, n_resample=3, alpha=0.05, l1_ratio=1.0, max_iter=20).collect()
    assert len(coefs) == 3 * 7
    assert all(r.coef > 0.1 for r in coefs if r.feature == "a")
    assert len({r.coef for r in coefs if r.feature == "a"}) == 6  # every resample differs


def test_forests_remember_the_node_of_each_row(planted):
    """Deep trees are not walked from the root again at every level; the trees stay the same."""
    forest = ML.random_forest(8, trees=12)
    assert forest.getOrDefault("cacheNodeIds")
    rows = ML.persona_vectors(planted, 2, ["a", "b", "c"]).persist()
    again = forest.copy({forest.cacheNodeIds: False})
    assert forest.fit(rows).toDebugString == again.fit(rows).toDebugString.replace(again.uid, forest.uid)
