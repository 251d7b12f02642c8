"""Classifiers per persona with MLlib: fit, search, bootstrap, importance, score.

The driver loops over personas and parameters; every fit runs distributed.  Training
rows should be a stored table (`materialize`); vectors are cached while a persona is
being worked on, and a lost executor's share is rebuilt from that table.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall import settings as S
from footfall.operators.profiling import nonnull_features
from footfall.operators.sampling import poisson_weight, stratified_folds
from footfall.operators.selection import as_lists
from footfall.sources.staging import checkpoint_dir, materialize

TARGET = "target_shopped_ind"
LABEL = "label"
VECTOR = "features"

FeatureLists = dict[int, list[str]]


def _columns() -> dict:
    return {"featuresCol": VECTOR, "labelCol": LABEL}


def random_forest(depth: int = 11, impurity: str = "gini", trees: int = 200, seed: int = 2301) -> Estimator:
    return RandomForestClassifier(
        numTrees=trees, maxDepth=depth, impurity=impurity, seed=seed, maxMemoryInMB=1024, cacheNodeIds=True, **_columns()
    )


def elastic_net(alpha: float = 0.001, l1_ratio: float = 0.4, max_iter: int = 1000) -> Estimator:
    """mean log loss + alpha * (l1_ratio * |w|_1 + (1 - l1_ratio) / 2 * |w|_2^2)."""
    return LogisticRegression(
        regParam=alpha, elasticNetParam=l1_ratio, standardization=False, maxIter=max_iter, **_columns()
    )


def l1_logistic(n_rows: int, c: float = 0.1, max_iter: int = 1000) -> Estimator:
    """C * summed log loss + |w|_1, put in terms of the mean loss."""
    return elastic_net(alpha=1.0 / (c * n_rows), l1_ratio=1.0, max_iter=max_iter)


def gradient_boosting(
    trees: int = 500, rate: float = 0.02, depth: int = 3, subsample: float = 1.0, seed: int = 5301
) -> Estimator:
    return GBTClassifier(
        maxIter=trees, stepSize=rate, maxDepth=depth, subsamplingRate=subsample, seed=seed, maxMemoryInMB=1024, **_columns()
    )


def usable_features(df: DataFrame, features: list[str]) -> FeatureLists:
    """Per persona, the features that are not null throughout, in the given order."""
    found = as_lists(nonnull_features(df, features))
    return {p: [f for f in features if f in names] for p, names in sorted(found.items())}


def persona_vectors(df: DataFrame, persona: int, features: list[str], *keep: str) -> DataFrame:
    """Rows of one persona with label and feature vector."""
    rows = df.where(F.col("persona") == persona)
    labelled = rows.withColumn(LABEL, F.col(TARGET).cast("double"))
    assembled = VectorAssembler(inputCols=features, outputCol=VECTOR).transform(labelled)
    return assembled.select("cust_key", "persona", TARGET, LABEL, VECTOR, *keep)


@contextmanager
def cached(df: DataFrame):
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def _ready(df: DataFrame) -> None:
    checkpoint_dir(df.sparkSession)  # tree ensembles cut their own lineage there


def side_by_side(jobs: list[Callable], parallelism: int) -> list:
    """Results of jobs that each start Spark jobs of their own, a few at a time."""
    session = SparkSession.active()
    with ThreadPool(max(1, min(parallelism, len(jobs)))) as pool:
        return pool.map(inheritable_thread_target(session)(lambda job: job()), jobs)


def fit_models(df: DataFrame, features: FeatureLists, make: Callable[[int, int], Estimator], parallelism: int = 5) -> dict[int, Model]:
    """One fitted model per persona; ``make(persona, n_rows)`` gives the estimator."""
    _ready(df)

    def fit(persona: int, names: list[str]) -> Model:
        with cached(persona_vectors(df, persona, names)) as rows:
            return make(persona, rows.count()).fit(rows)

    found = side_by_side([partial(fit, p, names) for p, names in features.items()], parallelism)
    return dict(zip(features, found, strict=True))


def score(df: DataFrame, features: FeatureLists, models: dict[int, Model]) -> DataFrame:
    """(cust_key, persona, y, pred, prob) over all personas that have a model."""
    parts = []
    for persona, model in models.items():
        predicted = model.transform(persona_vectors(df, persona, features[persona]))
        parts.append(
            predicted.select(
                "cust_key",
                "persona",
                F.col(TARGET).cast("int").alias("y"),
                F.col("prediction").cast("int").alias("pred"),
                vector_to_array("probability")[1].alias("prob"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def importances(df: DataFrame, features: FeatureLists, models: dict[int, Model]) -> DataFrame:
    """(persona, feature, importance) of tree models, most important first."""
    rows = []
    for persona, model in models.items():
        values = model.featureImportances.toArray()
        rows += [(persona, f, float(v)) for f, v in zip(features[persona], values)]
    table = df.sparkSession.createDataFrame(rows, "persona int, feature string, importance double")
    return table.orderBy("persona", F.col("importance").desc())


def grid_search(
    df: DataFrame,
    features: FeatureLists,
    make: Callable[[dict[str, float], int, int], Estimator],
    grid: list[dict[str, float]],
    n_folds: int = 5,
    seed: int = S.SPLIT_SEED,
    parallelism: int = 8,
) -> DataFrame:
    """(persona, params, mean_test_score, std_test_score, rank_test_score): negative log
    loss over stratified folds, for every parameter set of ``grid``.

    ``make(point, persona, n_rows)`` gives the estimator of a parameter set, with the rows
    it will be fitted on, so that penalties on summed losses can be searched as well.
    Folds are dealt once and stored; nothing is fitted beyond the folds.
    """
    _ready(df)
    folded = materialize(stratified_folds(df, n_folds, seed), "folds")
    loss = MulticlassClassificationEvaluator(metricName="logLoss", labelCol=LABEL, probabilityCol="probability")
    results = []
    for persona, names in features.items():
        with cached(persona_vectors(folded, persona, names, "fold")) as rows:
            sizes = {r.fold: r["count"] for r in rows.groupBy("fold").count().collect()}
            total = sum(sizes.values())

            def one(point: dict[str, float], fold: int, persona=persona, rows=rows, left=total, sizes=sizes) -> float:
                model = make(point, persona, left - sizes[fold]).fit(rows.where(F.col("fold") != fold))
                return -loss.evaluate(model.transform(rows.where(F.col("fold") == fold)))

            tries = [(i, fold) for i in range(len(grid)) for fold in sorted(sizes)]
            scores = side_by_side([partial(one, grid[i], fold) for i, fold in tries], parallelism)
        for i, point in enumerate(grid):
            of_point = np.array([s for (k, _), s in zip(tries, scores, strict=True) if k == i])
            results.append((persona, {k: float(v) for k, v in point.items()}, float(of_point.mean()), float(of_point.std())))
    table = df.sparkSession.createDataFrame(
        results, "persona int, params map<string,double>, mean_test_score double, std_test_score double"
    )
    order = Window.partitionBy("persona").orderBy(F.col("mean_test_score").desc())
    return table.withColumn("rank_test_score", F.rank().over(order))


def searchable(run_seed: int = 2301, trees: int = 200, boosts: int = 500, max_iter: int = 1000) -> dict[str, Callable]:
    """Estimators by parameter set, as `grid_search` takes them."""
    return {
        "rf": lambda x, p, n: random_forest(int(x["depth"]), trees=trees, seed=run_seed + p),
        "gbt": lambda x, p, n: gradient_boosting(boosts, depth=int(x["depth"]), subsample=x.get("subsample", 1.0), seed=5301 + p),
        "enet": lambda x, p, n: elastic_net(x["alpha"], x["l1_ratio"], max_iter),
        "l1": lambda x, p, n: l1_logistic(n, x["C"], max_iter),
    }


def best_params(results: DataFrame) -> DataFrame:
    """The parameters ranked first, one row per persona."""
    return results.where("rank_test_score = 1").groupBy("persona").agg(F.min_by("params", "std_test_score").alias("params"))


def bootstrap_coefs(
    df: DataFrame,
    features: FeatureLists,
    n_resample: int = 100,
    alpha: float = 0.001,
    l1_ratio: float = 0.4,
    seed: int = 4040,
    max_iter: int = 1000,
    parallelism: int = 8,
) -> DataFrame:
    """(persona, replicate, feature, coef): elastic-net fits on resampled rows.

    A resample is a weight per row, so all fits of a persona share one cached table.
    """
    results = []
    for persona, names in features.items():
        with cached(persona_vectors(df, persona, names)) as rows:
            rows.count()

            def one(replicate: int, rows=rows) -> list[float]:
                weighted = rows.withColumn("weight", poisson_weight(seed, replicate)).where("weight > 0")
                return elastic_net(alpha, l1_ratio, max_iter).setWeightCol("weight").fit(weighted).coefficients.toArray().tolist()

            fitted = side_by_side([partial(one, r) for r in range(n_resample)], parallelism)
        results += [(persona, r, f, c) for r, coefs in enumerate(fitted) for f, c in zip(names, coefs, strict=True)]
    return df.sparkSession.createDataFrame(results, "persona int, replicate int, feature string, coef double")
