"""The whole run for one event: features, sample, selection, models.

Every stage reads stored tables and writes stored tables under one output folder, so a
stage can be run again on its own and nothing depends on executors staying alive.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall import settings as S
from footfall.operators import distribution as DIST
from footfall.operators import evaluation as EVAL
from footfall.operators import linear as LIN
from footfall.operators import models as ML
from footfall.operators import profiling as PROF
from footfall.operators import sampling as SAMP
from footfall.operators import scaling as SCALE
from footfall.operators import selection as SEL
from footfall.operators import spans as SPAN
from footfall.operators.matrix import feature_matrix
from footfall.sources import tables as IO
from footfall.sources.retail import RetailTables


@dataclass(frozen=True)
class Run:
    """What to model, with the defaults of the original study."""

    out: str
    event: str = S.DEFAULT_EVENT
    year: int = S.DEFAULT_YEAR
    feature_date_offset: int = S.FEATURE_DATE_OFFSET
    sample_size: int = S.SAMPLE_SIZE
    sample_seed: int = S.SAMPLE_SEED
    split_seed: int = S.SPLIT_SEED
    train_size: float = S.TRAIN_SIZE
    log_features: list[str] = field(default_factory=lambda: list(S.LOG_FEATURES))
    search: tuple[str, ...] = ("enet", "l1")  # models whose parameters are searched instead of taken from here
    grids: dict[str, list[dict[str, float]]] = field(default_factory=lambda: default_grids())
    n_folds: int = 5
    n_resample: int = 100
    n_trees: int = 200
    n_boosts: int = 500
    max_iter: int = 1000
    forest_depth: dict[int, int] = field(default_factory=lambda: dict(S.FOREST_DEPTH))
    top_forest: dict[int, SEL.Quota] = field(
        default_factory=lambda: {
            1: 51,
            2: 45,
            3: {"continuous": 32, "binary": 13, "ordinal": 11},
            4: 55,
            5: {"continuous": 32, "binary": 12, "ordinal": 10},
        }
    )
    top_logistic: dict[int, int] = field(default_factory=lambda: {1: 57, 2: 49, 3: 60, 4: 59, 5: 55})

    @property
    def slug(self) -> str:
        """Short name of event and year, as in file names."""
        found = {e.event: e.event_slug for e in S.MODELLED_EVENTS}
        return f"{found[self.event]}{self.year % 1000}"

    def path(self, name: str) -> str:
        return f"{self.out.rstrip('/')}/ep_{self.slug}_{name}"


def _store(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_features(run: Run, tables: RetailTables, events: DataFrame, export: bool = False) -> DataFrame:
    """The feature matrix, stored as Parquet and on demand as delimited text."""
    start, end, feature_end = SPAN.target_window(events, run.event, run.year, run.feature_date_offset)
    matrix = _store(feature_matrix(tables, events, start, end, feature_end), run.path("matrix"))
    if export:
        IO.export_matrix(matrix, run.path("matrix_csv"))
    return matrix


def sample_and_split(run: Run, matrix: DataFrame) -> dict[str, DataFrame]:
    """Equal sample per persona, logs, stratified split and scaling, with summaries."""
    sample = _store(SAMP.sample_per_group(matrix, run.sample_size, run.sample_seed), run.path("sample"))
    _store(DIST.label_rate(matrix), run.path("data_summary"))
    _store(DIST.label_rate(sample), run.path("sample_summary"))

    logged = SCALE.log_features(sample, run.log_features)
    split = SAMP.stratified_split(logged, run.train_size, run.split_seed)
    train, test = split.where("is_train").drop("is_train"), split.where("not is_train").drop("is_train")
    result = {
        "unscaled_train": _store(train, run.path("unscaled_train_sample")),
        "unscaled_test": _store(test, run.path("unscaled_test_sample")),
    }
    features = [c for c in logged.columns if c not in S.ID_COLUMNS]
    train, test = SCALE.scale_data(result["unscaled_train"], result["unscaled_test"], features)
    result["scaled_train"] = _store(SCALE.add_squared_recency(train), run.path("scaled_train_sample"))
    result["scaled_test"] = _store(SCALE.add_squared_recency(test), run.path("scaled_test_sample"))
    return result


def persona_distribution(run: Run, tables: RetailTables, events: DataFrame) -> DataFrame:
    """Shoppers by persona and event in the years before the modelled one, their shares and the test of independence."""
    dist = _store(DIST.add_not_shopped(DIST.persona_event_dist(tables, events, run.year - 4, run.year)), run.path("persona_event_dist"))
    _store(DIST.shopped_share(dist), run.path("persona_event_pct"))
    tested = _store(DIST.chi_square(dist, ["persona", "event"], ["n_shopped", "n_notshopped"]), run.path("persona_event_test"))
    return tested.withColumn("p_value", F.lit(DIST.chi_square_p_value(tested)))


def explore(run: Run, sets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Profile, high correlations and low variances of the training set."""
    train, scaled = sets["unscaled_train"], sets["scaled_train"]
    features = [c for c in train.columns if c not in S.ID_COLUMNS]
    high = PROF.high_corr_pairs(PROF.correlations(train, features))
    return {
        "profile": _store(PROF.column_profile(train, features), run.path("profile")),
        "high_corr": _store(high, run.path("high_corr")),
        "low_variance": _store(PROF.low_variance(scaled, features), run.path("low_variance")),
    }


def select_features(run: Run, sets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Forest importances and bootstrap coefficients pick each persona's features."""
    train, scaled = sets["unscaled_train"], sets["scaled_train"]
    features = [c for c in train.columns if c not in S.ID_COLUMNS]
    kept = SEL.as_lists(SEL.keep_features(PROF.nonnull_features(train, features)))
    kept = {p: [f for f in features if f in names] for p, names in sorted(kept.items())}

    forests = ML.fit_models(
        train, kept, lambda p, n: ML.random_forest(run.forest_depth[p], trees=run.n_trees, seed=202741)
    )
    types = PROF.feature_kinds(train, features)
    importances = ML.importances(train, kept, forests).join(F.broadcast(types), "feature")
    importances = _store(importances.select("persona", "feature", "importance", "feature_type"), run.path("feature_importances"))

    with_square = {p: names + ["months_since_last_squared"] for p, names in kept.items()}
    coefs = LIN.bootstrap_coefs(scaled, with_square, run.n_resample, max_passes=run.max_iter)
    summary = _store(SEL.bootstrap_summary(coefs), run.path("bootstrapped_coefs"))

    forest = SEL.as_lists(SEL.top_stratified(importances, run.top_forest))
    logistic = SEL.as_lists(SEL.top_bootstrapped(summary, run.top_logistic, ["prop_selected", "abs_mean_coef"]))
    chosen = {}
    for kind, lists, source in (("rf", forest, "unscaled"), ("lr", logistic, "scaled")):
        for part in ("train", "test"):
            narrow = SEL.narrow_by_persona(sets[f"{source}_{part}"], lists)
            path = run.path(f"{kind}_{part}_data")
            IO.save_by_persona(narrow, path)
            # the persona comes back from the folder names
            chosen[f"{kind}_{part}"] = narrow.sparkSession.read.schema(narrow.schema).parquet(path)
    return chosen


def default_grids() -> dict[str, list[dict[str, float]]]:
    """The parameter sets of each kind of model."""
    boost = [{"depth": d} for d in S.BOOST_DEPTHS]
    return {
        "rf_gini": [{"depth": d} for d in S.FOREST_DEPTHS],
        "rf_entropy": [{"depth": d} for d in S.FOREST_DEPTHS],
        "enet": [{"alpha": a, "l1_ratio": r} for a in S.ENET_ALPHAS for r in S.ENET_L1_RATIOS],
        "l1": [{"C": c} for c in S.L1_CS],
        "gbt": boost,
        "gbt_sub": [{**b, "subsample": 0.7} for b in boost],
    }


def searched(run: Run, name: str, train: DataFrame, features: ML.FeatureLists) -> ML.Callable:
    """Searches a model's grid on the train rows, stores the results, and makes the best per persona."""
    kinds = ML.searchable(trees=run.n_trees, boosts=run.n_boosts, max_iter=run.max_iter)
    impurity, seed = ("entropy", 2351) if name == "rf_entropy" else ("gini", 2301)
    forest = lambda x, p, n: ML.random_forest(int(x["depth"]), impurity, run.n_trees, seed + p)
    make = {"enet": kinds["enet"], "l1": kinds["l1"], "gbt": kinds["gbt"], "gbt_sub": kinds["gbt"]}.get(name, forest)
    if name in ("enet", "l1"):
        results = LIN.grid_search(train, features, run.grids[name], run.n_folds, run.split_seed, run.max_iter)
    else:
        results = ML.grid_search(train, features, make, run.grids[name], run.n_folds, run.split_seed)
    found = _store(results, run.path(f"search/{name}"))
    best = {row.persona: row.params for row in ML.best_params(found).collect()}
    return lambda p, n: make(best[p], p, n)


def model_makers(run: Run) -> dict[str, tuple[str, type, ML.Callable]]:
    """Name: which data, the class that loads the model, and how to make it per persona."""
    from pyspark.ml.classification import (
        GBTClassificationModel,
        LogisticRegressionModel,
        RandomForestClassificationModel,
    )

    def forest(impurity: str, seed: int):
        return lambda p, n: ML.random_forest(run.forest_depth[p], impurity, run.n_trees, seed + p)

    def boosted(subsample: float):
        return lambda p, n: ML.gradient_boosting(run.n_boosts, subsample=subsample, seed=5301 + p)

    return {
        "rf_gini": ("rf", RandomForestClassificationModel, forest("gini", 2301)),
        "rf_entropy": ("rf", RandomForestClassificationModel, forest("entropy", 2351)),
        "enet": ("lr", LogisticRegressionModel, lambda p, n: ML.elastic_net(max_iter=run.max_iter)),
        "l1": ("lr", LogisticRegressionModel, lambda p, n: ML.l1_logistic(n, max_iter=run.max_iter)),
        "gbt": ("rf", GBTClassificationModel, boosted(1.0)),
        "gbt_sub": ("rf", GBTClassificationModel, boosted(0.7)),
    }


def fit_and_score(run: Run, chosen: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
    """Fits and saves each model per persona; (model, persona, metrics) on the test set."""
    tables = []
    for name, (kind, _, make) in model_makers(run).items():
        if names is not None and name not in names:
            continue
        train, test = chosen[f"{kind}_train"], chosen[f"{kind}_test"]
        features = ML.usable_features(train, [c for c in train.columns if c not in S.ID_COLUMNS])
        if name in run.search:
            make = searched(run, name, train, features)
        models = ML.fit_models(train, features, make)
        IO.save_models(models, run.path(f"models/{name}"))
        scored = _store(ML.score(test, features, models), run.path(f"scored/{name}"))
        tables.append(EVAL.score_metrics(scored).withColumn("model", F.lit(name)))
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return _store(result, run.path("scores"))


def run_all(run: Run, tables: RetailTables, events: DataFrame, models: list[str] | None = None) -> DataFrame:
    matrix = build_features(run, tables, events)
    sets = sample_and_split(run, matrix)
    explore(run, sets)
    persona_distribution(run, tables, events)
    return fit_and_score(run, select_features(run, sets), models)
