"""Registered queries: each operator run over whole tables under one data folder.

`queries` maps names to ``f(spark, sf_dir) -> DataFrame``.  Calendar operators are joined
to the sales of their days, so their work follows the tables as well.  Steps after the
feature matrix read it as a stored table, written once per session and folder, the way
the pipeline does.  Results are put into plain types (`plain`) for comparison.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from functools import cached_property

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall import settings as S
from footfall.functions.columns import hash_key, hash_number
from footfall.operators import calendar as CAL
from footfall.operators import distribution as DIST
from footfall.operators import evaluation as EVAL
from footfall.operators import features as FEAT
from footfall.operators import linear as LIN
from footfall.operators import matrix as MAT
from footfall.operators import models as ML
from footfall.operators import population as POP
from footfall.operators import profiling as PROF
from footfall.operators import ranking as RANK
from footfall.operators import sampling as SAMP
from footfall.operators import scaling as SCALE
from footfall.operators import selection as SEL
from footfall.operators import spans as SPAN
from footfall.sources import tables as IO
from footfall.sources.retail import RetailTables, retail_tables
from footfall.sources.staging import checkpoint_dir, materialize, partitions_by_size

CALENDAR_END = date(2019, 12, 31)
FIRST_YEAR, LAST_YEAR = 2013, 2017
N_SAMPLE = 500
SCORE_SEED = 7
# What the registered boosting query takes less of than the full run (`plans/pipeline.py`): 500
# trees are thousands of Spark jobs.
BOOSTS = 50

# Decimals that results are compared with.  Shares have ten decimals, a hundred times a
# share has eight: cutting these at six would meet exact ties, which engines round apart.
DIGITS = {
    "pct_spend_in_event": 10,
    "pct_spend_in_event_ly": 10,
    "pct_trips_in_event": 10,
    "pct_events_shopped": 10,
    "transform_by_rule": 10,
    "feature_matrix": 8,
    "roundtrip_csv": 8,
    "loaded_table": 8,
    "log_features": 8,
    "narrow_by_persona": 8,
    "column_profile": 8,
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

_stored: dict[tuple, object] = {}


def _once(key: tuple, make: Callable):
    """What a session works out once: the calendar, the target span, stored matrices."""
    if key not in _stored:
        _stored[key] = make()
    return _stored[key]


class Context:
    """Tables of one folder and the fixed settings of the registered queries."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._app = spark.sparkContext.applicationId

    @cached_property
    def tables(self) -> RetailTables:
        return retail_tables(self.spark, self.sf_dir)

    @property
    def events(self) -> DataFrame:
        """Event calendar of fixed dates: 2,556 rows, kept in memory."""
        return _once((self._app, "events"), lambda: CAL.default_event_calendar(self.spark, CALENDAR_END).persist())

    @property
    def window(self) -> tuple[date, date, date]:
        """Target start, target end and feature end."""
        find = lambda: SPAN.target_window(self.events, S.DEFAULT_EVENT, S.DEFAULT_YEAR)
        return _once((self._app, "window"), find)

    @property
    def observed(self) -> DataFrame:
        return CAL.observed_days(self.daily)

    @cached_property
    def daily(self) -> DataFrame:
        """Sale lines per day, from one scan of the sales."""
        return materialize(self.tables.trans.groupBy("sale_dt").agg(F.count("*").alias("n_lines")), "daily")

    def feature_matrix(self) -> DataFrame:
        start, end, feature_end = self.window
        return MAT.feature_matrix(self.tables, self.events, start, end, feature_end)

    @property
    def matrix(self) -> DataFrame:
        def make() -> DataFrame:
            with partitions_by_size(self.spark, sum(size for _, size, _ in self.version)):
                return materialize(self.feature_matrix(), "matrix")

        return _once((self._app, "matrix", self.sf_dir, self.version), make)

    @cached_property
    def version(self) -> tuple:
        """Sizes and times of the input files, so that changed data is worked out anew."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        seen = []
        for name in ("customer", "lineitem", "orders", "part"):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{name}.parquet")
            seen += [(s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in path.getFileSystem(conf).listStatus(path)]
        return tuple(seen)

    @property
    def sets(self) -> dict[str, DataFrame]:
        """Train and test rows of the stratified split, as they are and on the scale of the train rows."""

        def make() -> dict[str, DataFrame]:
            split = materialize(SAMP.stratified_split(self.matrix, S.TRAIN_SIZE, S.SPLIT_SEED), "split")
            scaling = SCALE.fit_standard_scaling(split.where("is_train"), S.FEATURE_COLUMNS)
            scaled = materialize(scaling.transform(split), "scaled")
            found = {}
            for kind, rows in (("unscaled", split), ("scaled", scaled)):
                found |= {f"{kind}_train": rows.where("is_train"), f"{kind}_test": rows.where("not is_train")}
            return found

        return _once((self._app, "sets", self.sf_dir, self.version), make)

    @property
    def importances(self) -> DataFrame:
        """A stand-in importance that any engine can work out: the log of the variance."""
        spread = PROF.variances(self.matrix, S.FEATURE_COLUMNS)
        types = PROF.feature_kinds(self.matrix, S.FEATURE_COLUMNS)
        rounded = spread.select("persona", "feature", F.round(F.log1p("variance"), 6).alias("importance"))
        return rounded.join(F.broadcast(types), "feature").select("persona", "feature", "importance", "feature_type")

    @property
    def coefs(self) -> DataFrame:
        """Stand-in coefficients of five replicates: feature means by customer fold."""
        means = self.matrix.groupBy("persona", (F.col("cust_key") % 5).cast("int").alias("replicate")).agg(
            *[F.round(F.avg(F.col(f).cast("double")), 6).alias(f) for f in S.FEATURE_COLUMNS]
        )
        structs = ", ".join(f"struct('{f}' as feature, {f} as coef)" for f in S.FEATURE_COLUMNS)
        return means.selectExpr("persona", "replicate", f"inline(array({structs}))")

    @property
    def summary(self) -> DataFrame:
        summary = SEL.bootstrap_summary(self.coefs)
        return summary.select("persona", "feature", *[F.round(c, 6).alias(c) for c in summary.columns[2:]])

    @property
    def scored(self) -> DataFrame:
        """Labels with a stand-in probability taken from the customer's digest."""
        prob = F.round(hash_number(hash_key(SCORE_SEED, "cust_key"), 6) / F.lit(float(16**6)), 3)
        scored = self.matrix.select("cust_key", "persona", F.col("target_shopped_ind").alias("y"), prob.alias("prob"))
        return scored.withColumn("pred", F.when(F.col("prob") >= 0.5, 1).otherwise(0))


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Dates as text, whole numbers as bigint, other numbers as rounded doubles."""
    columns = []
    for name, kind in df.dtypes:
        if kind in ("date", "timestamp", "timestamp_ntz"):
            columns.append(f"cast(`{name}` as string) as `{name}`")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            columns.append(f"round(cast(`{name}` as double), {digits}) + 0D as `{name}`")
        elif kind in ("int", "smallint", "tinyint", "boolean"):
            columns.append(f"cast(`{name}` as bigint) as `{name}`")
        else:
            columns.append(f"`{name}`")
    return df.selectExpr(*columns)


def query(build: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
    digits = DIGITS.get(build.__name__, 6)
    QUERIES[build.__name__] = lambda spark, sf_dir: plain(build(Context(spark, sf_dir)), digits)
    return build


def _with_lines(c: Context, days: DataFrame, day: str) -> DataFrame:
    """Adds the sale lines of each day, 0 on days without sales."""
    joined = days.join(c.daily, days[day] == c.daily["sale_dt"], "left").drop("sale_dt")
    return joined.withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))


def _span_lines(c: Context, spans: DataFrame) -> DataFrame:
    """Adds the sale lines of each span: spans by day, met by day."""
    keys = spans.columns
    by_day = spans.withColumn("sale_dt", F.explode(F.sequence("start_dt", "end_dt")))
    joined = by_day.join(c.daily, "sale_dt", "left")
    return joined.groupBy(*keys).agg(F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines"))


# --- sources and sinks -----------------------------------------------------------------


@query
def scan_trans(c: Context) -> DataFrame:
    return c.tables.trans


@query
def event_config(c: Context) -> DataFrame:
    """Modelled events with the sale lines of their days."""
    long = c.events.unpivot(["event_dt"], S.EVENT_NAMES, "event", "flag").where("flag = 1")
    lines = long.join(c.daily, long["event_dt"] == c.daily["sale_dt"]).groupBy("event").agg(
        F.sum("n_lines").alias("n_lines")
    )
    return IO.read_event_config(c.spark).join(lines, "event", "left")


def _export_path(c: Context) -> str:
    return f"{checkpoint_dir(c.spark).rstrip('/')}/footfall-export-{uuid.uuid4().hex}"


@query
def roundtrip_csv(c: Context) -> DataFrame:
    """The feature matrix written as delimited text and read back."""
    path = _export_path(c)
    IO.export_matrix(c.matrix, path)
    return IO.read_delimited(c.spark, path, c.matrix.schema)


@query
def loaded_table(c: Context) -> DataFrame:
    """The exported matrix loaded from its files into a catalog table, and that table read."""
    path, name = _export_path(c), f"footfall_export_{uuid.uuid4().hex}"
    IO.export_matrix(c.matrix, path)
    IO.load_delimited(c.spark, path, c.matrix.schema, name)
    try:
        return materialize(c.spark.table(name), "loaded")
    finally:
        c.spark.sql(f"drop table {name}")


@query
def persona_folders(c: Context) -> DataFrame:
    """The split saved in one folder per persona; reading finds the personas in the folder names."""
    path = _export_path(c)
    split = SAMP.stratified_split(c.matrix, S.TRAIN_SIZE, S.SPLIT_SEED)
    IO.save_by_persona(split.select("cust_key", "persona", "target_shopped_ind", "is_train"), path)
    return c.spark.read.parquet(path).select("cust_key", "persona", "target_shopped_ind", "is_train")


# --- calendar and spans ----------------------------------------------------------------


@query
def yearly_holidays(c: Context) -> DataFrame:
    per_year = c.daily.groupBy(F.year("sale_dt").alias("yr_cal")).agg(F.sum("n_lines").alias("n_lines"))
    return CAL.yearly_holidays(c.observed).join(per_year, "yr_cal", "left")


@query
def calendar_454(c: Context) -> DataFrame:
    return _with_lines(c, CAL.calendar_454(c.observed), "day_dt")


@query
def extra_week(c: Context) -> DataFrame:
    per_year = c.daily.groupBy(F.year("sale_dt").alias("yr_cal")).agg(F.sum("n_lines").alias("n_lines"))
    return CAL.extra_week(CAL.calendar_454(c.observed)).join(per_year, "yr_cal", "left")


@query
def event_calendar(c: Context) -> DataFrame:
    built = CAL.build_event_calendar(c.observed).select("day_dt", *S.CALENDAR_FLAGS)
    return _with_lines(c, built, "day_dt")


@query
def event_rollups(c: Context) -> DataFrame:
    built = CAL.build_event_calendar(c.observed).select("day_dt", *S.ROLLUPS, *S.ROLLUP_PAIRS)
    return _with_lines(c, built, "day_dt")


@query
def event_span(c: Context) -> DataFrame:
    return _span_lines(c, SPAN.event_span(c.events, S.DEFAULT_EVENT, S.DEFAULT_YEAR))


@query
def event_spans_all(c: Context) -> DataFrame:
    return _span_lines(c, SPAN.event_spans(c.events))


@query
def event_dates_lookback(c: Context) -> DataFrame:
    return _span_lines(c, SPAN.spans_in_lookback(SPAN.event_spans(c.events), c.window[2]))


# --- population ------------------------------------------------------------------------


@query
def post_acq_trans(c: Context) -> DataFrame:
    # a stored funnel: both sides of the join come straight from a shuffle, so that a heavy customer is split
    return POP.post_acquisition(c.tables.trans, materialize(c.tables.funnel, "funnel"))


@query
def base_population(c: Context) -> DataFrame:
    t = c.tables
    return POP.base_population(t.customers, t.trans, t.funnel, c.window[2])


@query
def persona_population(c: Context) -> DataFrame:
    t = c.tables
    return POP.persona_population(t.customers, t.personas, t.trans, t.funnel, FIRST_YEAR, LAST_YEAR)


@query
def base_trans(c: Context) -> DataFrame:
    t = c.tables
    population = POP.base_population(t.customers, t.trans, t.funnel, c.window[2])
    return POP.base_trans(t.trans, t.funnel, population, c.window[2])


@query
def target_label(c: Context) -> DataFrame:
    t = c.tables
    start, end, feature_end = c.window
    population = POP.base_population(t.customers, t.trans, t.funnel, feature_end)
    return POP.labelled_population(population, POP.target_label(t.trans, t.funnel, start, end))


# --- features --------------------------------------------------------------------------


@query
def pct_spend_in_event(c: Context) -> DataFrame:
    return FEAT.pct_spend_in_event(c.tables, c.events, c.window[2])


@query
def pct_spend_in_event_ly(c: Context) -> DataFrame:
    return FEAT.pct_spend_in_event_ly(c.tables, c.events, c.window[2])


@query
def pct_trips_in_event(c: Context) -> DataFrame:
    return FEAT.pct_trips_in_event(c.tables, c.events, c.window[2])


@query
def pct_events_shopped(c: Context) -> DataFrame:
    return FEAT.pct_events_shopped(c.tables, c.events, c.window[2])


@query
def event_shopped_ly(c: Context) -> DataFrame:
    return FEAT.event_shopped_ly(c.tables, c.events, c.window[2])


@query
def cust_stats(c: Context) -> DataFrame:
    return FEAT.cust_stats(c.tables, c.events, c.window[2])


@query
def feature_matrix(c: Context) -> DataFrame:
    return c.feature_matrix()


@query
def tenure_recency(c: Context) -> DataFrame:
    return MAT.tenure_recency(c.tables, c.events, c.window[0], c.window[2])


# --- persona distribution --------------------------------------------------------------


def _distribution(c: Context) -> DataFrame:
    return DIST.persona_event_dist(c.tables, c.events, FIRST_YEAR, LAST_YEAR)


@query
def persona_event_dist(c: Context) -> DataFrame:
    return DIST.add_not_shopped(_distribution(c))


@query
def persona_event_pct(c: Context) -> DataFrame:
    dist = materialize(_distribution(c), "distribution")
    overall = DIST.shopped_share(dist).withColumn("years", F.lit("all"))
    one_year = DIST.shopped_share(dist, LAST_YEAR).withColumn("years", F.lit(str(LAST_YEAR)))
    both = overall.unionByName(one_year)
    return both.select("years", "event", *[F.col(str(p)).alias(f"persona_{p}") for p in S.PERSONAS])


@query
def chi2_persona_event(c: Context) -> DataFrame:
    dist = materialize(DIST.add_not_shopped(_distribution(c)), "distribution")
    with_years = DIST.chi_square(dist, ["persona", "year", "event"], ["n_shopped", "n_existing"])
    plain_table = DIST.chi_square(dist, ["persona", "event"], ["n_shopped", "n_notshopped"])
    return with_years.withColumn("test", F.lit("persona_year_event")).unionByName(
        plain_table.withColumn("test", F.lit("persona_event"))
    )


@query
def label_rate_by_persona(c: Context) -> DataFrame:
    return DIST.label_rate(c.matrix)


# --- sampling and scaling --------------------------------------------------------------


@query
def sample_per_group(c: Context) -> DataFrame:
    return SAMP.sample_per_group(c.matrix, N_SAMPLE, S.SAMPLE_SEED).select(*S.ID_COLUMNS)


@query
def sample_n(c: Context) -> DataFrame:
    return SAMP.sample_n(c.matrix, N_SAMPLE, S.SAMPLE_SEED).select(*S.ID_COLUMNS)


@query
def sample_stratified(c: Context) -> DataFrame:
    return SAMP.sample_stratified(c.matrix, N_SAMPLE, S.SAMPLE_SEED).select(*S.ID_COLUMNS)


@query
def stratified_split(c: Context) -> DataFrame:
    return SAMP.stratified_split(c.matrix, S.TRAIN_SIZE, S.SPLIT_SEED).select(*S.ID_COLUMNS, "is_train")


@query
def stratified_folds(c: Context) -> DataFrame:
    return SAMP.stratified_folds(c.matrix, 5, S.SPLIT_SEED).select(*S.ID_COLUMNS, "fold")


@query
def bootstrap_resample(c: Context) -> DataFrame:
    return SAMP.bootstrap_resample(c.matrix.select(*S.ID_COLUMNS), S.SAMPLE_SEED)


@query
def log_features(c: Context) -> DataFrame:
    return SCALE.add_squared_recency(SCALE.log_features(c.matrix))


@query
def scale_standard(c: Context) -> DataFrame:
    """Train and test rows on the scale of the training rows."""
    split = SAMP.stratified_split(c.matrix, S.TRAIN_SIZE, S.SPLIT_SEED)
    scaling = SCALE.fit_standard_scaling(split.where("is_train"), S.FEATURE_COLUMNS)
    return scaling.transform(split)


@query
def transform_by_rule(c: Context) -> DataFrame:
    return SCALE.cap_months(SCALE.transform_by_rule(c.matrix, S.FEATURE_COLUMNS, S.LOG_FEATURES, -0.5))


@query
def min_max_log(c: Context) -> DataFrame:
    """Tenure on the three log scales."""
    tenure = c.matrix.select("cust_key", F.col("tenure_total_months").alias("tenure"))
    scaled = tenure
    for log in ("log1p", "log", "floored"):
        one = SCALE.min_max_log(scaled, "tenure", log)
        scaled = one.withColumnRenamed("tenure_scaled", f"tenure_{log}")
    return scaled


@query
def score_deciles(c: Context) -> DataFrame:
    return RANK.percent_ranks(c.scored, ["persona"], "prob")


# --- profiling and feature selection ---------------------------------------------------


@query
def column_profile(c: Context) -> DataFrame:
    return PROF.column_profile(c.matrix, S.FEATURE_COLUMNS)


@query
def key_alignment(c: Context) -> DataFrame:
    """Scaled against unscaled rows."""
    scaling = SCALE.fit_standard_scaling(c.matrix, S.FEATURE_COLUMNS)
    return PROF.key_alignment(scaling.transform(c.matrix), c.matrix)


@query
def high_corr_pairs(c: Context) -> DataFrame:
    return PROF.high_corr_pairs(PROF.correlations(c.matrix, S.FEATURE_COLUMNS), 0.8)


@query
def high_corr_pivot(c: Context) -> DataFrame:
    high = PROF.high_corr_pairs(PROF.correlations(c.matrix, S.FEATURE_COLUMNS), 0.8)
    return _personas_named(PROF.corr_pivot(high))


@query
def low_variance(c: Context) -> DataFrame:
    return PROF.low_variance(c.matrix, S.FEATURE_COLUMNS, 0.05)


@query
def low_variance_pivot(c: Context) -> DataFrame:
    return _personas_named(PROF.variance_pivot(PROF.low_variance(c.matrix, S.FEATURE_COLUMNS, 0.05)))


@query
def value_counts(c: Context) -> DataFrame:
    return PROF.value_counts(c.matrix, "target_shopped_ind")


@query
def keep_features(c: Context) -> DataFrame:
    return SEL.keep_features(PROF.nonnull_features(c.matrix, S.FEATURE_COLUMNS))


@query
def feature_types(c: Context) -> DataFrame:
    return PROF.feature_types(c.matrix, S.FEATURE_COLUMNS)


@query
def rank_importance(c: Context) -> DataFrame:
    return _personas_named(SEL.rank_importance(c.importances))


@query
def rank_from_top(c: Context) -> DataFrame:
    return SEL.rank_from_top(c.importances, of=35)


@query
def top_stratified(c: Context) -> DataFrame:
    quotas = {1: 51, 2: 45, 3: {"continuous": 32, "binary": 13, "ordinal": 11}, 4: 55, 5: 71}
    return SEL.top_stratified(c.importances, quotas)


@query
def bootstrap_summary(c: Context) -> DataFrame:
    return SEL.bootstrap_summary(c.coefs)


@query
def top_bootstrapped(c: Context) -> DataFrame:
    chosen = {1: 57, 2: 49, 3: 60, 4: 59, 5: 55}
    return SEL.top_bootstrapped(c.summary, chosen, ["prop_selected", "abs_mean_coef"])


@query
def threshold_bootstrapped(c: Context) -> DataFrame:
    least = {1: 0, 2: 70, 3: 0, 4: 49, 5: 71}
    return SEL.threshold_bootstrapped(c.summary, 0.5, least, sort_cols=["abs_mean_coef"])


def _chosen(c: Context) -> DataFrame:
    return SEL.top_bootstrapped(c.summary, 35, ["prop_selected", "abs_mean_coef"])


@query
def narrow_by_persona(c: Context) -> DataFrame:
    kept = SEL.keep_features(PROF.nonnull_features(c.matrix, S.FEATURE_COLUMNS))
    return SEL.narrow_by_persona(c.matrix, SEL.as_lists(kept))


@query
def feature_membership(c: Context) -> DataFrame:
    return _personas_named(SEL.feature_membership(_chosen(c)))


@query
def membership_by_type(c: Context) -> DataFrame:
    return SEL.membership_by_type(_chosen(c), PROF.feature_kinds(c.matrix, S.FEATURE_COLUMNS))


def _personas_named(df: DataFrame) -> DataFrame:
    names = {str(p): f"persona_{p}" for p in S.PERSONAS}
    return df.withColumnsRenamed(names)


# --- models and evaluation: fitted on the train rows, scored on the test rows -------------


@query
def nonnull_features(c: Context) -> DataFrame:
    return PROF.nonnull_features(c.matrix, S.FEATURE_COLUMNS)


def _held_out(c: Context, kind: str, make) -> DataFrame:
    """Scores of the test rows by models of the train rows."""
    train, test = c.sets[f"{kind}_train"], c.sets[f"{kind}_test"]
    usable = ML.usable_features(train, S.FEATURE_COLUMNS)
    return ML.score(test, usable, ML.fit_models(train, usable, make))


def _metrics(c: Context, kind: str, make) -> DataFrame:
    return EVAL.score_metrics(materialize(_held_out(c, kind, make), "scored"))


def _forest(impurity: str = "gini", seed: int = 2301):
    return lambda persona, n: ML.random_forest(S.FOREST_DEPTH.get(persona, 11), impurity, seed=seed + persona)


@query
def rf_importance(c: Context) -> DataFrame:
    train = c.sets["unscaled_train"]
    usable = ML.usable_features(train, S.FEATURE_COLUMNS)
    return ML.importances(train, usable, ML.fit_models(train, usable, _forest()))


@query
def fit_rf(c: Context) -> DataFrame:
    gini = _metrics(c, "unscaled", _forest("gini")).withColumn("impurity", F.lit("gini"))
    entropy = _metrics(c, "unscaled", _forest("entropy", 2351)).withColumn("impurity", F.lit("entropy"))
    return gini.unionByName(entropy)


def _linear(context: Context, **penalty) -> DataFrame:
    """Scores of the test rows by logistic models of the train rows, all personas in one scan."""
    train, test = context.sets["scaled_train"], context.sets["scaled_test"]
    usable = ML.usable_features(train, S.FEATURE_COLUMNS)
    return LIN.score(test, usable, LIN.fit_each(train, usable, **penalty))


@query
def fit_enet(c: Context) -> DataFrame:
    return EVAL.score_metrics(materialize(_linear(c, alpha=0.001, l1_ratio=0.4), "scored"))


@query
def fit_l1(c: Context) -> DataFrame:
    return EVAL.score_metrics(materialize(_linear(c, c=0.1), "scored"))


@query
def fit_gbt(c: Context) -> DataFrame:
    """Stochastic boosting with fewer, larger steps than the full run takes."""
    return _metrics(c, "unscaled", lambda persona, n: ML.gradient_boosting(trees=BOOSTS, rate=10 / BOOSTS, subsample=0.7, seed=5301 + persona))


@query
def reloaded_models(c: Context) -> DataFrame:
    """Test rows by persona, and how many of them models scored otherwise once saved and loaded."""
    train, test = c.sets["scaled_train"], c.sets["scaled_test"]
    usable = ML.usable_features(train, S.FEATURE_COLUMNS)
    models = ML.fit_models(train, usable, lambda persona, n: ML.elastic_net(max_iter=20))
    path = _export_path(c)
    IO.save_models(models, path)
    again = IO.load_models(c.spark, LogisticRegressionModel, path)
    before, after = ML.score(test, usable, models), ML.score(test, usable, again)
    both = before.join(after.select("cust_key", "persona", F.col("prob").alias("prob_again"), F.col("pred").alias("pred_again")), ["cust_key", "persona"], "left")
    same = F.col("prob").eqNullSafe(F.col("prob_again")) & F.col("pred").eqNullSafe(F.col("pred_again"))
    return both.groupBy("persona").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(~same, 1)).alias("n_changed"))


@query
def bootstrap_coefs(c: Context) -> DataFrame:
    """A hundred resamples per persona."""
    train = c.sets["scaled_train"]
    return SEL.bootstrap_summary(LIN.bootstrap_coefs(train, ML.usable_features(train, S.FEATURE_COLUMNS)))


def _searched(c: Context, grid: list[dict[str, float]]) -> DataFrame:
    train = c.sets["scaled_train"]
    found = LIN.grid_search(train, ML.usable_features(train, S.FEATURE_COLUMNS), grid)
    return found.select("*", *[F.col("params")[k].alias(k) for k in grid[0]]).drop("params")


@query
def grid_search(c: Context) -> DataFrame:
    """The elastic net over its whole grid, five folds."""
    return _searched(c, [{"alpha": a, "l1_ratio": r} for a in S.ENET_ALPHAS for r in S.ENET_L1_RATIOS])


@query
def grid_search_l1(c: Context) -> DataFrame:
    """Penalties on absolute values only, over all strengths, five folds."""
    return _searched(c, [{"C": x} for x in S.L1_CS])


@query
def best_params(c: Context) -> DataFrame:
    """Over a stand-in result table: one parameter set per feature, scored by its variance."""
    order = Window.partitionBy("persona").orderBy(F.col("mean_test_score").desc())
    results = c.importances.select(
        "persona",
        F.create_map(F.lit("width"), F.length("feature").cast("double")).alias("params"),
        F.col("importance").alias("mean_test_score"),
        F.length("feature").cast("double").alias("std_test_score"),
    ).withColumn("rank_test_score", F.rank().over(order))
    return ML.best_params(results).select("persona", F.col("params")["width"].alias("width"))


@query
def score_customers(c: Context) -> DataFrame:
    return _linear(c, alpha=0.001, l1_ratio=0.4)


#: Coefficients written down, by persona: one per feature below and the intercept.
FIXED_FEATURES = S.FEATURE_COLUMNS[:3]
FIXED_COEFS = {p: [0.01 * p, -0.02, 0.005 * (p - 3), 0.1 * p - 0.3] for p in S.PERSONAS}


@query
def score_fixed(c: Context) -> DataFrame:
    """Scores by the fixed coefficients."""
    return LIN.score(c.matrix, dict.fromkeys(FIXED_COEFS, FIXED_FEATURES), FIXED_COEFS)


@query
def export_order(c: Context) -> DataFrame:
    """The exported matrix read back, rows numbered in the order of its files."""
    path = _export_path(c)
    IO.export_matrix(c.matrix, path)
    return IO.read_in_order(c.spark, path, "persona").select("row_number", "persona", "target_shopped_ind", "cust_key")


@query
def score_metrics(c: Context) -> DataFrame:
    return EVAL.score_metrics(c.scored)


@query
def confusion_matrix(c: Context) -> DataFrame:
    return EVAL.confusion_matrix(c.scored)


@query
def percentile_cutoff(c: Context) -> DataFrame:
    return EVAL.percentile_cutoff(c.scored, 0.95)
