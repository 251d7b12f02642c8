"""Choosing features per persona.

The tables here have one row per persona and feature, so windows and pivots over them
are small whatever the number of customers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall import settings as S
from footfall.functions.columns import known_group

Quota = int | dict[str, int]


def keep_features(available: DataFrame) -> DataFrame:
    """Features per persona, less those left out by hand: some for every persona, some for one."""
    everywhere = available.where(~F.col("feature").isin(S.DROPPED_EVERYWHERE))
    dropped = [(p, f) for p, names in S.DROPPED_BY_PERSONA.items() for f in names]
    own = available.sparkSession.createDataFrame(dropped, "persona int, feature string").distinct()
    return everywhere.join(F.broadcast(own), ["persona", "feature"], "left_anti")


def rank_importance(importances: DataFrame) -> DataFrame:
    """Rank (ties take the lowest) within persona and feature type, personas as columns."""
    order = Window.partitionBy("persona", "feature_type").orderBy(F.col("importance").desc())
    ranked = importances.withColumn("rank", F.rank().over(order))
    return ranked.withColumn("persona", known_group("persona", S.PERSONAS)).groupBy("feature_type", "feature").pivot("persona", S.PERSONAS).agg(F.max("rank"))


def rank_from_top(importances: DataFrame, of: int = 35) -> DataFrame:
    """``of`` minus the average rank of an importance, smallest first, per persona."""
    group = Window.partitionBy("persona")
    ties = Window.partitionBy("persona", "importance")
    average = F.rank().over(group.orderBy("importance")) + (F.count("*").over(ties) - 1) / 2
    return importances.withColumn("rank", F.lit(of) - average)


def top_stratified(importances: DataFrame, top_n: Quota | dict[int, Quota]) -> DataFrame:
    """The most important features per persona, spread over feature types.

    A number is shared over the types in proportion to their features, by largest
    remainder; a dict gives each type's number.  Tied features take their average rank,
    so a tie across the edge of a quota leaves all its features out.
    """
    persona, kind = Window.partitionBy("persona"), Window.partitionBy("persona", "feature_type")
    ties = Window.partitionBy("persona", "feature_type", "importance")
    by_value = kind.orderBy(F.col("importance").desc())
    ranked = importances.select(
        "*",
        F.count("*").over(persona).alias("_features"),
        F.count("*").over(kind).alias("_of_type"),
        (F.rank().over(by_value) + (F.count("*").over(ties) - 1) / 2).alias("_rank"),
    )
    per_type = ranked.select("persona", "feature_type", "_features", "_of_type").distinct()
    total = _number_column(top_n, "persona")
    exact = total * F.col("_of_type") / F.col("_features")
    by_rest = persona.orderBy(F.round(F.col("_exact") - F.col("_whole"), 9).desc(), "feature_type")
    shared = (
        per_type.withColumn("_total", total)
        .withColumn("_exact", exact)
        .withColumn("_whole", F.floor("_exact"))
        .withColumn("_left", F.col("_total") - F.sum("_whole").over(persona))
        .withColumn("_shared", F.col("_whole") + F.when(F.row_number().over(by_rest) <= F.col("_left"), 1).otherwise(0))
    )
    given = _given_column(top_n)
    quota = F.when(F.col("_total") >= F.col("_features"), F.col("_features")).otherwise(F.col("_shared"))
    quotas = shared.select("persona", "feature_type", F.coalesce(given, quota).alias("_quota"))
    chosen = ranked.join(F.broadcast(quotas), ["persona", "feature_type"]).where("_rank <= _quota")
    return chosen.select(*importances.columns)


def _by_persona(top_n: Quota | dict[int, Quota]) -> bool:
    return isinstance(top_n, dict) and all(isinstance(k, int) for k in top_n)


def _number_column(top_n: Quota | dict[int, Quota], persona: str) -> Column:
    """One number for every persona of the data, or the number of each persona."""
    if isinstance(top_n, int):
        return F.lit(top_n).cast("bigint")
    numbers = {p: q for p, q in top_n.items() if isinstance(q, int)} if _by_persona(top_n) else {}
    return _lookup(numbers, F.col(persona))


def _given_column(top_n: Quota | dict[int, Quota]) -> Column:
    """Numbers given by feature type, for every persona or for one."""
    chosen = F.lit(None).cast("bigint")
    for p, q in (top_n.items() if _by_persona(top_n) else [(None, top_n)]):
        for kind, n in q.items() if isinstance(q, dict) else ():
            here = F.col("feature_type") == kind
            here = here if p is None else here & (F.col("persona") == p)
            chosen = F.when(here, F.lit(n).cast("bigint")).otherwise(chosen)
    return chosen


def _lookup(numbers: dict[int, int], key: Column) -> Column:
    found = F.lit(None).cast("bigint")
    for k, n in numbers.items():
        found = F.when(key == k, F.lit(n).cast("bigint")).otherwise(found)
    return found


def bootstrap_summary(coefs: DataFrame, threshold: float = 1e-6) -> DataFrame:
    """(persona, feature): how often a coefficient was kept, its mean and its spread.

    ``coefs`` has one row per persona, replicate and feature.
    """
    return coefs.groupBy("persona", "feature").agg(
        F.avg(F.when(F.abs("coef") > threshold, 1.0).otherwise(0.0)).alias("prop_selected"),
        F.avg("coef").alias("mean_coef"),
        F.abs(F.avg("coef")).alias("abs_mean_coef"),
        F.stddev_samp("coef").alias("std"),
    )


def _best_first(value_cols: list[str]) -> Window:
    return Window.partitionBy("persona").orderBy(*[F.col(c).desc() for c in value_cols], "feature")


def top_bootstrapped(summary: DataFrame, top_n: int | dict[int, int], value_cols: list[str]) -> DataFrame:
    """The first n features per persona by the value columns, largest first."""
    place = F.row_number().over(_best_first(value_cols))
    limit = _number_column(top_n, "persona")
    return summary.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def threshold_bootstrapped(
    summary: DataFrame,
    prop_threshold: float,
    min_n: int | dict[int, int] = 0,
    value_col: str = "prop_selected",
    sort_cols: list[str] | None = None,
) -> DataFrame:
    """Features above the threshold or, where these are too few, the first ``min_n``."""
    above = F.col(value_col) > prop_threshold
    n_above = F.count_if(above).over(Window.partitionBy("persona"))
    place = F.row_number().over(_best_first([value_col] + (sort_cols or [])))
    least = F.coalesce(_number_column(min_n, "persona"), F.lit(0))
    ranked = summary.select("*", n_above.alias("_above"), place.alias("_place"), least.alias("_least"))
    kept = F.when(F.col("_above") < F.col("_least"), F.col("_place") <= F.col("_least")).otherwise(above)
    return ranked.where(kept).drop("_above", "_place", "_least")


def as_lists(selected: DataFrame) -> dict[int, list[str]]:
    """Selected features per persona: a few hundred names to the driver."""
    lists: dict[int, list[str]] = {}
    for row in selected.select("persona", "feature").collect():
        lists.setdefault(row.persona, []).append(row.feature)
    return lists


def narrow_by_persona(df: DataFrame, selected: dict[int, list[str]], ids: list[str] = S.ID_COLUMNS) -> DataFrame:
    """Keeps each persona's own features; others become null.  One projection."""
    kept = []
    for c in df.columns:
        users = sorted(p for p, names in selected.items() if c in names)
        if c not in ids and users:
            kept.append(F.when(F.col("persona").isin(users), F.col(c)).alias(c))
    return df.where(F.col("persona").isin(sorted(selected))).select(*ids, *kept)


def feature_membership(selected: DataFrame) -> DataFrame:
    """Feature by persona, 1 where selected; features nobody selected have no row."""
    return selected.withColumn("persona", known_group("persona", S.PERSONAS)).groupBy("feature").pivot("persona", S.PERSONAS).agg(F.max(F.lit(1))).na.fill(0)


def membership_by_type(selected: DataFrame, types: DataFrame) -> DataFrame:
    """Selected features per persona by type, and in all."""
    typed = selected.select("persona", "feature").join(types.select("feature", "feature_type"), "feature")
    kinds = ["binary", "ordinal", "continuous"]
    counts = typed.groupBy("persona").pivot("feature_type", kinds).agg(F.count("feature")).na.fill(0)
    return counts.withColumn("total", F.col("binary") + F.col("ordinal") + F.col("continuous"))
