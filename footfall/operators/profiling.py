"""Column profiles, feature types, correlation and variance, per persona."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall import settings as S
from footfall.functions.columns import known_group

CONTINUOUS_ABOVE, ORDINAL_ABOVE = 8, 2
ROUNDING = 9  # digits that are the same however a sum was split over tasks


def _rows(structs: list[str]):
    return F.expr(f"inline(array({', '.join(structs)}))")


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, data_type, min_value, max_value, n_null): one pass for all columns."""
    types = dict(df.dtypes)
    aggregates = []
    for c in columns:
        aggregates += [
            F.min(F.col(c).cast("double")).alias(f"{c}__min"),
            F.max(F.col(c).cast("double")).alias(f"{c}__max"),
            F.count_if(F.col(c).isNull()).alias(f"{c}__null"),
        ]
    structs = [
        f"struct('{c}' as column_name, '{types[c]}' as data_type, `{c}__min` as min_value, "
        f"`{c}__max` as max_value, `{c}__null` as n_null)"
        for c in columns
    ]
    return df.agg(*aggregates).select(_rows(structs))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def key_alignment(left: DataFrame, right: DataFrame, key: str = "cust_key") -> DataFrame:
    """One row: keys on both sides, on one side only, and whether the sets are equal."""
    tagged = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_key = tagged.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return per_key.agg(
        F.count_if((F.col("l") > 0) & (F.col("r") > 0)).alias("n_both"),
        F.count_if(F.col("r") == 0).alias("n_left_only"),
        F.count_if(F.col("l") == 0).alias("n_right_only"),
        F.coalesce(F.bool_and(F.col("l") == F.col("r")), F.lit(True)).alias("aligned"),
    )


def _kind(n_distinct: str):
    return (
        F.when(F.col(n_distinct) > CONTINUOUS_ABOVE, "continuous")
        .when(F.col(n_distinct) > ORDINAL_ABOVE, "ordinal")
        .otherwise("binary")
    )


def feature_types(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, n_distinct, feature_type): more than 8 values continuous, more than 2
    ordinal, else binary.  Nulls are no values; what differs beyond nine decimals is one.

    Values are made distinct inside the tasks before (feature, value) pairs are shuffled.
    Where the type alone is wanted `feature_kinds` moves less.
    """
    structs = [f"struct('{f}' as feature, round(cast({f} as double), {ROUNDING}) as value)" for f in features]
    values = df.select(_rows(structs)).distinct().groupBy("feature").agg(F.count("value").cast("int").alias("n_distinct"))
    return values.withColumn("feature_type", _kind("n_distinct"))


def feature_kinds(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, feature_type) as `feature_types` has it.

    Every value that is not null sets one of 64 bits by its hash; more than 8 bits prove
    more than 8 values.  Only the features that this leaves open, which have few values,
    are counted.
    """
    mask = "bit_count(bit_or(if({0} is null, null, shiftleft(1L, cast(pmod(xxhash64(round(cast({0} as double), 9)), 64) as int))))) as {0}"
    seen = df.agg(*[F.expr(mask.format(f)) for f in features]).first()
    settled = [f for f in features if (seen[f] or 0) > CONTINUOUS_ABOVE]
    unsettled = [f for f in features if f not in settled]
    kinds = df.sparkSession.createDataFrame([(f, "continuous") for f in settled], "feature string, feature_type string")
    return kinds.unionByName(feature_types(df, unsettled).drop("n_distinct")) if unsettled else kinds


def _moments(columns: list[str], means: dict, by: str):
    """Arrow batches to sums over pairs: one row per group and pair for a whole task."""
    k = len(columns)
    upper = np.triu_indices(k, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            groups = np.array(batch.column(0).to_pylist(), dtype=object)
            values = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(k)], axis=1)
            for group in {g for g in groups if g is not None}:
                x = values[groups == group] - means[group]
                there = (~np.isnan(x)).astype(float)
                x = np.nan_to_num(x)
                square = x * x
                sums = np.stack([there.T @ there, x.T @ there, there.T @ x, square.T @ there, there.T @ square, x.T @ x])
                held[group] = held[group] + sums if group in held else sums
        for group, sums in held.items():
            arrays = [pa.array([group] * len(upper[0]), pa.int32()), pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(s[upper]) for s in sums], [by, "i", "j", *MOMENTS])

    return run


MOMENTS = ["n", "x", "y", "xx", "yy", "xy"]


def correlations(df: DataFrame, features: list[str], by: str = "persona") -> DataFrame:
    """(group, feature_1, feature_2, corr): absolute Pearson correlation of every pair.

    Each pair uses the rows where both are there.  One pass finds the mean of every
    feature and group; a second sums the products of the distances from it inside the
    tasks, as matrices, and Spark adds up one row per task, group and pair.  Pairs with a
    feature that is constant over their rows, or with fewer than two rows, have no
    correlation and are left out; so are rows without a group.
    """
    numbers = df.select(F.col(by).cast("int").alias(by), *[F.col(f).cast("double").alias(f) for f in features])
    centres = numbers.where(F.col(by).isNotNull()).groupBy(by).agg(*[F.avg(f).alias(f) for f in features]).collect()
    means = {row[by]: np.array([row[f] or 0.0 for f in features]) for row in centres}
    sums = ", ".join(f"{m} double" for m in MOMENTS)
    parts = numbers.mapInArrow(_moments(features, means, by), f"{by} int, i int, j int, {sums}")
    total = parts.groupBy(by, "i", "j").agg(*[F.sum(m).alias(m) for m in MOMENTS])
    spread = lambda square, one: f"({square} - {one} * {one} / n)"
    # what is left of the squares of a constant feature is rounding
    varies = [f"{spread(s, o)} > 1e-13 * {s}" for s, o in (("xx", "x"), ("yy", "y"))]
    corr = f"round(abs(xy - x * y / n) / sqrt({spread('xx', 'x')} * {spread('yy', 'y')}), {ROUNDING})"
    found = total.where("n >= 2 and xx > 0 and yy > 0 and " + " and ".join(varies)).selectExpr(by, "i", "j", f"least({corr}, 1D) as corr")
    names = F.array(*[F.lit(f) for f in features])
    both = found.union(found.select(by, "j", "i", "corr"))
    return both.select(by, F.get(names, F.col("i")).alias("feature_1"), F.get(names, F.col("j")).alias("feature_2"), "corr")


def high_corr_pairs(corr: DataFrame, lower_bound: float = 0.8, by: str = "persona") -> DataFrame:
    """Pairs with correlation strictly between the bound and 1, with their dense rank."""
    order = Window.partitionBy(by).orderBy(F.col("corr").desc())
    high = corr.where((F.col("corr") > lower_bound) & (F.col("corr") < 1.0))
    return high.withColumn("rank", F.dense_rank().over(order))


def corr_pivot(high: DataFrame, by: str = "persona", groups: list[int] = S.PERSONAS) -> DataFrame:
    """Pair by persona, with the sum over personas."""
    pivoted = high.withColumn(by, known_group(by, groups)).groupBy("feature_1", "feature_2").pivot(by, groups).agg(F.max("corr"))
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(str(g)), F.lit(0.0)) for g in groups])
    return pivoted.withColumn("sum", total)


def variances(df: DataFrame, features: list[str], by: str = "persona") -> DataFrame:
    """(group, feature, variance) with the sample variance."""
    spread = df.groupBy(by).agg(*[F.var_samp(F.col(f).cast("double")).alias(f) for f in features])
    structs = [f"struct('{f}' as feature, round(`{f}`, {ROUNDING}) as variance)" for f in features]
    return spread.select(by, _rows(structs))


def low_variance(df: DataFrame, features: list[str], upper_bound: float = 0.05, by: str = "persona") -> DataFrame:
    order = Window.partitionBy(by).orderBy("variance")
    low = variances(df, features, by).where(F.col("variance") < upper_bound)
    return low.withColumn("rank", F.dense_rank().over(order))


def variance_pivot(low: DataFrame, by: str = "persona", groups: list[int] = S.PERSONAS) -> DataFrame:
    return low.withColumn(by, known_group(by, groups)).groupBy("feature").pivot(by, groups).agg(F.max("variance"))


def nonnull_features(df: DataFrame, features: list[str], by: str = "persona") -> DataFrame:
    """(group, feature, n_nonnull) of the features with any value in the group."""
    counts = df.groupBy(by).agg(*[F.count(f).alias(f) for f in features])
    structs = [f"struct('{f}' as feature, `{f}` as n_nonnull)" for f in features]
    return counts.select(by, _rows(structs)).where("n_nonnull > 0")
