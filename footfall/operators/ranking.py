"""Exact ranks and percentiles inside groups of any size.

A window over a whole persona would sort it in one task.  Here equal values are counted
first, values are cut into ranges at approximate quantiles, and only a range is sorted
in one task; the counts of earlier ranges are added.  The quantiles decide how evenly
the work is spread, never the result.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N_RANGES = 256


def value_counts(df: DataFrame, by: list[str], value: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """(group, value) with its count and any further sums; nulls are left out."""
    extra = [F.sum(c).alias(name) for name, c in (sums or {}).items()]
    rows = df.where(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    return rows.groupBy(*by, value).agg(F.count("*").alias("n"), *extra)


def with_ranges(values: DataFrame, source: DataFrame, value: str, n_ranges: int = N_RANGES) -> DataFrame:
    """Adds ``_range``, at quantiles of the source column (a few hundred numbers)."""
    points = [i / n_ranges for i in range(1, n_ranges)]
    plain = source.select(F.col(value).cast("double").alias(value))
    cuts = sorted(set(plain.approxQuantile(value, points, 1.0 / (4 * n_ranges))))
    if len(cuts) < 2:
        return values.withColumn("_range", F.lit(0.0))
    splits = [-float("inf")] + cuts + [float("inf")]
    return Bucketizer(splits=splits, inputCol=value, outputCol="_range", handleInvalid="keep").transform(values)


def running_below(counted: DataFrame, by: list[str], value: str, sums: list[str]) -> DataFrame:
    """Adds ``<sum>_below`` (over smaller values) and ``<sum>_total`` per group.

    ``counted`` is a `value_counts` table with ``_range``.
    """
    ranges = counted.groupBy(*by, "_range").agg(*[F.sum(s).alias(s) for s in sums])
    group = Window.partitionBy(*(by or [F.lit(1)]))
    earlier = group.orderBy("_range")
    offsets = ranges.select(
        *by,
        "_range",
        *[(F.sum(s).over(earlier) - F.col(s)).alias(f"_{s}_before") for s in sums],
        *[F.sum(s).over(group).alias(f"{s}_total") for s in sums],
    )
    inside = Window.partitionBy(*by, "_range").orderBy(value)
    for s in sums:
        counted = counted.withColumn(f"_{s}_inside", F.sum(s).over(inside) - F.col(s))
    # the window above left the values partitioned and sorted by these very columns
    joined = counted.join(offsets, [*by, "_range"])
    for s in sums:
        joined = joined.withColumn(f"{s}_below", F.col(f"_{s}_before") + F.col(f"_{s}_inside"))
    return joined.drop("_range", *[f"_{s}_{part}" for s in sums for part in ("before", "inside")])


def value_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(group, value): n ties, n_below, n_total and the average rank of the ties."""
    counted = with_ranges(value_counts(df, by, value), df, value)
    ranked = running_below(counted, by, value, ["n"])
    return ranked.withColumn("avg_rank", F.col("n_below") + (F.col("n") + 1) / 2)


def percent_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds ``pct_rank`` (average rank over group size) and ``decile`` 1..10."""
    ranks = value_ranks(df, by, value).select(
        *[F.col(b).alias(f"_by_{b}") for b in by],
        F.col(value).alias("_value"),
        (F.col("avg_rank") / F.col("n_total")).alias("pct_rank"),
    )
    on = [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by] + [F.col(value).cast("double") == F.col("_value")]
    joined = df.join(ranks, on, "left").select(*df.columns, "pct_rank")
    return joined.withColumn("decile", F.ceil(F.round(10 * F.col("pct_rank"), 9)).cast("int"))


def percentile(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """Exact percentile with linear interpolation, one row per group."""
    ranked = value_ranks(df, by, value)
    position = F.lit(q) * (F.col("n_total") - 1)
    low, high = F.floor(F.round(position, 9)), F.ceil(F.round(position, 9))
    covers = lambda p: (F.col("n_below") <= p) & (p < F.col("n_below") + F.col("n"))
    near = ranked.where(covers(low) | covers(high))
    group = near.groupBy(*by).agg(
        F.max(F.when(covers(low), F.col(value))).alias("_low"),
        F.max(F.when(covers(high), F.col(value))).alias("_high"),
        F.max(position - low).alias("_part"),
    )
    return group.select(*by, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("percentile"))
