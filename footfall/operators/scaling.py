"""Log, standard and rule-based scaling.

Fitting is one aggregate whose single row (two numbers per feature) comes back to the
driver, as with any fitted transformer; applying it is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall import settings as S
from footfall.functions.columns import floored_log


def log_features(df: DataFrame, columns: list[str] = S.LOG_FEATURES, floor: float = -1.0) -> DataFrame:
    """Replaces the listed columns that exist by ``log_<name>``, in place."""
    logged = [floored_log(c, floor).alias(f"log_{c}") if c in columns else F.col(c) for c in df.columns]
    return df.select(*logged)


def add_squared_recency(df: DataFrame, column: str = "months_since_last_sale") -> DataFrame:
    return df.withColumn("months_since_last_squared", F.col(column) * F.col(column))


@dataclass(frozen=True)
class StandardScaling:
    """Mean and population standard deviation per feature."""

    stats: dict[str, tuple[float | None, float | None]]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[self._scaled(c) if c in self.stats else F.col(c) for c in df.columns])

    def _scaled(self, name: str) -> Column:
        mean, std = self.stats[name]
        if mean is None:
            return F.lit(None).cast("double").alias(name)
        return ((F.col(name).cast("double") - F.lit(mean)) / F.lit(std or 1.0)).alias(name)


def fit_standard_scaling(train: DataFrame, features: list[str]) -> StandardScaling:
    aggregates = [F.avg(F.col(f).cast("double")).alias(f"{f}__mean") for f in features]
    aggregates += [F.stddev_pop(F.col(f).cast("double")).alias(f"{f}__std") for f in features]
    row = train.agg(*aggregates).first()
    # a spread at the level of rounding error is a constant column
    return StandardScaling({f: (row[f"{f}__mean"], _or_zero(row[f"{f}__mean"], row[f"{f}__std"])) for f in features})


def _or_zero(mean: float | None, std: float | None) -> float | None:
    if mean is None or std is None:
        return None
    return 0.0 if std <= 1e-12 * max(1.0, abs(mean)) else std


def scale_data(train: DataFrame, test: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sets on the scale of the training set."""
    scaling = fit_standard_scaling(train, features)
    return scaling.transform(train), scaling.transform(test)


def transform_by_rule(df: DataFrame, features: list[str], logged: list[str], log_offset: float = 0.0) -> DataFrame:
    """Scaling by name: shares to 0..1, flags to integers, months as they are, rest min-max."""

    def value(name: str) -> Column:
        raw = F.col(name).cast("double")
        return floored_log(raw, log_offset) if name in logged else raw

    ranged = [f for f in features if "_pct_" not in f and not f.endswith("_ind") and "months" not in f]
    bounds = {}
    if ranged:
        low = [F.min(value(f)).alias(f"{f}__min") for f in ranged]
        high = [F.max(value(f)).alias(f"{f}__max") for f in ranged]
        bounds = df.agg(*low, *high).first().asDict()

    def scaled(name: str) -> Column:
        if "_pct_" in name:
            return value(name) / 100.0
        if name.endswith("_ind"):
            return value(name).cast("bigint")
        if "months" in name:
            return value(name)
        low, high = bounds[f"{name}__min"], bounds[f"{name}__max"]
        if low is None or low == high:
            return F.lit(None).cast("double")
        return (value(name) - F.lit(low)) / F.lit(high - low)

    return df.select(*[scaled(c).alias(c) if c in features else F.col(c) for c in df.columns])


def cap_months(df: DataFrame, tenure: str = "tenure_total_months", recency: str = "months_since_last_sale") -> DataFrame:
    """Tenure in units of 8 years, at most 1; recency in units of 2 years."""
    capped = F.when(F.col(tenure) > 96, 1.0).otherwise(F.col(tenure) / 96.0)
    return df.withColumns({tenure: capped, recency: F.col(recency) / 24.0})


def min_max_log(df: DataFrame, column: str, log: str = "log1p") -> DataFrame:
    """Adds ``<column>_scaled``: log1p, log or floored log of the column, put on 0..1."""
    floor = F.floor(column).cast("double")
    logs = {"log1p": F.log1p(floor), "log": F.log(floor), "floored": floored_log(floor)}
    row = df.agg(F.min(logs[log]).alias("low"), F.max(logs[log]).alias("high")).first()
    width = (row.high - row.low) if row.low is not None and row.high != row.low else None
    scaled = (logs[log] - F.lit(row.low)) / F.lit(width) if width else F.lit(None).cast("double")
    return df.withColumn(f"{column}_scaled", scaled)
