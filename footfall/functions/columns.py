"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cents(c: str | Column) -> Column:
    """Money as whole cents: long sums are exact and stay out of big-decimal arithmetic."""
    return (col(c).cast("decimal(12,2)") * 100).cast("bigint")


def sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def guarded_ratio(num: str, den: str, scale: float = 1.0) -> str:
    """SQL for scale * num / den as a double, 0 when the denominator is null or 0."""
    return f"if(coalesce({den}, 0) = 0, 0D, {scale}D * cast({num} as double) / cast({den} as double))"


def floored_log(c: str | Column, floor: float = -1.0) -> Column:
    """Natural log, with every non-positive value sent to ``floor`` (null stays null)."""
    return F.when(col(c) <= 0, F.lit(float(floor))).otherwise(F.log(col(c)))


def hash_key(seed: int, *keys: str | Column) -> Column:
    """Hex digest that puts rows in a seeded pseudo-random order, the same on every run."""
    parts = [F.lit(str(seed))] + [col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("-", *parts))


def hash_number(digest: str | Column, digits: int = 13) -> Column:
    """The leading hex digits of a digest as a long in [0, 16**digits)."""
    return F.conv(F.substring(col(digest), 1, digits), 16, 10).cast("bigint")


def known_group(column: str, groups: list) -> Column:
    """The column, with an error on a group that has no place in a pivot; null stays null."""
    known = F.col(column).isNull() | F.col(column).isin(groups)
    message = F.concat(F.lit(f"{column} is not one of {groups}: "), F.col(column).cast("string"))
    return F.when(known, F.col(column)).otherwise(F.raise_error(message)).alias(column)
