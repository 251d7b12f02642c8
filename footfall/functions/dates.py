"""Date columns: holidays of a year, 4-5-4 fiscal position, look-back windows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(value: date | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def date_sql(day: date) -> str:
    return f"date'{day}'"


def lookback_sql(col: str, feature_end: date, years: int) -> str:
    """Condition: from ``years`` before the feature end up to the day before it."""
    end = date_sql(feature_end)
    return f"{col} between add_months({end}, {-12 * years}) and date_sub({end}, 1)"


def months_between(later: date, earlier: str) -> Column:
    return F.months_between(as_date(later), earlier, roundOff=False)


def weekday_on_or_after(year: Column, month: int, day: int, weekday: str) -> Column:
    """First such weekday on or after the given day; ``next_day`` alone is strictly after."""
    return F.next_day(F.date_sub(F.make_date(year, F.lit(month), F.lit(day)), 1), weekday)


def holiday_columns(year: Column) -> dict[str, Column]:
    """Every holiday that follows from the year alone (Easter comes from a list)."""
    return {
        "new_years_day": F.make_date(year, F.lit(1), F.lit(1)),
        "valentines_day": F.make_date(year, F.lit(2), F.lit(14)),
        "mothers_day": weekday_on_or_after(year, 5, 8, "Sun"),
        "memorial_day": weekday_on_or_after(year, 5, 25, "Mon"),
        "fathers_day": weekday_on_or_after(year, 6, 15, "Sun"),
        "labor_day": weekday_on_or_after(year, 9, 1, "Mon"),
        "thanksgiving": weekday_on_or_after(year, 11, 22, "Thu"),
        "christmas": F.make_date(year, F.lit(12), F.lit(25)),
    }


def fiscal_columns(day: str | Column) -> dict[str, Column]:
    """Fiscal year, month, week and day: years end on the Saturday nearest Jan 31,
    quarters hold 4 + 5 + 4 weeks, and a 53rd week becomes week 5 of month 12."""
    d = F.col(day) if isinstance(day, str) else day

    def first_day(year: Column) -> Column:
        return weekday_on_or_after(year, 1, 29, "Sun")

    started = d >= first_day(F.year(d))
    fiscal_year = F.when(started, F.year(d)).otherwise(F.year(d) - 1)
    offset = F.datediff(d, first_day(fiscal_year))
    week = F.floor(offset / 7).cast("int")
    quarter = F.least(F.floor(week / 13).cast("int"), F.lit(3))
    week_in_quarter = week - quarter * 13
    third = F.when(week_in_quarter < 4, 0).when(week_in_quarter < 9, 1).otherwise(2)
    weeks_before = F.when(third == 0, 0).when(third == 1, 4).otherwise(9)
    return {
        "yr_454": fiscal_year,
        "mth_454": quarter * 3 + third + 1,
        "wk_454": week_in_quarter - weeks_before + 1,
        "day_454": offset % 7 + 1,
    }
