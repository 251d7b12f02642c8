"""Customer-day rollups: the one pass over transaction lines that features start from.

Every rule in the feature steps depends on a line only through its day (after the
acquisition date, inside a look-back, inside an event), so lines are first summed by
(customer, day) with map-side combine.  Only the rollup is joined and shuffled by
customer.  A customer that holds a third of all lines is down to one row per day
before any join sees it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall import settings as S
from footfall.functions.columns import cents, sql_list

SPEND_MEASURES = (
    ["fl_spend", "merch_spend", "womens_prod_spend", "mens_prod_spend"]
    + [f"{category}_spend" for category in S.CATEGORY_GROUPS]
    + ["giftcard_spend", "web_spend", "rack_spend", "jwn_spend"]
)
COUNT_MEASURES = ["fl_items", "sale_items"]
FLAG_MEASURES = ["discount_ind", "qualifying_ind", "fl_ind", "fl_trip_ind"]
DISTINCT_MEASURES = ["fl_trips", "fl_divs", "jwn_channels"]

FULL_LINE = f"intent_channel in ({sql_list(S.FULL_LINE_CHANNELS)})"
MERCHANDISE = f"merch_type = '{S.MERCH_TYPE}' and channel <> '{S.RESTAURANT_CHANNEL}'"


def _spend_conditions() -> dict[str, str]:
    """Which lines each spend measure adds up; ``full_line`` and ``merchandise`` are columns."""
    conditions = {
        "fl_spend": "full_line",
        "merch_spend": "full_line and merchandise",
        "womens_prod_spend": "full_line and prod_gender = 'F'",
        "mens_prod_spend": "full_line and prod_gender = 'M'",
    }
    for category, groups in S.CATEGORY_GROUPS.items():
        in_category = f"prod_merchlevel2 in ({sql_list(groups)})"
        if category == "food":
            in_category = f"({in_category} or merch_type = '{S.RESTAURANT_TYPE}')"
        conditions[f"{category}_spend"] = f"full_line and {in_category}"
    conditions["giftcard_spend"] = "full_line and tender_giftcard = 1"
    conditions["web_spend"] = f"intent_channel = '{S.WEB_CHANNEL}'"
    conditions["rack_spend"] = f"intent_channel = '{S.RACK_CHANNEL}'"
    return conditions


def customer_days(trans: DataFrame, by_day: str = "true") -> DataFrame:
    """(cust_key, sale_dt) with every additive measure; spend in whole cents.

    Columns a later step does not read are pruned away by the optimizer, down to the scan.

    ``by_day`` is the SQL condition of the days that are needed one by one.  Of all other
    lines, steps only ask whether any of them, since acquisition, carried an employee
    discount; they are folded into one row per customer and discount value, dated by the
    last such line, so old history adds next to nothing to the shuffle.
    """
    lines = trans.withColumns(
        {
            "full_line": F.expr(FULL_LINE),
            "merchandise": F.expr(MERCHANDISE),
            "cents": cents("spend_gross"),
            "_day": F.expr(f"if({by_day}, sale_dt, null)"),
            "_folded": F.expr(f"if({by_day}, null, spend_discount_employee_ind)"),
        }
    )
    aggregates = {
        "fl_items": "sum(if(full_line, 1, 0))",
        "sale_items": "sum(if(full_line, full_line_sale_ind, 0))",
        **{name: f"sum(if({c}, cents, 0L))" for name, c in _spend_conditions().items()},
        "jwn_spend": "sum(cents)",
        "discount_ind": "max(spend_discount_employee_ind)",
        "qualifying_ind": "max(if(full_line and merchandise, 1, 0))",
        "fl_ind": "max(if(full_line, 1, 0))",
        "fl_trip_ind": "max(if(full_line and corp_trip_key is not null, 1, 0))",
    }
    named = [F.expr(f"{text} as {name}") for name, text in aggregates.items()]
    grouped = lines.groupBy("cust_key", "_day", "_folded").agg(F.max("sale_dt").alias("sale_dt"), *named)
    return grouped.drop("_day", "_folded")


def last_seen_days(trans: DataFrame) -> DataFrame:
    """(cust_key, sale_dt): how many trips, divisions and channels were *last* seen that day.

    A trip counts for a customer when any of its lines falls on or after some day, that
    is, when its last day does.  So distinct counts "since day d" become plain sums over
    these rows, and no count(distinct) runs per customer.  Pass lines of one look-back.
    """
    keyed = trans.selectExpr(
        "cust_key",
        "sale_dt",
        f"if({FULL_LINE}, corp_trip_key, null) as trip",
        f"if({FULL_LINE}, prod_div, null) as division",
        "intent_channel as sold_via",
    )
    last = keyed.groupingSets(
        [["cust_key", "trip"], ["cust_key", "division"], ["cust_key", "sold_via"]],
        "cust_key",
        "trip",
        "division",
        "sold_via",
    ).agg(F.max("sale_dt").alias("sale_dt"))
    return (
        last.where("coalesce(trip, division, sold_via) is not null")
        .groupBy("cust_key", "sale_dt")
        .agg(
            F.count("trip").alias("fl_trips"),
            F.count("division").alias("fl_divs"),
            F.count("sold_via").alias("jwn_channels"),
        )
    )
