"""The feature matrix: one row per modelled customer, 3 id columns and 71 features."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from footfall import settings as S
from footfall.functions.columns import guarded_ratio
from footfall.functions.dates import date_sql, months_between
from footfall.functions.joins import once_per_customer
from footfall.operators.features import (
    ALL_GROUPS,
    STATS,
    customer_profile,
    named,
    shopped_share_columns,
    spend_share_columns,
)
from footfall.sources.retail import RetailTables


def _pct(num: str, den: str = "fl_spend") -> str:
    return guarded_ratio(num, den, 100.0)


def feature_columns(target_start: date, feature_end: date) -> dict[str, str]:
    """Tenure counts back from the feature end, recency from the target start."""
    features = {
        "tenure_total_months": f"months_between({date_sql(feature_end)}, acq_dt, false)",
        "loyalty_tender_ind": "coalesce(loyalty_tender_ind, 0)",
        "loyalty_nontender_ind": "coalesce(loyalty_nontender_ind, 0)",
        "fl_total_spend": "coalesce(fl_spend, 0L) / 100D",
        "fl_total_trips": "coalesce(fl_trips, 0L)",
        "fl_avg_spend_per_trip": guarded_ratio("fl_spend / 100D", "fl_trips"),
        "sale_pct_items": _pct("sale_items", "fl_items"),
        "merch_pct_spend": _pct("merch_spend"),
        "womens_prod_pct_spend": _pct("womens_prod_spend"),
        "mens_prod_pct_spend": _pct("mens_prod_spend"),
        **{f"{category}_pct_spend": _pct(f"{category}_spend") for category in S.CATEGORY_GROUPS},
        "giftcard_pct_spend": _pct("giftcard_spend"),
        "web_pct_spend": _pct("web_spend"),
        "rack_pct_spend": _pct("coalesce(rack_spend, 0L)", "jwn_spend"),
        "fl_total_divs": "coalesce(fl_divs, 0L)",
        "total_channels": "coalesce(jwn_channels, 0L)",
        "months_since_last_sale": f"months_between({date_sql(target_start)}, fl_last_sale_dt, false)",
        "fl_shopped_ly_ind": "coalesce(fl_shopped_ly_ind, 0)",
        "fl_total_spend_ly": "coalesce(fl_spend_ly, 0L) / 100D",
    }
    for name, share in (spend_share_columns() | shopped_share_columns()).items():
        features[name] = f"100D * coalesce({share}, 0D)"
    for short in S.SHORT_NAMES:
        features[f"{short}_shop_ly_ind"] = f"coalesce({short}_shopped_ind, 0)"
    return features


def feature_matrix(
    tables: RetailTables, events: DataFrame, target_start: date, target_end: date, feature_end: date
) -> DataFrame:
    """Everything the models read, for customers of the base population with a persona.

    All joins are by customer, so the partitioning of the profile carries through.
    Repeated persona or loyalty rows are dropped while these tables are still narrow.
    """
    profile = customer_profile(tables, events, feature_end, ALL_GROUPS, (target_start, target_end))
    personas = once_per_customer(tables.personas, "persona")
    loyalty = once_per_customer(tables.loyalty, "loyalty_tender_ind", "loyalty_nontender_ind")
    joined = profile.join(personas, "cust_key").join(loyalty, "cust_key", "left")
    features = feature_columns(target_start, feature_end)
    return joined.select(
        *S.ID_COLUMNS,
        *named({name: features[name] for name in S.FEATURE_COLUMNS}),
    )


def tenure_recency(
    tables: RetailTables, events: DataFrame, target_start: date, feature_end: date
) -> DataFrame:
    """Just the two date features, on their different anchors."""
    profile = customer_profile(tables, events, feature_end, (STATS,))
    return profile.select(
        "cust_key",
        months_between(feature_end, "acq_dt").alias("tenure_total_months"),
        months_between(target_start, "fl_last_sale_dt").alias("months_since_last_sale"),
    )
