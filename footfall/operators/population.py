"""Who is modelled, on which sales, and with which label."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.dates import date_sql, lookback_sql
from footfall.operators.rollup import FULL_LINE, customer_days
from footfall.sources.staging import materialize


def post_acquisition(sales: DataFrame, funnel: DataFrame) -> DataFrame:
    """Sales on or after the customer's acquisition date, with that date.

    Works on lines and on customer-day rollups alike.  ``funnel`` holds one row per
    customer.
    """
    acquired = funnel.select("cust_key", "acq_dt")
    return sales.join(acquired, "cust_key").where(F.col("sale_dt") >= F.col("acq_dt"))


def non_employees(customers: DataFrame) -> DataFrame:
    return customers.where("current_employee_ind = 0").select("cust_key")


def qualifies_sql(feature_end: date) -> str:
    """Aggregate test of the base population, over post-acquisition customer-days."""
    recent = lookback_sql("sale_dt", feature_end, 2)
    return f"max(discount_ind) = 0 and max(if({recent}, qualifying_ind, 0)) = 1"


def base_population(customers: DataFrame, trans: DataFrame, funnel: DataFrame, feature_end: date) -> DataFrame:
    """Non-employees without employee discount who bought merchandise in the last 2 years."""
    days = customer_days(trans, by_day=lookback_sql("sale_dt", feature_end, 2))
    kept = (
        post_acquisition(days, funnel)
        .groupBy("cust_key")
        .agg(F.expr(qualifies_sql(feature_end)).alias("qualified"))
        .where("qualified")
    )
    return kept.join(non_employees(customers), "cust_key", "left_semi").select("cust_key")


def base_trans(trans: DataFrame, funnel: DataFrame, population: DataFrame, feature_end: date) -> DataFrame:
    """Post-acquisition lines of the population in the 4 years before the feature end.

    The per-customer sides are joined and stored first.  The lines then meet one join
    whose inputs both come straight from a shuffle, which is when the adaptive skew join
    can split a customer with very many lines over tasks.
    """
    window = trans.where(lookback_sql("sale_dt", feature_end, 4)).drop("spend_discount_employee_ind")
    acquired = materialize(funnel.join(population, "cust_key", "left_semi"), "acquired")
    return post_acquisition(window, acquired).drop("acq_dt")


def target_label(trans: DataFrame, funnel: DataFrame, start: date, end: date) -> DataFrame:
    """Customers with a full-line sale in the target span, each with label 1."""
    sales = trans.where(f"{FULL_LINE} and sale_dt between {date_sql(start)} and {date_sql(end)}")
    # one row per customer is enough: any sale counts when the last one does
    last = sales.groupBy("cust_key").agg(F.max("sale_dt").alias("sale_dt"))
    return post_acquisition(last, funnel).select("cust_key", F.lit(1).alias("target_shopped_ind"))


def labelled_population(population: DataFrame, label: DataFrame) -> DataFrame:
    return population.join(label, "cust_key", "left").select(
        "cust_key", F.coalesce("target_shopped_ind", F.lit(0)).alias("target_shopped_ind")
    )


def persona_population(
    customers: DataFrame, personas: DataFrame, trans: DataFrame, funnel: DataFrame, first: int, last: int
) -> DataFrame:
    """Non-employees by persona with a full-line sale in years first..last."""
    in_years = F.year("sale_dt").between(first, last)
    days = customer_days(trans, by_day=f"year(sale_dt) between {first} and {last}")
    kept = (
        post_acquisition(days, funnel)
        .groupBy("cust_key")
        .agg(
            F.max("discount_ind").alias("discount_ind"),
            F.max(F.when(in_years, F.col("fl_ind")).otherwise(0)).alias("fl_ind"),
        )
        .where("discount_ind = 0 and fl_ind = 1")
    )
    kept = kept.join(non_employees(customers), "cust_key", "left_semi")
    return kept.join(personas, "cust_key").select("cust_key", "persona").distinct()
