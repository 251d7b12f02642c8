"""Hand-made retail tables for the edge cases."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from footfall.sources.retail import RetailTables

TRANS = (
    "cust_key long, tran_key long, tran_line_key long, corp_trip_key string, sale_dt date, intent_channel string, "
    "channel string, merch_type string, prod_div string, prod_merchlevel2 string, prod_gender string, "
    "full_line_sale_ind int, spend_gross decimal(12,2), tender_giftcard int, spend_discount_employee_ind int"
)


def line(cust, day, spend=10, channel="FLS", trip=None, **other):
    row = {
        "cust_key": cust,
        "tran_key": 1,
        "tran_line_key": 1,
        "corp_trip_key": trip or f"{cust}-{day}",
        "sale_dt": date.fromisoformat(day),
        "intent_channel": channel,
        "channel": "STORE",
        "merch_type": "Merch",
        "prod_div": "D1",
        "prod_merchlevel2": "Tops",
        "prod_gender": "F",
        "full_line_sale_ind": 0,
        "spend_gross": Decimal(spend),
        "tender_giftcard": 0,
        "spend_discount_employee_ind": 0,
    }
    row.update(other)
    return tuple(row.values())


def tables(spark, lines, acquired, employees=(), personas=None, loyalty=None):
    customers = sorted(acquired)
    personas = personas if personas is not None else {c: 1 for c in customers}
    return RetailTables(
        trans=spark.createDataFrame(lines, TRANS),
        customers=spark.createDataFrame([(c, int(c in employees)) for c in customers], "cust_key long, current_employee_ind int"),
        funnel=spark.createDataFrame([(c, date.fromisoformat(d)) for c, d in acquired.items()], "cust_key long, acq_dt date"),
        loyalty=spark.createDataFrame(
            [(c, *v) for c, v in (loyalty or {}).items()],
            "cust_key long, loyalty_tender_ind int, loyalty_nontender_ind int",
        ),
        personas=spark.createDataFrame(list(personas.items()), "cust_key long, persona int"),
    )
