"""Retail tables derived from the order, line, part and customer tables.

The text below is plain SQL that other engines read too, so the checks run over the
very same rows.  The attribute rules are invented for coverage and carry no meaning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TRANS_SQL = """
select o.o_custkey as cust_key, o.o_orderkey as tran_key, l.l_linenumber as tran_line_key,
  cast(o.o_custkey as varchar(20)) || '-' || cast(cast(o.o_orderdate as date) + 6575 as varchar(20)) as corp_trip_key,
  cast(o.o_orderdate as date) + 6575 as sale_dt,
  case o.o_orderpriority when '1-URGENT' then 'FLS' when '2-HIGH' then 'FLS' when '3-MEDIUM' then 'N.COM'
       when '4-NOT SPECIFIED' then 'RACK' else 'HL' end as intent_channel,
  case when p.p_type = 'PROMO' then 'RESTAURANT' else 'STORE' end as channel,
  case when p.p_type = 'PROMO' then 'Restaurant' else 'Merch' end as merch_type,
  p.p_brand as prod_div,
  case p.p_partkey % 12 when 0 then 'Belts & Braces' when 1 then 'Tops' when 2 then 'Pet Accessories' when 3 then 'Bags'
       when 4 then 'Makeup' when 5 then 'Toys/Games' when 6 then 'Food' when 7 then 'Home' when 8 then 'Jewelry'
       when 9 then 'Gift/Operational' when 10 then 'Shoes' else 'Dresses' end as prod_merchlevel2,
  case p.p_size % 3 when 0 then 'F' when 1 then 'M' end as prod_gender,
  case when l.l_discount >= 0.05 then 1 else 0 end as full_line_sale_ind,
  cast(case when l.l_returnflag = 'R' and l.l_linenumber = 7 then -l.l_extendedprice else l.l_extendedprice end as decimal(12,2)) as spend_gross,
  case when o.o_orderstatus = 'P' then 1 else 0 end as tender_giftcard,
  case when o.o_custkey % 97 = 0 then 1 else 0 end as spend_discount_employee_ind
from {orders} o join {lineitem} l on l.l_orderkey = o.o_orderkey join {part} p on p.p_partkey = l.l_partkey
"""

CUSTOMERS_SQL = """
select c_custkey as cust_key, case when c_custkey % 50 = 0 then 1 else 0 end as current_employee_ind from {customer}
"""

FUNNEL_SQL = """
select cust_key, min(sale_dt) + cast(90 * (cust_key % 3) as int) as acq_dt from {trans} group by cust_key
"""

LOYALTY_SQL = """
select c_custkey as cust_key, case when c_custkey % 2 = 0 then 1 else 0 end as loyalty_tender_ind,
  case when c_custkey % 2 = 1 then 1 else 0 end as loyalty_nontender_ind from {customer} where c_custkey % 3 <> 0
"""

PERSONAS_SQL = """
select c_custkey as cust_key, case c_mktsegment when 'AUTOMOBILE' then 1 when 'BUILDING' then 2 when 'FURNITURE' then 3
  when 'HOUSEHOLD' then 4 else 5 end as persona from {customer} where c_custkey % 41 <> 0
"""

# The columns read, so that opening a folder needs no look into its files.
SOURCE_SCHEMAS = {
    "customer": "c_custkey bigint, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_extendedprice double, l_discount double, l_returnflag string",
    "part": "p_partkey bigint, p_brand string, p_type string, p_size int",
}


@dataclass(frozen=True)
class RetailTables:
    trans: DataFrame
    customers: DataFrame
    funnel: DataFrame
    loyalty: DataFrame
    personas: DataFrame


def retail_tables(spark: SparkSession, sf_dir: str) -> RetailTables:
    def table(name: str) -> DataFrame:
        return spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")

    customer = table("customer")
    trans = spark.sql(TRANS_SQL, orders=table("orders"), lineitem=table("lineitem"), part=table("part"))
    return RetailTables(
        trans=trans,
        customers=spark.sql(CUSTOMERS_SQL, customer=customer),
        funnel=spark.sql(FUNNEL_SQL, trans=trans),
        loyalty=spark.sql(LOYALTY_SQL, customer=customer),
        personas=spark.sql(PERSONAS_SQL, customer=customer),
    )
