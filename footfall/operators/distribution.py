"""Shoppers by persona, event and span, and whether the differences are significant."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall import settings as S
from footfall.functions.columns import known_group
from footfall.functions.joins import is_small, once_per_customer, worked_out
from footfall.operators import spans as SP
from footfall.operators.features import named, with_open_bits, with_span_bits
from footfall.operators.population import non_employees
from footfall.operators.rollup import customer_days
from footfall.sources.retail import RetailTables


def persona_event_dist(tables: RetailTables, events: DataFrame, first: int, last: int) -> DataFrame:
    """(persona, event, year, span): eligible customers and those who shopped the span.

    Per customer and event the shopped and the open spans are two bit masks; equal masks
    are counted per persona before bits turn into rows, so customers are never expanded
    by span and nothing is counted distinct.  Sales before the acquisition date count as
    shopped here, as long as the customer was acquired by the end of the span.
    """
    spans = worked_out(SP.number_spans(SP.spans_in_years(SP.event_spans(events), first, last)))
    # beyond 63 spans an event has further masks, each under a name of its own
    names = [row.name for row in spans.select("name").distinct().orderBy("name").collect()]
    small = is_small(events)  # one row per day; spans and their days are no more than that
    years = f"year(sale_dt) between {first} and {last}"
    days = customer_days(tables.trans, by_day=years).join(tables.funnel.select("cust_key", "acq_dt"), "cust_key")
    # spans start in the years as well, so a shopped span day is always inside them
    masks = {e: f"bit_or(if(fl_ind = 1 and {years}, {e}_bits, null))" for e in names}
    customers = (
        with_span_bits(days, spans, small, names)
        .groupBy("cust_key")
        .agg(
            F.max("acq_dt").alias("acq_dt"),
            F.max(F.expr("if(sale_dt >= acq_dt, discount_ind, null)")).alias("discount_ind"),
            F.max(F.expr(f"if(sale_dt >= acq_dt and {years}, fl_ind, 0)")).alias("fl_ind"),
            *named(masks),
        )
        .where("discount_ind = 0 and fl_ind = 1")
        .join(non_employees(tables.customers), "cust_key", "left_semi")
        .join(once_per_customer(tables.personas, "persona"), "cust_key")
    )
    customers = with_open_bits(customers, spans, date(first, 1, 1), small, names)
    pairs = [f"struct('{e}' as name, coalesce({e}, 0L) as shopped, coalesce({e}_open, 0L) as open)" for e in names]
    alike = (
        customers.selectExpr("persona", f"inline(array({', '.join(pairs)}))")
        .groupBy("persona", "name", "open", F.col("shopped").bitwiseAND(F.col("open")).alias("shopped"))
        .agg(F.count("*").alias("n"))
    )
    counted = (
        alike.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(SP.MAX_BITS))))
        .where("getbit(open, bit) = 1")
        .groupBy("persona", "name", "bit")
        .agg(F.sum("n").alias("n_existing"), F.expr("sum(if(getbit(shopped, bit) = 1, n, 0L))").alias("n_shopped"))
    )
    return counted.join(spans, ["name", "bit"]).select(
        "persona", "event", F.col("yr").alias("year"), "start_dt", "end_dt", "n_shopped", "n_existing"
    )


def add_not_shopped(dist: DataFrame) -> DataFrame:
    return dist.withColumn("n_notshopped", F.col("n_existing") - F.col("n_shopped"))


def shopped_share(dist: DataFrame, year: int | None = None) -> DataFrame:
    """Event by persona: shopped share over all years, or in one year."""
    chosen = dist if year is None else dist.where(F.col("year") == year)
    share = F.try_divide(F.sum("n_shopped").cast("double"), F.sum("n_existing").cast("double"))
    known = chosen.withColumn("persona", known_group("persona", S.PERSONAS))
    return known.groupBy("event").pivot("persona", S.PERSONAS).agg(share)


def chi_square(dist: DataFrame, by: list[str], outcomes: list[str]) -> DataFrame:
    """Independence test of the table spanned by ``by`` and the outcome columns.

    One row: statistic, dof, number of cells and total.  Cells without rows count as 0:
    sum((o - e)^2 / e) over all cells equals sum(o^2 / e) - total, and an empty cell adds
    nothing to that sum.  (Yates' correction, which applies to one degree of freedom,
    is used then.)
    """
    long = dist.select(*by, F.explode(_outcome_rows(outcomes)).alias("o")).select(*by, "o.outcome", "o.n")
    factors = by + ["outcome"]
    cells = long.groupBy(*factors).agg(F.sum("n").cast("double").alias("observed"))
    everything = Window.partitionBy(F.lit(1))
    expected = F.lit(1.0)
    for factor in factors:
        expected = expected * F.sum("observed").over(Window.partitionBy(factor)) / F.col("total")
    # a table of counts: personas x years x events x outcomes, whatever the data size
    tested = cells.withColumn("total", F.sum("observed").over(everything)).withColumn(
        "expected", expected * F.col("total")
    )
    levels = [F.count_distinct(f) for f in factors]
    n_cells = levels[0]
    dof = -levels[0]
    for level in levels[1:]:
        n_cells = n_cells * level
        dof = dof - level
    dof = n_cells + dof + (len(factors) - 1)
    plain = F.sum(F.expr("observed * observed / expected")) - F.max("total")
    gap = F.abs(F.col("observed") - F.col("expected"))
    corrected = F.sum(F.pow(gap - F.least(F.lit(0.5), gap), 2) / F.col("expected"))
    return tested.agg(
        F.when(dof == 1, corrected).otherwise(plain).alias("statistic"),
        dof.alias("dof"),
        n_cells.alias("n_cells"),
        F.max("total").alias("total"),
    )


def _outcome_rows(outcomes: list[str]):
    return F.array(*[F.struct(F.lit(c).alias("outcome"), F.col(c).cast("double").alias("n")) for c in outcomes])


def chi_square_p_value(tested: DataFrame) -> float:
    """Upper-tail probability of a one-row result, from the library Spark ships with."""
    row = tested.first()
    gamma = tested.sparkSession._jvm.org.apache.commons.math3.special.Gamma
    return gamma.regularizedGammaQ(row.dof / 2.0, row.statistic / 2.0)  # keeps tails below 1e-16


def label_rate(df: DataFrame, group: str = "persona", target: str = "target_shopped_ind") -> DataFrame:
    """Group size, positives and rate."""
    return df.groupBy(group).agg(
        F.count("*").alias("n"), F.sum(target).alias("n_pos"), F.avg(F.col(target).cast("double")).alias("pct")
    )
