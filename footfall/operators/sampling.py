"""Exact, seeded samples and splits of any size.

A row's place in the random order is the digest of its key.  To keep the first n rows of
a group, the digests are counted by prefix, the prefix where the count reaches n is
opened, and the n-th digest becomes the group's cut-off: one row per group.  Choosing
rows is then a filter against a tiny broadcast table.  No group is ever sorted or
brought into one task, however large; keys must be unique within their group.

The cut-offs are worked out when the function is called, in two passes over the key and
group columns; pass a stored table (`materialize`) when the input is costly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.columns import hash_key, hash_number
from footfall.functions.joins import worked_out

PREFIX_DIGITS = 4  # 65,536 prefixes
POISSON_TERMS = 18  # more draws are less likely than the last digit of the digest


def _match(by: list[str]):
    return by if by else ["_everything"]


def _keyed(df: DataFrame, by: list[str], seed: int, key: str) -> DataFrame:
    keyed = df.withColumn("_digest", hash_key(seed, key))
    return keyed if by else keyed.withColumn("_everything", F.lit(1))


def mark_first(df: DataFrame, by: list[str], quota: DataFrame, seed: int, key: str, flag: str = "selected") -> DataFrame:
    """Adds a boolean: is the row among the first ``quota`` rows of its group.

    ``quota`` has one row per group: the group columns and ``quota``.
    """
    on = _match(by)
    rows = _keyed(df, by, seed, key)
    limits = quota if by else quota.withColumn("_everything", F.lit(1))
    prefixed = rows.select(*on, "_digest", hash_number("_digest", PREFIX_DIGITS).alias("_prefix"))

    sizes = prefixed.groupBy(*on, "_prefix").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*on).orderBy("_prefix"))  # at most 65,536 rows a group
    reached = F.col("_upto") >= F.col("quota")
    opened = (
        sizes.withColumn("_upto", upto)
        .join(limits, on)
        .groupBy(*on, "quota")
        .agg(
            F.min(F.when(reached, F.col("_prefix"))).alias("_open"),
            F.coalesce(F.max(F.when(~reached, F.col("_upto"))), F.lit(0)).alias("_before"),
        )
        .withColumn("_left", F.col("quota") - F.col("_before"))
    )
    opened = worked_out(opened)
    place = F.row_number().over(Window.partitionBy(*on).orderBy("_digest"))
    edge = (
        prefixed.join(opened, on)
        .where("_prefix = _open")
        .withColumn("_place", place)
        .where("_place = _left")
        .select(*on, F.col("_digest").alias("_nth"))
    )
    # hex digits sort below 'g', so a group smaller than its quota is taken whole
    cutoff = F.when(F.col("_open").isNull(), "g").when(F.col("_left") <= 0, "").otherwise(F.col("_nth"))
    cutoffs = worked_out(opened.join(edge, on, "left").select(*on, cutoff.alias("_cutoff")))
    marked = rows.join(cutoffs, on, "left").withColumn(
        flag, F.coalesce(F.col("_digest") <= F.col("_cutoff"), F.lit(False))
    )
    return marked.select(*df.columns, flag)


def group_sizes(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("size"))


def equal_quota(df: DataFrame, by: str, n: int) -> DataFrame:
    """n rows shared equally: every group gets the whole part of n / groups."""
    everything = Window.partitionBy(F.lit(1))
    share = F.floor(F.lit(n) / F.count("*").over(everything)).cast("bigint")
    return group_sizes(df, [by]).select(by, share.alias("quota"))


def allocate(sizes: DataFrame, strata: list[str], n: str | Column, within: list[str] | None = None) -> DataFrame:
    """Shares n over strata in proportion to size: whole parts, then largest remainders.

    Ties go to the lower stratum.  ``within`` allocates n inside each outer group.
    """
    outer = Window.partitionBy(*(within or [F.lit(1)]))
    exact = (F.expr(n) if isinstance(n, str) else n) * F.col("size") / F.sum("size").over(outer)
    parts = sizes.withColumn("_exact", exact).withColumn("_whole", F.floor("_exact").cast("bigint"))
    rest = F.col("_exact") - F.col("_whole")
    order = outer.orderBy(F.round(rest, 9).desc(), *strata)
    left = F.round(F.sum("_exact").over(outer)).cast("bigint") - F.sum("_whole").over(outer)
    extra = F.when(F.row_number().over(order) <= left, 1).otherwise(0)
    return parts.select(*strata, (F.col("_whole") + extra).alias("quota"))


def sample_per_group(df: DataFrame, n: int, seed: int, by: str = "persona", key: str = "cust_key") -> DataFrame:
    """n rows in all, the same number from every group, without replacement."""
    return mark_first(df, [by], equal_quota(df, by, n), seed, key).where("selected").drop("selected")


def sample_n(df: DataFrame, n: int, seed: int, key: str = "cust_key") -> DataFrame:
    """Exactly n rows, without replacement."""
    quota = df.sparkSession.range(1).select(F.lit(n).cast("bigint").alias("quota"))
    return mark_first(df, [], quota, seed, key).where("selected").drop("selected")


def sample_stratified(
    df: DataFrame, n: int, seed: int, by: str = "persona", stratum: str = "target_shopped_ind", key: str = "cust_key"
) -> DataFrame:
    """As `sample_per_group`, with each group's share split over strata in proportion."""
    each = equal_quota(df, by, n).withColumnRenamed("quota", "_each")
    sizes = group_sizes(df, [by, stratum]).join(each, by)
    quota = allocate(sizes, [by, stratum], F.col("_each"), within=[by])
    return mark_first(df, [by, stratum], quota, seed, key).where("selected").drop("selected")


def stratified_split(
    df: DataFrame,
    train_size: float,
    seed: int,
    strata: tuple[str, ...] = ("persona", "target_shopped_ind"),
    key: str = "cust_key",
) -> DataFrame:
    """Adds ``is_train``: the whole part of train_size * rows, in proportion per stratum."""
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("size").over(everything)
    sizes = group_sizes(df, list(strata)).withColumn("_train", F.floor(F.lit(train_size) * total))
    quota = allocate(sizes, list(strata), F.col("_train"))
    return mark_first(df, list(strata), quota, seed, key, "is_train")


def dense_index(df: DataFrame, seed: int, key: str = "cust_key", by: list[str] | None = None) -> DataFrame:
    """Adds ``row_idx`` 0..n-1 in digest order within each group, and the group's ``n_rows``.

    Rows are numbered inside each digest prefix and moved by the rows before it.
    """
    by = by or []
    rows = df.withColumn("_digest", hash_key(seed, key)).withColumn("_prefix", hash_number("_digest", PREFIX_DIGITS))
    sizes = rows.groupBy(*by, "_prefix").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*(by or [F.lit(1)]))
    offsets = sizes.select(
        *by,
        "_prefix",
        (F.sum("_n").over(group.orderBy("_prefix")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(group).alias("n_rows"),
    )
    place = F.row_number().over(Window.partitionBy(*by, "_prefix").orderBy("_digest")) - 1
    # both sides come partitioned by group and prefix
    indexed = rows.withColumn("_place", place).join(offsets, [*by, "_prefix"])
    return indexed.select(*df.columns, (F.col("_before") + F.col("_place")).alias("row_idx"), "n_rows")


def stratified_folds(
    df: DataFrame,
    n_folds: int,
    seed: int,
    strata: tuple[str, ...] = ("persona", "target_shopped_ind"),
    key: str = "cust_key",
) -> DataFrame:
    """Adds ``fold`` 0..n_folds-1; a stratum's fold sizes differ by one row at most."""
    indexed = dense_index(df, seed, key, list(strata))
    return indexed.select(*df.columns, (F.col("row_idx") % n_folds).cast("int").alias("fold"))


def bootstrap_resample(df: DataFrame, seed: int, key: str = "cust_key") -> DataFrame:
    """n draws with replacement from n rows, as the drawn rows with their ``draws``."""
    indexed = dense_index(df, seed, key)
    drawn = hash_number(hash_key(seed, F.lit("draw"), "row_idx")) % F.col("n_rows")
    draws = indexed.select(drawn.alias("row_idx")).groupBy("row_idx").agg(F.count("*").alias("draws"))
    return indexed.join(draws, "row_idx").select(*df.columns, "draws")


def poisson_weight(seed: int, replicate: int, key: str = "cust_key") -> Column:
    """How often a row appears in a large resample: Poisson(1), from the row's digest.

    Needs no shuffle and no row count, so hundreds of resamples cost one pass each.
    """
    u = hash_number(hash_key(seed, F.lit(replicate), key)) / F.lit(float(16**13))
    below, term, weight = 0.0, 0.36787944117144233, F.lit(0)
    for k in range(POISSON_TERMS):
        below += term
        weight = weight + F.when(u >= below, 1).otherwise(0)
        term /= k + 1
    return weight.cast("double")
