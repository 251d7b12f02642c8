"""Reading and writing: warehouse tables, event configuration, delimited files, models."""

from __future__ import annotations

from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from footfall import settings as S
from footfall.sources.retail import RetailTables
from footfall.sources.staging import materialize

TABLE_NAMES = {f: f for f in RetailTables.__dataclass_fields__}


def warehouse_tables(spark: SparkSession, prefix: str = "", test: bool = False) -> RetailTables:
    """Catalog tables ``<prefix><name>``, or their small ``_test`` copies."""
    suffix = "_test" if test else ""
    return RetailTables(**{f: spark.table(f"{prefix}{name}{suffix}") for f, name in TABLE_NAMES.items()})


def parquet_tables(spark: SparkSession, root: str, test: bool = False) -> RetailTables:
    suffix = "_test" if test else ""
    return RetailTables(**{f: spark.read.parquet(f"{root}/{name}{suffix}") for f, name in TABLE_NAMES.items()})


def read_event_config(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(event, short_event, event_slug), from a JSON list or the built-in events."""
    schema = "event string, short_event string, event_slug string"
    if path is None:
        return spark.createDataFrame([tuple(e) for e in S.MODELLED_EVENTS], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


def write_delimited(
    df: DataFrame, path: str, sep: str = "|", gzip: bool = True, single_file: bool = False, header: bool = True
) -> None:
    """Delimited text with a header; one part per task unless a single file is asked for."""
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode("overwrite").option("header", header).option("sep", sep)
    writer.option("compression", "gzip" if gzip else "none").csv(path)


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = "|") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def export_matrix(matrix: DataFrame, path: str, single_file: bool = False) -> None:
    """The feature matrix as text, ordered by persona and label, both descending as text.

    Part files are in order, so many writers work at once; the customer key ends the sort
    order because persona and label alone could be cut into a handful of ranges only.
    ``single_file`` is for matrices that one reader wants as one file.
    """
    text = matrix.select(*[F.col(c).cast("string").alias(c) for c in matrix.columns])
    ordered = text.orderBy(F.col("persona").desc(), F.col("target_shopped_ind").desc(), "cust_key")
    write_delimited(ordered, path, single_file=single_file)


def read_in_order(spark: SparkSession, path: str, *names: str, sep: str = "|") -> DataFrame:
    """Delimited part files as text columns, with ``row_number`` 1, 2, ... through the files in the order of their numbers.

    Rows are counted per file and split; nothing is sorted. ``names`` must be in the header.
    """
    rows = spark.read.option("header", True).option("sep", sep).csv(path)
    missing = set(names) - set(rows.columns)
    if missing:
        raise ValueError(f"no such columns in {path}: {sorted(missing)}")
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long").alias("_part")
    piece = F.regexp_extract("_metadata.file_name", r"-c(\d+)", 1).cast("long").alias("_piece")
    seen = rows.select("*", part, piece, F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    seen = materialize(seen, "export")
    place = ["_part", "_piece", "_block"]
    counts = seen.groupBy(*place).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)  # a row per file and split
    starts = counts.select(*place, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return seen.join(starts, place).withColumn("row_number", F.col("_at") + F.col("_shift")).drop(*place, "_at", "_shift")


def load_delimited(spark: SparkSession, path: str, schema: StructType | str, table: str, sep: str = "|") -> None:
    """Loads a delimited file into a catalog table."""
    read_delimited(spark, path, schema, sep).write.mode("overwrite").saveAsTable(table)


def save_by_persona(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("persona").parquet(path)


def save_models(models: dict[int, MLWritable], path: str) -> None:
    """One folder per persona."""
    for persona, model in models.items():
        model.write().overwrite().save(f"{path}/persona={persona}")


def load_models(spark: SparkSession, model_class: type[MLReadable], path: str) -> dict:
    """The models of all personas that have a folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = [f.getPath().getName() for f in found]
    personas = sorted(int(n.partition("=")[2]) for n in names if n.startswith("persona="))
    return {persona: model_class.load(f"{path}/persona={persona}") for persona in personas}
