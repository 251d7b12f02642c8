"""Written tables in the shared checkpoint folder: they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting, as in tests, gets a temporary folder; a
    cluster has to name a folder that every executor reaches.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="footfall-"))
    return context.getCheckpointDir()


#: Tables written by each application, until `remove_stored` takes them away.
_written: dict[str, list[str]] = {}


def remove_stored(spark: SparkSession) -> int:
    """Deletes the tables that `materialize` wrote for this application; how many there were.

    For the end of a run or a session: results that still read them become invalid.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes the table once and reads it back; Parquet keeps pruning and pushdown."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/footfall-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Shuffled bytes that one task reads of a table that `partitions_by_size` is held around.
TASK_BYTES = 8 << 20


@contextmanager
def partitions_by_size(spark: SparkSession, input_bytes: int) -> Iterator[None]:
    """Shuffles within have a partition per TASK_BYTES, not per core, so that a task's memory does not grow with the input.

    Adaptive execution merges small partitions; it has to be given enough of them. The session's
    settings come back at the end.
    """
    names = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"]
    before = {n: spark.conf.get(n, None) for n in names}
    least = int(before[names[2]] or spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        for n, value in zip(names, (TASK_BYTES, "false", max(least, -(-input_bytes // TASK_BYTES))), strict=True):
            spark.conf.set(n, str(value))
        yield
    finally:
        for n, value in before.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)
