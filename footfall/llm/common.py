"""Helpers that the text operators share: batches of texts inside tasks, cut lineage, folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one step inside a task works on; a longer text is a step of its own.
STEP_CHARS = 2_000_000
STEP_ROWS = 1024


def cut(df: DataFrame) -> DataFrame:
    """Store the rows in the reliable checkpoint folder and go on from there.

    The folder is `spark.checkpoint.dir`. Where that is unset a local session gets a temporary
    folder; any other session must name one, since executors do not share local disks.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set where it is not set yet."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="footfall-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet into the shared folder and read them back.

    The table goes with the checkpoints of the session: whoever clears that folder clears it too.
    """
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/footfall-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.parquet(place)


def steps(batches: Iterator[pa.RecordBatch], column: str, chars: int = STEP_CHARS, rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of bounded text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        first = held = 0
        for row, size in enumerate(sizes):
            if row > first and (held + size > chars or row - first >= rows):
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += size
        if first < batch.num_rows:
            yield batch.slice(first)


def map_texts(
    df: DataFrame,
    column: str,
    make: Callable[[], Callable[[list[str]], dict[str, object]]],
    added: str,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns worked out from a text column, batch by batch inside each task.

    `make()` runs once in a task and returns the function from texts (null: empty) to columns;
    `added` is the DDL of these columns; `keep` names the input columns that stay (default: all
    but the text).
    """
    keep = [c for c in df.columns if c != column] if keep is None else keep
    source = df.select(*dict.fromkeys([*keep, column]))
    out = df.select(*keep).schema
    names = [part.split()[0] for part in added.split(",")]
    for field in parse_ddl(added):
        out = out.add(field)
    kinds = [arrow_type(f.dataType) for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in steps(batches, column):
            texts = ["" if t is None else t for t in part.column(column).to_pylist()]
            made = work(texts)
            arrays = [part.column(c) for c in keep]
            arrays += [pa.array(made[n], type=k) for n, k in zip(names, kinds[len(keep) :], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *names])

    return source.mapInArrow(run, out)


def fresh(df: DataFrame, name: str) -> str:
    """A name for a scratch column that no column of the table has."""
    held = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in held:
        name += "_"
    return name


def parse_ddl(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fields


def arrow_type(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def ascii_words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def fold(key: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; a null id is in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % of, F.lit(0))
