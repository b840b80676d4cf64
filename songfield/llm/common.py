"""Pieces that several corpus operators share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words, as characters and as a pattern.
SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The words of a text, in order; a null or blank text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def once(value: Column) -> Column:
    """``value``, computed once for each row. The optimizer copies a column's
    expression into whatever reads it, into lambdas and pushed filters too, where
    it would run for every element; it leaves alone what depends on the partition."""
    return F.when(F.spark_partition_id() >= 0, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, one machine
    gets a temporary one; on a cluster that is an error, as executors would write to
    folders that no other machine sees."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="songfield-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder: later stages read that,
    so a lost executor costs no more than the stage that it was running."""
    path = f"{shared_folder(df.sparkSession)}/songfield/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.path = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` whose successors are written. Files are deleted by
    the file system that Spark itself uses, whichever it is; PySpark has no call for it."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.path)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def returned() -> None:
    """Gives what was freed back to the system. A worker waits for later tasks, and there
    are more workers than cores where a task has two; what each keeps for itself adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every system's library keeps it
    if trim:
        trim(0)


def returning(rows: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """``rows`` for mapInArrow, whose memory goes back when a task is through."""

    @functools.wraps(rows)
    def run(batches: Iterable) -> Iterator:
        yield from rows(batches)
        returned()

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def refuse_clash(columns: list[str], *added: str) -> None:
    """An error where a caller's columns are called as those that an operator adds:
    neither is replaced in silence."""
    if clash := sorted(set(columns) & set(added)):
        raise ValueError(f"columns {clash} are the operator's own: rename them before")
