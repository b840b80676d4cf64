"""A library that grows in place: one base and the segments appended since.

An append writes its rows as a segment and then one row of a log; it reads and rewrites
nothing of what is there. A reader merges the newest base with the segments that the
base doesn't cover, of each key the row that was appended last. Compaction writes that
as a new base and says which segments it covers. As a base names what it covers, appends
and compactions at the same time neither lose a segment nor count one twice.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG = "number bigint, id string, kind string, path string, schema string, covers array<string>"
#: When a row came: the number of its append, and its id where two took one number.
AT = "_at"


def log(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).json(f"{root}/log")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], LOG)


def _add(spark: SparkSession, root: str, number: int, id: str, kind: str, rows: DataFrame, covers: list[str]) -> None:
    path = f"{root}/{kind}/{number:012d}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    # One row in one file, which the writer moves to its place once it is whole.
    spark.createDataFrame([(number, id, kind, path, json.dumps(rows.schema.jsonValue()), covers)], LOG).coalesce(1).write.mode("append").json(f"{root}/log")


def _next(spark: SparkSession, root: str) -> int:
    return (log(spark, root).agg(F.max("number")).first()[0] or 0) + 1


def append(rows: DataFrame, root: str, batch: str | None = None) -> bool:
    """``rows`` as a segment. ``batch`` names it: a batch that is in the library
    already, as one of a stream that is tried again, is left alone and gives False."""
    spark = rows.sparkSession
    if AT in rows.columns:
        raise ValueError(f"column {AT} is the library's own: rename it before")
    if batch is not None and not log(spark, root).filter((F.col("id") == batch) & (F.col("kind") == "segment")).isEmpty():
        return False
    number, id = _next(spark, root), batch or uuid.uuid4().hex
    _add(spark, root, number, id, "segment", rows.withColumn(AT, F.struct(F.lit(number).cast("bigint").alias("number"), F.lit(id).alias("id"))), [])
    return True


def _open(spark: SparkSession, root: str) -> tuple[DataFrame | None, DataFrame | None, list[str]]:
    """The newest base, the segments that it doesn't cover, and what base and segments cover together."""
    entries, table = log(spark, root), lambda x: spark.read.schema(StructType.fromJson(json.loads(x["schema"]))).parquet(x["path"])
    last = entries.filter("kind = 'base'").orderBy(F.col("number").desc(), F.col("id").desc()).limit(1).first()
    covered = last["covers"] if last else []
    # A row for each append since the last compaction; of a batch that came twice at once, the first.
    fresh = {}
    for x in entries.filter("kind = 'segment'").filter(~F.array_contains(F.lit(covered).cast("array<string>"), F.col("id"))).orderBy("number", "path").collect():
        fresh.setdefault(x["id"], x)
    if last is None and not fresh:
        raise ValueError(f"nothing was appended under {root}")
    parts = [table(x) for x in fresh.values()]
    return table(last) if last else None, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None, [*covered, *fresh]


def _merged(base: DataFrame | None, fresh: DataFrame | None, key: str) -> DataFrame:
    if fresh is None:
        return base
    columns = fresh.columns
    latest = F.max_by(F.struct(*columns), F.struct(AT, F.xxhash64(*columns), F.to_json(F.struct(*columns))))
    newest = fresh.filter(F.col(key).isNotNull()).groupBy(key).agg(latest.alias("row")).select("row.*").unionByName(fresh.filter(F.col(key).isNull()))
    if base is None:
        return newest
    # What is new is small beside the base, so that the base is read where it lies.
    stamps = newest.filter(F.col(key).isNotNull()).select(key, F.col(AT).alias("_new"))
    stays = base.join(stamps, key, "left").filter(F.col("_new").isNull() | (F.col("_new") < F.col(AT))).select(*base.columns)
    later = base.join(stamps, key).filter(F.col("_new") < F.col(AT)).select(key)
    return stays.unionByName(newest.join(later, key, "left_anti"), allowMissingColumns=True)


def read(spark: SparkSession, root: str, key: str = "id") -> DataFrame:
    """The library: of each key the row appended last; of rows of one append with one key,
    one that a hash of them chooses. Rows without a key are all kept, an append of no rows
    changes nothing, and a column that a segment doesn't have is null for its rows."""
    base, fresh, _ = _open(spark, root)
    return _merged(base, fresh, key).drop(AT)


def compact(spark: SparkSession, root: str, key: str = "id") -> int:
    """Writes the library as a new base; what is appended meanwhile stays beside it. The
    number of segments that the base now covers and the last one didn't."""
    base, fresh, covers = _open(spark, root)
    if fresh is None:
        return 0
    before = log(spark, root).filter("kind = 'base'").orderBy(F.col("number").desc(), F.col("id").desc()).limit(1).first()
    _add(spark, root, _next(spark, root), uuid.uuid4().hex, "base", _merged(base, fresh, key), covers)
    return len(covers) - len(before["covers"] if before else [])
