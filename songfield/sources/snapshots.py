"""Several tables that change together: each commit writes what changed to folders of
its own, then one row of a manifest that names the folders of all tables. That row is
last and appears whole, so a reader has all tables of before or all of after, and a
commit that stops half way leaves folders that no manifest names."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "number bigint, id string, tables string, about string"


def history(spark: SparkSession, root: str) -> DataFrame:
    """The commits under ``root``; none where nothing was committed."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(MANIFEST).json(f"{root}/manifest")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], MANIFEST)


def current(spark: SparkSession, root: str):
    """The newest commit's row, or None. Of two that took one number, the larger id."""
    return history(spark, root).orderBy(F.col("number").desc(), F.col("id").desc()).limit(1).first()


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], about: dict | None = None) -> int:
    """Writes ``tables`` and makes them current beside those that aren't given. They may
    be made from the tables that they replace, which stay as they are."""
    last = current(spark, root)
    named = json.loads(last["tables"]) if last else {}
    number, id = (last["number"] if last else 0) + 1, uuid.uuid4().hex
    for name, rows in tables.items():
        path = f"{root}/{name}/{number:012d}-{id}"
        rows.write.parquet(path)
        named = named | {name: {"path": path, "schema": rows.schema.json()}}
    said = json.dumps(about if about is not None else json.loads(last["about"]) if last else {})
    # One row in one file, which the writer moves to its place once it is whole.
    spark.createDataFrame([(number, id, json.dumps(named), said)], MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifest")
    return number


def tables(spark: SparkSession, root: str, number: int | None = None) -> tuple[dict[str, DataFrame], dict]:
    """The tables of the newest commit, or of commit ``number``, and what it says about
    itself. What is read stays the same while others commit."""
    from pyspark.sql.types import StructType

    row = current(spark, root) if number is None else history(spark, root).filter(F.col("number") == number).orderBy(F.col("id").desc()).first()
    if row is None:
        raise ValueError(f"nothing was committed under {root}")
    return {n: spark.read.schema(StructType.fromJson(json.loads(x["schema"]))).parquet(x["path"]) for n, x in json.loads(row["tables"]).items()}, json.loads(row["about"])
