"""Merges of tracks over all tables that name them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from songfield.sources.snapshots import commit, tables
from songfield.sources.tables import written

#: Tables by track, of which a merged track's rows go.
OF_TRACKS = ("features", "layout", "failures", "mix_failures", "dedupe_seen")


def resolved(merges: DataFrame) -> DataFrame:
    """(from_id, into_id): every merged id beside what is left in the end. Each round
    doubles how far ids look ahead, so a chain of n takes log2 n rounds, a table each.
    A circle has no end: its smallest id keeps, and is from nothing. Of several merges
    of one id that into the smallest counts; one into itself is none."""
    now = written(merges.filter("from_id <> into_id").groupBy("from_id").agg(F.min("into_id").alias("into_id")).withColumn("low", F.least("from_id", "into_id")), "merges")
    rounds = max(1, now.count()).bit_length()
    for _ in range(rounds):
        on = now.select(F.col("from_id").alias("into_id"), F.col("into_id").alias("further"), F.col("low").alias("low_on"))
        if now.join(on, "into_id", "left_semi").isEmpty():
            break
        now = written(now.join(on, "into_id", "left").select("from_id", F.coalesce("further", "into_id").alias("into_id"), F.least("low", F.coalesce("low_on", "low")).alias("low")), "merges")
    # Who still points to a merged id is on a circle or leads to one: all of it lies ahead of that id.
    circle = now.select(F.col("from_id").alias("into_id"), F.col("low").alias("keeper"))
    ends = now.join(circle, "into_id", "left").select("from_id", F.coalesce("keeper", "into_id").alias("into_id"))
    return ends.filter("from_id <> into_id")


def _moved(rows: DataFrame, ends: DataFrame, id: str) -> DataFrame:
    """``rows`` with their id in the end, and ``__from``: the id they had, null where it stays."""
    m = ends.select(F.col("from_id").alias(id), "into_id")
    out = rows.join(m, id, "left")
    return out.withColumns({id: F.coalesce("into_id", id), "__from": F.when(F.col("into_id").isNotNull(), F.col(id))}).drop("into_id")


def _own_first(rows: DataFrame, key: list[str], *then) -> DataFrame:
    """The row that was there, else the first that was moved."""
    w = Window.partitionBy(*key).orderBy(F.col("__from").isNotNull(), *then, "__from")
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


@F.pandas_udf(StringType())
def _renamed(entries: pd.Series, ids: pd.Series) -> pd.Series:
    """the entry as of the other track; what isn't an object stays."""

    def one(entry, id):
        try:
            value = json.loads(entry)
            value["origin"]["item"]["id"] = str(id)
        except (TypeError, ValueError, KeyError):
            return entry
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False)

    return pd.Series([one(e, i) for e, i in zip(entries, ids)], dtype=object)


def merged_refs(refs: DataFrame, ends: DataFrame) -> DataFrame:
    """Providers' items of a merged track are the kept one's; other kinds stay."""
    ours = F.when(F.col("kind") == "track", F.col("id").cast("bigint"))
    out = _moved(refs.withColumn("__id", ours), ends, "__id")
    return out.withColumn("id", F.when(F.col("__from").isNotNull(), F.col("__id").cast("string")).otherwise(F.col("id"))).select(*refs.columns)


def merged_likes(likes: DataFrame, ends: DataFrame) -> DataFrame:
    """A like of both stays the kept track's own, else the earliest of the merged ones."""
    ours = F.when(F.col("kind") == "track", F.col("ref_id").cast("bigint"))
    out = _moved(likes.withColumn("__id", ours), ends, "__id")
    kind = dict(likes.dtypes)["ref_id"]
    out = out.withColumn("ref_id", F.when(F.col("__from").isNotNull(), F.col("__id").cast(kind)).otherwise(F.col("ref_id")))
    return _own_first(out, ["user_id", "kind", "ref_id"], "liked_at").select(*likes.columns)


def merged_listens(listens: DataFrame, ends: DataFrame) -> DataFrame:
    """Who listened to one listened to the other."""
    return _moved(listens, ends, "track_id").select(*listens.columns)


def merged_queue(queue: DataFrame, ends: DataFrame) -> DataFrame:
    """The most urgent reason of all, the kept track's own of equal ones; it keeps the
    time at which it was queued, else that of the first that is merged into it."""
    rows = _moved(queue, ends, "track_id")
    moved = F.col("__from").isNotNull()
    urgent = F.min_by(F.struct("priority", "reason"), F.struct("priority", moved, "__from")).alias("u")
    others = [c for c in queue.columns if c not in ("track_id", "priority", "reason")]
    first = F.min_by(F.struct(*others), F.struct(moved, "__from")).alias("f")
    return rows.groupBy("track_id").agg(urgent, first).select("track_id", "u.*", "f.*").select(*queue.columns)


def merged_mix(mix: DataFrame, ends: DataFrame) -> DataFrame:
    """The kept track's own analysis, else that of the first merged one, renamed for it."""
    rows = _own_first(_moved(mix, ends, "track_id"), ["track_id"])
    entry = F.when(F.col("__from").isNull(), F.col("entry_json")).otherwise(_renamed("entry_json", "track_id"))
    return rows.withColumn("entry_json", entry).select(*mix.columns)


def merged_tracks(tracks: DataFrame, ends: DataFrame) -> DataFrame:
    """Merged tracks go; the kept one gets their least distance, and their code if it has none."""
    m = ends.select(F.col("from_id").alias("id"), F.col("into_id").alias("__into"))
    gone = tracks.join(m, "id").groupBy("__into").agg(F.min("seed_distance").alias("__near"), F.min_by("isrc", F.when(F.col("isrc").isNotNull(), F.col("id"))).alias("__isrc"))
    left = tracks.join(m.select("id"), "id", "left_anti").join(gone, F.col("id") == F.col("__into"), "left")
    return left.withColumns({"seed_distance": F.least("seed_distance", "__near"), "isrc": F.coalesce("isrc", "__isrc")}).select(*tracks.columns)


def merged_history(track_merges: DataFrame, merges: DataFrame, ends: DataFrame) -> DataFrame:
    """All merges so far, each into what is left in the end; a new one of an id counts."""
    new = merges.join(ends.select("from_id"), "from_id", "left_semi")
    old = track_merges.join(new.select("from_id"), "from_id", "left_anti")
    w = Window.partitionBy("from_id").orderBy("into_id")
    once = new.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return _moved(old.unionByName(once.select(*old.columns)).withColumnRenamed("into_id", "__to"), ends.withColumnRenamed("into_id", "__end").withColumnRenamed("from_id", "__to").select(F.col("__to").alias("from_id"), F.col("__end").alias("into_id")), "__to").withColumnRenamed("__to", "into_id").filter("from_id <> into_id").select(*track_merges.columns)


def merge(old: dict[str, DataFrame], merges: DataFrame) -> dict[str, DataFrame]:
    """The tables that ``merges`` (from_id, into_id, similarity, merged_at) change, of
    those given; ids that were merged before count as what they were merged into."""
    before = old["track_merges"].select("from_id", "into_id") if "track_merges" in old else None
    every = merges.select("from_id", "into_id")
    if before is not None:
        every = every.unionByName(before.join(every.select("from_id"), "from_id", "left_anti"))
    ends = written(resolved(every), "ends")
    change = {"refs": merged_refs, "likes": merged_likes, "listens": merged_listens, "mix_queue": merged_queue, "mix": merged_mix, "tracks": merged_tracks}
    out = {name: f(old[name], ends) for name, f in change.items() if name in old}
    for name in OF_TRACKS:
        if name in old:
            out[name] = old[name].join(ends.select(F.col("from_id").alias("track_id")), "track_id", "left_anti").select(*old[name].columns)
    if before is not None:
        out["track_merges"] = merged_history(old["track_merges"], merges, ends)
    return out


def merge_snapshot(spark: SparkSession, root: str, merges: DataFrame) -> int:
    """``merge`` over the tables under ``root`` as one commit."""
    old, _ = tables(spark, root)
    return commit(spark, root, merge(old, merges))
