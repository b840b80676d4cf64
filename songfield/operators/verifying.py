"""Which rules of a walk are broken, for any number of walks in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songfield.schemas import COOLDOWN

#: Steps of a walk that are looked at together.
CHUNK = 4096
FIELDS = ["walk", "step", "id", "artist_id", "album_id", "recording", "bpm"]


def overlapping(rows: DataFrame, step: str, size: int, reach: int) -> DataFrame:
    """``rows`` in chunks of ``size`` steps, each with copies (``own`` false) of the last
    ``reach`` steps before it: what a window of ``reach`` rows sees, however long a walk is."""
    if not 0 < reach <= size:
        raise ValueError("a chunk holds as many steps as are looked back at, and one at least")
    at = F.floor(F.col(step) / size)
    here, next_ = F.struct(at.alias("chunk"), F.lit(True).alias("own")), F.struct((at + 1).alias("chunk"), F.lit(False).alias("own"))
    last = F.pmod(F.col(step), F.lit(size)) >= size - reach
    return rows.withColumn("in", F.explode(F.when(last, F.array(here, next_)).otherwise(F.array(here)))).select(*rows.columns, "in.chunk", "in.own")


def broken_rules(walks: DataFrame, blocked: DataFrame, exclude: DataFrame | None = None, cooldown: int = COOLDOWN, same_album: bool = False, bpm_limit: float | None = None, chunk: int = CHUNK) -> DataFrame:
    """(walk, step, id) of every row of ``walks`` (FIELDS, others aren't carried)
    and a boolean for each rule: ``blocked`` and ``excluded`` (ids in ``exclude``);
    ``artist`` is one of the last ``cooldown`` artists, ``album`` the last one's unless
    ``same_album``, ``tempo`` further than ``bpm_limit`` from the last one's, and
    ``recording`` was in the walk before.

    Steps of a walk are whole numbers without gaps. A null or negative artist is nobody, a
    null or empty album none; a null tempo or recording breaks nothing; nulls in ``walk`` are
    one walk. A row without a step has no place, and rules that look back are false for it.
    An empty table has no rows. A walk of any length is judged by chunks."""
    rows = walks.select(*FIELDS).withColumn("artist_id", F.when(F.col("artist_id") >= 0, F.col("artist_id"))).withColumn("album_id", F.nullif(F.col("album_id"), F.lit("")))
    placed = overlapping(rows, "step", chunk, max(cooldown, 1))
    in_order = Window.partitionBy("walk", "chunk").orderBy("step", "id")

    def said(rule: Column) -> Column:
        return F.coalesce(F.col("step").isNotNull() & rule, F.lit(False))

    recent = F.collect_list("artist_id").over(in_order.rowsBetween(-cooldown, -1)) if cooldown else F.array().cast("array<bigint>")
    last = lambda c: F.lag(c).over(in_order)
    seen = placed.withColumn("recent", recent).withColumn("last_album", last("album_id")).withColumn("last_bpm", last("bpm")).filter("own")
    judged = seen.select(
        *FIELDS,
        said(F.array_contains("recent", F.col("artist_id").cast("bigint"))).alias("artist"),
        said((F.col("album_id") == F.col("last_album")) & F.lit(not same_album)).alias("album"),
        said(F.abs(F.col("bpm") - F.col("last_bpm")) > F.lit(bpm_limit).cast("double")).alias("tempo"),
    )
    # By an aggregate that combines before it shuffles: a common recording is one row for each walk.
    firsts = rows.filter("recording IS NOT NULL AND step IS NOT NULL").groupBy(F.col("walk").alias("of"), F.col("recording").alias("which")).agg(F.min("step").alias("first"))
    judged = judged.join(firsts, F.col("walk").eqNullSafe(F.col("of")) & (F.col("recording") == F.col("which")), "left")
    judged = judged.withColumn("again", said(F.col("step") > F.col("first"))).drop("of", "which", "first")
    barred = judged.join(blocked.select(F.col("artist_id"), F.lit(True).alias("is_blocked")).distinct(), "artist_id", "left")
    if exclude is None:
        barred = barred.withColumn("is_excluded", F.lit(False))
    else:
        barred = barred.join(exclude.select("id", F.lit(True).alias("is_excluded")).distinct(), "id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return barred.select("walk", "step", "id", flag(F.col("is_blocked")).alias("blocked"), flag(F.col("is_excluded")).alias("excluded"), "artist", "album", "tempo", F.col("again").alias("recording"))
