"""Listens from what sessions showed after each operation, and sessions by gaps.

A moment is a session's state after one operation: (user_id, seq, at, op, row,
index, track, seconds, sounding, output, position), in the order of ``seq``; ``row``
is where an ``ended`` says that it ended. Listens are cut out of a user's moments
by windows: sounding time lies between two moments, a listen is what lies between
two cuts, and the moment that cuts says how it ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songfield.schemas import CLOCK_SLACK, FINISH_SHARE, FINISH_SLACK

MOMENT = "user_id bigint, seq bigint, at double, op string, row int, index int, track bigint, seconds double, sounding boolean, output string, position double"


def _intervals(moments: DataFrame) -> DataFrame:
    """Each moment with the one before it, the seconds heard in between, and whether it
    cuts: another track plays from then on, or the same one anew."""
    by_user = Window.partitionBy("user_id").orderBy("seq", "silent")
    past = {f"was_{c}": F.lag(c).over(by_user) for c in ("at", "index", "track", "seconds", "sounding", "output", "position")}
    rows = moments.withColumns(past).withColumn("sounding", F.coalesce("sounding", F.lit(False)))
    clock = F.col("was_position") + F.when(F.col("was_sounding"), F.col("at") - F.col("was_at")).otherwise(0.0)
    due = F.least(clock, F.coalesce("was_seconds", clock))  # where the clock says that playing was by now
    same = F.col("track").eqNullSafe(F.col("was_track"))
    reached = F.when((F.col("op") == "report") & same, F.col("position")).otherwise(due)
    heard = F.greatest(F.lit(0.0), F.least(reached - F.col("was_position"), F.col("at") - F.col("was_at") + CLOCK_SLACK))
    muted = (F.col("op") == "output") & F.col("output").isNull()
    silenced = muted & F.col("was_output").isNotNull()
    anew = F.col("op").isin("load", "jump", "clear") | ((F.col("op") == "step") & (F.col("index") != F.col("was_index"))) | ((F.col("op") == "ended") & (F.col("row") == F.col("was_index"))) | silenced
    return rows.select(
        "user_id", "seq", "silent", "at", "op", "track", "seconds", "sounding", "output", reached.alias("reached"), muted.alias("muted"),
        F.when(F.col("was_sounding"), heard).otherwise(0.0).alias("heard"), F.coalesce(anew | ~same, F.lit(True)).alias("cuts"),
    )


def _ended(seconds: Column) -> Column:
    """How the moment that closes a listen of a track of ``seconds`` ended it."""
    near = F.when(seconds.isNull(), F.col("op") == "ended").otherwise(F.col("reached") >= seconds - F.least(F.lit(FINISH_SLACK), seconds * FINISH_SHARE))
    return F.when(near, "finished").when(F.col("track").isNull() | (F.col("op") == "clear") | F.col("muted"), "stopped").otherwise("skipped")


def _silences(moments: DataFrame, silence: float, until: float | None) -> DataFrame:
    """A closing moment, ``silence`` seconds after each moment that nothing follows in
    that time; after a user's last one only if ``until`` is that late."""
    following = F.lead("at").over(Window.partitionBy("user_id").orderBy("seq"))
    end = F.coalesce(following, F.lit(until).cast("double"))
    quiet = moments.withColumn("__end", end).filter(F.col("__end") - F.col("at") > silence)
    return quiet.select("user_id", "seq", (F.col("at") + silence).alias("at"), F.lit("clear").alias("op"), *[F.lit(None).cast(k).alias(c) for c, k in (("row", "int"), ("index", "int"), ("track", "bigint"), ("seconds", "double"))], F.lit(False).alias("sounding"), "output", "position", F.lit(1).alias("silent"))


def _numbered(moments: DataFrame, silence: float | None, until: float | None) -> DataFrame:
    """Intervals with the number of the part that each begins or belongs to."""
    once = moments.distinct()
    every = once.withColumn("silent", F.lit(0))
    if silence is not None:
        every = every.unionByName(_silences(once, silence, until))
    upto = Window.partitionBy("user_id").orderBy("seq", "silent").rowsBetween(Window.unboundedPreceding, 0)
    return _intervals(every).withColumn("part", F.sum(F.col("cuts").cast("int")).over(upto))


def listens(moments: DataFrame, silence: float | None = None, until: float | None = None) -> DataFrame:
    """(user_id, track_id, device_id, started_at, listened_seconds, track_seconds,
    ended) of every listen that a later moment closed. Moments repeated whole count
    once; a user without moments has no listens. With ``silence`` a listen also ends
    that many seconds after a moment that nothing follows, at ``until`` at the latest."""
    return _closed(_numbered(moments, silence, until))


def _closed(numbered: DataFrame) -> DataFrame:
    begun = F.when(F.col("sounding") & F.col("track").isNotNull(), F.struct("seq", "silent", "at", "track", "output", "seconds"))
    inside = numbered.groupBy("user_id", "part").agg(F.min(begun).alias("begun"), F.sum(F.when(~F.col("cuts"), F.col("heard")).otherwise(0.0)).alias("inside"))
    # A cut's own interval is the last of the part before it.
    closing = numbered.filter("cuts").select("user_id", (F.col("part") - 1).alias("part"), "op", "track", "reached", "muted", F.col("heard").alias("last"))
    both = inside.filter("begun IS NOT NULL").join(closing, ["user_id", "part"])
    return both.select(
        "user_id", F.col("begun.track").alias("track_id"), F.col("begun.output").alias("device_id"), F.col("begun.at").alias("started_at"),
        (F.col("inside") + F.col("last")).alias("listened_seconds"), F.col("begun.seconds").alias("track_seconds"), _ended(F.col("begun.seconds")).alias("ended"),
    )


def listens_on(stream: DataFrame, folder: str, checkpoint: str, silence: float | None = None, delay: float = 0.0):
    """The listens of a stream of moments, each once, as a table under
    ``folder``/listens, in files by batch.

    From batch to batch a table keeps each user's moments since the last cut, which
    is all that an open listen needs, and how late it is: the latest moment so far,
    less ``delay``. A batch reads the table of the batch before and writes its own
    beside it, so one that is tried again finds what it found and replaces what it
    wrote. A user's moments come in the order of ``seq``; one that comes after its
    listen was closed is left out. With ``silence``, a listen of a user who falls silent
    is closed by the clock, and nothing of it is kept any more."""
    spark = stream.sparkSession
    held, clock = (f"{folder}/{name}" for name in ("open", "clock"))

    def put(batch: DataFrame, number: int) -> None:
        slot = number % 2
        new = batch.select(*[f.split()[0] for f in MOMENT.split(", ")]).persist()
        try:
            before, late, closed = None, None, None
            if number:
                last = 1 - slot
                before = spark.read.schema(f"{MOMENT}, done bigint").parquet(f"{held}/slot={last}")
                late = spark.read.schema("at double").parquet(f"{clock}/slot={last}").first()["at"]
            seen = new.agg(F.max("at")).first()[0]
            times = [x for x in (late, None if seen is None else seen - delay) if x is not None]
            until = max(times) if times else None
            moments = new
            if before is not None:
                # ``done``: the last moment of each user whose listens are all told.
                told = before.groupBy("user_id").agg(F.max("done").alias("done"))
                fresh = new.join(told, "user_id", "left").filter("done IS NULL OR seq > done").drop("done")
                moments = fresh.unionByName(before.filter("seq IS NOT NULL").drop("done"))
            numbered = _numbered(moments, silence, until)
            _closed(numbered).write.mode("overwrite").parquet(f"{folder}/listens/batch={number}")
            ends = numbered.groupBy("user_id").agg(F.max(F.when(F.col("cuts"), F.struct("seq", "silent"))).alias("cut"), F.max("seq").alias("newest"))
            by = moments.distinct().join(ends, "user_id")
            # Where silence made the last cut there is no moment to keep, only that it came so far.
            kept = by.filter("seq > cut.seq OR (seq = cut.seq AND cut.silent = 0)").select(*moments.columns, (F.col("cut.seq") - 1).alias("done"))
            quiet = ends.filter("cut.silent = 1 AND cut.seq = newest")
            blank = quiet.select("user_id", *[F.lit(None).cast(dict(moments.dtypes)[c]).alias(c) for c in moments.columns[1:]], F.col("newest").alias("done"))
            kept.unionByName(blank).write.mode("overwrite").parquet(f"{held}/slot={slot}")
            spark.createDataFrame([(until,)], "at double").coalesce(1).write.mode("overwrite").parquet(f"{clock}/slot={slot}")
        finally:
            new.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def record(stream: DataFrame, folder: str, checkpoint: str):
    """A stream's rows to a table; a batch that is tried again replaces its own
    files, so each row is there once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user's events by a gap, as event-time windows."""
    w = F.session_window("ts", gap)
    return events.groupBy("user_id", w).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
