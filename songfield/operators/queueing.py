"""Priority queues and the crawl frontier, as tables that jobs rewrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songfield.operators.catalogue import first_by
from songfield.operators.numbering import numbered


def positions(queue: DataFrame) -> DataFrame:
    """How many go before each row. A hot priority is in many ranges."""
    return numbered(queue, [F.col("priority"), F.col("seq")], name="position")


def claim(queue: DataFrame, taken: DataFrame, done: DataFrame, n: int) -> DataFrame:
    """The next n rows that nobody took and that aren't done."""
    free = queue.join(done.select("track_id"), "track_id", "left_anti").join(taken.select("track_id"), "track_id", "left_anti")
    return free.orderBy("priority", "seq").limit(n)


def enqueued(queue: DataFrame, asked: DataFrame) -> DataFrame:
    """A track asked for again keeps its place and the more urgent reason."""
    every = queue.select("track_id", "priority", "reason", "seq").unionByName(asked.select("track_id", "priority", "reason", "seq"))
    best = F.min(F.struct("priority", "seq", "reason"))
    return every.groupBy("track_id").agg(best.alias("best"), F.min("seq").alias("seq")).select("track_id", "best.priority", "best.reason", "seq")


def next_frontier(frontier: DataFrame, n: int) -> DataFrame:
    """O2: the frontier's next rows; of equal priority artists before albums."""
    return frontier.filter("state = 'pending'").orderBy("priority", F.col("kind").desc(), "ref_id").limit(n)


def crawl_step(frontier: DataFrame, similar: DataFrame, blocked: DataFrame, most: int) -> DataFrame:
    """The artists one hop on, at their least distance; not those already
    there, blocked, or too far."""
    now = frontier.filter("state = 'pending'").select(F.col("ref_id").alias("from_id"), F.col("priority").alias("distance"))
    reached = now.join(similar, "from_id").groupBy(F.col("to_id").alias("ref_id")).agg((F.min("distance") + 1).alias("priority"))
    new = reached.filter(F.col("priority") <= most).join(frontier.select("ref_id"), "ref_id", "left_anti").join(blocked.select(F.col("artist_id").alias("ref_id")), "ref_id", "left_anti")
    return new.select(F.lit("artist").alias("kind"), "ref_id", "priority", F.lit("pending").alias("state"))


def seeded(likes: DataFrame, frontier: DataFrame) -> DataFrame:
    """Likes as frontier rows at distance 0, each once, not those there."""
    rows = likes.select("kind", "ref_id").distinct().select("kind", "ref_id", F.lit(0).cast("bigint").alias("priority"), F.lit("pending").alias("state"))
    return rows.join(frontier.select("kind", "ref_id"), ["kind", "ref_id"], "left_anti")


def likes_to_queue(likes: DataFrame, queued: DataFrame, now: int, window: int = 24 * 3600) -> DataFrame:
    """Likes that never were queued, the recent ones urgent."""
    last = likes.groupBy("kind", "ref_id").agg(F.max("liked_at").alias("liked_at"))
    new = last.join(queued.select("kind", "ref_id"), ["kind", "ref_id"], "left_anti")
    return new.withColumn("priority", F.when(F.col("liked_at") >= now - window, 0).otherwise(1))


def new_releases(albums: DataFrame, liked_artists: DataFrame, known: DataFrame, today, days: int) -> DataFrame:
    """Albums of liked artists of the last days that aren't known yet."""
    from songfield.operators.catalogue import released_within

    mine = albums.join(liked_artists.select("artist_id").distinct(), "artist_id", "left_semi")
    return released_within(mine.join(known.select("id"), "id", "left_anti"), today, days)


def around(nearest: DataFrame, count: int) -> DataFrame:
    """Seeds (seed_pos) with their neighbours (rank 0 is the seed), each id once, in order."""
    once = first_by(nearest, ["id"], F.col("seed_pos"), F.col("rank"))
    return once.orderBy("seed_pos", "rank").limit(count)


def _shared(a: Column, b: Column) -> Column:
    """How many elements two arrays begin with in common; nulls equal each other."""
    boxed = lambda xs: F.transform(xs, lambda x: F.struct(x.alias("x")))  # noqa: E731  an element that is null isn't an end
    differ = F.array_position(F.zip_with(boxed(a), boxed(b), lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differ == 0, F.size(a).cast("bigint")).otherwise(differ - 1)


def splice(before: Column, after: Column) -> Column:
    """T5: (at, removed, tracks): what lies between the beginning and the end that two
    queues have in common. Null is an empty queue."""
    before, after = F.coalesce(before, F.array().cast("array<bigint>")), F.coalesce(after, F.array().cast("array<bigint>"))
    head = _shared(before, after).cast("int")
    old, new = F.slice(before, head + 1, F.size(before)), F.slice(after, head + 1, F.size(after))
    tail = _shared(F.reverse(old), F.reverse(new)).cast("int")
    return F.struct(head.cast("bigint").alias("at"), (F.size(old) - tail).cast("bigint").alias("removed"), F.slice(new, F.lit(1), F.size(new) - tail).alias("tracks"))


def spliced(queue: Column, change: Column) -> Column:
    """T5: the queue after the change; null where the change doesn't fit it."""
    queue = F.coalesce(queue, F.array().cast("array<bigint>"))
    at, removed = change["at"].cast("int"), change["removed"].cast("int")
    fits = (change["at"] >= 0) & (change["removed"] >= 0) & (F.try_add(change["at"], change["removed"]) <= F.size(queue))
    return F.when(fits, F.concat(F.slice(queue, F.lit(1), at), change["tracks"], F.slice(queue, at + removed + 1, F.size(queue))))


def splices(snapshots: DataFrame) -> DataFrame:
    """T5: snapshots (user_id, seq, tracks) of queues as changes to the one before of the
    user, whose seq is ``base``; the first changes an empty queue and has no base. Each
    user's seq must be distinct."""
    w = Window.partitionBy("user_id").orderBy("seq")
    both = snapshots.select("user_id", "seq", F.lag("seq").over(w).alias("base"), F.lag("tracks").over(w).alias("before"), "tracks")
    return both.select("user_id", "seq", "base", F.coalesce("before", F.array().cast("array<bigint>")).alias("before"), splice(F.col("before"), F.col("tracks")).alias("change"))
