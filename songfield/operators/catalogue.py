"""The catalogue's relational operators: scans, predicates, joins, aggregates,
queues and searches. Each takes and returns DataFrames; ``row_no`` is the order
of a catalogue wherever order decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songfield.functions import text as tx
from songfield.operators.numbering import Down, numbered
from songfield.schemas import RECHECK_DAYS, SEARCH_LIMIT

# --- scans and order ---------------------------------------------------------


def in_order(ids: list, kind: str = "bigint", spark=None) -> DataFrame:
    """(row_no, id) of a list: a lookup's order is the list's."""
    return spark.createDataFrame(list(enumerate(ids)), f"row_no bigint, id {kind}")


def scan(ids: DataFrame, tracks: DataFrame, artists: DataFrame, albums: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """Metadata in the order of ``ids`` (row_no, id); an id that the
    catalogue lacks gets a row that says so; nobody's artist is -1."""
    t = tracks.select(F.col("id"), "album_id", "artist_id", "title", "duration", "isrc")
    a = artists.select(F.col("id").alias("artist_id"), F.col("name").alias("artist"))
    b = albums.select(F.col("id").alias("album_id"), F.col("title").alias("album"), "genre", "release_date")
    out = ids.join(t, "id", "left").join(a, "artist_id", "left").join(b, "album_id", "left")
    if layout is not None:
        out = out.join(layout.select(F.col("track_id").alias("id"), "x", "y"), "id", "left")
    return out.withColumns(
        {
            "title": F.coalesce("title", F.concat(F.lit("<missing "), F.col("id").cast("string"), F.lit(">"))),
            "artist_id": F.coalesce("artist_id", F.lit(-1).cast("bigint")),
            **{c: F.coalesce(c, F.lit("")) for c in ("artist", "album", "genre", "album_id")},
        }
    )


def embeddings_for(ids: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """The vector of each id; zeros where there is none or its width is another."""
    right = vectors.filter(F.size("clap") == dims).select(F.col("track_id").alias("id"), "clap")
    return ids.join(right, "id", "left").withColumn("clap", F.coalesce("clap", F.array_repeat(F.lit(0.0).cast("float"), dims)))


def buildable(tracks: DataFrame, features: DataFrame, albums: DataFrame, blocked: DataFrame, dims: int) -> DataFrame:
    """Analysed tracks that aren't blocked, with their album's date."""
    f = features.filter(F.size("clap") == dims).select(F.col("track_id").alias("id"), "clap", "descriptors_json")
    b = albums.select(F.col("id").alias("album_id"), "release_date")
    return not_blocked(tracks, blocked).join(f, "id").join(b, "album_id", "left")


# --- predicates --------------------------------------------------------------


def not_blocked(rows: DataFrame, blocked: DataFrame, artist: str = "artist_id") -> DataFrame:
    """Rows of no blocked artist; a row without artist stays."""
    return rows.join(blocked.select(F.col("artist_id").alias(artist)).distinct(), artist, "left_anti").select(*rows.columns)


def without_artist_of(rows: DataFrame, seed_artist: Column) -> DataFrame:
    """Not the seed's artist, if it has one."""
    return rows.filter(seed_artist.isNull() | ~F.col("artist_id").eqNullSafe(seed_artist))


def stale(tracks: DataFrame, features: DataFrame, version: str) -> DataFrame:
    """Never analysed, or by another version."""
    return tracks.join(features.filter(F.col("extractor_version") == version).select(F.col("track_id").alias("id")), "id", "left_anti").select(*tracks.columns)


def pending_analysis(tracks: DataFrame, features: DataFrame, blocked: DataFrame, failures: DataFrame, version: str, retry: bool = False, limit: int = 0) -> DataFrame:
    """What is to be analysed, nearest to the seeds first; 0 is no limit."""
    rows = not_blocked(stale(tracks, features, version), blocked)
    if not retry:
        rows = rows.join(failures.select(F.col("track_id").alias("id")), "id", "left_anti")
    rows = rows.orderBy("seed_distance", "id")
    return rows.limit(limit) if limit else rows


def pending_mix(asked: DataFrame, mixes: DataFrame, failures: DataFrame, version: str, retry: bool = False) -> DataFrame:
    """(row_no, id) asked for that have no current mix with drops, in order."""
    current = mixes.filter((F.col("version") == version) & F.col("drops")).select(F.col("track_id").alias("id"))
    rows = asked.join(current, "id", "left_anti")
    return rows if retry else rows.join(failures.select(F.col("track_id").alias("id")), "id", "left_anti")


def pending_lyrics(tracks: DataFrame, lyrics: DataFrame, own: DataFrame, today: Column, days: int = RECHECK_DAYS) -> DataFrame:
    """Never looked up, or found none too long ago; one's own library first."""
    known = lyrics.select(F.col("track_id").alias("id"), "status", "checked_at")
    mine = own.select("id").distinct().withColumn("own", F.lit(True))
    rows = tracks.join(known, "id", "left").join(mine, "id", "left")
    due = F.col("status").isNull() | ((F.col("status") == "none") & (F.col("checked_at") < F.date_sub(today, days)))
    return rows.filter(due).orderBy(F.col("own").isNull(), "seed_distance", "id")


def pruned_results(tracks: DataFrame, query: str) -> DataFrame:
    """Rows whose title has all terms; all rows if no field holds the terms."""
    words = tx.terms(query)
    placed = tx.any_has_each([F.col("title"), F.col("artist"), F.col("album")], words)
    return tracks.filter(tx.has_all(F.col("title"), words) | ~placed)


def catalogue_only(rows: DataFrame, space: DataFrame) -> DataFrame:
    """What the space doesn't list, with its place kept."""
    return rows.join(space.select("id").distinct(), "id", "left_anti").select(*rows.columns)


def listed_in(rows: DataFrame, *others: DataFrame) -> DataFrame:
    """U4: rows whose id each of ``others`` lists too; a null id is in none."""
    for other in others:
        rows = rows.join(other.select("id").distinct(), "id", "left_semi").select(*rows.columns)
    return rows


def owned_devices(devices: DataFrame, users: DataFrame) -> DataFrame:
    """Devices (id, user_id, name, scope, created_at, last_seen) with their owner's
    name; one without a known owner is left out."""
    owners = users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name"))
    return devices.join(owners, "user_id").select("id", "name", "scope", "created_at", "last_seen", "user_id", "user_name")


def liked_only(rows: DataFrame, likes: DataFrame, kind: str) -> DataFrame:
    """P15."""
    return rows.join(likes.filter(F.col("kind") == kind).select(F.col("ref_id").alias("id")), "id", "left_semi")


def of_genres(rows: DataFrame, genres: list[str], limit: int) -> DataFrame:
    """Some requested genre is part of the row's; none requested is all."""
    if genres:
        hit = F.lit(False)
        for g in genres:
            hit = hit | F.contains(F.lower(F.col("genre")), F.lit(g.lower()))
        rows = rows.filter(hit)
    return rows.orderBy("row_no").limit(limit)


def of_artist_name(rows: DataFrame, name: str) -> DataFrame:
    """The names agree without case, spaces and marks."""
    return rows.filter(tx.squash(F.col("artist")) == tx.squash(F.lit(name)))


def known_albums(albums: DataFrame, tracks: DataFrame, features: DataFrame, failures: DataFrame) -> DataFrame:
    """Albums of which a track was analysed, or failed to be."""
    done = features.select("track_id").unionByName(failures.select("track_id")).distinct()
    there = tracks.join(done, F.col("id") == F.col("track_id"), "left_semi").select(F.col("album_id").alias("id"))
    return albums.join(there, "id", "left_semi")


def released_within(albums: DataFrame, today: Column, days: int) -> DataFrame:
    """Released in the last days, newest first."""
    day = F.to_date("release_date")
    return albums.filter(day.between(F.date_sub(today, days), today)).orderBy(day.desc(), "id")


def own_releases(albums: DataFrame, artist: int) -> DataFrame:
    """P20: of that artist, or of nobody named."""
    return albums.filter(F.col("artist_id").isNull() | (F.col("artist_id") == artist))


def find_artists(artists: DataFrame, tracks: DataFrame, needle: str, limit: int = 25) -> DataFrame:
    """By id if the needle is one, else by part of the name; the most tracks first."""
    hit = F.col("name").ilike(f"%{needle}%")
    if needle.isdigit():
        hit = F.col("id") == int(needle)
    n = tracks.groupBy(F.col("artist_id").alias("id")).agg(F.count("id").alias("n_tracks"))
    rows = artists.filter(hit).join(n, "id", "left").select("id", "name", F.coalesce("n_tracks", F.lit(0).cast("bigint")).alias("n_tracks"))
    return rows.orderBy(F.col("n_tracks").desc(), "name", "id").limit(limit)


def checked_weights(weights: dict[str, float]) -> dict[str, float]:
    """Weights are finite and between 0 and 10."""
    bad = {k: w for k, w in weights.items() if not 0 <= w <= 10}
    if bad:
        raise ValueError(f"weights out of range: {bad}")
    return weights


# --- joins with an order -----------------------------------------------------


def first_by(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__at", F.row_number().over(w)).filter("__at = 1").drop("__at")


def lyric_matches(tracks: DataFrame, dump: DataFrame, slack: float = 2) -> DataFrame:
    """The dump's row for each track: its artist and title, and a length
    no more than ``slack`` away if the track's is known; the same album first, then one
    with words or marked as without, then the smaller id. A title whose first row has
    neither words nor the mark is as one that finds nothing: the bare title is tried,
    if that is another.

    Rows of the dump that no track can tell apart, and tracks that ask the same, meet as
    one. Words are read for what they say of a row, and join at the end."""
    t = tracks.select("id", tx.prepared(F.col("artist")).alias("a"), F.coalesce(tx.prepared(F.col("album")), F.lit("")).alias("b"), F.col("duration").cast("double").alias("s"), tx.prepared(F.col("title")).alias("whole"), tx.prepared(tx.bare_title(F.col("title"))).alias("bare"))
    first = t.select("*", F.lit(0).alias("turn"), F.col("whole").alias("n"))
    both = first.unionByName(t.filter("bare <> '' AND bare <> whole").select("*", F.lit(1).alias("turn"), F.col("bare").alias("n")))
    asked = both.select("n", "a", "b", "s").filter("n IS NOT NULL AND a IS NOT NULL").distinct()
    silent, words = F.coalesce("instrumental", F.lit(False)), F.coalesce("plain_lyrics", F.lit(""))
    best = F.struct((~((words != "") | silent)).alias("empty"), F.col("dump_id"), (silent | (F.trim(words) != "")).alias("told"))
    rows = dump.select(F.col("name_lower").alias("n"), F.col("artist_name_lower").alias("a"), F.col("album_name_lower").alias("album"), F.col("dump_duration").cast("double").alias("d"), best.alias("best"))
    one = rows.filter("n IS NOT NULL AND a IS NOT NULL").groupBy("n", "a", "album", "d").agg(F.min("best").alias("best"))
    # Without a length, a track meets the best of each album; with one, the best of each length that is near.
    anyone = one.groupBy("n", "a", "album").agg(F.min("best").alias("best"))
    place = F.struct(F.when(F.col("album").isNull(), 2).when(F.col("album") == F.col("b"), 0).otherwise(1).alias("other"), "best")
    free = asked.filter("s IS NULL").join(anyone, ["n", "a"]).select("n", "a", "b", "s", place.alias("place"))
    width = slack + 1
    buckets = F.explode(F.sequence(F.floor((F.col("s") - slack) / width), F.floor((F.col("s") + slack) / width)))
    near = asked.filter("s IS NOT NULL").withColumn("bucket", buckets).join(one.filter("d IS NOT NULL").withColumn("bucket", F.floor(F.col("d") / width)), ["n", "a", "bucket"])
    near = near.filter(F.col("d").between(F.col("s") - slack, F.col("s") + slack)).select("n", "a", "b", "s", place.alias("place"))
    answers = free.unionByName(near).groupBy("n", "a", "b", "s").agg(F.min("place").alias("place")).withColumnRenamed("s", "length")
    known = lambda c: F.coalesce(c, F.lit(-1.0)).alias("known")
    hit = both.select("*", known("s")).join(answers.select("*", known("length")), ["n", "a", "b", "known"]).filter(F.col("s").eqNullSafe(F.col("length")))
    firsts = hit.groupBy("id", "turn").agg(F.min("place").alias("place")).filter("place.best.told")
    found = firsts.groupBy("id").agg(F.min(F.struct("turn", F.col("place.best.dump_id").alias("dump_id"))).alias("f")).select("id", "f.dump_id")
    return found.join(dump.select("dump_id", "plain_lyrics", "instrumental").dropDuplicates(["dump_id"]), "dump_id", "left").select("id", "dump_id", "plain_lyrics", "instrumental")


def same_as(items: DataFrame, refs: DataFrame) -> DataFrame:
    """What another provider's item is here: of the same code, or for all but
    tracks of the same key; not where this provider has something under that id. A
    playlist is nobody else's, and a key of nothing but separators is no key.

    Items of one provider that ask for the same code or key have the same answer, so
    each is asked once; items join the answers, a row each."""
    some = items.filter("kind <> 'playlist'").select("provider", "kind", "ref", tx.isrc_key(F.col("isrc")).alias("isrc"), "match_key")
    keyed = some.filter((F.col("kind") != "track") & (F.trim(F.translate("match_key", "|", "")) != ""))
    asks = some.filter("isrc IS NOT NULL").select("provider", "kind", "ref", F.lit(0).alias("turn"), F.col("isrc").alias("key"))
    asks = asks.unionByName(keyed.select("provider", "kind", "ref", F.lit(1).alias("turn"), F.col("match_key").alias("key")))
    of = lambda column, turn: refs.filter(F.col(column).isNotNull()).select("kind", F.lit(turn).alias("turn"), F.col(column).alias("key"), F.col("id").alias("known"), F.col("provider").alias("p"))
    there = of("isrc", 0).unionByName(of("match_key", 1)).filter("kind <> 'playlist'").distinct()
    once = asks.select("provider", "kind", "turn", "key").distinct()
    taken = refs.select("provider", "kind", F.col("id").alias("known"))
    free = once.join(there, ["kind", "turn", "key"]).filter("p <> provider").join(taken, ["provider", "kind", "known"], "left_anti")
    answers = free.groupBy("provider", "kind", "turn", "key").agg(F.min("known").alias("known"))
    found = asks.join(answers, ["provider", "kind", "turn", "key"]).groupBy("provider", "kind", "ref").agg(F.min(F.struct("turn", "known")).alias("f"))
    return found.select("provider", "kind", "ref", "f.known")


def redirected(rows: DataFrame, merges: DataFrame, id: str = "track_id") -> DataFrame:
    """Ids of merged tracks as what they were merged into."""
    m = merges.select(F.col("from_id").alias(id), F.col("into_id").alias("__into"))
    return rows.join(m, id, "left").withColumn(id, F.coalesce("__into", id)).drop("__into")


def gathered(sources: list[DataFrame], id: str = "id") -> DataFrame:
    """All sources' rows, an id's first by source and place."""
    every = None
    for rank, rows in enumerate(sources):
        rows = rows.withColumn("source_rank", F.lit(rank))
        every = rows if every is None else every.unionByName(rows)
    return first_by(every, [id], F.col("source_rank"), F.col("pos"))


def fallback(answers: DataFrame, id: str = "id") -> DataFrame:
    """Each id's answer from the first source that has one, late ones last."""
    good = answers.filter(F.col("value").isNotNull())
    return good.groupBy(id).agg(F.min_by("value", F.struct("late", "source_rank")).alias("value"))


def exported(playlist: DataFrame, refs: DataFrame, provider: str) -> DataFrame:
    """A playlist's tracks that the provider has, by its ids, in order."""
    return playlist.join(refs.filter(F.col("provider") == provider).select("id", "ref"), "id").select("pos", "id", "ref").orderBy("pos")


# --- aggregates --------------------------------------------------------------


def corpus_counts(tracks: DataFrame, features: DataFrame, failures: DataFrame, blocked: DataFrame, seen: DataFrame, version: str) -> DataFrame:
    """One row of counters, each asked the way its stage asks."""
    flag = lambda rows, name: rows.select(F.col("track_id").alias("id")).distinct().withColumn(name, F.lit(1))
    rows = tracks.select("id", "artist_id").join(flag(features.filter(F.col("extractor_version") == version), "done"), "id", "left")
    rows = rows.join(flag(failures, "failed"), "id", "left").join(flag(seen, "seen"), "id", "left")
    rows = rows.join(blocked.select("artist_id").distinct().withColumn("barred", F.lit(1)), "artist_id", "left")
    n = lambda c: F.count(F.when(c, 1))
    done, failed, free = F.col("done").isNotNull(), F.col("failed").isNotNull(), F.col("barred").isNull()
    return rows.agg(
        F.count(F.lit(1)).alias("tracks"), n(done).alias("analysed"), n(~done & free & ~failed).alias("to_analyse"),
        n(~done & failed).alias("failed"), n(done & F.col("seen").isNull()).alias("to_dedupe"), n(done & free).alias("buildable"),
    )


def family_likes(likes: DataFrame) -> DataFrame:
    """Each liked item once, with its last time and an item to show."""
    return likes.filter(F.col("item_json").isNotNull()).groupBy("kind", "ref_id").agg(F.max("item_json").alias("item_json"), F.max("liked_at").alias("liked_at"))


def liked_tracks(likes: DataFrame, tracks: DataFrame, users: DataFrame, since: int, salts: int = 8) -> DataFrame:
    """Tracks liked themselves or by their album, when, and by whom.

    Names of an album are gathered, sorted and joined once, not for each of its tracks;
    only a track that is liked itself too merges its own names into them. Tracks of an
    album are dealt over ``salts``. A track's further albums count as its own likes."""
    recent = likes.filter(F.col("liked_at") >= since).join(users.select("user_id", "name"), "user_id", "left")
    once = lambda rows, key: rows.groupBy(key, "name").agg(F.max("liked_at").alias("liked_at"))
    gather = lambda pairs, key: pairs.groupBy(key).agg(F.max("liked_at").alias("liked_at"), F.collect_set("name").alias("names"))
    joined = lambda names: F.array_join(F.sort_array(names), ", ")
    fans = once(recent.filter("kind = 'album'").withColumnRenamed("ref_id", "album_id"), "album_id")
    placed = tracks.select("id", "album_id").filter("album_id IS NOT NULL").distinct()
    main = placed.groupBy("id").agg(F.min("album_id").alias("album_id"))
    own = recent.filter("kind = 'track'").select(F.col("ref_id").cast(tracks.schema["id"].dataType).alias("id"), "name", "liked_at")
    own = own.unionByName(placed.join(main, ["id", "album_id"], "left_anti").join(fans, "album_id").select("id", "name", "liked_at"))
    own = gather(once(own, "id"), "id").select("id", F.col("liked_at").alias("own_at"), F.col("names").alias("own"))
    album = gather(fans, "album_id").select("*", joined(F.col("names")).alias("text"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    asked = main.join(own, "id", "full_outer").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    both = asked.join(album, ["album_id", "salt"], "left").filter("own_at IS NOT NULL OR liked_at IS NOT NULL")
    text = F.when(F.col("own").isNull(), F.col("text")).when(F.col("names").isNull(), joined(F.col("own"))).otherwise(joined(F.array_union("own", "names")))
    return both.select("id", F.greatest("own_at", "liked_at").alias("liked_at"), text.alias("names"))


def queue_sizes(queue: DataFrame) -> DataFrame:
    """A6."""
    return queue.groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


def first_free(ids: DataFrame, least: int = 1) -> DataFrame:
    """The next id that nothing has."""
    return ids.agg(F.greatest(F.coalesce(F.max("id"), F.lit(0)) + 1, F.lit(least)).alias("next_id"))


def numbered_artists(rows: DataFrame) -> DataFrame:
    """Artists numbered from 0 by their first row."""
    firsts = rows.groupBy("artist_id").agg(F.min("row_no").alias("first_row"))
    return numbered(firsts, [F.col("first_row")]).select("artist_id", F.col("number").cast("int").alias("number"))


def reach(visible: DataFrame) -> DataFrame:
    """How many albums and artists there are; nobody and nothing don't count."""
    return visible.agg(F.count_distinct(F.when(F.col("album_id") != "", F.col("album_id"))).alias("albums"), F.count_distinct(F.when(F.col("artist_id") != -1, F.col("artist_id"))).alias("artists"))


def upserted(base: DataFrame, news: DataFrame, key: str, always: list[str], least: list[str] = ()) -> DataFrame:
    """Rows by key. Columns in ``always`` take the newest row's value,
    those in ``least`` the smallest, all others the newest that isn't null.
    ``news`` has an order ``seq`` from 1."""
    every = base.withColumn("seq", F.lit(0).cast("bigint")).unionByName(news, allowMissingColumns=True)
    aggs = []
    for c in base.columns:
        if c == key:
            continue
        if c in least:
            aggs.append(F.min(c).alias(c))
        elif c in always:
            aggs.append(F.max_by(c, "seq").alias(c))
        else:
            aggs.append(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c))
    return every.groupBy(key).agg(*aggs).select(*base.columns)


def capabilities(providers: DataFrame) -> DataFrame:
    """What any provider can, and all kinds that they name."""
    return providers.agg(F.bool_or("can_search").alias("can_search"), F.array_sort(F.collect_set("kind")).alias("kinds"))


def step_stats(steps: DataFrame) -> DataFrame:
    """Crawl steps by how they ended."""
    n = lambda k: F.count(F.when(F.col("outcome") == k, 1)).alias(k)
    return steps.agg(n("expanded"), n("skipped"), n("failed"))


def listen_rollup(listens: DataFrame) -> DataFrame:
    """What a user heard of a track."""
    return listens.groupBy("user_id", "track_id").agg(F.count(F.lit(1)).alias("plays"), F.sum("listened_seconds").alias("seconds"))


# --- searches and orders -----------------------------------------------------


def search(rows: DataFrame, query: str, sort: str | None = None, descending: bool = False, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Rows of (row_no, title …) that hold all terms, those that begin
    with the query first; a field's order is stable on that; the total stands in each row."""
    hit = rows.filter(tx.has_all(F.col("title"), tx.terms(query)))
    ranked = hit.withColumn("rank", F.when(F.lower("title").startswith(query.lower()), 0).otherwise(1))
    total = ranked.agg(F.count(F.lit(1)).alias("total"))
    if sort is None:
        order = [F.col("rank").desc(), F.col("row_no").desc()] if descending else [F.col("rank"), F.col("row_no")]
    else:
        order = [F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last(), F.col("rank"), F.col("row_no")]
    return ranked.crossJoin(F.broadcast(total)).orderBy(*order).limit(limit)  # one row


def search_groups(rows: DataFrame, query: str) -> tuple[DataFrame, DataFrame]:
    """The albums and the artists of rows that hold each term somewhere:
    the first row's fields, ranked by whether a name begins with the query."""
    words, low = tx.terms(query), query.lower()
    hit = rows.filter(tx.any_has_each([F.col("artist"), F.col("title"), F.col("album")], words))
    begins = lambda c: F.lower(F.col(c)).startswith(low)
    artists = hit.filter("artist_id <> -1").groupBy("artist_id").agg(F.min_by("artist", "row_no").alias("artist"), F.min(F.when(begins("artist"), 0).otherwise(1)).alias("rank"), F.min("row_no").alias("row_no"))
    albums = hit.filter("album_id <> ''").groupBy("album_id").agg(F.min_by("album", "row_no").alias("album"), F.min(F.when(begins("artist") | begins("album"), 0).otherwise(1)).alias("rank"), F.min("row_no").alias("row_no"))
    return albums.orderBy("rank", "row_no"), artists.orderBy("rank", "row_no")


def sorted_rows(rows: DataFrame, field: str | None, descending: bool = False, number: str | None = None) -> DataFrame:
    """Missing values last both ways, text without case, ties in place. With
    ``number`` the rows get their place, from 0, and are left where they are."""
    if field is None:
        order = [Down(F.col("pos")) if descending else F.col("pos")]
    else:
        value = F.nullif(F.lower(field), F.lit("")) if dict(rows.dtypes)[field] == "string" else F.col(field)
        order = [Down(value) if descending else value, F.col("pos")]
    if number:
        return numbered(rows, order, name=number)
    return rows.orderBy(*[o.of(o.by) if isinstance(o, Down) else o.asc_nulls_last() for o in order])


def remembered(history: DataFrame, keep: int = 20) -> DataFrame:
    """The newest searches, each once whatever its case."""
    newest = first_by(history.withColumn("low", F.lower("query")), ["low"], F.col("at").desc())
    return newest.drop("low").orderBy(F.col("at").desc()).limit(keep)


def discography(albums: DataFrame) -> DataFrame:
    """Each album once, by provider and place, the newest first."""
    once = first_by(albums, ["id"], F.col("source_rank"), F.col("pos"))
    return once.orderBy(F.col("released").desc_nulls_last(), "source_rank", "pos")


def newest_likes(likes: DataFrame, user: int, kind: str, cap: int) -> DataFrame:
    """O3."""
    mine = likes.filter((F.col("user_id") == user) & (F.col("kind") == kind) & F.col("item_json").isNotNull())
    return mine.orderBy(F.col("liked_at").desc(), "ref_id").limit(cap)


def blocked_by_name(blocked: DataFrame) -> DataFrame:
    """O8."""
    return blocked.orderBy(F.lower("name"), "artist_id")
