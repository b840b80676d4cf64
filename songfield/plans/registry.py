"""Registered queries by name, and the SQL that checks them.

A query's name starts with its operator's number in the inventory. Those
without SQL walk greedily or lay out, and are tested against plain versions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songfield.functions import music as mu
from songfield.functions import text as tx
from songfield.functions import vectors as ve
from songfield.operators import build as bu
from songfield.operators import catalogue as ca
from songfield.operators import layout as la
from songfield.operators import mapview as mv
from songfield.operators import merging as me
from songfield.operators import navigate as na
from songfield.operators import numbering as nu
from songfield.operators import queueing as qu
from songfield.operators import similarity as si
from songfield.operators import verifying as ver
from songfield.plans.standins import SQL, Tables
from songfield.sources import library as lib
from songfield.sources.tables import shared_folder
from songfield.streaming import listens as li

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TODAY = "DATE '2024-01-31'"


def with_standins(sql: str) -> str:
    for head in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(head):
            return f"{head}{SQL}, {sql[len(head):]}"
    return f"WITH {SQL} {sql}"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_standins(sql.lstrip())
        return f

    return add


# --- vectors -------------------------------------------------------------------

BLOCKS = [("tempo", 0, 16), ("timbre", 16, 32), ("mood", 32, 48), ("semantic", 48, 64)]
FACTORS = [2.0] * 16 + [1.0] * 16 + [0.5] * 16 + [1.5] * 16
_W = "list_transform(range(64), lambda i: CASE WHEN i < 16 THEN 2.0 WHEN i < 32 THEN 1.0 WHEN i < 48 THEN 0.5 ELSE 1.5 END::DOUBLE)"
_MICRO = lambda x: f"floor({x} * 1e6 + 0.5)::BIGINT"


@query(
    "v2_weighted_neighbours",
    f"""WITH w AS (SELECT *, list_transform(list_zip(unit, {_W}), lambda p: p[1] * p[2]) AS s FROM space),
    u AS (SELECT *, list_transform(s, lambda x: x / greatest(sqrt(list_dot_product(s, s)), 1e-9)) AS v FROM w),
    q AS (SELECT v AS q, artist_id AS who, recording AS own FROM u WHERE id = 7),
    c AS (SELECT u.id, row_no, recording, {_MICRO("list_dot_product(v, q)")} AS micro FROM u, q WHERE recording <> own AND artist_id <> who),
    r AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY micro DESC, row_no) AS n FROM c)
    SELECT id, micro, row_no FROM r WHERE n = 1 ORDER BY micro DESC, row_no LIMIT 20""",
)
def _(t: Tables) -> DataFrame:
    factors = ve.scales(BLOCKS, {"tempo": 2.0, "timbre": 1.0, "mood": 0.5, "semantic": 1.5, "nothing": 9.0}, {})
    return si.neighbours(t.space().withColumn("unit", ve.unit(ve.weighted(F.col("unit"), factors))), 7, 20, other_artists=True)


@query(
    "v13_knn_self_join",
    f"""WITH p AS (SELECT a.id AS src, b.id AS dst, {_MICRO("list_dot_product(a.unit, b.unit)")} AS micro FROM space a JOIN space b ON a.id <> b.id),
    r AS (SELECT *, (row_number() OVER (PARTITION BY src ORDER BY micro DESC, dst))::INTEGER AS rank FROM p) SELECT src, dst, micro, rank FROM r WHERE rank <= 15""",
)
def _(t: Tables) -> DataFrame:
    return si.knn_self_join(t.space(), 15)


@query("v31_quantised", "SELECT id, list_transform(unit, lambda x: round(greatest(-1, least(1, x)) * 127)::TINYINT) AS q FROM space")
def _(t: Tables) -> DataFrame:
    return t.space().select("id", F.transform("unit", lambda x: ve.quantised(x.cast("double"))).alias("q"))


@query(
    "v18_text_baseline",
    f"""WITH s AS (SELECT p.id AS phrase, list_dot_product(a.unit, p.unit) AS s FROM space a JOIN space p ON p.id < 12)
    SELECT phrase, {_MICRO("avg(s)")} AS mean, {_MICRO("greatest(stddev_pop(s), 1e-6)")} AS spread FROM s GROUP BY phrase""",
)
def _(t: Tables) -> DataFrame:
    phrases = t.space().filter("id < 12").select(F.col("id").alias("phrase"), F.col("unit").alias("embedding"))
    return si.text_baseline(t.space(), phrases).select("phrase", ve.micro(F.col("mean")).alias("mean"), ve.micro(F.col("spread")).alias("spread"))


@query(
    "v19_describe",
    f"""WITH s AS (SELECT a.id, p.id AS phrase, list_dot_product(a.unit, p.unit) AS s FROM space a JOIN space p ON p.id < 40),
    b AS (SELECT phrase, avg(s) AS mean, greatest(stddev_pop(s), 1e-6) AS spread FROM s GROUP BY phrase)
    SELECT phrase, {_MICRO("(s - mean) / spread")} AS score FROM s JOIN b USING (phrase) WHERE id = 100 ORDER BY score DESC LIMIT 12""",
)
def _(t: Tables) -> DataFrame:
    phrases = t.space().filter("id < 40").select(F.col("id").alias("phrase"), F.col("unit").alias("embedding"))
    return si.describe(t.space(), 100, phrases, si.text_baseline(t.space(), phrases)).select("phrase", ve.micro(F.col("score")).alias("score"))


_COL = lambda i, f: f"{f}(unit[{i}])"


@query(
    "v20_normalised",
    f"""WITH m AS (SELECT {", ".join(f"avg(unit[{i}]) AS m{i}, stddev_pop(unit[{i}]) AS s{i}" for i in range(1, 65))} FROM space),
    z AS (SELECT id, [{", ".join(f"(unit[{i}] - m{i}) / CASE WHEN s{i} < 1e-9 THEN 1 ELSE s{i} END" for i in range(1, 65))}] AS z FROM space, m)
    SELECT id, list_transform(z, lambda x: round(x / greatest(sqrt(list_dot_product(z, z)), 1e-9), 5)) AS z FROM z""",
)
def _(t: Tables) -> DataFrame:
    rows, _ = bu.normalised(t.space().select("id", F.col("unit").alias("block")), "block", 64)
    # What rounds to zero keeps its sign, as in SQL; Spark's round drops it.
    return rows.select("id", F.transform("block", lambda x: F.abs(F.round(x, 5)) * F.signum(x)).alias("z"))


@query(
    "v30_phrase_rows",
    f"""WITH s AS (SELECT id // 20 AS track_id, id % 20 AS pos, id * 1.5::DOUBLE AS start, CASE WHEN id % 13 = 0 THEN unit[1:60] ELSE unit END AS v FROM space WHERE id // 20 % 4 <> 1),
    p AS (SELECT track_id, pos, start, list_transform(range(8), lambda k: ((v[8 * k + 1] - 0.01 * k) - (v[8 * k + 2] - 0.01 * k) / 2 - k / 100) / (0.5 + k)) AS z FROM s WHERE len(v) = 64),
    q AS (SELECT track_id, pos, start, list_transform(z, lambda x: round(greatest(-1.0, least(1.0, x / greatest(sqrt(list_dot_product(z, z)), 1e-9))) * 127)::INTEGER) AS row FROM p),
    g AS (SELECT track_id, count(*) AS count, list(start ORDER BY pos)::DOUBLE[] AS starts, flatten(list(row ORDER BY pos)) AS rows FROM q GROUP BY track_id)
    SELECT row_number() OVER (ORDER BY track_id) - 1 AS number, track_id, (sum(count) OVER (ORDER BY track_id) - count)::BIGINT AS first, count, starts, rows FROM g""",
)
def _(t: Tables) -> DataFrame:
    id = F.col("id")
    cut = F.when(id % 13 == 0, F.slice("unit", 1, 60)).otherwise(F.col("unit"))
    segments = t.space().select(F.floor(id / 20).alias("track_id"), (id % 20).alias("pos"), (id * 1.5).alias("start"), cut.alias("embedding"))
    axes = np.zeros((8, 64))
    for k in range(8):
        axes[k, 8 * k], axes[k, 8 * k + 1] = 1.0, -0.5
    found = bu.phrase_rows(segments, segments.filter("track_id % 4 <> 1").select(F.col("track_id").alias("id")), np.repeat(np.arange(8) / 100, 8), axes, [(k / 100, 0.5 + k) for k in range(8)])
    return found.withColumns({"starts": F.col("starts").cast("array<double>"), "rows": F.col("rows").cast("array<int>")})


@query(
    "v24_imputed_medians",
    "WITH m AS (SELECT median(value) AS middle FROM events WHERE event_type <> 'view') SELECT event_id, CASE WHEN event_type = 'view' THEN middle ELSE value END AS value FROM events, m",
)
def _(t: Tables) -> DataFrame:
    return bu.imputed(t.events.select("event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("value")), ["value"])


@query("v25_languages", "SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= 20 ORDER BY count(*) DESC, lang LIMIT 24")
def _(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(x,) for x in bu.language_columns(t.documents, "lang")], "lang string")


@query(
    "v22_pca_variance",
    f"SELECT {_MICRO('sum(v) * 0.001')} AS total FROM (SELECT var_pop(unit[i]) * count(*) AS v FROM space, range(1, 65) r(i) GROUP BY i)",
)
def _(t: Tables) -> DataFrame:
    mean, axes = bu.fit_pca(t.space(), "unit", 64)
    flat = t.space().select(bu.projected(F.col("unit"), mean, axes).alias("p"))
    return flat.agg(ve.micro(F.sum(F.aggregate("p", F.lit(0.0), lambda a, x: a + x * x)) * 0.001).alias("total"))


@query("v28_build_space")
def _(t: Tables) -> DataFrame:
    rows = t.space().select("id", "artist_id", F.slice("unit", 1, 8).alias("timbre"), F.slice("unit", 9, 8).alias("mood"))
    rows = rows.withColumn("language", bu.one_hot(F.col("artist_id").cast("string"), ["1", "2"]))
    return bu.build(rows, {"timbre": 8, "mood": 8, "language": 2})[0].select("id", "raw")


@query(
    "v43_evaluate",
    f"""WITH p AS (SELECT a.id, a.album_id = b.album_id AS same, row_number() OVER (PARTITION BY a.id ORDER BY {_MICRO("list_dot_product(a.unit, b.unit)")} DESC, b.id) AS rank FROM space a JOIN space b ON a.id <> b.id),
    r AS (SELECT id, coalesce(min(rank) FILTER (same), (SELECT count(*) FROM space)) AS rank FROM p GROUP BY id)
    SELECT count(*) AS "rows", avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END) AS top1, list_sort(list(rank))[count(*) // 2 + 1]::BIGINT AS upper_median, avg(rank) AS mean FROM r""",
)
def _(t: Tables) -> DataFrame:
    return si.evaluate(t.space().withColumn("album", F.col("album_id"))).withColumn("upper_median", F.col("upper_median").cast("bigint"))


# --- duplicates ----------------------------------------------------------------

_PAIRS = f"""n AS (SELECT id, (id % 60) * 2 AS seconds, CASE WHEN id % 3 > 0 THEN 'c' || id % 3 END AS isrc, unit, id % 4 = 0 AS new FROM space),
    p AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.unit, b.unit) AS s FROM n a JOIN n b ON (b.seconds > a.seconds OR b.seconds = a.seconds AND b.id > a.id) AND b.seconds - a.seconds <= 2
      AND (a.new OR b.new) AND list_dot_product(a.unit, b.unit) >= CASE WHEN a.isrc IS NOT NULL AND b.isrc IS NOT NULL AND a.isrc <> b.isrc THEN 0.25 ELSE 0.15 END)"""


def _pairs(t: Tables) -> DataFrame:
    rows = t.space().select("id", ((F.col("id") % 60) * 2).alias("seconds"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("c"), F.col("id") % 3)).alias("isrc"), "unit", (F.col("id") % 4 == 0).alias("new"))
    return si.duplicate_pairs(rows, 0.15, 0.25)


@query("j12_duplicate_pairs", f"WITH {_PAIRS} SELECT a, b, {_MICRO('s')} AS similarity FROM p")
def _(t: Tables) -> DataFrame:
    return _pairs(t).select("a", "b", ve.micro(F.col("similarity")).alias("similarity"))


@query("v40_star_groups")
def _(t: Tables) -> DataFrame:
    return si.star_groups(_pairs(t), t.space().select("id", (F.col("id") % 5).alias("place")))


@query(
    "v38_recordings",
    """WITH RECURSIVE n AS (SELECT doc_id AS id, lang AS artist_key, CASE WHEN doc_id % 4 = 0 THEN 'C' || doc_id // 200 END AS isrc_key, trim(lower(regexp_extract(text, '^[A-Za-z]+'))) AS song FROM documents),
    k AS (SELECT id, 'i' || isrc_key || song AS k FROM n WHERE song <> '' AND isrc_key IS NOT NULL UNION ALL SELECT id, 's' || artist_key || ':' || song FROM n WHERE song <> ''),
    f AS (SELECT k, min(id) AS m FROM k GROUP BY k), e AS (SELECT DISTINCT id AS a, m AS b FROM k JOIN f USING (k) WHERE id <> m),
    g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a)
    SELECT n.id, coalesce(least(n.id, min(r.b)), n.id) AS recording FROM n LEFT JOIN r ON r.a = n.id GROUP BY n.id""",
)
def _(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("artist_key"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("C"), F.floor(F.col("doc_id") / 200))).alias("isrc_key"), F.lower(F.regexp_extract("text", "^[A-Za-z]+", 0)).alias("song"))
    return si.recordings(rows)


@query("v39_first_of_each", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY row_no) AS n FROM space) SELECT id, recording FROM r WHERE n = 1")
def _(t: Tables) -> DataFrame:
    return si.first_of_each(t.space(), "row_no").select("id", "recording")


_MERGES = "m AS (SELECT i AS from_id, i - 10 AS into_id FROM range(10, 30) r(i) WHERE i % 3 = 0)"


def _merges(t: Tables) -> DataFrame:
    return t.spark.range(10, 30).filter("id % 3 = 0").select(F.col("id").alias("from_id"), (F.col("id") - 10).alias("into_id"))


# Chains: an even id is merged into its half, so all end at an odd one; 700 and 701 go round.
_CHAINS = "m AS (SELECT i AS from_id, CASE WHEN i = 701 THEN 700 ELSE i // 2 END AS into_id FROM range(2, 60000) r(i) WHERE (i % 2 = 0 AND i <> 700) OR i = 701 UNION ALL SELECT 700, 701)"
_ENDS = f"""{_CHAINS},
    w AS (SELECT from_id, into_id AS x FROM m WHERE from_id NOT IN (700, 701) UNION ALL SELECT w.from_id, m.into_id FROM w JOIN m ON m.from_id = w.x WHERE w.x NOT IN (700, 701)),
    ends AS (SELECT from_id, x AS into_id FROM w WHERE x IN (700, 701) OR x NOT IN (SELECT from_id FROM m) UNION ALL SELECT 701, 700),
    e AS (SELECT from_id, CASE WHEN into_id = 701 THEN 700 ELSE into_id END AS into_id FROM ends)"""


def _chains(t: Tables) -> DataFrame:
    id = F.col("id")
    rows = t.spark.range(2, 60000).filter((id % 2 == 0) & (id != 700) | (id == 701))
    rows = rows.select(id.alias("from_id"), F.when(id == 701, 700).otherwise(F.floor(id / 2)).cast("bigint").alias("into_id"))
    return rows.unionByName(t.spark.range(700, 701).select(id.alias("from_id"), F.lit(701).cast("bigint").alias("into_id")))


@query("v41_resolved", f"WITH RECURSIVE {_ENDS} SELECT from_id, into_id FROM e")
def _(t: Tables) -> DataFrame:
    return me.resolved(_chains(t))


@query(
    "v41_refs",
    f"""WITH RECURSIVE {_ENDS}, r AS (SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'album' ELSE 'track' END AS kind, l_partkey::VARCHAR AS id, 'p' || l_linenumber AS provider, l_orderkey || '-' || l_linenumber AS ref FROM lineitem)
    SELECT kind, CASE WHEN kind = 'track' THEN coalesce(into_id::VARCHAR, id) ELSE id END AS id, provider, ref FROM r LEFT JOIN e ON e.from_id::VARCHAR = r.id""",
)
def _(t: Tables) -> DataFrame:
    refs = t.lineitem.select(F.when(F.col("l_linenumber") % 3 == 0, "album").otherwise("track").alias("kind"), F.col("l_partkey").cast("string").alias("id"), F.concat(F.lit("p"), F.col("l_linenumber")).alias("provider"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("ref"))
    return me.merged_refs(refs, me.resolved(_chains(t)))


@query(
    "v41_merged_likes",
    f"""WITH RECURSIVE {_ENDS}, x AS (SELECT user_id, kind, CASE WHEN kind = 'track' THEN coalesce(into_id, ref_id) ELSE ref_id END AS ref_id, liked_at, kind = 'track' AND into_id IS NOT NULL AS moved FROM likes LEFT JOIN e ON from_id = ref_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind, ref_id ORDER BY moved, liked_at) AS n FROM x) SELECT user_id, kind, ref_id, liked_at FROM r WHERE n = 1""",
)
def _(t: Tables) -> DataFrame:
    # Of likes of the track itself there may be several here; the earliest counts.
    return me.merged_likes(t.likes().select("user_id", "kind", "ref_id", "liked_at"), me.resolved(_chains(t)))


@query("v41_listens", f"WITH RECURSIVE {_ENDS} SELECT event_id, coalesce(into_id, user_id) AS track_id FROM events LEFT JOIN e ON from_id = user_id")
def _(t: Tables) -> DataFrame:
    return me.merged_listens(t.events.select("event_id", F.col("user_id").cast("bigint").alias("track_id")), me.resolved(_chains(t)))


@query(
    "v41_queue",
    f"""WITH RECURSIVE {_ENDS}, x AS (SELECT coalesce(into_id, track_id) AS track_id, priority, reason, seq, CASE WHEN into_id IS NULL THEN -1 ELSE track_id END AS o FROM queue LEFT JOIN e ON from_id = track_id)
    SELECT track_id, arg_min(priority, {{'p': priority, 'o': o}}) AS priority, arg_min(reason, {{'p': priority, 'o': o}}) AS reason, arg_min(seq, o) AS seq FROM x GROUP BY track_id""",
)
def _(t: Tables) -> DataFrame:
    return me.merged_queue(t.queue(), me.resolved(_chains(t)))


_ENTRY = """'{"n":' || p_size || ',"origin":{"item":{"id":"' || p_partkey || '"}}}'"""


@query(
    "v41_mix",
    f"""WITH RECURSIVE {_ENDS}, x AS (SELECT coalesce(into_id, p_partkey) AS track_id, p_brand AS version, {_ENTRY.replace("' || p_partkey || '", "' || coalesce(into_id, p_partkey) || '")} AS entry_json, CASE WHEN into_id IS NULL THEN -1 ELSE p_partkey END AS o
    FROM part LEFT JOIN e ON from_id = p_partkey WHERE p_partkey % 5 <> 1), r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY o) AS n FROM x) SELECT track_id, version, entry_json FROM r WHERE n = 1""",
)
def _(t: Tables) -> DataFrame:
    entry = F.concat(F.lit('{"n":'), F.col("p_size"), F.lit(',"origin":{"item":{"id":"'), F.col("p_partkey"), F.lit('"}}}'))
    mix = t.part.filter("p_partkey % 5 <> 1").select(F.col("p_partkey").alias("track_id"), F.col("p_brand").alias("version"), entry.alias("entry_json"))
    return me.merged_mix(mix, me.resolved(_chains(t)))


@query(
    "v41_tracks",
    f"""WITH RECURSIVE {_ENDS}, p AS (SELECT p_partkey AS id, (p_partkey * 7) % 11 AS seed_distance, CASE WHEN p_size % 4 = 0 THEN p_type END AS isrc FROM part),
    g AS (SELECT into_id, min(seed_distance) AS near, arg_min(isrc, id) FILTER (isrc IS NOT NULL) AS isrc FROM p JOIN e ON from_id = id GROUP BY into_id)
    SELECT id, least(seed_distance, near) AS seed_distance, coalesce(p.isrc, g.isrc) AS isrc FROM p LEFT JOIN g ON into_id = id WHERE id NOT IN (SELECT from_id FROM e)""",
)
def _(t: Tables) -> DataFrame:
    tracks = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7 % 11).alias("seed_distance"), F.when(F.col("p_size") % 4 == 0, F.col("p_type")).alias("isrc"))
    return me.merged_tracks(tracks, me.resolved(_chains(t)))


@query("j11_redirected", f"WITH {_MERGES} SELECT coalesce(into_id, ref_id) AS ref_id, count(*) AS n FROM likes LEFT JOIN m ON from_id = ref_id GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return ca.redirected(t.likes(), _merges(t), "ref_id").groupBy("ref_id").agg(F.count(F.lit(1)).alias("n"))


@query("v42_compared", "SELECT track_id FROM failures UNION SELECT id FROM tracks WHERE id % 2 = 0")
def _(t: Tables) -> DataFrame:
    return si.compared(t.failures(), t.tracks().filter("id % 2 = 0"))


# --- catalogue -----------------------------------------------------------------


@query(
    "s1_scan",
    """WITH ids AS (SELECT p_partkey AS row_no, p_partkey * 2 AS id FROM part) SELECT ids.row_no, ids.id, coalesce(t.title, '<missing ' || ids.id || '>') AS title, coalesce(t.artist_id, -1) AS artist_id,
    coalesce(a.name, '') AS artist, coalesce(b.title, '') AS album FROM ids LEFT JOIN tracks t ON t.id = ids.id LEFT JOIN artists a ON a.id = t.artist_id LEFT JOIN albums b ON b.id = t.album_id""",
)
def _(t: Tables) -> DataFrame:
    ids = t.part.select(F.col("p_partkey").alias("row_no"), (F.col("p_partkey") * 2).alias("id"))
    return ca.scan(ids, t.tracks(), t.artists(), t.albums()).select("row_no", "id", "title", "artist_id", "artist", "album")


@query("s2_embeddings", "WITH i AS (SELECT o_orderkey AS id FROM orders) SELECT i.id, list_sum(list_transform(coalesce(unit, list_transform(range(64), lambda x: 0.0::DOUBLE)), lambda x: abs(x))) = 0 AS empty FROM i LEFT JOIN space USING (id)")
def _(t: Tables) -> DataFrame:
    vectors = t.space().select(F.col("id").alias("track_id"), "clap")
    return ca.embeddings_for(t.orders.select(F.col("o_orderkey").alias("id")), vectors, 64).select("id", (~F.exists("clap", lambda x: x != 0)).alias("empty"))


@query("s3_buildable", "SELECT t.id, b.release_date FROM tracks t JOIN features f ON f.track_id = t.id LEFT JOIN albums b ON b.id = t.album_id WHERE t.artist_id IS NULL OR t.artist_id NOT IN (SELECT artist_id FROM blocked)")
def _(t: Tables) -> DataFrame:
    features = t.features().select("track_id", F.array(F.lit(1.0)).alias("clap"), F.lit("{}").alias("descriptors_json"))
    return ca.buildable(t.tracks(), features, t.albums(), t.blocked(), 1).select("id", "release_date")


@query("s15_gathered", "WITH u AS (SELECT id, 0 AS r, id AS pos, title FROM tracks WHERE id % 2 = 0 UNION ALL SELECT id, 1, -id, upper(title) FROM tracks WHERE id % 3 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r, pos) AS n FROM u) SELECT id, title FROM n WHERE n = 1")
def _(t: Tables) -> DataFrame:
    one = t.tracks().filter("id % 2 = 0").select("id", "title", F.col("id").alias("pos"))
    two = t.tracks().filter("id % 3 = 0").select("id", F.upper("title").alias("title"), (-F.col("id")).alias("pos"))
    return ca.gathered([one, two]).select("id", "title")


@query("s16_fallback", "SELECT l_partkey AS id, arg_min((l_shipdate::VARCHAR)[1:10], (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::VARCHAR || l_linenumber || (l_shipdate::VARCHAR)[1:10]) AS value FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_partkey")
def _(t: Tables) -> DataFrame:
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    answers = t.lineitem.select(F.col("l_partkey").alias("id"), F.when(F.col("l_returnflag") != "N", day).alias("value"), (F.col("l_returnflag") == "R").alias("late"), F.concat(F.col("l_linenumber").cast("string"), day).alias("source_rank"))
    return ca.fallback(answers)


@query("s20_exported", "SELECT seq AS pos, track_id AS id, reason AS ref FROM queue WHERE priority = 2")
def _(t: Tables) -> DataFrame:
    refs = t.queue().select(F.col("track_id").alias("id"), F.col("priority").cast("string").alias("provider"), F.col("reason").alias("ref"))
    return ca.exported(t.queue().select(F.col("seq").alias("pos"), F.col("track_id").alias("id")), refs, "2")


@query("s23_upserted", "SELECT t.id, coalesce(upper(n.title), t.title) AS title, coalesce(CASE WHEN t.id % 10 = 0 THEN NULL ELSE n.duration + 1 END, t.duration) AS duration, least(t.seed_distance, 2) AS seed_distance FROM tracks t LEFT JOIN tracks n ON n.id = t.id AND t.id % 2 = 0 WHERE t.id % 2 = 0 UNION ALL SELECT id, title, duration, seed_distance FROM tracks WHERE id % 2 = 1")
def _(t: Tables) -> DataFrame:
    base = t.tracks().select("id", "title", "duration", "seed_distance")
    news = base.filter("id % 2 = 0").select("id", F.upper("title").alias("title"), F.when(F.col("id") % 10 != 0, F.col("duration") + 1).alias("duration"), F.lit(2).cast("bigint").alias("seed_distance"), F.lit(1).cast("bigint").alias("seq"))
    return ca.upserted(base, news, "id", ["title"], ["seed_distance"])


_FREE = "(artist_id IS NULL OR artist_id NOT IN (SELECT artist_id FROM blocked))"


@query("p1_not_blocked", f"SELECT id, artist_id FROM tracks WHERE {_FREE}")
def _(t: Tables) -> DataFrame:
    return ca.not_blocked(t.tracks(), t.blocked()).select("id", "artist_id")


@query("p4_other_artists", "SELECT id FROM tracks WHERE artist_id IS DISTINCT FROM 5")
def _(t: Tables) -> DataFrame:
    return ca.without_artist_of(t.tracks(), F.lit(5).cast("bigint")).select("id")


@query("p6_stale", "SELECT id FROM tracks WHERE id NOT IN (SELECT track_id FROM features WHERE extractor_version = 'F')")
def _(t: Tables) -> DataFrame:
    return ca.stale(t.tracks(), t.features(), "F").select("id")


@query("p7_pending_analysis", f"SELECT id, seed_distance FROM tracks WHERE id NOT IN (SELECT track_id FROM features WHERE extractor_version = 'F') AND {_FREE} AND id NOT IN (SELECT track_id FROM failures) ORDER BY seed_distance, id LIMIT 100")
def _(t: Tables) -> DataFrame:
    return ca.pending_analysis(t.tracks(), t.features(), t.blocked(), t.failures(), "F", limit=100).select("id", "seed_distance")


@query("p8_pending_mix", "SELECT seq AS row_no, track_id AS id FROM queue WHERE track_id NOT IN (SELECT track_id FROM features WHERE extractor_version = 'O') AND track_id NOT IN (SELECT track_id FROM failures)")
def _(t: Tables) -> DataFrame:
    asked = t.queue().select(F.col("seq").alias("row_no"), F.col("track_id").alias("id"))
    return ca.pending_mix(asked, t.features().select("track_id", F.col("extractor_version").alias("version"), F.lit(True).alias("drops")), t.failures(), "O")


@query("p9_pending_lyrics", "SELECT id, seed_distance FROM tracks t LEFT JOIN (SELECT DISTINCT l_partkey, CASE WHEN l_partkey % 2 = 0 THEN 'none' ELSE 'lyrics' END AS s, DATE '2024-01-01' - (l_partkey % 200)::INTEGER AS d FROM lineitem) y ON y.l_partkey = t.id WHERE s IS NULL OR s = 'none' AND d < DATE '2024-01-31' - 90")
def _(t: Tables) -> DataFrame:
    known = t.lineitem.select(F.col("l_partkey").alias("track_id")).distinct().select("track_id", F.when(F.col("track_id") % 2 == 0, "none").otherwise("lyrics").alias("status"), F.date_sub(F.lit("2024-01-01").cast("date"), (F.col("track_id") % 200).cast("int")).alias("checked_at"))
    return ca.pending_lyrics(t.tracks(), known, t.failures().select(F.col("track_id").alias("id")), F.expr(TODAY)).select("id", "seed_distance")


@query("p12_pruned_results", "SELECT id FROM cat WHERE contains(lower(title), '1') AND contains(lower(title), '2') OR NOT ((contains(lower(title), '1') OR contains(lower(artist), '1') OR contains(lower(album), '1')) AND (contains(lower(title), '2') OR contains(lower(artist), '2') OR contains(lower(album), '2')))")
def _(t: Tables) -> DataFrame:
    return ca.pruned_results(t.rows(), "1 2").select("id")


@query("p14_catalogue_only", "SELECT id FROM tracks WHERE id NOT IN (SELECT id FROM space)")
def _(t: Tables) -> DataFrame:
    return ca.catalogue_only(t.tracks(), t.space()).select("id")


@query("p15_liked_only", "SELECT id FROM tracks WHERE id IN (SELECT ref_id FROM likes WHERE kind = 'track')")
def _(t: Tables) -> DataFrame:
    return ca.liked_only(t.tracks(), t.likes(), "track").select("id")


@query("p16_of_genres", "SELECT id, genre FROM cat WHERE contains(lower(genre), 'econ') OR contains(lower(genre), 'steel') OR contains(lower(genre), 'd') ORDER BY row_no LIMIT 300")
def _(t: Tables) -> DataFrame:
    return ca.of_genres(t.rows(), ["Econ", "Steel", "D"], 300).select("id", "genre")


@query("p17_of_artist_name", "SELECT id FROM cat WHERE regexp_replace(lower(artist), '[^\\p{L}\\p{N}]+', '', 'g') = (SELECT regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', '', 'g') FROM artists WHERE id = 3)")
def _(t: Tables) -> DataFrame:
    name = t.artists().filter("id = 3").first()
    return ca.of_artist_name(t.rows(), f" {name['name'].upper()}! " if name else "").select("id")


@query("p18_known_albums", "SELECT id FROM albums WHERE id IN (SELECT album_id FROM tracks WHERE id IN (SELECT track_id FROM features UNION SELECT track_id FROM failures))")
def _(t: Tables) -> DataFrame:
    return ca.known_albums(t.albums(), t.tracks(), t.features(), t.failures()).select("id")


@query("p19_released_within", f"SELECT id, release_date FROM albums WHERE release_date::DATE BETWEEN {TODAY} - 29 AND {TODAY}")
def _(t: Tables) -> DataFrame:
    return ca.released_within(t.albums(), F.expr(TODAY), 29).select("id", "release_date")


@query("p20_own_releases", "SELECT id FROM albums WHERE artist_id IS NULL OR artist_id = 1")
def _(t: Tables) -> DataFrame:
    return ca.own_releases(t.albums(), 1).select("id")


@query("p21_find_artists", "SELECT a.id, name, count(t.id) AS n_tracks FROM artists a LEFT JOIN tracks t ON t.artist_id = a.id WHERE name ILIKE '%IER#%' GROUP BY a.id, name ORDER BY n_tracks DESC, name, a.id LIMIT 25")
def _(t: Tables) -> DataFrame:
    return ca.find_artists(t.artists(), t.tracks(), "IER#")


@query("p10_search", "WITH h AS (SELECT *, CASE WHEN starts_with(lower(title), 're in') THEN 0 ELSE 1 END AS rank FROM cat WHERE contains(lower(title), 're') AND contains(lower(title), 'in')) SELECT id, rank, (SELECT count(*) FROM h) AS total FROM h ORDER BY duration DESC, rank, row_no LIMIT 50")
def _(t: Tables) -> DataFrame:
    return ca.search(t.rows(), "re IN", "duration", True, 50).select("id", F.when(F.lower("title").startswith("re in"), 0).otherwise(1).alias("rank"), "total")


@query("p11_search_albums", "WITH h AS (SELECT * FROM cat WHERE contains(lower(artist), '1') OR contains(lower(title), '1') OR contains(lower(album), '1')) SELECT album_id, arg_min(album, row_no) AS album, min(CASE WHEN starts_with(lower(artist), '1') OR starts_with(lower(album), '1') THEN 0 ELSE 1 END) AS rank, min(row_no) AS row_no FROM h WHERE album_id <> '' GROUP BY album_id")
def _(t: Tables) -> DataFrame:
    return ca.search_groups(t.rows(), "1")[0]


@query("p11_search_artists", "WITH h AS (SELECT * FROM cat WHERE contains(lower(artist), 's') OR contains(lower(title), 's') OR contains(lower(album), 's')) SELECT artist_id, arg_min(artist, row_no) AS artist, min(CASE WHEN starts_with(lower(artist), 's') THEN 0 ELSE 1 END) AS rank, min(row_no) AS row_no FROM h WHERE artist_id <> -1 GROUP BY artist_id")
def _(t: Tables) -> DataFrame:
    return ca.search_groups(t.rows(), "s")[1]


@query(
    "j7_liked_tracks",
    """WITH k AS (SELECT o_custkey AS user_id, CASE WHEN o_orderkey % 2 = 0 THEN 'track' ELSE 'album' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 900)::VARCHAR ELSE 'Brand#' || o_orderkey % 40 END AS ref_id, epoch(o_orderdate)::BIGINT AS liked_at FROM orders),
    u AS (SELECT ref_id::BIGINT AS id, user_id, liked_at FROM k WHERE kind = 'track' AND liked_at >= 900000000 UNION ALL SELECT t.id, user_id, liked_at FROM k JOIN tracks t ON t.album_id = ref_id WHERE kind = 'album' AND liked_at >= 900000000)
    SELECT id, max(liked_at) AS liked_at, array_to_string(list_sort(list(DISTINCT c_name)), ', ') AS names FROM u LEFT JOIN customer ON c_custkey = user_id GROUP BY id""",
)
def _(t: Tables) -> DataFrame:
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    even, key = F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")
    likes = t.orders.select(F.col("o_custkey").alias("user_id"), F.when(even, "track").otherwise("album").alias("kind"), F.when(even, (key % 900).cast("string")).otherwise(F.concat(F.lit("Brand#"), key % 40)).alias("ref_id"), F.unix_timestamp("o_orderdate").alias("liked_at"))
    return ca.liked_tracks(likes, t.tracks(), users, 900000000)


@query(
    "j14_lyric_matches",
    """WITH d AS (SELECT doc_id AS dump_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 7 = 0 THEN '  ' WHEN doc_id % 11 <> 0 THEN text END AS words, 'n' || doc_id % 50 || CASE WHEN doc_id % 4 = 0 THEN ' live' ELSE '' END AS name, 'a' || doc_id % 3 AS artist, CASE WHEN doc_id % 6 <> 0 THEN 'b' || doc_id % 7 END AS album, (doc_id % 40)::DOUBLE AS s, CASE WHEN doc_id % 9 <> 0 THEN doc_id % 5 = 0 END AS instrumental FROM documents),
    t AS (SELECT id, 'n' || id % 50 AS bare, CASE WHEN id % 2 = 0 THEN ' live' ELSE '' END AS version, 'a' || id % 3 AS artist, CASE WHEN id % 8 <> 0 THEN 'b' || id % 7 END AS album, CASE WHEN id % 5 <> 0 THEN duration % 40 END AS s FROM tracks),
    v AS (SELECT *, 0 AS turn, bare || version AS name FROM t UNION ALL SELECT *, 1, bare FROM t WHERE version <> ''),
    m AS (SELECT v.id, turn, d.dump_id, words, instrumental, row_number() OVER (PARTITION BY v.id, turn ORDER BY (d.album = coalesce(v.album, '')) DESC NULLS LAST, (coalesce(words, '') <> '' OR coalesce(instrumental, false)) DESC, d.dump_id) AS n
          FROM v JOIN d ON d.name = v.name AND d.artist = v.artist AND (v.s IS NULL OR d.s BETWEEN v.s - 2 AND v.s + 2)),
    f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn) AS k FROM m WHERE n = 1 AND (coalesce(instrumental, false) OR trim(coalesce(words, '')) <> ''))
    SELECT id, dump_id FROM f WHERE k = 1""",
)
def _(t: Tables) -> DataFrame:
    named = lambda c, s, n: F.concat(F.lit(s), F.col(c) % n)
    doc, id = F.col("doc_id"), F.col("id")
    words = F.when(doc % 3 == 0, "").when(doc % 7 == 0, "  ").when(doc % 11 != 0, F.col("text"))
    dump = t.documents.select(
        doc.alias("dump_id"), words.alias("plain_lyrics"), F.concat(named("doc_id", "n", 50), F.when(doc % 4 == 0, " live").otherwise("")).alias("name_lower"), named("doc_id", "a", 3).alias("artist_name_lower"),
        F.when(doc % 6 != 0, named("doc_id", "b", 7)).alias("album_name_lower"), (doc % 40).cast("double").alias("dump_duration"), F.when(doc % 9 != 0, doc % 5 == 0).alias("instrumental"),
    )
    tracks = t.tracks().select("id", F.concat(named("id", "N", 50), F.when(id % 2 == 0, " (Live)").otherwise("")).alias("title"), named("id", "A", 3).alias("artist"), F.when(id % 8 != 0, named("id", "B", 7)).alias("album"), F.when(id % 5 != 0, F.col("duration") % 40).alias("duration"))
    return ca.lyric_matches(tracks, dump).select("id", "dump_id")


_KINDS = "['track', 'album', 'playlist', 'artist'][id % 4 + 1]"


@query(
    "j15_same_as",
    f"""WITH x AS (SELECT id, {_KINDS} AS kind, CASE WHEN id % 3 <> 0 THEN 'c' || id % 120 END AS isrc, CASE WHEN id % 5 = 0 THEN ' | ' WHEN id % 7 <> 0 THEN 'k' || id % 90 || '|' || id % 2 END AS key FROM tracks),
    r AS (SELECT kind, id AS known, 'p' || id % 3 AS provider, upper(isrc) AS isrc, key FROM x WHERE id % 16 < 8),
    i AS (SELECT kind, 'x' || id AS ref, 'p' || id % 5 AS provider, upper(trim(CASE WHEN id % 11 = 0 THEN ' ' ELSE ' ' || isrc || ' ' END)) AS isrc, key FROM x WHERE id % 16 >= 4 AND kind <> 'playlist'),
    b AS (SELECT i.provider, i.kind, i.ref, r.known, 0 AS turn FROM i JOIN r ON r.kind = i.kind AND r.isrc = i.isrc AND i.isrc <> '' AND r.provider <> i.provider
          UNION ALL SELECT i.provider, i.kind, i.ref, r.known, 1 FROM i JOIN r ON i.kind <> 'track' AND r.kind = i.kind AND r.key = i.key AND trim(replace(i.key, '|', '')) <> '' AND r.provider <> i.provider),
    m AS (SELECT *, row_number() OVER (PARTITION BY provider, kind, ref ORDER BY turn, known) AS n FROM b WHERE NOT EXISTS (SELECT 1 FROM r s WHERE s.kind = b.kind AND s.provider = b.provider AND s.known = b.known))
    SELECT provider, kind, ref, known FROM m WHERE n = 1""",
)
def _(t: Tables) -> DataFrame:
    id = F.col("id")
    key = F.when(id % 5 == 0, " | ").when(id % 7 != 0, F.concat_ws("|", F.concat(F.lit("k"), id % 90), id % 2))
    kind = F.get(F.array(*map(F.lit, ("track", "album", "playlist", "artist"))), (id % 4).cast("int"))
    base = t.tracks().select(kind.alias("kind"), "id", F.when(id % 3 != 0, F.concat(F.lit("c"), id % 120)).alias("isrc"), key.alias("match_key"))
    refs = base.filter("id % 16 < 8").withColumns({"provider": F.concat(F.lit("p"), id % 3), "isrc": F.upper("isrc")})
    written = F.when(id % 11 == 0, " ").otherwise(F.concat(F.lit(" "), "isrc", F.lit(" ")))
    items = base.filter("id % 16 >= 4").withColumns({"ref": F.concat(F.lit("x"), id), "provider": F.concat(F.lit("p"), id % 5), "isrc": written}).drop("id")
    return ca.same_as(items, refs)


# --- aggregates, queues, orders --------------------------------------------------


@query(
    "a1_corpus_counts",
    f"""WITH x AS (SELECT t.*, id IN (SELECT track_id FROM features WHERE extractor_version = 'F') AS done, id IN (SELECT track_id FROM failures) AS failed, {_FREE} AS free FROM tracks t)
    SELECT count(*) AS tracks, count(*) FILTER (done) AS analysed, count(*) FILTER (NOT done AND free AND NOT failed) AS to_analyse, count(*) FILTER (NOT done AND failed) AS failed, count(*) FILTER (done AND NOT failed) AS to_dedupe, count(*) FILTER (done AND free) AS buildable FROM x""",
)
def _(t: Tables) -> DataFrame:
    return ca.corpus_counts(t.tracks(), t.features(), t.failures(), t.blocked(), t.failures(), "F")


@query("a3_family_likes", "SELECT kind, ref_id, max(item_json) AS item_json, max(liked_at) AS liked_at FROM likes WHERE item_json IS NOT NULL GROUP BY kind, ref_id")
def _(t: Tables) -> DataFrame:
    return ca.family_likes(t.likes())


@query("a6_queue_sizes", "SELECT priority, count(*) AS n FROM queue GROUP BY priority")
def _(t: Tables) -> DataFrame:
    return ca.queue_sizes(t.queue())


@query("a8_first_free", "SELECT greatest(max(id) + 1, 1)::BIGINT AS next_id FROM tracks")
def _(t: Tables) -> DataFrame:
    return ca.first_free(t.tracks())


@query("a12_numbered_artists", "WITH f AS (SELECT artist_id, min(row_no) AS r FROM cat GROUP BY artist_id) SELECT artist_id, (row_number() OVER (ORDER BY r) - 1)::INTEGER AS number FROM f")
def _(t: Tables) -> DataFrame:
    return ca.numbered_artists(t.rows())


@query("a13_reach", f"SELECT count(DISTINCT album_id) AS albums, count(DISTINCT nullif(artist_id, -1)) AS artists FROM cat WHERE {_FREE}")
def _(t: Tables) -> DataFrame:
    return ca.reach(ca.not_blocked(t.rows(), t.blocked()))


@query("a17_capabilities", "SELECT bool_or(n_regionkey = 2) AS can_search, list_sort(list(DISTINCT r_name)) AS kinds FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(t: Tables) -> DataFrame:
    return ca.capabilities(t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select((F.col("n_regionkey") == 2).alias("can_search"), F.col("r_name").alias("kind")))


@query("a18_step_stats", "SELECT count(*) FILTER (o_orderstatus = 'O') AS expanded, count(*) FILTER (o_orderstatus = 'F') AS skipped, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders")
def _(t: Tables) -> DataFrame:
    return ca.step_stats(t.orders.select(F.when(F.col("o_orderstatus") == "O", "expanded").when(F.col("o_orderstatus") == "F", "skipped").otherwise("failed").alias("outcome")))


@query("a20_listen_rollup", "SELECT user_id, event_id % 20 AS track_id, count(*) AS plays, sum(floor(value))::DOUBLE AS seconds FROM events GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return ca.listen_rollup(t.events.select("user_id", (F.col("event_id") % 20).alias("track_id"), F.floor("value").cast("double").alias("listened_seconds")))


@query("j10_positions", "SELECT track_id, row_number() OVER (ORDER BY priority, seq) - 1 AS position FROM queue")
def _(t: Tables) -> DataFrame:
    return qu.positions(t.queue()).select("track_id", F.col("position").cast("bigint").alias("position"))


@query("o1_claim", "SELECT track_id, priority FROM queue WHERE track_id NOT IN (SELECT track_id FROM features) AND track_id NOT IN (SELECT track_id FROM failures) ORDER BY priority, seq LIMIT 40")
def _(t: Tables) -> DataFrame:
    return qu.claim(t.queue(), t.failures(), t.features(), 40).select("track_id", "priority")


@query("t9_enqueued", "WITH u AS (SELECT * FROM queue WHERE priority > 2 UNION ALL SELECT track_id, priority - 2, 'again', seq + 1000000 FROM queue WHERE track_id % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY priority, seq, reason) AS n, min(seq) OVER (PARTITION BY track_id) AS s FROM u) SELECT track_id, priority, reason, s AS seq FROM r WHERE n = 1")
def _(t: Tables) -> DataFrame:
    again = t.queue().filter("track_id % 2 = 0").select("track_id", (F.col("priority") - 2).alias("priority"), F.lit("again").alias("reason"), (F.col("seq") + 1000000).alias("seq"))
    return qu.enqueued(t.queue().filter("priority > 2"), again)


def _frontier(t: Tables) -> DataFrame:
    return t.supplier.select(F.when(F.col("s_suppkey") % 3 == 0, "artist").otherwise("album").alias("kind"), F.col("s_suppkey").alias("ref_id"), F.col("s_nationkey").cast("bigint").alias("priority"), F.when(F.col("s_acctbal") > 0, "pending").otherwise("done").alias("state"))


_FRONTIER = "f AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'artist' ELSE 'album' END AS kind, s_suppkey AS ref_id, s_nationkey::BIGINT AS priority, CASE WHEN s_acctbal > 0 THEN 'pending' ELSE 'done' END AS state FROM supplier)"


@query("o2_frontier", f"WITH {_FRONTIER} SELECT kind, ref_id, priority FROM f WHERE state = 'pending' ORDER BY priority, kind DESC, ref_id LIMIT 30")
def _(t: Tables) -> DataFrame:
    return qu.next_frontier(_frontier(t), 30).select("kind", "ref_id", "priority")


@query("t13_crawl_step", f"WITH {_FRONTIER}, s AS (SELECT DISTINCT l_suppkey AS from_id, l_partkey AS to_id FROM lineitem) SELECT 'artist' AS kind, to_id AS ref_id, min(priority) + 1 AS priority, 'pending' AS state FROM f JOIN s ON s.from_id = f.ref_id WHERE state = 'pending' AND to_id NOT IN (SELECT ref_id FROM f) AND to_id NOT IN (SELECT artist_id FROM blocked) GROUP BY to_id HAVING min(priority) + 1 <= 8")
def _(t: Tables) -> DataFrame:
    similar = t.lineitem.select(F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id")).distinct()
    return qu.crawl_step(_frontier(t), similar, t.blocked(), 8)


@query("t14_seeded", f"WITH {_FRONTIER} SELECT DISTINCT kind, ref_id, 0::BIGINT AS priority, 'pending' AS state FROM likes WHERE (kind, ref_id) NOT IN (SELECT kind, ref_id FROM f)")
def _(t: Tables) -> DataFrame:
    return qu.seeded(t.likes(), _frontier(t))


@query("t11_likes_to_queue", f"WITH {_FRONTIER} SELECT kind, ref_id, max(liked_at) AS liked_at, CASE WHEN max(liked_at) >= 1700000000 - 86400 THEN 0 ELSE 1 END AS priority FROM likes WHERE (kind, ref_id) NOT IN (SELECT kind, ref_id FROM f) GROUP BY kind, ref_id")
def _(t: Tables) -> DataFrame:
    return qu.likes_to_queue(t.likes(), _frontier(t), 1700000000)


@query("t21_new_releases", f"SELECT id FROM albums WHERE release_date::DATE BETWEEN {TODAY} - 29 AND {TODAY} AND artist_id IN (SELECT ref_id FROM likes WHERE kind = 'artist') AND id NOT IN (SELECT album_id FROM tracks WHERE id < 40)")
def _(t: Tables) -> DataFrame:
    liked = t.likes().filter("kind = 'artist'").select(F.col("ref_id").alias("artist_id"))
    return qu.new_releases(t.albums(), liked, t.tracks().filter("id < 40").select(F.col("album_id").alias("id")), F.expr(TODAY), 29).select("id")


@query("o3_newest_likes", "SELECT ref_id, liked_at FROM likes WHERE user_id = 7 AND kind = 'artist' AND item_json IS NOT NULL ORDER BY liked_at DESC, ref_id LIMIT 5")
def _(t: Tables) -> DataFrame:
    return ca.newest_likes(t.likes(), 7, "artist", 5).select("ref_id", "liked_at")


@query("o5_sorted_rows", "SELECT id, row_number() OVER (ORDER BY lower(nullif(artist, '')) DESC NULLS LAST, row_no) AS at FROM cat")
def _(t: Tables) -> DataFrame:
    return ca.sorted_rows(t.rows().withColumn("pos", F.col("row_no")), "artist", True, number="place").select("id", (F.col("place") + 1).alias("at"))


@query("o7_discography", "SELECT p_brand AS id, arg_min(p_size, p_partkey)::BIGINT AS released FROM part GROUP BY p_brand")
def _(t: Tables) -> DataFrame:
    return ca.discography(t.part.select(F.col("p_brand").alias("id"), F.col("p_size").cast("bigint").alias("released"), F.lit(0).alias("source_rank"), F.col("p_partkey").alias("pos"))).select("id", "released")


@query("o8_blocked_by_name", "SELECT artist_id, name FROM blocked ORDER BY lower(name), artist_id")
def _(t: Tables) -> DataFrame:
    return ca.blocked_by_name(t.blocked())


@query("o11_remembered", "WITH h AS (SELECT CASE WHEN event_id % 2 = 0 THEN upper(event_type || user_id) ELSE event_type || user_id END AS query, event_id AS \"at\" FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY lower(query) ORDER BY \"at\" DESC) AS n FROM h) SELECT query, \"at\" FROM r WHERE n = 1 ORDER BY \"at\" DESC LIMIT 20")
def _(t: Tables) -> DataFrame:
    text = F.concat("event_type", F.col("user_id").cast("string"))
    return ca.remembered(t.events.select(F.when(F.col("event_id") % 2 == 0, F.upper(text)).otherwise(text).alias("query"), F.col("event_id").alias("at")))


@query("w4_offsets", "SELECT o_custkey, o_orderkey, (coalesce(sum(o_orderkey % 5) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM orders")
def _(t: Tables) -> DataFrame:
    return nu.numbered(t.orders, [F.col("o_orderkey")], ["o_custkey"], weight=F.col("o_orderkey") % 5).select("o_custkey", "o_orderkey", "start")


# --- functions -----------------------------------------------------------------


@query("f2_keys", r"SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || '|' || lang AS key, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS squashed FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.key(F.col("text"), F.col("lang")).alias("key"), tx.squash(F.col("text")).alias("squashed"))


_HAS = lambda part, names: f"list_has_any(regexp_extract_all({part}, '[\\p{{L}}\\p{{N}}]+'), {names!r})"
_RELEASE = lambda part: f"({_HAS(part, tx.RELEASE_WORDS)} AND NOT {_HAS(part, tx.PERFORMANCE_WORDS)})"


@query(
    "f1_song_titles",
    rf"""WITH s AS (SELECT doc_id, regexp_extract_all(lower(text || ' (Remastered) - Single Version'), '(?s)[^(\[]+|\([^)]*\)|\[[^\]]*\]|[(\[].*') AS pieces FROM documents),
    b AS (SELECT doc_id, list_filter(pieces, lambda x: NOT (regexp_matches(x, '(?s)^(\(.*\)|\[.*\])$') AND {_RELEASE("x")})) AS kept FROM s),
    p AS (SELECT doc_id, string_split(array_to_string(list_transform(kept, lambda x: CASE WHEN regexp_matches(x, '(?s)^(\(.*\)|\[.*\])$') THEN ' ' || x[2:-2] || ' ' ELSE x END), ''), ' - ') AS parts FROM b),
    l AS (SELECT doc_id, parts, list_max(list_transform(range(1, len(parts) + 1), lambda i: CASE WHEN {_RELEASE("parts[i]")} AND i > 1 THEN 1 ELSE i END)) AS last FROM p)
    SELECT doc_id, trim(regexp_replace(array_to_string(parts[1:last], ' '), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS song FROM l""",
)
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.song_title(F.concat("text", F.lit(" (Remastered) - Single Version"))).alias("song"))


@query("f7_isrc_years", "SELECT o_orderkey, nullif(upper(trim(nullif(o_orderstatus, 'P') || ' ')), '') AS isrc, regexp_extract(strftime(o_orderdate, '%Y-%m-%d'), '^([0-9]{4})', 1)::DOUBLE AS year FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", tx.isrc_key(F.concat(F.nullif("o_orderstatus", F.lit("P")), F.lit(" "))).alias("isrc"), tx.release_year(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year"))


@query("f9_folded_bpm", "WITH b AS (SELECT o_orderkey, o_totalprice - 1000 AS bpm FROM orders), x AS (SELECT o_orderkey, bpm, bpm / pow(2, floor(log2(bpm / 70))) AS v FROM b WHERE bpm > 0), y AS (SELECT o_orderkey, log2(CASE WHEN v < 70 THEN v * 2 WHEN v >= 140 THEN v / 2 ELSE v END) AS f FROM x) SELECT o_orderkey, floor(f * 1e6 + 0.5)::BIGINT AS folded FROM b LEFT JOIN y USING (o_orderkey)")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", ve.micro(mu.folded_bpm(F.col("o_totalprice") - 1000)).alias("folded"))


_KEY = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B','H']"


@query("f11_keys", f"WITH k AS (SELECT p_partkey, {_KEY}[p_partkey % 13 + 1] AS tonic, p_size % 2 = 0 AS major FROM part), c AS (SELECT *, CASE WHEN tonic <> 'H' THEN p_partkey % 13 + CASE WHEN major THEN 0 ELSE 12 END END AS code FROM k) SELECT p_partkey, code::SMALLINT AS code, CASE WHEN code < 12 THEN ((code * 7 + 7) % 12 + 1) || 'B' WHEN code >= 12 THEN (((code - 12) * 7 + 4) % 12 + 1) || 'A' END AS camelot FROM c")
def _(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(p) for p in [*mu.PITCHES, "H"]])
    code = mu.key_code(F.element_at(names, (F.col("p_partkey") % 13 + 1).cast("int")), F.when(F.col("p_size") % 2 == 0, "major"))
    return t.part.select("p_partkey", code.alias("code")).withColumn("camelot", mu.camelot(F.col("code")))


@query("f10_key_places", f"WITH k AS (SELECT p_partkey, p_partkey % 13 AS i, CASE WHEN p_size % 2 = 0 THEN 1 ELSE -1 END AS m FROM part) SELECT p_partkey, CASE WHEN i = 12 THEN [0, 0, 0] ELSE [{_MICRO('cos((i * 7) % 12 * (2 * pi() / 12)) * 0.5')}, {_MICRO('sin((i * 7) % 12 * (2 * pi() / 12)) * 0.5')}, {_MICRO('m * 0.5')}] END AS place FROM k")
def _(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(p) for p in [*mu.PITCHES, "H"]])
    place = mu.key_coordinates(F.element_at(names, (F.col("p_partkey") % 13 + 1).cast("int")), F.when(F.col("p_size") % 2 == 0, "major"), F.lit(None).cast("double"))
    return t.part.select("p_partkey", F.transform(place, ve.micro).alias("place"))


@query("f14_lyrics_states", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unknown' WHEN doc_id % 5 = 1 THEN 'instrumental' WHEN doc_id % 5 = 2 AND lang <> 'de' THEN 'sung' ELSE 'none' END AS state FROM documents")
def _(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 5
    status = F.when(k == 1, "instrumental").when(k == 2, "lyrics").when(k > 2, "none")
    return t.documents.select("doc_id", mu.lyrics_state(status, F.nullif("lang", F.lit("de"))).alias("state"))


@query("f16_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS at, CASE WHEN value > 90 THEN (floor(value) - 90) / 2 ELSE 0 END::DOUBLE AS start FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", mu.utc_text(F.unix_timestamp("ts")).alias("at"), mu.excerpt_start(F.floor("value")).alias("start"))


@query("f25_moves", "SELECT i, s, g, CASE WHEN i = s THEN g WHEN s < i AND i <= g THEN i - 1 WHEN g <= i AND i < s THEN i + 1 ELSE i END AS at FROM range(7) a(i), range(7) b(s), range(7) c(g)")
def _(t: Tables) -> DataFrame:
    every = t.spark.range(343).select(F.floor(F.col("id") / 49).alias("i"), (F.floor(F.col("id") / 7) % 7).alias("s"), (F.col("id") % 7).alias("g"))
    return every.withColumn("at", mu.index_after_move(F.col("i"), F.col("s"), F.col("g")))


@query("t7_played_through", "SELECT event_id, floor(value) >= least(coalesce((event_id % 600) / 2.0, 240), 240) AS through FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", mu.played_through(F.floor("value").cast("double"), (F.col("event_id") % 600).cast("double")).alias("through"))


# --- map -----------------------------------------------------------------------


@query("m1_bounds", "SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM places")
def _(t: Tables) -> DataFrame:
    return mv.bounds(t.places())


@query("m1_genres", "WITH f AS (SELECT genre, min(row_no) AS r FROM places GROUP BY genre) SELECT genre, (row_number() OVER (ORDER BY r) - 1)::INTEGER AS number FROM f")
def _(t: Tables) -> DataFrame:
    return mv.genre_numbers(t.places())


@query("m3_cells", "WITH b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM places) SELECT id, least(15, floor((x - x0) / greatest(x1 - x0, 1e-12) * 16))::INTEGER AS cx, least(15, floor((y - y0) / greatest(y1 - y0, 1e-12) * 16))::INTEGER AS cy FROM places, b")
def _(t: Tables) -> DataFrame:
    return mv.celled(t.places(), 16).select("id", "cx", "cy")


@query("m4_rectangle", "SELECT id FROM places WHERE x BETWEEN -5 AND 5 AND y BETWEEN -3 AND 8")
def _(t: Tables) -> DataFrame:
    return mv.inside(t.places(), -5, 5, -3, 8).select("id")


@query("m5_hit", "SELECT id, x * x + y * y AS d2 FROM places WHERE x * x + y * y < 400 ORDER BY d2, row_no LIMIT 1")
def _(t: Tables) -> DataFrame:
    return mv.hit(t.places(), 0.0, 0.0, 20.0).select("id", "d2")


_WORD = "4294967296::HUGEINT"


@query(
    "m6_bins",
    f"""WITH p AS (SELECT *, floor(x * 2.0 / 16)::BIGINT AS bx, floor(y * 2.0 / 16)::BIGINT AS "by" FROM places),
    c AS (SELECT bx, "by", count(*) AS n FROM p GROUP BY ALL),
    w AS (SELECT bx + dx AS bx, "by" + dy AS "by", sum(n * CASE dx WHEN 0 THEN 2 ELSE 1 END * CASE dy WHEN 0 THEN 2 ELSE 1 END) / 16.0::DOUBLE AS blur FROM c, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) GROUP BY bx + dx, "by" + dy),
    h1 AS (SELECT p.*, greatest(1.0, blur / 4.0) AS crowding, xor(((id % {_WORD}) * 2654435761 % {_WORD})::BIGINT, id >> 32) AS h FROM p JOIN w USING (bx, "by")),
    h2 AS (SELECT * EXCLUDE h, (xor(h, h >> 16)::HUGEINT * 2246822507 % {_WORD})::BIGINT AS h FROM h1),
    h3 AS (SELECT * EXCLUDE h, (xor(h, h >> 13)::HUGEINT * 3266489909 % {_WORD})::BIGINT AS h FROM h2),
    k AS (SELECT * FROM h3 WHERE xor(h, h >> 16) / 4294967296.0::DOUBLE < 1 / crowding),
    g AS (SELECT bx, "by", genre, count(*) AS g FROM k GROUP BY ALL)
    SELECT bx, "by", sum(g)::BIGINT AS n, arg_max(genre, lpad(g::VARCHAR, 9, '0') || genre) AS genre, max(g) / sum(g) AS share FROM g GROUP BY bx, "by" """,
)
def _(t: Tables) -> DataFrame:
    return mv.bins(t.places(), 2.0, 16.0, 4.0).select("bx", "by", "n", "genre", "share")


@query("m2_regions")
def _(t: Tables) -> DataFrame:
    return mv.regions(t.places())


# --- streams -------------------------------------------------------------------


# Moments of users' events: what was done, to which row and track, is a rule of the event's number.
_MOMENTS = """m AS (
  SELECT user_id, event_id AS seq, event_id::DOUBLE AS "at", ['load', 'report', 'pause', 'play', 'step', 'ended', 'seek', 'output', 'report', 'clear'][event_id % 10 + 1] AS op,
         (event_id % 3)::INTEGER AS "row", (event_id // 40 % 3)::INTEGER AS "index", CASE WHEN event_id % 10 <> 9 AND event_id % 37 <> 0 THEN event_id // 40 % 3 + user_id % 2 * 10 END AS track,
         event_id % 4 <> 2 AS sounding, CASE WHEN event_id % 10 <> 7 OR event_id % 3 <> 0 THEN 'd' || user_id % 2 END AS output, (event_id * 7 % 50)::DOUBLE AS position FROM events),
n AS (SELECT *, CASE WHEN track % 2 = 0 THEN 120.0::DOUBLE END AS seconds, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM m)"""


def _moments(t: Tables) -> DataFrame:
    e = F.col("event_id")
    ops = F.array(*map(F.lit, ("load", "report", "pause", "play", "step", "ended", "seek", "output", "report", "clear")))
    index = F.floor(e / 40) % 3
    track = F.when((e % 10 != 9) & (e % 37 != 0), index + F.col("user_id") % 2 * 10)
    return t.events.select(
        F.col("user_id").cast("bigint").alias("user_id"), e.alias("seq"), e.cast("double").alias("at"), F.get(ops, (e % 10).cast("int")).alias("op"), (e % 3).cast("int").alias("row"), index.cast("int").alias("index"),
        track.cast("bigint").alias("track"), F.when(track % 2 == 0, 120.0).alias("seconds"), (e % 4 != 2).alias("sounding"), F.when((e % 10 != 7) | (e % 3 != 0), F.concat(F.lit("d"), F.col("user_id") % 2)).alias("output"), (e * 7 % 50).cast("double").alias("position"),
    )


@query(
    "t6_listens",
    f"""WITH RECURSIVE {_MOMENTS},
    s AS (
      SELECT n.*, CASE WHEN sounding AND track IS NOT NULL THEN {{'track': track, 'device': output, 'from': "at", 'seconds': seconds, 'heard': 0.0::DOUBLE}} END AS open, NULL::STRUCT(track BIGINT, device VARCHAR, "from" DOUBLE, seconds DOUBLE, heard DOUBLE, reached DOUBLE) AS closed FROM n WHERE k = 1
      UNION ALL
      SELECT user_id, seq, "at", op, "row", "index", track, sounding, output, position, seconds, k,
             CASE WHEN open IS NOT NULL AND NOT over THEN {{'track': open.track, 'device': open.device, 'from': open."from", 'seconds': open.seconds, 'heard': open.heard + more}}
                  WHEN sounding AND track IS NOT NULL THEN {{'track': track, 'device': output, 'from': "at", 'seconds': seconds, 'heard': 0.0::DOUBLE}} END,
             CASE WHEN open IS NOT NULL AND over THEN {{'track': open.track, 'device': open.device, 'from': open."from", 'seconds': open.seconds, 'heard': open.heard + more, 'reached': reached}} END
      FROM (
        SELECT *, CASE WHEN was_sounding THEN greatest(0.0, least(reached - was_position, "at" - was_at + 2.0)) ELSE 0.0 END AS more,
               op IN ('load', 'jump', 'clear') OR (op = 'step' AND "index" <> was_index) OR (op = 'ended' AND "row" = was_index) OR (op = 'output' AND output IS NULL AND was_output IS NOT NULL) OR track IS DISTINCT FROM open.track AS over
        FROM (
          SELECT n.*, s.open, s.sounding AS was_sounding, s.position AS was_position, s."at" AS was_at, s."index" AS was_index, s.output AS was_output,
                 CASE WHEN n.op = 'report' AND n.track IS NOT DISTINCT FROM s.track THEN n.position
                      ELSE least(s.position + CASE WHEN s.sounding THEN n."at" - s."at" ELSE 0.0 END, coalesce(s.seconds, 1e300)) END AS reached
          FROM s JOIN n ON n.user_id = s.user_id AND n.k = s.k + 1)))
    SELECT user_id, closed.track AS track_id, closed.device AS device_id, closed."from" AS started_at, closed.heard AS listened_seconds, closed.seconds AS track_seconds,
           CASE WHEN CASE WHEN closed.seconds IS NULL THEN op = 'ended' ELSE closed.reached >= closed.seconds - least(15.0, closed.seconds / 10) END THEN 'finished'
                WHEN track IS NULL OR op = 'clear' OR (op = 'output' AND output IS NULL) THEN 'stopped' ELSE 'skipped' END AS ended
    FROM s WHERE closed IS NOT NULL""",
)
def _(t: Tables) -> DataFrame:
    return li.listens(_moments(t))


@query(
    "t6_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS "start", epoch_us(max(ts) + INTERVAL 30 MINUTE) AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def _(t: Tables) -> DataFrame:
    found = li.sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")))
    return found.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query(
    "t5_splices",
    """WITH q AS (SELECT o_custkey AS user_id, o_orderkey AS seq, list(l_partkey % 4 ORDER BY l_linenumber, l_partkey % 4)::BIGINT[] AS tracks FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey),
    b AS (SELECT user_id, seq, lag(seq) OVER w AS base, coalesce(lag(tracks) OVER w, []) AS a, tracks AS z FROM q WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
    h AS (SELECT *, list_max(list_filter(range(least(len(a), len(z)) + 1), lambda k: a[1:k] = z[1:k])) AS head FROM b),
    t AS (SELECT *, list_max(list_filter(range(least(len(a), len(z)) - head + 1), lambda k: a[len(a) - k + 1:len(a)] = z[len(z) - k + 1:len(z)])) AS tail FROM h)
    SELECT user_id, seq, base, head::BIGINT AS "at", (len(a) - head - tail)::BIGINT AS removed, z[head + 1:len(z) - tail] AS tracks, z AS queue FROM t""",
)
def _(t: Tables) -> DataFrame:
    row = F.struct(F.col("l_linenumber"), (F.col("l_partkey") % 4).cast("bigint").alias("track"))
    queues = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("seq")).agg(F.sort_array(F.collect_list(row))["track"].alias("tracks"))
    found = qu.splices(queues)
    return found.select("user_id", "seq", "base", "change.at", "change.removed", "change.tracks", qu.spliced(F.col("before"), F.col("change")).alias("queue"))


# --- walks and layout: no SQL ------------------------------------------------------


def _steps(t: Tables, found) -> DataFrame:
    rows = [(i, int(x[0]), x[1]) if isinstance(x, tuple) else (i, int(x), None) for i, x in enumerate(found)]
    return t.spark.createDataFrame(rows, "step int, id bigint, micro bigint")


def _clap(t: Tables) -> np.ndarray:
    return np.array(t.space().filter("id = 3").first()["clap"], np.float64)


@query("v7_radio")
def _(t: Tables) -> DataFrame:
    return _steps(t, na.radio(t.space(), 7, 6, 0.1))


@query("v8_even_path")
def _(t: Tables) -> DataFrame:
    return _steps(t, na.even_path(t.space(), 7, 90, 6))


@query(
    "w5_broken_rules",
    """WITH w AS (SELECT l_orderkey AS walk, l_linenumber AS step, p_partkey AS id, nullif(p_size, 7)::BIGINT AS artist_id, p_brand AS album_id, p_partkey // 4 AS recording, nullif(p_size, 9) * 4 AS bpm
        FROM lineitem JOIN part ON p_partkey = l_partkey),
    b AS (SELECT *, lag(artist_id, 1) OVER o AS a1, lag(artist_id, 2) OVER o AS a2, lag(artist_id, 3) OVER o AS a3, lag(album_id) OVER o AS album_before, lag(bpm) OVER o AS bpm_before,
        min(step) OVER (PARTITION BY walk, recording) AS first FROM w WINDOW o AS (PARTITION BY walk ORDER BY step, id))
    SELECT walk::BIGINT AS walk, step::BIGINT AS step, id::BIGINT AS id, coalesce(artist_id IN (SELECT artist_id FROM blocked), false) AS blocked,
        id IN (SELECT ref_id FROM likes WHERE kind = 'track') AS excluded,
        coalesce(artist_id = a1, false) OR coalesce(artist_id = a2, false) OR coalesce(artist_id = a3, false) AS artist,
        coalesce(album_id = album_before, false) AS album, coalesce(abs(bpm - bpm_before) > 120, false) AS tempo, step > first AS recording FROM b""",
)
def _(t: Tables) -> DataFrame:
    tracks = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_partkey").cast("bigint").alias("id"), F.nullif(F.col("p_size").cast("bigint"), F.lit(7).cast("bigint")).alias("artist_id"), F.col("p_brand").alias("album_id"), F.floor(F.col("p_partkey") / 4).alias("recording"), (F.nullif(F.col("p_size").cast("int"), F.lit(9)) * 4).cast("double").alias("bpm"))
    walks = t.lineitem.select("l_partkey", F.col("l_orderkey").cast("bigint").alias("walk"), F.col("l_linenumber").cast("bigint").alias("step")).join(tracks, "l_partkey")
    return ver.broken_rules(walks, t.blocked(), t.likes().filter("kind = 'track'").select(F.col("ref_id").alias("id")), bpm_limit=120.0)


@query(
    "t20_grown_library",
    """WITH s AS (SELECT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS turn, l_partkey::BIGINT AS id, count(*) AS n, max(l_linestatus) AS version FROM lineitem
        WHERE l_linenumber <= CASE l_returnflag WHEN 'A' THEN 7 WHEN 'R' THEN 2 ELSE 1 END GROUP BY 1, 2)
    SELECT id, n, version, turn::BIGINT AS turn FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY turn DESC) = 1""",
)
def _(t: Tables) -> DataFrame:
    root = f"{shared_folder(t.spark)}/songfield/library-{uuid.uuid4().hex}"
    for turn, (flag, most) in enumerate((("A", 7), ("R", 2), ("N", 1)), 1):
        own = t.lineitem.filter((F.col("l_returnflag") == flag) & (F.col("l_linenumber") <= most))
        lib.append(own.groupBy(F.col("l_partkey").cast("bigint").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("l_linestatus").alias("version"), F.lit(turn).cast("bigint").alias("turn")), root)
        if turn == 2:
            lib.compact(t.spark, root)
    return lib.read(t.spark, root)


@query(
    "u4_listed_everywhere",
    "SELECT id, artist_id, album_id, title FROM cat WHERE id IN (SELECT track_id FROM features) AND id IN (SELECT track_id FROM failures) AND artist_id NOT IN (SELECT artist_id FROM blocked)",
)
def _(t: Tables) -> DataFrame:
    visible = ca.not_blocked(t.rows(), t.blocked())
    return ca.listed_in(visible, t.features().withColumnRenamed("track_id", "id"), t.failures().withColumnRenamed("track_id", "id")).select("id", "artist_id", "album_id", "title")


@query(
    "j6_owned_devices",
    "SELECT o_orderkey AS id, o_orderpriority AS name, o_orderstatus AS scope, o_orderdate AS created_at, o_totalprice AS last_seen, c_custkey AS user_id, c_name AS user_name FROM orders JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0",
)
def _(t: Tables) -> DataFrame:
    devices = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("scope"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("last_seen"))
    return ca.owned_devices(devices, t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))


@query("v12_graph_path")
def _(t: Tables) -> DataFrame:
    return _steps(t, na.graph_path(t.space(), 7, 90))


@query("v13_order")
def _(t: Tables) -> DataFrame:
    return _steps(t, na.order(t.space(), list(range(0, 60, 2)), 1))


@query("v16_drift")
def _(t: Tables) -> DataFrame:
    return _steps(t, na.drift(t.space(), 7, _clap(t), 5))


@query("v17_mood")
def _(t: Tables) -> DataFrame:
    return _steps(t, na.mood(t.space(), _clap(t), 12, 0.1))


@query("v33_fuzzy_graph")
def _(t: Tables) -> DataFrame:
    return la.fuzzy_graph(t.space())


@query("v37_layout")
def _(t: Tables) -> DataFrame:
    return la.layout(t.space())
