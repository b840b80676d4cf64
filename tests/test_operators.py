import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from songfield.functions import music as mu
from songfield.operators import build as bu
from songfield.operators import catalogue as ca
from songfield.operators import layout as la
from songfield.operators import mapview as mv
from songfield.operators import navigate as na
from songfield.operators import queueing as qu
from songfield.operators import merging as me
from songfield.operators import similarity as si
from songfield.operators.components import components
from songfield.sources import tables as so

SCHEMA = "row_no bigint, id bigint, artist_id bigint, album_id string, recording bigint, bpm double, unit array<double>, clap array<double>"


def circle(spark, rows):
    """Rows (id, degrees, artist, recording, clap score) on the unit circle."""
    data = []
    for n, (i, deg, artist, rec, score) in enumerate(rows):
        a = math.radians(deg)
        data.append((n, i, artist, "", rec, None, [math.cos(a), math.sin(a)], [float(score)]))
    return spark.createDataFrame(data, SCHEMA).cache()


@pytest.fixture(scope="module")
def plain(spark):
    return circle(spark, [(10 + i, 10 * i, i, 10 + i, s) for i, s in enumerate([0.0, 0.1, 0.9, 0.3, 0.8, 0.7])])


@pytest.fixture(scope="module")
def twins(spark):
    return circle(spark, [(1, 0, 1, 1, 0), (2, 1, 1, 1, 0), (3, 2, 1, 3, 0), (4, 3, 1, 3, 0), (5, 10, 1, 5, 0), (6, 11, 1, 5, 0), (7, 20, 1, 7, 0), (8, 30, 1, 8, 0)])


def test_neighbours_skip_twins(twins):
    assert [r["id"] for r in si.neighbours(twins, 1, 3).collect()] == [3, 5, 7]


def test_radio_plays_each_song_once(twins):
    assert [i for i, _ in na.radio(twins, 1, 5, c=na.Constraints(cooldown=0))] == [1, 3, 5, 7, 8]
    assert na.radio(twins, 99, 5) == []


def test_order_by_angle(plain):
    assert na.order(plain, [13, 11, 15, 12, 14], 10) == [11, 12, 13, 14, 15]
    assert na.order(plain, [13, 99, 11]) == [13, 11]
    assert na.order(plain, [11, 11, 12, 13])[:2] == [11, 11]


def test_mood_takes_the_best(plain):
    got = na.mood(plain, np.array([1.0]), 4, c=na.Constraints(cooldown=0))
    assert {i for i, _ in got} == {12, 13, 14, 15}


def test_even_path_ends_at_goal(plain):
    path = na.even_path(plain, 10, 15, 6, na.Constraints(cooldown=0))
    assert path == [10, 11, 12, 13, 14, 15]


def test_graph_path(plain, twins):
    path = na.graph_path(plain, 10, 15, k=2)
    assert path[0] == 10 and path[-1] == 15
    songs = [r for r in na.graph_path(twins, 1, 8, k=3)]
    recordings = {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 8}
    assert len({recordings[i] for i in songs}) == len(songs)


def test_recordings(spark):
    rows = spark.createDataFrame([(1, "C1", "#1", "heroes"), (2, None, "#1", "heroes"), (3, "C1", "#9", "heroes"), (4, None, "#2", "heroes"), (5, None, "#1", "heroes live"), (6, "C1", "#1", "other"), (7, None, "#1", "")], "id bigint, isrc_key string, artist_key string, song string")
    assert {r["id"]: r["recording"] for r in si.recordings(rows).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}


def test_duplicates_make_stars(spark):
    angle = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    rows = spark.createDataFrame([(1, 100, None, angle(0), True), (2, 101, "A", angle(4), True), (3, 102, "B", angle(8), False), (4, 200, None, angle(0), True), (5, None, None, angle(0), True)], "id bigint, seconds bigint, isrc string, unit array<double>, new boolean")
    pairs = si.duplicate_pairs(rows, 0.997, 0.997)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(1, 2), (2, 3)}
    order = rows.select("id", F.lit(0).alias("place"))
    assert {(r["id"], r["keeper"]) for r in si.star_groups(pairs, order).collect()} == {(2, 1)}


def test_components_of_stars_chains_and_odd_links(spark, monkeypatch):
    from songfield.operators import components as own

    writes, written = [], own.written
    monkeypatch.setattr(own, "written", lambda df, name: writes.append(name) or written(df, name))

    def found(links):
        writes.clear()
        return {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}

    # A hub that isn't the smallest, and one round for it.
    assert found([(77, i) for i in range(300) if i != 77]) == dict.fromkeys(range(300), 0) and len(writes) == 3
    assert found([(i, i + 1) for i in range(128)]) == dict.fromkeys(range(129), 0) and len(writes) <= 17
    assert found([(1, 1), (None, 2), (-5, 3), (3, -5), (4, 3), (None, None)]) == {-5: -5, 3: -5, 4: -5}


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)], "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and len(got) == 44
    assert components(links.limit(0)).count() == 0


def test_merges_lead_to_the_end(spark):
    merges = spark.createDataFrame([(3, 2), (2, 1), (9, 8)], "from_id bigint, into_id bigint")
    assert {(r[0], r[1]) for r in me.resolved(merges).collect()} == {(3, 1), (2, 1), (9, 8)}


def test_upserts(spark):
    base = spark.createDataFrame([(1, "a", "x", 3)], "id bigint, title string, genre string, seed_distance bigint")
    news = spark.createDataFrame([(1, "b", None, 5, 1), (2, "c", "y", 1, 2)], "id bigint, title string, genre string, seed_distance bigint, seq bigint")
    assert {tuple(r) for r in ca.upserted(base, news, "id", ["title"], ["seed_distance"]).collect()} == {(1, "b", "x", 3), (2, "c", "y", 1)}


def test_not_blocked_keeps_nobody(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, 6)], "id bigint, artist_id bigint")
    blocked = spark.createDataFrame([(5,), (None,)], "artist_id bigint")
    assert {r["id"] for r in ca.not_blocked(rows, blocked).collect()} == {1, 3}


def test_queue_keeps_place_and_urgency(spark):
    s = "track_id bigint, priority bigint, reason string, seq bigint"
    queue = spark.createDataFrame([(1, 2, "later", 1), (2, 1, "now", 2)], s)
    asked = spark.createDataFrame([(1, 0, "played", 9), (2, 3, "idle", 8), (3, 1, "new", 7)], s)
    assert {tuple(r) for r in qu.enqueued(queue, asked).collect()} == {(1, 0, "played", 1), (2, 1, "now", 2), (3, 1, "new", 7)}


def test_pca_finds_the_line(spark):
    rng = np.random.default_rng(0)
    data = [([1 + x, 1 + x],) for x in rng.normal(size=200).tolist()]
    mean, axes = bu.fit_pca(spark.createDataFrame(data, "v array<double>"), "v", 1)
    assert np.allclose(axes[0], [math.sqrt(0.5)] * 2)


def test_normalise_and_impute(spark):
    rows = spark.createDataFrame([([1.0, float("nan")],), ([3.0, 4.0],)], "b array<double>")
    out, stats = bu.normalised(rows, "b", 2)
    assert stats[0] == (2.0, 1.0)
    assert all(abs(sum(x * x for x in r["b"]) - 1) < 1e-9 for r in out.collect())
    some = spark.createDataFrame([(1.0,), (None,), (5.0,), (3.0,)], "v double")
    assert [r["v"] for r in bu.imputed(some, ["v"]).collect()] == [1.0, 3.0, 5.0, 3.0]


def test_space_is_a_space_only_with_its_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0])], "track_id bigint, row_no bigint, raw array<float>")
    blocks = [{"name": "a", "start": 0, "end": 2, "mean": [0, 0], "std": [1, 1]}]
    so.write_space(rows, str(tmp_path / "s"), blocks, "2024", (np.zeros(2), np.eye(2)))
    opened, manifest = so.open_space(spark, str(tmp_path / "s"))
    assert opened.count() == 1 and manifest["n_dims"] == 2
    mean, axes = so.pca_model(spark, str(tmp_path / "s"))
    assert axes.shape == (2, 2)
    so.write_space(rows, str(tmp_path / "t"), [blocks[0] | {"end": 3}], "2024")
    with pytest.raises(ValueError):
        so.open_space(spark, str(tmp_path / "t"))


def test_codecs_round_trip():
    points = [(1, 0.5, -1.5, 3), (2**40, 0.0, 2.0, 65535)]
    assert so.decode_points(so.encode_points(points)) == points
    assert so.decode_labels(so.encode_labels({"n": 2}, ["a\nb", "c"])) == ({"n": 2}, ["a b", "c"])
    ragged = so.encode_ragged([5, 6], [[0.0, 1.5], [2.0]], [[[1, -2], [3, 4]], [[-127, 127]]], 2)
    assert so.decode_ragged(ragged) == [(5, [0.0, 1.5], [[1, -2], [3, 4]]), (6, [2.0], [[-127, 127]])]
    with pytest.raises(ValueError):
        so.decode_ragged(ragged[:-1])
    rows = [{"id": 1, "name": "a", "row": [1, 2]}, {"id": 2, "name": "b\x1fc", "row": [-1, 0]}]
    assert [r["row"] for r in so.decode_vectors(so.encode_vectors(rows, 2))] == [[1, 2], [-1, 0]]


def test_curve_constants():
    a, b = la.curve()
    assert abs(a - 1.577) < 0.02 and abs(b - 0.895) < 0.01


def test_layout_keeps_clusters_apart(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(3):
        for i in range(30):
            v = np.zeros(6)
            v[2 * c] = 1
            v = v + rng.normal(0, 0.05, 6)
            rows.append((c * 30 + i, [float(x) for x in v / np.linalg.norm(v)]))
    at = la.layout(spark.createDataFrame(rows, "id bigint, unit array<double>"), epochs=4, k=8).toPandas().sort_values("id")
    xy = at[["x", "y"]].to_numpy().reshape(3, 30, 2)
    centres, spread = xy.mean(1), xy.std(1).mean()
    assert min(np.linalg.norm(centres[a] - centres[b]) for a in range(3) for b in range(a)) > spread


def test_regions_find_the_dense_place(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i, "g", float(x), float(y)) for i, (x, y) in enumerate(np.vstack([rng.normal(5, 0.1, (60, 2)), rng.uniform(0, 10, (40, 2))]))]
    got = mv.regions(spark.createDataFrame(rows, "row_no bigint, id bigint, genre string, x double, y double")).collect()
    assert got and all(abs(r["x"] - 5) < 1 for r in got[:1])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert si.knn_self_join(empty, 3).count() == 0
    assert si.neighbours(empty, 1, 3).count() == 0
    assert mv.celled(empty.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), 4).count() == 0


def test_a_stamp_is_of_the_set(spark):
    ids = spark.range(500).withColumn("id", F.when(F.col("id") != 7, F.col("id")))
    one = ids.agg(mu.stamp(F.col("id"))).first()[0]
    assert one == ids.unionByName(ids.filter("id % 3 = 0")).repartition(5).orderBy(F.rand(1)).agg(mu.stamp(F.col("id"))).first()[0]
    assert one != ids.filter("id <> 3").agg(mu.stamp(F.col("id"))).first()[0]
    plan = ids.groupBy().agg(mu.stamp(F.col("id")))._jdf.queryExecution().toString()
    assert "collect_set" not in plan and "collect_list" not in plan


def test_places_of_ids_are_the_clients(spark):
    def rank(i):
        h = (i % 2**32 * 0x9E3779B1 % 2**32) ^ (i >> 32)
        h = (h ^ h >> 16) * 0x85EBCA6B % 2**32
        h = (h ^ h >> 13) * 0xC2B2AE35 % 2**32
        return (h ^ h >> 16) / 2**32

    ids = [0, 1, 7, 2**31, 2**32 - 1, 2**32 + 5, 2**40 + 99, 2**52 - 1]
    got = spark.createDataFrame([(i,) for i in ids], "id bigint").select("id", mu.place_hash(F.col("id"))).collect()
    assert {r[0]: r[1] for r in got} == {i: rank(i) for i in ids}


def test_lyrics_without_a_length_and_without_words(spark):
    track = lambda *rows: spark.createDataFrame([(i, t, "Lun", album, d) for i, t, album, d in rows], "id bigint, title string, artist string, album string, duration bigint")
    dump = spark.createDataFrame(
        [(1, "gwerz", "lun", "x", 200.0, None, True), (2, "gwerz", "lun", "live at x", 300.0, "words", False), (3, "an dro", "lun", None, 100.0, " ", None), (4, "an dro live", "lun", None, 100.0, "", False)],
        "dump_id bigint, name_lower string, artist_name_lower string, album_name_lower string, dump_duration double, plain_lyrics string, instrumental boolean",
    )
    got = lambda *rows: [(r["id"], r["dump_id"]) for r in ca.lyric_matches(track(*rows), dump).orderBy("id").collect()]
    assert got((1, "Gwerz", "X", 201), (2, "Gwerz", None, None), (3, "Gwerz", "Live at X", None), (4, "Gwerz", None, 250)) == [(1, 1), (2, 1), (3, 2)]
    assert got((5, "An Dro", None, 100), (6, "An Dro (Live)", None, None)) == []


def test_phrase_rows_of_a_track(spark):
    segments = [(2, n, float(n), [0.9, 0.25, 0.3]) for n in range(3)] + [(2, 3, 3.0, [1.0]), (2, 65_535, 9.0, [0.9, 0.25, 0.3]), (1, 0, 5.0, [0.9, 0.25, 0.3]), (3, 0, 0.0, []), (4, 0, 0.0, [0.9, 0.25, 0.3])]
    table = spark.createDataFrame(segments, "track_id bigint, pos bigint, start double, embedding array<double>")
    visible = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    model = (np.array([0.1, 0.0, -0.1]), np.array([[1.0, 0, 0], [0, 1.0, 0]]), [(0.5, 2.0), (0.0, 0.5)])
    norm = (0.15**2 + 0.5**2) ** 0.5
    row = [round(0.15 / norm * 127), round(0.5 / norm * 127)]
    got = [tuple(r) for r in bu.phrase_rows(table, visible, *model).orderBy("number").collect()]
    assert got == [(0, 1, 0, 1, [5.0], row), (1, 2, 1, 3, [0.0, 1.0, 2.0], row * 3)]
    with pytest.raises(ValueError):
        bu.phrase_rows(table, visible, model[0], model[1][:, :2], model[2])
    assert bu.phrase_rows(table.limit(0), visible, *model).count() == 0


def test_splices_lead_from_each_queue_to_the_next(spark):
    import random

    rng = random.Random(5)
    pairs = [([rng.choice([1, 2, None]) for _ in range(rng.randrange(7))], [rng.choice([1, 2, None]) for _ in range(rng.randrange(7))]) for _ in range(300)]
    pairs += [([], []), (None, [1]), ([1], None), ([1, 1], [1, 1, 1]), ([1, None], [1])]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<bigint>, b array<bigint>")
    found = rows.withColumn("c", qu.splice(F.col("a"), F.col("b"))).withColumn("again", qu.spliced(F.col("a"), F.col("c"))).collect()
    for r in found:
        a, b = r["a"] or [], r["b"] or []
        head = max(k for k in range(min(len(a), len(b)) + 1) if a[:k] == b[:k])
        tail = max(k for k in range(min(len(a), len(b)) - head + 1) if a[len(a) - k :] == b[len(b) - k :])
        assert (r["c"]["at"], r["c"]["removed"], r["c"]["tracks"]) == (head, len(a) - head - tail, b[head : len(b) - tail])
        assert r["again"] == b
    refused = spark.sql("SELECT array(1L, 2L) AS q, named_struct('at', x, 'removed', y, 'tracks', array(9L)) AS c FROM VALUES (3L, 0L), (2L, 1L), (-1L, 1L), (9223372036854775807L, 1L) v(x, y)")
    assert [r[0] for r in refused.select(qu.spliced(F.col("q"), F.col("c"))).collect()] == [None] * 4
    snaps = spark.createDataFrame([(1, 5, [1, 2, 3]), (1, 9, [1, 3]), (2, 1, []), (1, 7, None)], "user_id int, seq int, tracks array<bigint>")
    got = sorted((r["user_id"], r["seq"], r["base"], *r["change"]) for r in qu.splices(snaps).collect() if r["base"] is not None)
    assert got == [(1, 7, 5, 0, 3, []), (1, 9, 7, 0, 0, [1, 3])]
