"""Merges over all tables, and commits that readers see whole."""

import json

import pytest
from pyspark.sql import functions as F

from songfield.operators import merging as me
from songfield.sources import snapshots as sn
from songfield.sources import tables as so


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


MERGES = "from_id bigint, into_id bigint, similarity double, merged_at string"


def catalogue(spark):
    """Track 1 is kept; 2 is merged into it, and 3 was merged into 2 before."""
    entry = json.dumps({"origin": {"item": {"id": "2", "x": [1]}}, "z": None})
    return {
        "tracks": frame(spark, [(1, 5, None, "a"), (2, 1, "X", "b"), (4, 0, "Y", "c")], "id bigint, seed_distance bigint, isrc string, title string"),
        "refs": frame(spark, [("track", "2", "p", "r2"), ("album", "2", "p", "a2"), ("track", "4", "p", "r4"), ("track", None, "q", "r")], "kind string, id string, provider string, ref string"),
        "likes": frame(spark, [(1, "track", "1", "own", 9), (1, "track", "2", "moved", 3), (2, "track", "2", "only", 4), (2, "artist", "2", "other", 1), (None, "track", "2", "nobody", 1)], "user_id bigint, kind string, ref_id string, item_json string, liked_at bigint"),
        "listens": frame(spark, [("l1", 2), ("l2", 4), ("l3", 3), ("l4", None)], "id string, track_id bigint"),
        "mix_queue": frame(spark, [(1, 3, "asked", 10), (2, 1, "liked", 5)], "track_id bigint, priority bigint, reason string, queued_at bigint"),
        "mix": frame(spark, [(2, "v1", entry)], "track_id bigint, version string, entry_json string"),
        "features": frame(spark, [(1, "e"), (2, "e"), (4, "e")], "track_id bigint, extractor_version string"),
        "track_merges": frame(spark, [(3, 2, 0.9, "then")], MERGES),
    }


def values(rows):
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def test_a_merge_moves_what_names_the_track(spark, tmp_path):
    root = str(tmp_path / "db")
    sn.commit(spark, root, catalogue(spark))
    me.merge_snapshot(spark, root, frame(spark, [(2, 1, 0.99, "now")], MERGES))
    new, _ = sn.tables(spark, root)
    assert values(new["tracks"]) == [(1, 1, "X", "a"), (4, 0, "Y", "c")]
    assert values(new["refs"]) == sorted([("track", "1", "p", "r2"), ("album", "2", "p", "a2"), ("track", "4", "p", "r4"), ("track", None, "q", "r")], key=repr)
    assert values(new["likes"]) == sorted([(1, "track", "1", "own", 9), (2, "track", "1", "only", 4), (2, "artist", "2", "other", 1), (None, "track", "1", "nobody", 1)], key=repr)
    assert values(new["listens"]) == sorted([("l1", 1), ("l2", 4), ("l3", 1), ("l4", None)], key=repr)
    assert values(new["mix_queue"]) == [(1, 1, "liked", 10)]
    (track, version, entry), = values(new["mix"])
    assert (track, version, json.loads(entry)) == (1, "v1", {"origin": {"item": {"id": "1", "x": [1]}}, "z": None})
    assert values(new["features"]) == [(1, "e"), (4, "e")]
    assert values(new["track_merges"]) == [(2, 1, 0.99, "now"), (3, 1, 0.9, "then")]
    assert values(sn.tables(spark, root, 1)[0]["tracks"]) == values(catalogue(spark)["tracks"])


@pytest.mark.parametrize("links", [[], [(1, 1)], [(2, 1), (3, 2), (4, 3), (5, 4)], [(1, 2), (2, 3), (3, 1)], [(9, 8), (8, 7), (7, 8), (5, 9)], [(i, i + 1) for i in range(100)], [(i, (i + 1) % 64) for i in range(64)], [(2, 1), (2, 0), (None, 3), (4, None)]])
def test_ends_of_chains_and_circles(spark, links):
    into = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            into[a] = min(b, into.get(a, b))
    want = set()
    for a in into:
        seen, x = [], a
        while x in into and x not in seen:
            seen.append(x)
            x = into[x]
        end = min(seen[seen.index(x) :]) if x in into else x
        want |= {(a, end)} if a != end else set()
    got = me.resolved(frame(spark, links, "from_id bigint, into_id bigint"))
    assert {tuple(r) for r in got.collect()} == want


def test_a_reader_sees_old_or_new(spark, tmp_path):
    root = str(tmp_path / "space")
    rows = lambda n: spark.createDataFrame([(i, i, [float(n)] * 2) for i in range(n)], "track_id bigint, row_no bigint, raw array<float>")
    blocks = [{"name": "b", "start": 0, "end": 2}]
    with pytest.raises(ValueError):
        so.open_space(spark, root)
    so.write_space(rows(3), root, blocks, "first")
    held, _ = so.open_space(spark, root)

    broken = rows(5).withColumn("raw", F.when(F.col("track_id") < 4, F.col("raw")).otherwise(F.raise_error(F.lit("stopped half way")).cast("array<float>")))
    with pytest.raises(Exception, match="stopped half way"):
        so.write_space(broken, root, blocks, "second")
    opened, manifest = so.open_space(spark, root)
    assert (opened.count(), manifest["built_at"]) == (3, "first")

    so.write_space(rows(7), root, blocks, "third")
    opened, manifest = so.open_space(spark, root)
    assert (opened.count(), manifest["built_at"]) == (7, "third")
    assert held.count() == 3  # who read the old one reads on
    so.replace_layout(rows(2).selectExpr("track_id", "0.5D AS x", "1.5D AS y"), str(tmp_path / "layout"))
    so.replace_layout(so.layout_of(spark, str(tmp_path / "layout")).withColumn("x", F.col("x") + 1), str(tmp_path / "layout"))
    assert values(so.layout_of(spark, str(tmp_path / "layout"))) == [(0, 1.5, 1.5), (1, 1.5, 1.5)]
