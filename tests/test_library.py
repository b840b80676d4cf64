"""Rules of walks, and a library that grows in place."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from songfield.operators import navigate as na
from songfield.operators import verifying as ve
from songfield.sources import library as lib

WALKS = "walk bigint, step bigint, id bigint, artist_id bigint, album_id string, recording bigint, bpm double, own string"
RULES = ["blocked", "excluded", "artist", "album", "tempo", "recording"]


def plain(rows, blocked, exclude, cooldown, same_album, limit):
    """Row by row, by the walker's own predicate where it has the rule."""
    out = {}
    for walk, own in itertools.groupby(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])), key=lambda r: r[0]):
        before = []
        for _, step, id, artist, album, recording, bpm, _ in own:
            somebody = artist is not None and artist != -1
            last = before[-1] if before else None
            out[walk, step] = (
                somebody and artist in blocked,
                id in exclude,
                somebody and cooldown > 0 and artist in [b[0] for b in before[-cooldown:]],
                bool(last and not same_album and album and album == last[1]),
                bool(last and limit is not None and bpm is not None and last[2] is not None and abs(bpm - last[2]) > limit),
                recording is not None and recording in [b[3] for b in before],
            )
            before.append((artist if somebody else None, album, bpm, recording))
    return out


@pytest.mark.parametrize("cooldown, same_album, limit, chunk", [(3, False, 10.0, 4), (3, False, None, 4096), (0, True, 0.0, 1), (5, False, 25.0, 5)])
def test_broken_rules_equal_a_plain_reading(spark, cooldown, same_album, limit, chunk):
    rng = random.Random(cooldown)
    rows = []
    for walk, n in ((1, 60), (2, 1), (None, 23), (4, 9)):
        for step in range(n):
            rows.append((walk, step, rng.randrange(40), rng.choice([None, -1, *range(9)]), rng.choice([None, "", "a", "b", "c"]), rng.choice([None, *range(50)]), rng.choice([None, 80.0, 90.0, 100.0, 120.0]), "x"))
    walks = spark.createDataFrame(rows, WALKS)
    blocked, exclude = spark.createDataFrame([(2,), (2,), (None,)], "artist_id bigint"), spark.createDataFrame([(7,), (7,), (None,)], "id bigint")
    got = ve.broken_rules(walks, blocked, exclude, cooldown, same_album, limit, chunk).collect()
    assert len(got) == len(rows)
    assert {(r["walk"], r["step"]): tuple(r[c] for c in RULES) for r in got} == plain(rows, {2}, {7}, cooldown, same_album, limit)
    assert ve.broken_rules(walks.limit(0), blocked).count() == 0


def test_a_row_without_a_step_breaks_no_rule_that_looks_back(spark):
    rows = [(1, None, 5, 3, "a", 9, 80.0, "x"), (1, None, 5, 3, "a", 9, 200.0, "x"), (1, 0, 5, 3, "a", 9, 80.0, "x")]
    got = ve.broken_rules(spark.createDataFrame(rows, WALKS), spark.createDataFrame([(3,)], "artist_id bigint"), bpm_limit=1.0).collect()
    assert len(got) == 3 and all(r["blocked"] and not any(r[c] for c in RULES[1:]) for r in got)


def test_walks_break_no_rule(spark):
    """Radio's and the even path's own walks, over a space where artists and albums are few."""
    rng = random.Random(3)
    unit = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(150)]
    unit = [[x / sum(y * y for y in v) ** 0.5 for x in v] for v in unit]
    space = spark.createDataFrame([(i, i, i % 7, str(i % 11), i // 2, float(60 + i % 50), v, v) for i, v in enumerate(unit)], "row_no bigint, id bigint, artist_id bigint, album_id string, recording bigint, bpm double, unit array<double>, clap array<double>").cache()
    rules = na.Constraints(bpm_limit=30.0)
    nobody = spark.createDataFrame([], "artist_id bigint")
    for ids, picked in (([x[0] for x in na.radio(space, 5, 12, c=rules)], 0), (na.even_path(space, 3, 90, 8, c=rules), 1)):
        assert len(ids) > 4
        places = spark.createDataFrame([(1, i, int(x)) for i, x in enumerate(ids)], "walk bigint, step bigint, id bigint")
        judged = ve.broken_rules(places.join(space, "id"), nobody, bpm_limit=30.0)
        # A path's end is given, not picked.
        assert judged.filter("artist OR album OR recording OR tempo").filter(F.col("step") < len(ids) - picked).count() == 0
    space.unpersist()


SONGS = "id bigint, v string, n bigint"


def whole(rows):
    return sorted((tuple(r) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("compacted", list(itertools.product([False, True], repeat=3)))
def test_a_grown_library_equals_one_that_is_made_anew(spark, tmp_path, compacted):
    rng, root, want = random.Random(sum(compacted)), str(tmp_path / "lib"), {}
    for turn, compacts in enumerate((*compacted, False)):
        rows = [(i, f"{turn}-{i}", turn) for i in rng.sample(range(30), 12)]
        want.update({r[0]: r for r in rows})
        assert lib.append(spark.createDataFrame([*rows, (None, "nobody", turn)], SONGS), root)
        if compacts:
            assert lib.compact(spark, root) > 0 and lib.compact(spark, root) == 0
        got = whole(lib.read(spark, root))
        assert got == sorted([*want.values(), *[(None, "nobody", t) for t in range(turn + 1)]], key=repr)


def test_what_is_appended_while_a_base_is_written_stays(spark, tmp_path, monkeypatch):
    root, add = str(tmp_path / "lib"), lib._add
    lib.append(spark.createDataFrame([(1, "a", 0), (2, "a", 0)], SONGS), root)

    def slow(spark, root, number, id, kind, rows, covers):
        if kind == "base":
            add(spark, root, number, "other", "segment", spark.createDataFrame([(2, "b", 1, (number, "other"))], SONGS + ", _at struct<number:bigint,id:string>"), [])
        add(spark, root, number, id, kind, rows, covers)

    monkeypatch.setattr(lib, "_add", slow)
    lib.compact(spark, root)
    assert whole(lib.read(spark, root)) == [(1, "a", 0), (2, "b", 1)]


def test_a_batch_that_is_tried_again_and_one_that_fails(spark, tmp_path):
    root = str(tmp_path / "lib")
    with pytest.raises(ValueError):
        lib.read(spark, root)
    one = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], SONGS)
    assert lib.append(one, root, "batch-1") and not lib.append(one, root, "batch-1")
    assert lib.read(spark, root).count() == 1 and whole(lib.read(spark, root)) == whole(lib.read(spark, root))
    with pytest.raises(Exception):
        lib.append(one.select("id", F.raise_error(F.lit("lost")).cast("string").alias("v"), "n"), root, "batch-2")
    assert lib.read(spark, root).count() == 1
    assert lib.append(one.limit(0), root) and lib.append(spark.createDataFrame([(3, "c", 0, "new")], SONGS + ", extra string"), root)
    assert (3, "c", 0, "new") in whole(lib.read(spark, root)) and lib.read(spark, root).count() == 2
    with pytest.raises(ValueError):
        lib.append(one.withColumn("_at", F.lit(1)), root)
