import random

import pytest

from songfield.streaming import listens as li

LENGTHS = {1: 100.0, 2: 100.0, 3: 20.0}


def heard(spark, *moments, user=1):
    """Listens of one user's moments (at, op, row, index, track, sounding, position)."""
    rows = [(user, n, float(at), op, row, index, track, LENGTHS.get(track), sounding, "d" if op != "mute" else None, float(position)) for n, (at, op, row, index, track, sounding, position) in enumerate(moments)]
    return [(r["track_id"], r["ended"], r["listened_seconds"]) for r in li.listens(spark.createDataFrame(rows, li.MOMENT)).orderBy("started_at").collect()]


LOAD = (0, "load", None, 0, 1, True, 0)


def test_finished_skipped_and_stopped(spark):
    got = heard(spark, LOAD, (95, "ended", 0, 1, 2, True, 0), (105, "step", None, 2, 3, True, 0), (110, "clear", None, 0, None, False, 0))
    assert got == [(1, "finished", 95), (2, "skipped", 10), (3, "stopped", 5)]


def test_pause_and_stalls_are_not_heard(spark):
    assert heard(spark, LOAD, (10, "pause", None, 0, 1, False, 10), (50, "play", None, 0, 1, True, 10), (60, "step", None, 1, 2, True, 0)) == [(1, "skipped", 20)]
    assert heard(spark, LOAD, (30, "report", None, 0, 1, True, 10), (40, "step", None, 1, 2, True, 0)) == [(1, "skipped", 20)]


def test_seek_does_not_count(spark):
    assert heard(spark, LOAD, (10, "seek", None, 0, 1, True, 80), (12, "step", None, 1, 2, True, 0)) == [(1, "skipped", 12)]


def test_late_ended_is_ignored(spark):
    assert heard(spark, LOAD, (95, "ended", 0, 1, 2, True, 0), (96, "ended", 0, 1, 2, True, 1)) == [(1, "finished", 95)]


def test_the_same_track_again_is_another_listen(spark):
    assert heard(spark, LOAD, (20, "jump", None, 0, 1, True, 0), (25, "clear", None, 0, None, False, 0)) == [(1, "skipped", 20), (1, "stopped", 5)]


def test_batches_are_recorded_once(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = li.record(spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def scripted(users=5, moments=60):
    """Moments by a rule, of which the last user's stop for long now and then."""
    rows, ops = [], ("load", "report", "pause", "play", "step", "ended", "seek", "output", "report", "clear")
    rng = random.Random(9)
    for user in range(users):
        at = 0.0
        for n in range(moments):
            at += rng.choice([1, 3, 20, 400 if user == users - 1 else 5])
            op, index = rng.choice(ops), rng.randrange(3)
            track = None if op == "clear" else rng.choice([1, 2, 3])
            rows.append((user, n, at, op, rng.randrange(3), index, track, LENGTHS.get(track) if track != 2 else None, rng.random() < 0.7, rng.choice(["d", "d", None]), float(rng.randrange(60))))
    return sorted(rows, key=lambda r: r[2])


@pytest.mark.parametrize("silence", [None, 60.0])
@pytest.mark.parametrize("cuts", [(40, 41, 150), (7, 100, 101, 290)])
def test_a_stream_tells_what_one_batch_does(spark, tmp_path, silence, cuts):
    rows = scripted()
    bounds, source = [0, *cuts, len(rows)], tmp_path / "in"
    for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
        again = rows[max(0, a - 3) : a] if n == 2 else []  # some moments come twice
        spark.createDataFrame(rows[a:b] + again, li.MOMENT).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(li.MOMENT).parquet(str(source))
        li.listens_on(stream, str(tmp_path / "out"), str(tmp_path / "check"), silence).awaitTermination(120)
        if n == 1:  # the batch is tried again: its commit is lost, its files are there
            newest = max((p for p in (tmp_path / "check/commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
            newest.unlink()
            (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
            li.listens_on(stream, str(tmp_path / "out"), str(tmp_path / "check"), silence).awaitTermination(120)
    until = max(r[2] for r in rows)
    want = li.listens(spark.createDataFrame(rows, li.MOMENT), silence, until)
    got = spark.read.parquet(str(tmp_path / "out/listens")).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert want.count() > 40
