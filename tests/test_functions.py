import math

from pyspark.sql import functions as F

from songfield.functions import music as mu
from songfield.functions import text as tx
from songfield.functions import vectors as ve


def test_titles_as_songs(spark):
    same = ["Heroes (2017 Remaster)", "Heroes - Single Version", "Heroes [Deluxe Edition]", "Heroes (feat. Someone)", "HEROES!", "Heroes (Radio Edit)"]
    others = ["Heroes (Live)", "Heroes - Acoustic", "Heroes (Remix)", "Heroes (Live Version)", "Heroes - Radio Mix", "Heroes (VIP Edit)"]
    more = {"Part I - The Beginning": "part i the beginning", "Heroes - Mono - Remastered": "heroes", "Mono - Stereo": "mono", "Live (deluxe": "live deluxe", "A (b) [c]": "a b c", "": "", None: None}
    rows = spark.createDataFrame([(t,) for t in [*same, *others, *more]], "t string")
    got = {r["t"]: r["song"] for r in rows.select("t", tx.song_title(F.col("t")).alias("song")).collect()}
    assert all(got[t] == "heroes" for t in same) and not any(got[t] == "heroes" for t in others)
    assert {t: got[t] for t in more} == more


def test_keys_and_names(spark):
    rows = spark.createDataFrame([("Bad Omens, Dahlia", "Song (feat. X)", " ab1 "), (None, None, "  ")], "a string, t string, i string")
    got = rows.select(tx.credit_key(F.col("a"), F.col("t")).alias("k"), tx.isrc_key(F.col("i")).alias("i"), tx.bare_title(F.lit("Song - Live [x]")).alias("b"), tx.prepared(F.lit("Déjà-Vu, It's")).alias("p")).collect()
    assert got[0]["k"] == "bad omens|song" and got[0]["i"] == "AB1" and got[1]["i"] is None
    assert got[0]["b"] == "Song" and got[0]["p"] == "deja vu its"


def test_bpm_folds(spark):
    values = [172.0, 86.0, 60.0, 120.0, 70.0, 140.0, 280.0, 139.999, 0.0, -3.0, float("nan"), float("inf"), None]
    rows = spark.createDataFrame([(v,) for v in values], "b double").select(mu.folded_bpm(F.col("b")).alias("f")).collect()

    def plain(b):
        if b is None or not math.isfinite(b) or b <= 0:
            return None
        while b < 70:
            b *= 2
        while b >= 140:
            b /= 2
        return math.log2(b)

    for v, r in zip(values, rows):
        assert (r["f"] is None) == (plain(v) is None) and (r["f"] is None or abs(r["f"] - plain(v)) < 1e-12)


def test_moves_are_exhaustive(spark):
    cases = [(i, s, g) for i in range(7) for s in range(7) for g in range(7)]
    got = spark.createDataFrame(cases, "i int, s int, g int").select("i", "s", "g", mu.index_after_move(F.col("i"), F.col("s"), F.col("g")).alias("at")).collect()
    for r in got:
        row = list(range(7))
        row.insert(r["g"], row.pop(r["s"]))
        assert row[r["at"]] == r["i"]


def test_camelot(spark):
    got = spark.createDataFrame([("C", "major"), ("A", "minor"), ("A", None), ("H", "major")], "k string, s string").select(mu.key_code(F.col("k"), F.col("s")).alias("c")).select("c", mu.camelot(F.col("c")).alias("w"), mu.key_name(F.col("c")).alias("n")).collect()
    assert [(r["w"], r["n"]) for r in got] == [("8B", "C major"), ("8A", "A minor"), ("8A", "A minor"), (None, None)]


def test_quantised_halves(spark):
    got = spark.createDataFrame([(2.5 / 127,), (-2.5 / 127,), (3.0,), (-3.0,)], "x double").select(ve.quantised(F.col("x")).alias("q")).collect()
    assert [r["q"] for r in got] == [3, -3, 127, -127]


def test_weights(spark):
    factors = ve.scales([("a", 0, 2), ("b", 2, 3)], {"a": 2.0, "zz": 5.0}, {"b": 3.0})
    assert factors == [2.0, 2.0, 3.0]
    row = spark.createDataFrame([([1.0, 0.0, 0.0],), ([0.0, 0.0, 0.0],)], "v array<double>").select(ve.unit(ve.weighted(F.col("v"), factors)).alias("u")).collect()
    assert list(row[0]["u"]) == [1.0, 0.0, 0.0] and list(row[1]["u"]) == [0.0, 0.0, 0.0]
