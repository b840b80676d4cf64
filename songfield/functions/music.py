"""Tempo, keys, lyrics, time and places as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from songfield.schemas import BPM_HIGH, BPM_LOW, PLAYED_MOST

# Pitch names in semitones from C.
PITCHES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
PITCH_NAMES = ["C", "C♯", "D", "E♭", "E", "F", "F♯", "G", "A♭", "A", "B♭", "B"]


def finite(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def folded_bpm(bpm: Column) -> Column:
    """halved or doubled into [70, 140), then the logarithm to base 2."""
    good = F.when(finite(bpm) > 0, bpm)
    near = good / F.pow(F.lit(2.0), F.floor(F.log2(good / BPM_LOW)))
    return F.log2(F.when(near < BPM_LOW, near * 2).when(near >= BPM_HIGH, near / 2).otherwise(near))


def pitch(key: Column) -> Column:
    """The key's number of semitones from C, null if there is no such key."""
    return F.nullif(F.array_position(F.array(*[F.lit(p) for p in PITCHES]), key), F.lit(0).cast("bigint")) - 1


def key_coordinates(key: Column, scale: Column, strength: Column) -> Column:
    """a place on the circle of fifths, and the mode, by the key's strength."""
    at, much = pitch(key), F.coalesce(finite(strength), F.lit(0.5))
    angle = ((at * 7) % 12) * (2 * math.pi / 12)
    mode = F.when(scale == "major", F.lit(1.0)).otherwise(F.lit(-1.0))
    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return F.when(at.isNull(), zero).otherwise(F.array(F.cos(angle) * much, F.sin(angle) * much, mode * much))


def key_code(key: Column, scale: Column) -> Column:
    """0 to 11 for major, 12 to 23 for minor, null for none."""
    return (pitch(key) + F.when(scale == "major", 0).otherwise(12)).cast("smallint")


def camelot(code: Column) -> Column:
    """the code's place on the wheel: 8B is C major, a fifth is one step."""
    hour = F.when(code < 12, (code * 7 + 7) % 12).otherwise(((code - 12) * 7 + 4) % 12) + 1
    return F.when(code.isNotNull(), F.concat(hour.cast("int").cast("string"), F.when(code < 12, "B").otherwise("A")))


def key_name(code: Column) -> Column:
    name = F.element_at(F.array(*[F.lit(p) for p in PITCH_NAMES]), (code % 12 + 1).cast("int"))
    return F.when(code.isNotNull(), F.concat(name, F.when(code < 12, " major").otherwise(" minor")))


def language_status(instrumental: Column, language: Column, text: Column) -> Column:
    """instrumental before detected before none."""
    return F.when(F.coalesce(instrumental, F.lit(False)), "instrumental").when((F.coalesce(F.trim(text), F.lit("")) != "") & language.isNotNull(), "lyrics").otherwise("none")


def lyrics_state(status: Column, language: Column) -> Column:
    """what a row says of a track's lyrics; sung needs a language."""
    return F.when(status.isNull(), "unknown").when(status == "instrumental", "instrumental").when((status == "lyrics") & language.isNotNull(), "sung").otherwise("none")


def reliable_language(status: Column, reliable: Column, language: Column) -> Column:
    """F15."""
    return F.when((status == "lyrics") & reliable, language)


def utc_text(seconds: Column) -> Column:
    """F16: ISO time to the second with +00:00."""
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def place_hash(id: Column) -> Column:
    """a number in [0, 1) that only depends on the id, as clients reckon it: three
    rounds of multiplying and folding 32 bits."""
    word = lambda x: x.bitwiseAND(F.lit((1 << 32) - 1).cast("bigint"))

    def times(x: Column, by: int) -> Column:  # modulo 2^32; no product here is over 2^48
        return word(x * F.lit(by & 0xFFFF) + F.shiftleft((x * F.lit(by >> 16)).bitwiseAND(F.lit(0xFFFF).cast("bigint")), 16))

    fold = lambda x, n: x.bitwiseXOR(F.shiftright(x, n))
    whole = id.cast("bigint")
    # The multipliers.
    h = times(word(whole), 0x9E3779B1).bitwiseXOR(word(F.shiftright(whole, 32)))
    h = times(fold(h, 16), 0x85EBCA6B)
    h = times(fold(h, 13), 0xC2B2AE35)
    return fold(h, 16).cast("double") / float(1 << 32)


def excerpt_start(seconds: Column, excerpt: float = 90.0) -> Column:
    """where a centred excerpt begins."""
    return F.greatest(F.lit(0.0), (F.coalesce(seconds.cast("double"), F.lit(0.0)) - excerpt) / 2)


def index_after_move(index: Column, source: Column, target: Column) -> Column:
    """where an index is after the row at ``source`` went to ``target``."""
    return (
        F.when(index == source, target)
        .when((source < index) & (index <= target), index - 1)
        .when((target <= index) & (index < source), index + 1)
        .otherwise(index)
    )


def played_through(listened: Column, track: Column) -> Column:
    """At least half of the track, or four minutes."""
    return listened >= F.least(F.coalesce(track / 2, F.lit(PLAYED_MOST)), F.lit(PLAYED_MOST))


def stamp(ids: Column) -> Column:
    """one hash for a set of ids, as an aggregate: the number of its members and
    the sum of their hashes, which come out alike in any order and are added up
    before they meet. No set is gathered; an id that is null is none."""
    h = F.when(ids.isNotNull(), F.xxhash64(ids))
    total = F.coalesce(F.sum_distinct(h.cast("decimal(20,0)")), F.lit(0))
    return F.xxhash64(F.count_distinct(h), total.cast("string"))
