"""Similarity joins: nearest rows by blocks, and pairs of one length and sound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from songfield.functions.vectors import dot, micro
from songfield.operators.components import components
from songfield.operators.numbering import at_ranks
from songfield.schemas import LENGTH_SLACK, SAME, SAME_OTHER_ISRC
from songfield.sources.tables import written

#: Rows of a tile's side at most, of those of one band, and what of a tile is held as scores at once.
BLOCK, BAND_BLOCK, PART = 32_768, 4096, (256, 8192)


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    values = table[name].combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def _single(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both sides in single precision, the second one turned, and for each row of the
    first by how much its scores may be off, in millionths rounded as well. Rows too
    large for that stay in double precision."""
    x, y = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1).max(initial=0)
    kind = np.float32 if max(x.max(initial=0), y) < 1e15 else np.float64
    return a.astype(kind), np.ascontiguousarray(b.astype(kind).T), (a.shape[1] + 8) * 1.2e-7 * x * y + 2e-6


def _parts(x: np.ndarray, y: np.ndarray):
    """(first row, first column, scores) of one part of a tile after the other."""
    for r in range(0, x.shape[0], PART[0]):
        for c in range(0, y.shape[1], PART[1]):
            yield r, c, x[r : r + PART[0]] @ y[:, c : c + PART[1]]


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Scores of rows i with rows j as ``dot`` has them: in double precision, summed from
    the first component to the last."""
    out = np.zeros(len(i))
    for s in range(0, len(i) if a.shape[1] else 0, 1 << 15):
        own = slice(s, s + (1 << 15))
        out[own] = np.add.accumulate(a[i[own]] * b[j[own]], axis=1)[:, -1]
    return out


def _micro(scores: np.ndarray) -> np.ndarray:
    return np.floor(scores * 1e6 + 0.5)


def _top(row: np.ndarray, value: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k largest values, of equal ones those with the smaller tie."""
    order = np.lexsort((tie, -value, row))
    held = row[order]
    first = np.searchsorted(held, held, side="left")
    return order[np.arange(len(order)) - first < k]


def _nearest(a: np.ndarray, b: np.ndarray, src: np.ndarray, dst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, micro) of each row's k best columns but itself. Single precision
    says which may be; these are scored in double precision."""
    x, y, off = _single(a, b)
    found, rows, cols, near = [], [], [], []
    bar = np.empty(0)

    def settle() -> None:
        i, j, v = (np.concatenate(z) if z else np.empty(0, dtype=int) for z in (rows, cols, near))
        if len(i):
            best = _top(i, v, j, k)
            least = np.full(len(a), -np.inf)
            last = np.flatnonzero(np.append(i[best][1:] != i[best][:-1], True))
            full = np.bincount(i[best], minlength=len(a)) >= k
            least[i[best][last]] = v[best][last]
            keep = v >= np.where(full, least - 2 * off, -np.inf)[i]
            i, j = i[keep], j[keep]
            micro = _micro(_exact(a, b, i, j))
            good = np.isfinite(micro)
            i, j, micro = i[good], j[good], micro[good]
            own = _top(i, micro, dst[j], k)
            found.append((i[own], j[own], micro[own]))
        rows.clear(), cols.clear(), near.clear()

    for r, c, score in _parts(x, y):
        if c == 0:
            settle()
            kth = score.shape[1] - k - 1  # one more, for the row itself
            bar = np.partition(score, kth, axis=1)[:, kth] - 2 * off[r : r + len(score)] if kth >= 0 else np.full(len(score), -np.inf)
        i, j = np.nonzero(score >= bar[:, None])
        other = src[r + i] != dst[c + j]
        i, j = i[other], j[other]
        rows.append(r + i), cols.append(c + j), near.append(score[i, j])
    settle()
    return tuple(np.concatenate(z) if z else np.empty(0, dtype=int) for z in (zip(*found) if found else ((), (), ())))


def _tiles(rows: DataFrame, n_blocks: int, i: str, j: str, left: bool, *columns) -> DataFrame:
    """Each row in its block, and with each of the other side's blocks."""
    own, every = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    return rows.select((own if left else every).alias(i), (every if left else own).alias(j), *columns).groupBy(i, j)


def knn_self_join(rows: DataFrame, k: int, id: str = "id", vector: str = "unit", block: int = BLOCK) -> DataFrame:
    """(src, dst, micro, rank): each row's k nearest others.

    Rows are dealt into blocks by a hash; each pair of blocks is a tile, worked off in
    parts, of which every row keeps its k best; a top-k merge joins what the tiles
    kept. Scores are compared as millionths, ties by the smaller id.
    """
    one = rows.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("v"))
    n_blocks = max(1, -(-one.count() // block))

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("micro", pa.int64())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        src, dst = a["id"].to_numpy(), b["id2"].to_numpy()
        x, y = _matrix(a, "v"), _matrix(b, "v2")
        i, j = np.isfinite(x).all(axis=1), np.isfinite(y).all(axis=1)  # others have no finite score
        src, dst = src[i], dst[j]
        row, column, micro = _nearest(x[i], y[j], src, dst, k) if i.any() and j.any() else [np.empty(0, dtype=int)] * 3
        return pa.table([src[row], dst[column], micro.astype(np.int64)], schema=schema)

    left = _tiles(one, n_blocks, "i", "j", True, "id", "v")
    right = _tiles(one, n_blocks, "i2", "j2", False, F.col("id").alias("id2"), F.col("v").alias("v2"))
    tops = left.cogroup(right).applyInArrow(tile, "src bigint, dst bigint, micro bigint")
    order = Window.partitionBy("src").orderBy(F.col("micro").desc(), "dst")
    return tops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def duplicate_pairs(tracks: DataFrame, same: float = SAME, same_other: float = SAME_OTHER_ISRC, slack: int = LENGTH_SLACK, block: int = BAND_BLOCK) -> DataFrame:
    """(a, b, similarity) of tracks of about one length that sound the
    same; with two different codes they must sound still more alike; at least one
    of a pair is new. Columns: id, seconds, isrc, unit, new. Of a pair, a comes first
    in the order of (seconds, id).

    Buckets of lengths wider than the slack make it an equi-join. A bucket's rows are
    dealt into blocks; each pair of blocks is a tile that compares vectors where they
    are, so no pair travels unless it is found.
    """
    whole = F.col("unit").isNotNull() & ~F.exists("unit", lambda x: x.isNull())
    rows = tracks.filter(F.col("seconds").isNotNull() & whole).select(F.col("id").cast("bigint").alias("id"), F.col("seconds").alias("length"), "isrc", "unit", F.coalesce("new", F.lit(False)).alias("new"), F.size("unit").alias("dims"), F.floor(F.col("seconds") / (slack + 1)).alias("own"))
    # A row for each bucket, with its blocks and those of the buckets beside it.
    blocks = rows.groupBy("own").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("g"))
    beside = lambda by, name: blocks.select((F.col("own") + by).alias("own"), F.col("g").alias(name))
    placed = rows.join(blocks.join(beside(1, "before"), "own", "left").join(beside(-1, "after"), "own", "left"), "own").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    tiles = lambda step, n: F.transform(F.sequence(F.lit(0), n - 1), lambda at: F.struct(F.lit(step).alias("step"), at.alias("at")))
    with_ = lambda other: F.explode(F.concat(tiles(0, F.col("g")), F.when(F.col(other).isNotNull(), tiles(1, F.col(other))).otherwise(F.array().cast("array<struct<step:int,at:int>>")))).alias("to")
    columns = ["dims", "id", "length", "isrc", "unit", "new"]
    left = placed.select("own", F.col("mine").alias("i"), *columns, with_("after")).select((F.col("own") + F.col("to.step")).alias("bucket"), F.col("to.step").alias("step"), "i", F.col("to.at").alias("j"), *columns)
    right = placed.select(F.col("own").alias("bucket2"), F.col("mine").alias("j2"), *[F.col(c).alias(f"{c}2") for c in columns], with_("before")).select("bucket2", F.col("to.step").alias("step2"), F.col("to.at").alias("i2"), "j2", *[f"{c}2" for c in columns])

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        id_a, id_b, at_a, at_b, new_a, new_b = (t[c].to_numpy() for c in ("id", "length", "new") for t, c in ((a, c), (b, f"{c}2")))
        codes = pa.chunked_array([*a["isrc"].chunks, *b["isrc2"].chunks], a["isrc"].type).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        code_a, code_b = codes[: len(id_a)], codes[len(id_a) :]
        va, vb = _matrix(a, "unit"), _matrix(b, "unit2")
        x, y, off = _single(va, vb)
        found = []
        for r, c, score in _parts(x, y):
            low = min(same, same_other) - off[r : r + len(score), None]
            i, j = np.nonzero(~(score < low))  # what isn't a number counts as large
            near = score[i, j]
            i, j = i + r, j + c
            gap = at_b[j] - at_a[i]
            bar = np.where((code_a[i] >= 0) & (code_b[j] >= 0) & (code_a[i] != code_b[j]), same_other, same)
            may = ((gap > 0) | (gap == 0) & (id_b[j] > id_a[i])) & (gap <= slack) & (new_a[i] | new_b[j]) & ~(near < bar - off[i])
            i, j, bar = i[may], j[may], bar[may]
            value = _exact(va, vb, i, j)
            good = ~(value < bar)
            found.append((id_a[i[good]], id_b[j[good]], value[good]))
        return pa.table([np.concatenate(z) for z in zip(*found)], schema=schema)

    key = ["bucket", "step", "i", "j", "dims"]
    return left.groupBy(*key).cogroup(right.groupBy(*[f"{k}2" for k in key])).applyInArrow(tile, "a bigint, b bigint, similarity double")


def star_groups(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """(id, keeper): a star, not a chain. In the order (place, id) each id that
    nobody took keeps, and takes its partners that nobody took.

    Rounds: an id without free partners before it keeps; its free partners are
    taken; both leave. Order decides alone, so rounds find what one walk would.
    """
    from songfield.sources.tables import written

    place = order.select("id", F.struct("place", "id").alias("at"))
    edges = written(
        pairs.select("a", "b").join(place.select(F.col("id").alias("a"), F.col("at").alias("at_a")), "a").join(place.select(F.col("id").alias("b"), F.col("at").alias("at_b")), "b")
        .select(F.when(F.col("at_a") < F.col("at_b"), F.struct("at_a", "at_b")).otherwise(F.struct(F.col("at_b").alias("at_a"), F.col("at_a").alias("at_b"))).alias("e"))
        .select("e.at_a", "e.at_b").distinct(),
        "star",
    )
    found = None
    while not edges.isEmpty():
        later = edges.select(F.col("at_b").alias("x")).distinct()
        keepers = edges.select(F.col("at_a").alias("x")).distinct().join(later, "x", "left_anti")
        taken = edges.join(keepers.withColumnRenamed("x", "at_a"), "at_a").groupBy("at_b").agg(F.min("at_a").alias("keeper"))
        round_ = written(taken.select(F.col("at_b.id").alias("id"), F.col("keeper.id").alias("keeper"), F.col("at_b").alias("x")), "taken")
        found = round_.select("id", "keeper") if found is None else found.unionByName(round_.select("id", "keeper"))
        gone = round_.select("x").unionByName(keepers)
        edges = written(edges.join(gone.withColumnRenamed("x", "at_a"), "at_a", "left_anti").join(gone.withColumnRenamed("x", "at_b"), "at_b", "left_anti"), "star")
    return found if found is not None else pairs.select(F.col("a").alias("id"), F.col("b").alias("keeper")).limit(0)


def compared(seen: DataFrame, tracks: DataFrame) -> DataFrame:
    """V42."""
    return seen.select("track_id").unionByName(tracks.select(F.col("id").alias("track_id"))).distinct()


def recordings(tracks: DataFrame) -> DataFrame:
    """(id, recording): tracks that share code and song, or artist and song,
    directly or by others, are one recording, named by its smallest id.
    Columns: id, isrc_key, artist_key, song; an empty song joins nothing."""
    named = tracks.filter(F.coalesce("song", F.lit("")) != "")
    code = named.filter(F.col("isrc_key").isNotNull()).select("id", F.concat_ws(":", F.lit("isrc"), "isrc_key", "song").alias("key"))
    song = named.select("id", F.concat_ws(":", F.lit("song"), F.coalesce("artist_key", F.lit("")), "song").alias("key"))
    keyed = code.unionByName(song)
    links = keyed.join(keyed.groupBy("key").agg(F.min("id").alias("b")), "key").select(F.col("id").alias("a"), "b")
    return tracks.select("id").join(components(links), "id", "left").select("id", F.coalesce("component", "id").alias("recording"))


def first_of_each(rows: DataFrame, order: str) -> DataFrame:
    """The first row of each recording."""
    w = Window.partitionBy("recording").orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def evaluate(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """How near the nearest of the same album is, for every row of an album with
    several, ranked over all rows: share found first, upper median and mean of the
    ranks. A row without an album has no partner and is nobody's. Tiles of rows whose
    albums share a hash find each row's nearest partner, tiles of all rows count what
    is nearer; single precision counts what is plain, double precision the rest."""
    one = rows.select(F.col("id").cast("bigint").alias("id"), F.when(F.col("album").isNotNull(), F.xxhash64("album")).alias("album"), F.col("unit").alias("v"))
    n_blocks = max(1, -(-one.count() // block))

    def sides(a: pa.Table, b: pa.Table):
        x, y = _matrix(a, "v"), _matrix(b, "v2")
        return (x, y, a["id"].to_numpy(), b["id2"].to_numpy(), *_single(x, y))

    def partner(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            album_a, album_b = a["album"].to_numpy(), b["album2"].to_numpy()
            x, y, src, dst = _matrix(a, "v"), _matrix(b, "v2"), a["id"].to_numpy(), b["id2"].to_numpy()
            in_a, in_b = np.argsort(album_a, kind="stable"), np.argsort(album_b, kind="stable")
            for album in np.intersect1d(album_a, album_b):
                p = in_a[slice(*(np.searchsorted(album_a[in_a], album, side=z) for z in ("left", "right")))]
                q = in_b[slice(*(np.searchsorted(album_b[in_b], album, side=z) for z in ("left", "right")))]
                row, column, micro = _nearest(x[p], y[q], src[p], dst[q], 1)
                found.append((src[p][row], micro.astype(np.int64), dst[q][column]))
        return pa.table({n: pa.array(np.concatenate(z) if len(z) else [], pa.int64()) for n, z in zip(("id", "micro", "dst"), zip(*found) if found else ((), (), ()))})

    def nearer(a: pa.Table, b: pa.Table) -> pa.Table:
        found = ([], [])
        if a.num_rows and b.num_rows:
            va, vb, src, dst, x, y, off = sides(a, b)
            micro, at = a["micro"].to_numpy(), a["dst"].to_numpy()
            n = np.zeros(len(src), dtype=np.int64)
            for r, c, score in _parts(x, y):
                own = slice(r, r + len(score))
                bar = (micro[own] / 1e6)[:, None]
                above = score > bar + off[own, None]
                n[own] += above.sum(axis=1)
                i, j = np.nonzero((score >= bar - off[own, None]) & ~above)
                i, j = i + r, j + c
                exact = _micro(_exact(va, vb, i, j))
                good = ((exact > micro[i]) | (exact == micro[i]) & (dst[j] < at[i])) & (src[i] != dst[j])
                n += np.bincount(i[good], minlength=len(n))
            # A row isn't nearer to itself; where it stands plainly above, it was counted.
            order = np.argsort(dst, kind="stable")
            place = np.minimum(np.searchsorted(dst[order], src), len(dst) - 1)
            i = np.flatnonzero(dst[order][place] == src)
            j = order[place[i]]
            self_score = np.einsum("ij,ij->i", x[i], y.T[j])
            n[i] -= self_score > micro[i] / 1e6 + off[i]
            found = (src, n)
        return pa.table({n: pa.array(z, pa.int64()) for n, z in zip(("id", "n"), found)})

    right = [F.col("id").alias("id2"), F.col("album").alias("album2"), F.col("v").alias("v2")]
    # Albums by buckets, of about a block each; a larger one is dealt into blocks of its own.
    kept = one.filter("album IS NOT NULL").withColumn("bucket", F.pmod(F.col("album"), F.lit(n_blocks)).cast("int"))
    blocks = kept.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("g"))
    dealt = kept.join(blocks, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), F.col("g")).cast("int")).withColumn("every", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    left_albums = dealt.select("bucket", F.col("own").alias("i"), F.col("every").alias("j"), "id", "album", "v").groupBy("bucket", "i", "j")
    right_albums = dealt.select(F.col("bucket").alias("bucket2"), F.col("every").alias("i2"), F.col("own").alias("j2"), *right).groupBy("bucket2", "i2", "j2")
    best = left_albums.cogroup(right_albums).applyInArrow(partner, "id bigint, micro bigint, dst bigint").groupBy("id").agg(F.max(F.struct("micro", (-F.col("dst")).alias("dst"))).alias("best"))
    known = written(one.join(best, "id").select("id", "v", "best.micro", (-F.col("best.dst")).alias("dst")), "partners")
    counts = _tiles(known, n_blocks, "i", "j", True, "id", "v", "micro", "dst").cogroup(_tiles(one, n_blocks, "i2", "j2", False, right[0], right[2])).applyInArrow(nearer, "id bigint, n bigint")
    ranks = written(counts.groupBy("id").agg((F.sum("n") + 1).alias("rank")), "ranks")
    found = ranks.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("top1"), F.avg("rank").alias("mean"))
    n = ranks.count()
    middle = at_ranks(ranks, {"rank": [n // 2]})["rank"][0] if n else None
    return found.select("rows", "top1", F.lit(middle).cast("double").alias("upper_median"), "mean")


def neighbours(rows: DataFrame, seed: int, k: int, other_artists: bool = False) -> DataFrame:
    """The seed's k nearest, each recording once, its own never.
    Columns: row_no, id, artist_id, recording, unit; blocked rows are left out before."""
    s = rows.filter(F.col("id") == seed).select(F.col("unit").alias("q"), F.col("recording").alias("own"), F.col("artist_id").alias("by"))
    scored = rows.crossJoin(F.broadcast(s)).filter("recording <> own")  # one row
    if other_artists:
        scored = scored.filter(F.col("by").isNull() | ~F.col("artist_id").eqNullSafe(F.col("by")))
    scored = scored.select("row_no", "id", "recording", micro(dot(F.col("unit"), F.col("q"))).alias("micro"))
    best = scored.groupBy("recording").agg(F.max(F.struct("micro", (-F.col("row_no")).alias("back"), "id")).alias("b"))
    return best.select("b.id", "b.micro", (-F.col("b.back")).alias("row_no")).orderBy(F.col("micro").desc(), "row_no").limit(k)


def text_baseline(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """Each phrase's mean similarity and spread over rows with a vector."""
    some = rows.filter(F.exists("clap", lambda x: x != 0)).select("clap")
    scores = some.crossJoin(F.broadcast(phrases)).select("phrase", dot(F.col("clap"), F.col("embedding")).alias("s"))  # a label list
    return scores.groupBy("phrase").agg(F.avg("s").alias("mean"), F.greatest(F.stddev_pop("s"), F.lit(1e-6)).alias("spread"))


def describe(rows: DataFrame, id: int, phrases: DataFrame, baseline: DataFrame, words: int = 12) -> DataFrame:
    """The phrases that a row answers most beyond what is usual."""
    one = rows.filter((F.col("id") == id) & F.exists("clap", lambda x: x != 0)).select("clap")
    scored = one.crossJoin(F.broadcast(phrases)).join(baseline, "phrase").select("phrase", ((dot(F.col("clap"), F.col("embedding")) - F.col("mean")) / F.col("spread")).alias("score"))
    return scored.orderBy(F.col("score").desc(), "phrase").limit(words)
