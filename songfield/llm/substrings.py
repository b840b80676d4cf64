"""Near-duplicate passages by compact windows.

A text is a sequence of n-gram hashes. Under one hash function every stretch
of it has a smallest n-gram, and all stretches around a place c that have it
there are one compact window (l, c, r): those that begin in l..c and end in
c..r. The windows are the subtrees of the sequence's Cartesian tree, of which
only those count that hold a stretch as long as a passage: some two of them for
each passage's length of text, whatever the text.

1. Windows are keyed by their smallest n-gram. A bitmap of fixed size says of which
   keys there is more than one in all texts; a window whose key is a text's own never
   leaves the worker that finds it. Where two keys share a bit, one window more
   does, which costs room and no passage. The windows of some hash functions whose
   key several documents hold are joined within a text: around the smallest n-grams under two functions
   at once. The first document of those that share both stands for them.
2. The windows that two documents share give intervals at one offset. Where they
   overlap or lie near each other, there is a region to verify.
3. Of the regions only the blocks of hashes that they need are fetched. A
   passage is a longest stretch whose n-grams match the source's up to the
   similarity, counted over the whole stretch.
4. Where a passage doesn't hold a window whole, all stretches of ``least`` words
   in the windows of its key meet by a hash of the stretch: here the first
   document shares just what the others share. So every exact repeat is found.
5. A passage as similar as 0.8 has a word changed in some 50 at most, so a run of
   21 n-grams in it is whole. Around windows that lie in no passage yet, all such
   runs meet by a hash of the run, again with the first document that has it.

In 1, 4 and 5 a document is only ever compared with the first that has a key, so
the work grows with the text and not with the square of a group, however many
documents share a line.

The later document (larger id) is the copy. Repeats inside one document aren't
looked for. Null ids and null or short texts have no passages; rows that repeat
an id are one document with several texts, whose passages aren't compared with
each other; equal texts are copies of the one with the smallest id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songfield.llm.common import dropped, once, returned, returning, written
from songfield.llm.jaccard import grams, mixed, word_hashes

#: Words of an n-gram, words of a passage, hash functions, and how many must agree.
GRAM, LEAST, FUNCTIONS, ENOUGH = 5, 50, 3, 2
#: log2 of the bits of the bitmaps of keys and of texts, the largest data that is broadcast.
KEY_BITS, TEXT_BITS = 27, 24
#: log2 of the ranges of places by which the bitmap of keys is made.
RANGE_BITS = 8
#: Pairs of windows of a text that are looked at at once.
PAIRS = 1 << 18
#: Rounds of jumps to nearest smaller keys that are made for all places at once.
JUMPS = 8
#: Offsets of one region differ by no more from one window to the next.
SLACK = 16
#: n-grams of a block that is fetched, of texts that are worked on at once, and of a
#: text beyond which it goes on in a row of its own.
BLOCK, TOGETHER, SLICE = 64, 1 << 18, 1 << 20
PLACE = np.uint64((1 << 24) - 1)


def sequence(text: str | None) -> np.ndarray:
    return grams(word_hashes(text or "", lower=False), GRAM)


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest key of every stretch of ``width``."""
    have, out = 1, keys
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(keys) - width + 1], out[width - have :]) if have < width else out


def smaller_before(values: np.ndarray) -> np.ndarray:
    """Where the nearest smaller value before each stands, -1 without one. Values differ."""
    at = np.arange(-1, len(values) - 1)
    left = np.arange(1, len(values))
    for _ in range(JUMPS):
        left = left[values[at[left]] > values[left]]
        if not len(left):
            return at
        at[left] = at[at[left]]  # what lies between is no smaller
        left = left[at[left] >= 0]
    own, before = values.tolist(), at.tolist()
    for i in left.tolist():  # few; after a rise their jumps are single steps, of which none is made twice
        j = before[i]
        while j >= 0 and own[j] > own[i]:
            j = before[j]
        before[i] = j
    return np.array(before, np.int64)


def compact_windows(keys: np.ndarray, width: int) -> np.ndarray:
    """Rows (l, c, r) of the windows that hold a stretch of ``width``. Keys differ.

    The neighbours of such a place in the Cartesian tree's path to the root, the
    nearest smaller keys left and right, are smallest in some stretch too, so they
    are looked for among those places only.
    """
    if len(keys) < width:
        return np.zeros((0, 3), np.int64)
    least = (window_minima(keys, width) & PLACE).astype(np.int64)
    places = least[np.concatenate([[True], least[1:] != least[:-1]])]
    own = keys[places]
    edge = np.append(places, -1)
    left = edge[smaller_before(own)] + 1
    edge[-1] = len(keys)
    right = edge[len(own) - 1 - smaller_before(own[::-1])[::-1]] - 1
    return np.stack([left, places, right], axis=1)


def document_windows(ids: list[int], sequences: list[np.ndarray], least: int, functions: int):
    """(key, doc, f, c, l, r) arrays of the windows of several documents."""
    width = least - GRAM + 1
    parts, starts, at = [], [], 0
    for s in sequences:
        starts.append(at)
        parts += [s, np.zeros(1, np.uint64)]
        at += len(s) + 1
    base = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    ends = np.array([a + len(s) for a, s in zip(starts, sequences)], np.int64)
    starts, doc = np.array(starts, np.int64), np.array(ids, np.int64)
    place = np.arange(len(base), dtype=np.uint64)
    found = []
    for f in range(functions):
        seed = mixed(np.array([f + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
        hashed = mixed(base ^ seed)
        keys = (hashed | np.uint64(1 << 63)) & ~PLACE | place
        keys[ends] = place[ends]  # between documents stands what is smaller than all
        windows = compact_windows(keys, width)
        windows = windows[keys[windows[:, 1]] >= np.uint64(1 << 63)]
        own = np.searchsorted(starts, windows[:, 1], side="right") - 1
        begin = starts[own]
        c = windows[:, 1]
        found.append((mixed(hashed[c] + np.uint64(f)).view(np.int64), doc[own], np.full(len(c), f, np.int32), (c - begin).astype(np.int32), (windows[:, 0] - begin).astype(np.int32), (windows[:, 2] - begin).astype(np.int32)))
    return [np.concatenate(x) for x in zip(*found)]


def joint_windows(row, f, key, c, l, r, width: int, functions: int, enough: int) -> list[np.ndarray]:
    """(row, key, exact, c, c2, l, r) arrays of the windows of texts (``row`` says whose)
    under ``enough`` functions at once: around the smallest n-grams of all of them,
    keyed by these. ``exact`` marks the first functions; every stretch of ``width`` is
    in just one such window."""
    base = row << 32  # texts one after another, so that a window's neighbours are its text's
    order = np.argsort(base + c, kind="stable")
    every = [np.stack([key, base + c, base + l, base + r])[:, order[f[order] == g]] for g in range(functions)]
    out = []
    for number, chosen in enumerate(itertools.combinations(range(functions), enough)):
        key, c, l, r = every[chosen[0]]
        low = high = last = c
        for g in chosen[1:]:
            key2, c2, l2, r2 = every[g]
            # The other's places inside a window are neighbours in its order. A text that repeats
            # itself has windows in windows, so pairs are made so many at a time.
            begin, end = np.searchsorted(c2, l), np.searchsorted(c2, r, side="right")
            cuts = np.unique(np.searchsorted(np.cumsum(end - begin), np.arange(0, int((end - begin).sum()) + PAIRS, PAIRS)))
            kept = []
            for first, last_ in zip(cuts, [*cuts[1:], len(l)]):
                n = (end - begin)[first:last_]
                i = np.repeat(np.arange(first, last_), n)
                j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[first:last_], n)
                lowest, highest = np.minimum(low[i], c2[j]), np.maximum(high[i], c2[j])
                fits = (np.maximum(l[i], l2[j]) <= lowest) & (np.minimum(r[i], r2[j]) >= highest) & (np.minimum(r[i], r2[j]) - np.maximum(l[i], l2[j]) + 1 >= width)
                i, j = i[fits], j[fits]
                joint = mixed(key[i].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + key2[j].view(np.uint64)).view(np.int64)
                kept.append((joint, c[i], c2[j], lowest[fits], highest[fits], np.maximum(l[i], l2[j]), np.minimum(r[i], r2[j])))
            key, c, last, low, high, l, r = (np.concatenate(x) for x in zip(*kept)) if kept else (key[:0], c[:0], c[:0], c[:0], c[:0], c[:0], c[:0])
        own = c >> 32
        out.append((own, key, np.full(len(key), number == 0), *((x - (own << 32)).astype(np.int32) for x in (c, last, l, r))))
    return [np.concatenate(x) for x in zip(*out)]


def regions(row, c, c2, l, r, ac, ac2, al, ar, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, offsets' ends, offsets) where windows that two texts share
    (``row`` says which two) overlap or lie near each other at offsets that differ
    little, with a block more on both sides: a near passage may go on there."""
    d = np.concatenate([ac - c, ac2 - c2])
    row, l, r, al, ar = (np.concatenate([x, x]) for x in (row, l, r, al, ar))
    s, e = np.maximum(l, al - d), np.minimum(r, ar - d)
    near = np.abs((ac - c) - (ac2 - c2)) <= SLACK
    fits = (e - s + 1 >= width) & np.concatenate([near, near])
    row, s, e, d = (x[fits] for x in (row, s, e, d))
    order = np.lexsort((d, row))
    row, s, e, d = (x[order] for x in (row, s, e, d))
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (d[1:] - d[:-1] > SLACK)
    band = np.cumsum(first)
    order = np.lexsort((s, band))
    row, s, e, d, band = (x[order] for x in (row, s, e, d, band))
    reach = np.maximum.accumulate((band << 32) + e)  # of what came before in the band
    first[1:] = (band[1:] != band[:-1]) | (s[1:] > reach[:-1] - (band[1:] << 32) + 2 * BLOCK)
    number = np.cumsum(first) - 1
    at = np.nonzero(first)[0]
    end = np.maximum.reduceat(e, at) if len(at) else e
    pairs = np.unique(np.stack([number, d], axis=1), axis=0)
    ends = np.cumsum(np.bincount(pairs[:, 0], minlength=len(at))) if len(at) else np.zeros(0, np.int64)
    return row[at], np.maximum(0, s[at] - BLOCK), end + BLOCK, ends, pairs[:, 1]


def passages(copy: np.ndarray, source: np.ndarray, offsets: list[int], width: int, similarity: float) -> list[tuple[int, int, int, float]]:
    """(start, end, offset, similarity) of the stretches of ``copy`` whose n-grams
    match ``source`` at the offsets. A stretch of L n-grams of which M match is
    M / (2 L - M) similar; a mismatch costs what keeps that at the similarity, so
    a stretch is similar enough if its sum isn't negative. Found are the longest such
    stretches that begin and end with a match, which may overlap; one below ``width``
    is filled up with what doesn't match if the similarity allows that."""
    match, by = np.zeros(len(copy), bool), np.zeros(len(copy), np.int64)
    for d in offsets:
        low, high = max(0, -d), min(len(copy), len(source) - d)
        if high > low:
            new = (copy[low:high] == source[low + d : high + d]) & ~match[low:high]
            match[low:high] |= new
            by[low:high][new] = d
    edge = np.diff(np.concatenate([[0], match.astype(np.int8), [0]]))
    first, last = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    if not len(first):
        return []
    sums = np.concatenate([[0.0], np.cumsum(np.where(match, 1.0, -2 * similarity / (1 - similarity)))])
    # A start counts if no earlier one has as small a sum; its end is the last one with a sum as large.
    lowest = np.minimum.accumulate(sums[first])
    begins = np.nonzero(np.concatenate([[True], sums[first[1:]] < lowest[:-1]]))[0]
    highest = np.maximum.accumulate(sums[last][::-1])[::-1]
    found, reached = [], -1
    for i, j in zip(begins.tolist(), (np.searchsorted(-highest, 1e-6 - sums[first[begins]], side="right") - 1).tolist()):
        if j > reached:
            reached, s, e = j, int(first[i]), int(last[j])
            same = int(match[s:e].sum())
            # Changed words at an end leave too little that matches; what is missing lies before or after it.
            s = max(0, min(s, e - width))
            e = min(len(copy), max(e, s + width))
            if e - s >= width and sums[e] - sums[s] >= -1e-6:
                found.append((s, e, int(by[first[i]]), same / (2 * (e - s) - same)))
    return found


def flat(lists: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of lists of structs of integers: whose each struct is, and the fields."""
    counts = lists.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), counts), [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists.flatten().flatten()]


def together(batches: Iterable[pa.RecordBatch], keys: int, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, pa.Table, np.ndarray]]:
    """Of rows sorted by their first ``keys`` columns, some ``most`` at once and groups
    whole: the number of each row's group, the rows, and where each group begins."""
    held, n, limit = [], 0, most

    def split(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for own in (table[i].to_numpy() for i in range(keys)):
            new[1:] |= own[1:] != own[:-1]
        return new

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= limit:
            table = pa.Table.from_batches(held)
            new = split(table)
            last = int(np.nonzero(new)[0][-1])
            if last:
                yield np.cumsum(new[:last]) - 1, table.slice(0, last), np.nonzero(new[:last])[0]
            held, n = table.slice(last).to_batches(), table.num_rows - last
            limit = max(most, 2 * n)
    if n:
        table = pa.Table.from_batches(held)
        new = split(table)
        yield np.cumsum(new) - 1, table, np.nonzero(new)[0]


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bits of 64-bit hashes in a bitmap."""
    return (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """The places in the column ``slot`` as a bitmap; the driver gets at most 2 ** (bits - 6)
    words of it, for any table."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("slot").bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def held(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def needed(texts: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of ``texts`` (doc, digest, text) that ``of`` (doc, digest) names, and few
    others: whatever else there is stays out of the join's exchange."""
    slot = F.shiftrightunsigned(F.xxhash64("doc", "digest"), 64 - TEXT_BITS)
    marks = texts.sparkSession.sparkContext.broadcast(bitmap(of.select(slot.alias("slot")).distinct(), TEXT_BITS))

    @returning
    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held(marks.value, batch.column(3).to_numpy()))).select(["doc", "digest", "text"])

    return texts.select("doc", "digest", "text", slot.alias("slot")).mapInArrow(kept, "doc bigint, digest bigint, text string")


def stretch_hashes(own: np.ndarray, width: int) -> np.ndarray:
    """A hash of every stretch of ``width`` n-grams."""
    return grams(own, width)


PACKED = "key binary, row binary, own binary, f binary, c binary, l binary, r binary"
WINDOW = "key bigint, doc bigint, digest bigint, f int, c int, l int, r int"
JOINT = "key bigint, doc bigint, digest bigint, exact boolean, c int, c2 int, l int, r int"
#: Columns of a window, as those of a source's.
SOURCE = {"doc": "source", "digest": "source_digest", "c": "ac", "c2": "ac2", "l": "al", "r": "ar"}
STRETCH = "key bigint, doc bigint, digest bigint, at int, size int"
REGION = "doc bigint, digest bigint, source bigint, source_digest bigint, start int, end int, offsets array<int>"
PASSAGE = "doc_id bigint, start_word int, end_word int, source_id bigint, source_start int, similarity double, digest bigint"


def find(docs: DataFrame, least: int = LEAST, similarity: float = 0.8, functions: int = FUNCTIONS, enough: int = ENOUGH) -> DataFrame:
    """(doc_id, start_word, end_word, source_id, source_start, similarity, digest):
    words start_word up to end_word of a document are a copy of its source's. Where
    rows of one id have several texts, digest, xxhash64 of the text, says which."""
    spark, width = docs.sparkSession, least - GRAM + 1
    run = _whole_run(width, similarity)
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.xxhash64(text).alias("digest"), text.alias("text")).filter("doc IS NOT NULL")

    @returning
    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of arrays for the windows of several texts, ``row`` says of which."""

        def rows(own, parts, at=0):
            key, row, f, *where = document_windows(list(range(len(own))), parts, least, functions)
            arrays = [key, row.astype(np.int32), np.array(own, np.int64), f, *((x + at).astype(np.int32) for x in where)]
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], ["key", "row", "own", "f", "c", "l", "r"])

        own, parts, size, seen = [], [], 0, set()
        for batch in batches:
            for doc, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                whole = sequence(text.as_py())
                # Beyond what a place can number, a text goes on in a row of its own, overlapping by a passage.
                for at in range(0, max(1, len(whole)), SLICE):
                    part = whole if len(whole) <= SLICE else whole[at : at + SLICE + width]
                    if at == 0 and len(part) >= width:
                        if (doc, digest) in seen:  # an equal row of the id
                            break
                        seen.add((doc, digest))
                        own.append((doc, digest))
                        parts.append(part)
                        size += len(part) + 1
                    elif len(part) >= width:
                        yield rows([(doc, digest)], [part], at)
                if size >= TOGETHER:
                    yield rows(own, parts)
                    own, parts, size, seen = [], [], 0, set()
                    pa.default_memory_pool().release_unused()
        if own:
            yield rows(own, parts)

    @returning
    def slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, row in zip(*batch.columns):
                key, row = np.frombuffer(key.as_buffer(), np.int64), np.frombuffer(row.as_buffer(), np.int32)
                # A text's own repeats don't count; of one slot two texts are as good as many.
                each = np.unique(row.astype(np.int64) << KEY_BITS | places(key, KEY_BITS)) & ((1 << KEY_BITS) - 1)
                slot, n = np.unique(each, return_counts=True)
                cuts = np.searchsorted(slot, np.arange((1 << RANGE_BITS) + 1) << (KEY_BITS - RANGE_BITS))
                filled = np.nonzero(np.diff(cuts))[0]
                code = slot.astype(np.uint32) << 1 | (n > 1)
                lists = [code[a:b].tobytes() for a, b in zip(cuts[filled].tolist(), cuts[filled + 1].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(lists, pa.binary())], ["range", "codes"])

    @returning
    def repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The slots in some ranges that several texts have; of a range a byte for each is held."""
        counts = {}
        for batch in batches:
            for part, codes in zip(batch.column(0).to_pylist(), batch.column(1)):
                code, own = np.frombuffer(codes.as_buffer(), np.uint32), counts.setdefault(part, np.zeros(1 << (KEY_BITS - RANGE_BITS), np.uint8))
                at = (code >> 1) & ((1 << (KEY_BITS - RANGE_BITS)) - 1)
                own[at] = np.minimum(own[at] + 1 + (code & 1), 2)
        for part, own in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(own > 1)[0] + (part << (KEY_BITS - RANGE_BITS)))], ["slot"])

    # Texts are read once here: their windows, of which most leave no worker but in this table, take less room.
    packed = written(texts.mapInArrow(windows, PACKED), "packed")
    twice = packed.select("key", "row").mapInArrow(slots, "range int, codes binary").repartition("range").mapInArrow(repeated, "slot bigint")
    common = spark.sparkContext.broadcast(bitmap(twice, KEY_BITS))

    @returning
    def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, row, own, *rest in zip(*batch.columns):
                key, row, own, rest = np.frombuffer(key.as_buffer(), np.int64), np.frombuffer(row.as_buffer(), np.int32), np.frombuffer(own.as_buffer(), np.int64), [np.frombuffer(x.as_buffer(), np.int32) for x in rest]
                kept = held(common.value, places(key, KEY_BITS))
                doc, digest = own.reshape(-1, 2)[row[kept]].T
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[kept], doc, digest, *(x[kept] for x in rest))], ["key", "doc", "digest", "f", "c", "l", "r"])

    every = written(packed.mapInArrow(shared, WINDOW), "windows")
    dropped(packed)
    several = every.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("key")
    several = written(several, "several")
    own = every.join(several, "key").select("doc", "digest", "f", "key", "c", "l", "r").repartition("doc", "digest").sortWithinPartitions("doc", "digest")

    @returning
    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, part, begin in together(batches, 2):
            f, key, c, l, r = (part[i].to_numpy().astype(np.int64) for i in range(2, 7))
            # Equal rows of an id have equal windows, of which one is kept.
            every = np.stack([row, f, key, c, l, r])[:, np.lexsort((r, l, c, f, row))]
            new = np.append(True, (every[:, 1:] != every[:, :-1]).any(axis=0))
            row, *found = joint_windows(*every[:, new], width, functions, enough)
            whose = pa.array(begin[row])
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), *(part[i].combine_chunks().take(whose) for i in (0, 1)), *map(pa.array, found[1:])], ["key", "doc", "digest", "exact", "c", "c2", "l", "r"])

    def heads_of(rows: DataFrame) -> DataFrame:
        """The first window of each key that several documents have."""
        firsts = rows.groupBy("key").agg(F.min(F.struct("doc", "digest", "c", "c2", "l", "r")).alias("first"), F.max("doc").alias("last")).filter("first.doc < last")
        return written(firsts.select("key", *(F.col(f"first.{a}").alias(b) for a, b in SOURCE.items())), "heads")

    def heads_of_first(rows: DataFrame) -> DataFrame:
        """The first window of each key, of the rows of its first document."""
        firsts = rows.groupBy("key").agg(F.min(F.struct("doc", "digest", "c", "c2", "l", "r")).alias("first"))
        return written(firsts.select("key", *(F.col(f"first.{a}").alias(b) for a, b in SOURCE.items())), "heads")

    def spread(rows: DataFrame, found: DataFrame) -> DataFrame:
        """``rows`` beside the passages found in their text."""
        spans = found.groupBy(F.col("doc_id").alias("doc"), "digest").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
        return rows.join(spans, ["doc", "digest"], "left")

    def inside(start, end) -> Column:
        held = F.exists("spans", lambda p: (p["start_word"] <= start) & (p["end_word"] >= end))
        return F.coalesce(held, F.lit(False))

    def by_stretches(rows: DataFrame, found: DataFrame) -> DataFrame:
        """Passages where a stretch of ``size`` n-grams, somewhere from begin to end and not
        in a passage yet, is that of the first document that has it."""
        wanted = rows.groupBy("doc", "digest").agg(F.collect_set(F.struct("size", "begin", "end")).alias("wanted"))

        @returning
        def stretched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    row, (sizes, first, last) = flat(part.column(3))
                    found = []
                    for i, text in enumerate(part.column(2)):
                        whole = sequence(text.as_py())
                        for size in np.unique(sizes[row == i]).tolist():
                            own, mine = stretch_hashes(whole, size), (row == i) & (sizes == size)
                            steps = np.zeros(len(own) + 1, np.int64)
                            np.add.at(steps, first[mine], 1)
                            np.add.at(steps, np.minimum(last[mine] - size + 2, len(own)), -1)
                            where = np.nonzero(np.cumsum(steps[:-1]) > 0)[0]
                            found.append((own[where], np.full(len(where), i), where, np.full(len(where), size)))
                    key, of, where, size = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(part.column(c).take(pa.array(of)) for c in (0, 1)), pa.array(where.astype(np.int32)), pa.array(size.astype(np.int32))], ["key", "doc", "digest", "at", "size"])

        wanted = written(wanted, "wanted")
        stretches = written(needed(texts, wanted).join(wanted, ["doc", "digest"]).select("doc", "digest", "text", "wanted").mapInArrow(stretched, STRETCH), "stretches")
        places = stretches.select("key", "doc", "digest", F.col("at").alias("c"), F.col("at").alias("c2"), F.col("at").alias("l"), (F.col("at") + F.col("size") - 1).alias("r"))
        dropped(beside, marked, heads, wanted)
        copies = spread(places, found).filter(~inside(F.col("l"), F.col("r") + GRAM)).drop("spans")
        return _verified(texts, copies.join(heads_of(places), "key").filter("doc > source"), width, similarity, run)

    every_joint = written(own.mapInArrow(joined, JOINT), "joint")
    dropped(every, several)
    # Numbers only are aggregated over all windows; whole windows only of the keys' first documents.
    lows = every_joint.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("key", "low")
    lows = written(lows, "lows")  # so that a hot key's rows can be split in the join
    marked = written(every_joint.join(lows, "key").withColumn("first", F.col("doc") == F.col("low")).drop("low"), "shared")
    dropped(every_joint, lows)
    joint, heads, later = marked.drop("first"), heads_of_first(marked.filter("first")), marked.filter("NOT first").drop("first")
    found = _verified(texts, later.join(heads, "key"), width, similarity)

    low, high = F.least("c", "c2"), F.greatest("c", "c2")
    begin, end = F.greatest("l", high - (width - 1)), F.least("r", low + (width - 1))
    marks = spread(later, found).select("key", "exact", once(~inside(begin, end + GRAM)).alias("partly"), once(~inside(low, high + GRAM)).alias("left"))
    marks = marks.groupBy("key").agg(F.bool_or(F.col("exact") & F.col("partly")).alias("partly"), F.bool_or("left").alias("left"))
    beside = written(marks.filter("partly OR left"), "beside")
    # Exact stretches in windows that a passage doesn't hold whole meet by a hash of all their n-grams;
    # in windows that lie in no passage, what a near passage leaves whole meets by a hash of it.
    sizes = F.array_compact(F.array(F.when(F.col("exact") & F.col("partly"), F.lit(width)), F.when(F.col("left"), F.lit(run))))
    wanted = joint.join(beside, "key").select("doc", "digest", begin.alias("begin"), end.alias("end"), F.explode(sizes).alias("size"))
    return _longest(found.unionByName(by_stretches(wanted, found)))


def _whole_run(width: int, similarity: float) -> int:
    """The n-grams that follow each other unchanged somewhere in any passage of at
    least ``width``: each word that is changed, or put in, takes GRAM - 1 of them or
    more, and one more part is left than such words."""
    most = lambda n: int(n - 2 * n * similarity / (1 + similarity) + 1e-9)  # noqa: E731  n-grams of n that may differ
    return min(-(-(n - most(n)) // (most(n) // (GRAM - 1) + 1)) for n in range(width, 20 * width))


def _longest(found: DataFrame) -> DataFrame:
    """``found`` without what lies in another passage of the text; of passages over the
    same words the one with the smallest source stays."""
    order = [F.col("start_word"), F.col("end_word").desc(), F.col("source_id"), F.col("source_start"), F.col("similarity").desc()]
    before = Window.partitionBy("doc_id", "digest").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    reach = found.distinct().withColumn("__reach", F.max("end_word").over(before))
    return reach.filter(F.col("__reach").isNull() | (F.col("__reach") < F.col("end_word"))).drop("__reach")


def _verified(texts: DataFrame, hits: DataFrame, width: int, similarity: float, held: int | None = None) -> DataFrame:
    """The passages in the regions that windows shared by two texts make, where these
    have ``held`` n-grams (``width`` of them if not given) in common."""
    key = ["doc", "digest", "source", "source_digest", "start", "end", "offsets"]
    pair = ["doc", "digest", "source", "source_digest"]
    pairs = hits.select(*pair, "c", "c2", "l", "r", "ac", "ac2", "al", "ar").repartition(*pair).sortWithinPartitions(*pair)

    @returning
    def swept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, part, begin in together(batches, 4):
            row, start, end, ends, offsets = regions(row, *(part[i].to_numpy().astype(np.int64) for i in range(4, 12)), held or width)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(offsets.astype(np.int32)))
            whose = pa.array(begin[row])
            yield pa.RecordBatch.from_arrays([*(part[i].combine_chunks().take(whose) for i in range(4)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), lists], key)

    found = written(pairs.mapInArrow(swept, REGION).withColumn("id", F.monotonically_increasing_id()), "regions")
    start, end = F.greatest(F.lit(0), F.col("start") + F.array_min("offsets")), F.col("end") + F.array_max("offsets")
    in_copy = found.select("id", F.lit(0).alias("side"), F.col("doc").alias("of"), F.col("digest").alias("of_digest"), "start", "end")
    in_source = found.select("id", F.lit(1).alias("side"), F.col("source").alias("of"), F.col("source_digest").alias("of_digest"), start.alias("start"), end.alias("end"))
    needs = in_copy.unionByName(in_source).withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor(F.col("end") / BLOCK))))
    of_text = written(needs.select("of", "of_digest", "block").distinct().groupBy("of", "of_digest").agg(F.collect_list("block").alias("blocks")), "needs")

    @returning
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, digests, number, hashes = [], [], [], []
            for doc, digest, text, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                own = sequence(text.as_py()).astype(np.uint32)
                for b in blocks:
                    part = own[b * BLOCK : (b + 1) * BLOCK]
                    if len(part):
                        of.append(doc)
                        digests.append(digest)
                        number.append(b)
                        hashes.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(digests, pa.int64()), pa.array(number, pa.int64()), pa.array(hashes, pa.binary())], ["of", "of_digest", "block", "hashes"])

    same = (F.col("doc") == F.col("of")) & (F.col("digest") == F.col("of_digest"))
    fetched = needed(texts, of_text.select(F.col("of").alias("doc"), F.col("of_digest").alias("digest"))).join(of_text, same).select("doc", "digest", "text", "blocks").mapInArrow(cut, "of bigint, of_digest bigint, block bigint, hashes binary")
    # Equal rows of an id cut equal blocks, of which one is kept. A table, so that texts
    # are off the executors' disks before blocks go to their regions.
    fetched = written(fetched.groupBy("of", "of_digest", "block").agg(F.first("hashes").alias("hashes")), "blocks")
    before = F.greatest(F.lit(0), F.col("start") - F.col("block") * BLOCK).cast("int")
    upto = F.least(F.lit(BLOCK), F.col("end") + 1 - F.col("block") * BLOCK).cast("int")
    part = F.struct("side", "block", (F.col("block") * BLOCK + before).alias("at"), F.substring("hashes", before * 4 + 1, (upto - before) * 4).alias("hashes"))
    parts = needs.join(fetched, ["of", "of_digest", "block"]).groupBy("id").agg(F.collect_list(part).alias("parts"))
    both = found.join(parts, "id").select(*key, "parts")

    @returning
    def verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            # Sorted by region, side and block, what a side has is one run of hashes.
            row, parts = np.repeat(np.arange(batch.num_rows), batch.column(7).value_lengths().to_numpy()), batch.column(7).flatten()
            side, block, at = (parts.field(i).to_numpy() for i in range(3))
            order = np.lexsort((block, side, row))
            hashes, at = parts.field(3).take(pa.array(order)).cast(pa.large_binary()), at[order]
            ends = np.frombuffer(hashes.buffers()[1], np.int64)[hashes.offset :][: len(hashes) + 1] // 4
            values = np.frombuffer(hashes.buffers()[2] or b"", np.uint32)
            cuts = np.searchsorted((2 * row + side)[order], np.arange(2 * batch.num_rows + 1)).tolist()
            for i, (doc, digest, source, start, offsets) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4, 6)))):
                a, b, c = cuts[2 * i : 2 * i + 3]
                if a == b or b == c:
                    continue
                a0 = int(at[b])
                copy, origin = values[ends[a] : ends[b]], values[ends[b] : ends[c]]
                for s, e, d, like in passages(copy, origin, [x + start - a0 for x in offsets], width, similarity):
                    out.append((doc, start + s, start + e + GRAM - 1, source, a0 + s + d, like, digest))
            cols = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start_word", "end_word", "source_id", "source_start", "similarity", "digest"])

    passed = written(both.mapInArrow(verified, PASSAGE).distinct(), "passages")
    dropped(found, of_text, fetched)
    return passed


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the words of their passages, with whatever stands between
    words of one passage. A document of which no word is left goes; one that
    had none stays. Columns are those of ``docs``, n_chars counted again."""
    import re

    word = re.compile(rb"[^\x20\x09-\x0D]+")
    spans = found.groupBy("doc_id", F.col("digest").alias("__digest")).agg(F.sort_array(F.collect_set(F.struct("start_word", "end_word"))).alias("__spans"))

    @F.arrow_udf("string")
    def rest(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts, spans):
            if not own.is_valid or not text.is_valid:
                out.append(None)
                continue
            data = text.as_py().encode()
            at = [m.span() for m in word.finditer(data)]
            gone = np.zeros(len(at), bool)
            for s in own.as_py():
                gone[s["start_word"] : s["end_word"]] = True
            if gone.all():
                out.append(None)
                continue
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            kept, last = [], 0
            for s, e in zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist()):
                kept.append(data[last : at[s][0]])
                last = at[e - 1][1]
            kept.append(data[last:])
            out.append(b"".join(kept).decode())
        left = pa.array(out, pa.string())
        del out
        returned()
        return left

    cut = rest(F.when(F.col("__spans").isNotNull(), F.col("text")), "__spans")  # no other text goes to a worker
    joined = docs.withColumn("__digest", F.xxhash64(F.col("text").cast("string"))).join(spans, ["doc_id", "__digest"], "left").withColumn("__rest", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(cut))
    left = joined.filter(F.col("__spans").isNull() | F.col("__rest").isNotNull()).withColumn("text", F.col("__rest"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))
    return left.select(*docs.columns)
