"""Exact Jaccard join of documents' n-gram sets by prefix trees.

1. Every text becomes its set of n-gram hashes. Equal sets are one class; only
   one document of a class goes on, so copies cost nothing.
2. N-grams are ordered globally, rare ones first. The quarter of all hashes
   below a bound is counted over all documents and comes first, in steps of
   how many documents hold it, then by hash; the rest comes after. Two sets that
   link share an n-gram among the first few of both (as many as may be missing,
   plus one). So a set whose first few are its own alone links with nothing, and
   is done. The others meet by n-gram, each with its size, the n-gram's place and
   a sketch: the parities of its n-grams in 256 slots. Two sets differ by as many
   n-grams at least as their sketches by parities, and where the first n-gram they
   share stands bounds the overlap, so sets that share one by chance part again.
   What is left hangs together in blocks, and no link leaves a block. As a sketch
   tells nothing of a long set, n-grams of sets from ``SPLIT`` on are dealt by hash
   into 4, 16, ... ranges; sets that link do so in one range at least, and in both
   ways to deal where their sizes are on two sides of a bound. The steps are told by
   a bitmap whose size is bounded; where two n-grams meet in it one comes later
   than it might, which costs time and no link.
3. In a block the ordered sets are stored in a trie, and each set walks it:
   overlaps with all sets below a node are counted once, and a subtree is left
   when what remains of either side can't bring the overlap that a link needs,
   or when all below is already connected to the walking set. Blocks beyond
   ``TILE`` sets are dealt into bands by size, so wide that sets which link are
   of one band or of two that adjoin, and bands into tiles: each tile by itself
   first, then pairs of tiles of such bands, which know what is connected so far.
4. The links, at most one fewer than a block has sets, are made components.

Which links appear is up to the walk, which components do is not: sets in
different components were compared or provably don't link. No list of copies,
common n-gram or block is ever gathered beyond a tile.

Texts without words, and null texts, have an empty set and link with nothing.
Equal sets link whatever their ids; a null id is never a component's id, and
takes part only through sets equal to its own. Rows that repeat an id are one
document with several texts, and are of one component. A very long text is one
set like any other; an empty table has no rows. Other columns aren't carried.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songfield.llm.common import dropped, returning, written
from songfield.operators.components import components

#: The part of all hashes that is counted, log2 of the least and most bits of the
#: bitmap, and the numbers of documents at which an n-gram comes a step later, a bit for each.
COUNTED, BITS, MOST_BITS, STEPS = 0.25, 26, 28, (2, 5, 20, 200)
#: Sizes from which n-grams are dealt into ranges, words of a sketch, rows of an
#: n-gram whose pairs are all compared, and about how many pairs at once.
SPLIT, WORDS, FEW, PAIRS = 384, 4, 128, 1 << 19
#: Sets that are walked in one trie, and bits of a tile's number within its band.
TILE, TILE_BITS = 2048, 32


def word_hashes(text: str, lower: bool = True) -> np.ndarray:
    """A hash for each word; ``lower`` folds A-Z only."""
    data = text.encode()
    words = (data.lower() if lower else data).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that any of their bits may be used."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in order."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = words[:size].copy()
    for i in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + size]
    return mixed(out + np.uint64(n))


def gram_set(text: str | None, n: int) -> np.ndarray:
    """Distinct n-gram hashes, sorted; a shorter text is one gram of its own."""
    words = word_hashes(text or "")
    return np.unique(grams(words, min(n, len(words)))) if len(words) else np.zeros(0, np.uint64)


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def class_of(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def counted(own: np.ndarray) -> np.ndarray:
    """Those of a sorted set that are counted."""
    return own[: np.searchsorted(own, np.uint64(int(COUNTED * 2**64)))]


def steps(own: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """For each n-gram its step: 0 for one document's own, up to 4 by how many hold
    it, 5 where that isn't counted."""
    out = np.full(len(own), len(STEPS) + 1, np.int8)
    told = own < np.uint64(int(COUNTED * 2**64))
    slot = own[told] & np.uint64(16 * len(bitmap) - 1)
    four = (bitmap[(slot >> np.uint64(4)).astype(np.int64)] >> ((slot & np.uint64(15)) << np.uint64(2))) & np.uint64(15)
    out[told] = np.bitwise_count(four)
    return out


def prefix_size(size: int, percent: int) -> int:
    """The first n-grams of which two linked sets share one: all but what the
    smallest overlap of a link leaves out."""
    return size - -(-percent * size // 100) + 1


def linked(overlap: int, a: int, b: int, percent: int) -> bool:
    return 100 * overlap >= percent * (a + b - overlap)


def levels(size: int, percent: int) -> range:
    """How sets of a size are dealt: at level k into 4 ** k ranges. A set is dealt as
    the largest it may link with is, too."""
    level = lambda n: next(k for k in range(32) if n < SPLIT << 2 * k)
    return range(level(size), level(100 * size // percent) + 1)


def heads(sets: list[np.ndarray], bitmap: np.ndarray, percent: int) -> list[np.ndarray]:
    """The first n-grams of each range of sorted sets that others may share: n-gram and
    level as one number, the set's number, its size in the range, the n-gram's place
    there, and the range's sketch."""
    dealt = [(i, k) for i, own in enumerate(sets) if len(own) for k in levels(len(own), percent)]
    if not dealt:
        return [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32)] + [np.zeros(0, np.int64)] * WORDS
    all_ = np.concatenate([sets[i] for i, _ in dealt])
    ranges = np.array([1 << 2 * k for _, k in dealt])
    entry = np.repeat(np.arange(len(dealt)), [len(sets[i]) for i, _ in dealt])
    part = (np.cumsum(ranges) - ranges)[entry] + ((all_ >> np.uint64(32)) & (ranges - 1).astype(np.uint64)[entry]).astype(np.int64)
    sketch = np.zeros(int(ranges.sum()) * WORDS, np.uint64)
    np.bitwise_xor.at(sketch, part * WORDS + ((all_ >> np.uint64(30)) & np.uint64(WORDS - 1)).astype(np.int64), np.uint64(1) << ((all_ >> np.uint64(24)) & np.uint64(63)))
    step = steps(all_, bitmap)
    order = np.argsort(part * 8 + step, kind="stable")
    sizes = np.bincount(part, minlength=int(ranges.sum()))
    size = sizes[part[order]]
    at = np.arange(len(all_)) - (np.cumsum(sizes) - sizes)[part[order]]
    kept = (at < size - -(-percent * size // 100) + 1) & (step[order] > 0)
    order = order[kept]
    level = np.array([k for _, k in dealt], np.uint64)[entry[order]]
    number = np.array([i for i, _ in dealt])[entry[order]]
    words = sketch.reshape(-1, WORDS)[part[order]].view(np.int64)
    return [(all_[order] ^ (level << np.uint64(52))).view(np.int64), number, size[kept].astype(np.int32), at[kept].astype(np.int32), *words.T]


def may_link(size: np.ndarray, at: np.ndarray, sketch: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows a and b, of one n-gram, may be of sets that link with this n-gram as
    the first they share: by the least overlap of a link, what can still be shared from
    it on, and what their sketches differ by."""
    total = size[a] + size[b]
    least = -(-percent * total // (100 + percent))
    ok = (at[a] <= size[a] - least) & (at[b] <= size[b] - least)
    left = np.flatnonzero(ok)
    differ = np.bitwise_count((sketch[a[left]] ^ sketch[b[left]]).view(np.uint64)).sum(1, dtype=np.int64)
    ok[left] = differ <= (total - 2 * least)[left]
    return ok


def meeting(gram: np.ndarray, cls: np.ndarray, size: np.ndarray, at: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of classes (n, 2) that connect what may link, among rows by n-gram and size."""
    size, at = size.astype(np.int64), at.astype(np.int64)
    begins = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[begins, len(gram)])
    group = np.repeat(np.arange(len(counts)), counts)
    found = [np.zeros((0, 2), np.int64)]
    few = np.flatnonzero(counts[group] <= FEW)
    ends = np.searchsorted((group << 40) + size, (group[few] << 40) + 100 * size[few] // percent, side="right")
    most = np.cumsum(ends - few - 1)
    for part in np.split(few, np.searchsorted(most, np.arange(PAIRS, most[-1], PAIRS))) if len(few) else ():
        with_ = ends[np.searchsorted(few, part)] - part - 1
        a = np.repeat(part, with_)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(with_) - with_, with_)
        ok = (cls[a] != cls[b]) & may_link(size, at, sketch, a, b, percent)
        found.append(np.unique(np.stack([cls[a[ok]], cls[b[ok]]], 1), axis=0))
    for k in np.flatnonzero(counts > FEW):  # rows that are connected already aren't compared again
        begin, end = int(begins[k]), int(begins[k] + counts[k])
        _, own = np.unique(np.stack([cls[begin:end], size[begin:end], at[begin:end]], 1), axis=0, return_index=True)
        own = begin + np.sort(own)
        sizes, open_ = size[own], np.ones(len(own), bool)
        for first in range(len(own)):
            stack = [first] if open_[first] else []
            open_[first] = False
            while stack:
                i = stack.pop()
                low, high = np.searchsorted(sizes, [-(-percent * int(sizes[i]) // 100), 100 * int(sizes[i]) // percent + 1])
                others_ = low + np.flatnonzero(open_[low:high])
                if len(others_):
                    new = others_[may_link(size, at, sketch, np.full(len(others_), own[i]), own[others_], percent)]
                    open_[new] = False
                    stack += new.tolist()
                    found.append(np.stack([np.full(len(new), cls[own[i]]), cls[own[new]]], 1))
    pairs = np.concatenate(found)
    return np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)


class Node:
    """A run of n-grams, the nodes after it, and what is stored below: the least
    and largest size of a set, and one of them where all are known to connect."""

    __slots__ = ("run", "after", "ends", "low", "high", "label")

    def __init__(self, run, size, item):
        self.run, self.after, self.ends = run, {}, []
        self.low = self.high = size
        self.label = item


class PrefixTree:
    """Sets as ordered int arrays, and the union of those that link."""

    def __init__(self, sets: list[np.ndarray], percent: int, known: list[int] | None = None):
        self.sets, self.percent = sets, percent
        self.up = list(range(len(sets)))
        self.root = Node(np.zeros(0, np.int64), 0, None)
        self.root.low, self.root.high = 1 << 60, 0
        self.links: list[tuple[int, int]] = []
        first: dict[int, int] = {}
        for i, k in enumerate(known or []):
            self.up[i] = first.setdefault(k, i)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def union(self, a: int, b: int) -> None:
        self.links.append((a, b))
        self.up[self.find(a)] = self.find(b)

    def insert(self, item: int) -> None:
        own, node, at = self.sets[item], self.root, 0
        while True:
            node.low, node.high = min(node.low, len(own)), max(node.high, len(own))
            if node.label is not None and self.find(node.label) != self.find(item):
                node.label = None
            if at == len(own):
                node.ends.append(item)
                return
            child = node.after.get(int(own[at]))
            if child is None:
                child = Node(own[at:], len(own), item)
                child.ends.append(item)
                node.after[int(own[at])] = child
                return
            run = child.run
            most = min(len(run), len(own) - at)
            differ = np.nonzero(run[:most] != own[at : at + most])[0]
            same = int(differ[0]) if len(differ) else most
            if same < len(run):  # the run is split where the two part
                rest = Node(run[same:], 0, child.label)
                rest.after, rest.ends, rest.low, rest.high = child.after, child.ends, child.low, child.high
                child.run, child.after, child.ends = run[:same], {int(run[same]): rest}, []
            node, at = child, at + same

    def walk(self, item: int) -> None:
        """Unites ``item`` with every stored set that it links with and isn't
        connected to yet."""
        own, percent = self.sets[item], self.percent
        size = len(own)
        stack = [(self.root, 0, 0, 0, None)]
        while stack:
            node, depth, at, overlap, parent = stack.pop()
            if node.label is not None and self.find(node.label) == self.find(item):
                continue
            if not size * percent <= 100 * node.high or not percent * node.low <= 100 * size:
                continue
            if len(node.run):
                stop = at + int(np.searchsorted(own[at:], node.run[-1], side="right"))
                if stop > at:
                    own_part = own[at:stop]
                    place = np.searchsorted(own_part, node.run)
                    place[place == len(own_part)] = len(own_part) - 1
                    overlap += int((own_part[place] == node.run).sum())
                depth, at = depth + len(node.run), stop
            # 100 o >= p (a + b - o): the least overlap for the smallest set below.
            least = -(-percent * (size + max(node.low, depth)) // (100 + percent))
            if overlap + min(size - at, node.high - depth) < least:
                continue
            for end in node.ends:
                if linked(overlap, size, len(self.sets[end]), percent) and self.find(end) != self.find(item):
                    self.union(item, end)
            for child in node.after.values():
                stack.append((child, depth, at, overlap, node))


def join_sets(ids: list[int], sets: list[np.ndarray], bitmap: np.ndarray, percent: int, side: list[int] | None = None, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what links connect among ``sets``. With ``side`` only
    sets of side 1 walk, among those of side 0."""
    every = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    place = np.empty(len(every), np.int64)
    place[np.argsort(steps(every, bitmap), kind="stable")] = np.arange(len(every))
    ranks = [np.sort(place[np.searchsorted(every, s)]) for s in sets]
    tree = PrefixTree(ranks, percent, known)
    order = sorted(range(len(ranks)), key=lambda i: (len(ranks[i]), ids[i]))
    if side is None:
        for i in order:
            tree.walk(i)
            tree.insert(i)
    else:
        for i in order:
            if side[i] == 0:
                tree.insert(i)
        for i in order:
            if side[i] == 1:
                tree.walk(i)
    return [(ids[a], ids[b]) for a, b in tree.links]


def stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of what the links connect, each id with the smallest: chains take no rounds later."""
    up: dict[int, int] = {}

    def find(i: int) -> int:
        while (to := up.setdefault(i, i)) != i:
            up[i] = i = up[to]
        return i

    for pair in links:
        low, high = sorted(map(find, pair))
        up[high] = low
    return [(i, find(i)) for i in list(up) if find(i) != i]


def summaries(texts: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, digest) of every document."""

    @returning
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [gram_set(text.as_py(), n) for text in batch.column(1)]
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest"])

    return written(texts.mapInArrow(rows, "doc_id bigint, n_shingles bigint, digest binary"), "summaries")


def bits_for(n_grams: int) -> int:
    """log2 of a bitmap's bits that leaves room for the n-grams that some 10⁹ share."""
    return min(MOST_BITS, max(BITS, (n_grams // 4).bit_length()))


def shared_bitmap(texts: DataFrame, n: int, bits: int) -> np.ndarray:
    """Four bits for each of 2 ** (bits - 2) places: one for each of STEPS that a
    counted n-gram there reaches."""

    @returning
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [counted(gram_set(text.as_py(), n)) for text in batch.column(0).slice(at, 256)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["gram"])

    grams_ = texts.select("text").mapInArrow(rows, "gram bigint")
    several = grams_.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    slot = F.col("gram").bitwiseAND(F.lit((1 << (bits - 2)) - 1).cast("bigint"))
    reached = sum((F.when(F.col("n") >= at, 1 << i).otherwise(0) for i, at in enumerate(STEPS)), F.lit(0)).cast("bigint")
    four = F.call_function("shiftleft", reached, (slot.bitwiseAND(F.lit(15).cast("bigint")) * 4).cast("int"))
    words = several.groupBy(F.shiftright(slot, 4).alias("word")).agg(F.bit_or(four).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bitmap


def banded(inside: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``inside`` (cls, size, block) with ``wide``, band and tile, and of blocks beyond
    TILE sets (block, band, tiles, above, below): the tiles of a band and of those beside it.
    A tile's number is its band's above TILE_BITS bits. Other blocks are one tile."""
    blocks = inside.groupBy("block").agg((F.count(F.lit(1)) > TILE).alias("wide"))
    # Of two sets that link the larger has 100 / percent times the other's size at most;
    # the factor is a trifle wider, so that rounded logarithms can't skip a band.
    step = math.log(100 / min(percent, 99)) * (1 + 1e-9)
    band = F.when(F.col("wide"), F.floor(F.log(F.col("size")) / step)).otherwise(0).cast("bigint")
    sized = inside.join(blocks, "block").withColumn("band", band)
    counts = sized.groupBy("block", "wide", "band").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("bigint").alias("tiles"))
    own = F.shiftleft("band", TILE_BITS) + F.pmod(F.xxhash64("cls"), F.col("tiles"))
    placed = sized.join(counts.drop("wide"), ["block", "band"]).select("first", "digest", "block", "wide", "band", own.alias("tile"))
    bands = counts.filter("wide").drop("wide")
    for name, to in (("above", 1), ("below", -1)):
        bands = bands.join(counts.select("block", (F.col("band") - to).alias("band"), F.col("tiles").alias(name)), ["block", "band"], "left")
    return placed, bands


def others() -> Column:
    """The tiles that a tile of a row (band, tiles, above, below) is paired with, itself among them."""
    of = lambda band, tiles: F.when(tiles > 0, F.sequence(F.shiftleft(band, TILE_BITS), F.shiftleft(band, TILE_BITS) + tiles - 1))
    none = F.array().cast("array<bigint>")
    band = F.col("band")
    return F.concat(of(band, F.col("tiles")), F.coalesce(of(band + 1, F.col("above")), none), F.coalesce(of(band - 1, F.col("below")), none))


def candidates(texts: DataFrame, n: int, percent: int, told: Broadcast[np.ndarray]) -> DataFrame:
    """Pairs (a, b) of classes that connect all that may link, by what rows of one n-gram tell."""
    names = ["gram", "cls", "size", "at", *(f"s{i}" for i in range(WORDS))]

    @returning
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = {class_of(digest(own)): own for text in batch.column(0).slice(at, 256) if len(own := gram_set(text.as_py(), n))}
                gram, number, *rest = heads(list(sets.values()), told.value, percent)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, np.array([*sets, 0], np.int64)[number], *rest)], names)

    @returning
    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            columns = [c.to_numpy() for c in pa.Table.from_batches(held).columns]
            found = meeting(*columns[:4], np.stack(columns[4:], 1), percent)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        held: list[pa.RecordBatch] = []  # the rows of an n-gram come one after another
        for batch in filter(len, batches):
            gram = batch.column(0).to_numpy()
            begin = int(np.flatnonzero(gram != gram[-1])[-1]) + 1 if gram[0] != gram[-1] else 0
            if held and gram[0] != held[-1].column(0)[-1].as_py():
                yield met(held)
                held = []
            if begin:
                yield met([*held, batch.slice(0, begin)])
                held = []
            held.append(batch.slice(begin))
        if held:
            yield met(held)

    shape = "gram bigint, cls bigint, size int, at int, " + ", ".join(f"s{i} bigint" for i in range(WORDS))
    by_gram = texts.select("text").mapInArrow(rows, shape).repartition("gram").sortWithinPartitions("gram", "size")
    return by_gram.mapInArrow(pairs, "a bigint, b bigint").distinct()


def join(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: its component holds
    all that links, 100 * intersection >= percent * union, lead to."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = summaries(texts, n)
    n_grams = own.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    told = spark.sparkContext.broadcast(shared_bitmap(texts, n, bits_for(n_grams)))
    classes = written(own.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("size")), "classes")
    blocks = written(components(candidates(texts, n, percent, told)), "blocks")
    # class_of(digest), as Spark says it: the first eight bytes, the last one leading.
    code = F.hex("digest")
    turned = F.concat(*[F.substring(code, 15 - 2 * i, 2) for i in range(8)])
    high = F.conv(F.substring(turned, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(turned, 9, 8), 16, 10).cast("bigint")
    numbered = classes.withColumn("cls", F.shiftleft(F.when(high >= 1 << 31, high - (1 << 32)).otherwise(high), 32).bitwiseOR(low))
    inside = numbered.join(blocks.select(F.col("id").alias("cls"), F.col("component").alias("block")), "cls")
    placed, bands = banded(inside, percent)
    held = written(texts.join(placed.withColumnRenamed("first", "doc_id"), "doc_id"), "members")

    def group(pairs: bool):
        def links(table: pa.Table) -> pa.Table:
            order = told.value
            ids, sets, side, known = [], [], [], []
            for row in table.select([c for c in table.column_names if c in ("doc_id", "text", "digest", "side", "known")]).to_pylist():
                grams_ = gram_set(row["text"], n)
                if digest(grams_) == row["digest"]:
                    ids.append(row["doc_id"])
                    sets.append(grams_)
                    side.append(row.get("side"))
                    known.append(row.get("known"))
            found = join_sets(ids, sets, order, percent, side if pairs else None, known if pairs else None)
            label = dict(zip(ids, known)) if pairs else {i: i for i in ids}
            found = stars([(label[x], label[y]) for x, y in found])
            return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

        return links

    one = held.select("block", "tile", "doc_id", "digest", "text")
    links = written(one.groupBy("block", "tile").applyInArrow(group(False), "a bigint, b bigint"), "links")
    wide = held.filter("wide")
    if not wide.isEmpty():
        # A set is in one tile, whose links lead to the smallest id; an id of several texts is
        # linked in each of their tiles, and connected with any of these.
        so_far = links.groupBy(F.col("a").alias("doc_id")).agg(F.min("b").alias("known"))
        labelled = wide.join(so_far, "doc_id", "left").withColumn("known", F.coalesce("known", "doc_id"))
        other = labelled.join(bands, ["block", "band"]).withColumn("other", F.explode(others())).filter("other <> tile")
        pairs = other.select("block", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"), (F.col("tile") > F.col("other")).cast("int").alias("side"), "known", "doc_id", "digest", "text")
        across = pairs.groupBy("block", "t", "u").applyInArrow(group(True), "a bigint, b bigint")
        links = written(links.unionByName(across), "links")
    dropped(blocks, held)
    # Classes that one document's texts belong to are linked as well.
    apart = own.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low < high")
    firsts = own.join(apart.select("doc_id"), "doc_id").join(classes, "digest").select("doc_id", "first").distinct()
    least = firsts.groupBy("doc_id").agg(F.min("first").alias("b"))
    same = firsts.join(least, "doc_id").filter("first <> b").select(F.col("first").alias("a"), "b")
    joined = components(links.unionByName(same)).select(F.col("id").alias("first"), "component")
    named = classes.join(joined, "first", "left").select("digest", F.coalesce("component", "first").alias("component"))
    rows = own.join(named, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    by_id = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("of_id"))  # a text without words beside one that has some
    return rows.join(by_id, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("of_id", "component_id").alias("component_id"))
