"""The corpus operators against brute force, libraries and round trips."""

import collections
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from songfield.llm import archives, jaccard, lattice, mixing, nearest, pieces, quality, sharding, substrings, tokencounts, toxicity

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "ta") for b in ("", "n", "ra", "st", "vel", "gor")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, rows):
    """Documents with null and clashing columns beside."""
    return spark.createDataFrame([(i, t, "en", s, 0, None) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    base = [text(rng, rng.choice([3, 30, 80, 200])) for _ in range(30)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    for i in range(8):  # near copies: some words of a longer text changed
        words = base[i + 10].split()
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((100 + i, " ".join(words), "s0"))
    rows += [(200, base[0], None), (201, base[0].upper(), "s1"), (202, "", "s1"), (203, None, "s1"), (204, " \n\t ", "s1"), (205, "one two", "s2"), (206, "ONE two", "s2"), (None, base[1], "s1"), (207, base[2], "s1"), (207, base[2], "s1")]
    passage = text(rng, 60)
    rows += [(300 + i, f"{text(rng, 40)} {passage} {text(rng, 40)}", "s2") for i in range(4)]
    return table(spark, rows).cache()


# --- sharding --------------------------------------------------------------------


def test_shards_are_even_gapless_and_stable(spark, docs):
    got = sharding.shard(docs.select("doc_id", "text"), 8).collect()
    assert len(got) == docs.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = sharding.shard(docs.select("doc_id", "text").repartition(3), 8).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    assert sharding.shard(docs.limit(0).select("doc_id"), 8).count() == 0


def test_draws_follow_the_law():
    rng = np.random.default_rng(3)
    got = np.bincount([sharding.draw(rng, 4, 6, 5) for _ in range(20000)], minlength=5) / 20000
    want = np.array([6, 60, 120, 60, 6]) / 252
    assert np.abs(got - want).max() < 0.015
    assert sharding.draw(rng, 0, 5, 3) == 0 and sharding.draw(rng, 5, 0, 3) == 3
    m = sharding.communication([5, 0, 9, 3], 4, 1)
    assert m.sum(1).tolist() == [5, 0, 9, 3] and m.sum(0).tolist() == [5, 4, 4, 4]


# --- quality ---------------------------------------------------------------------


def plain_quality(t):
    t = t or ""
    words = t.encode().split()
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    seen = collections.defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, docs):
    extra = table(spark, [(1, "a b c d e f g h " * 5, "x"), (2, "é# * $%\nsame\nsame\n\n same", "x"), (3, "x" * 5000, "x"), (4, "a\x0bb\x0cc\rd\x85e f", "x"), (5, "w " * 30000, "x")])
    for r in quality.quality(docs.unionByName(extra)).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_quality(r["text"]), r["text"]
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_filters_measure_once(spark, docs):
    assert quality.quality(docs).filter("kept").select("doc_id").count() == sum(r["kept"] for r in quality.quality(docs).collect())


def test_ablations(spark, docs):
    led = quality.ledger(quality.measure(docs)).cache()
    rows = led.collect()
    for r in quality.ablations(led).collect():
        bit = quality.mask((r["rule"],))
        whole = quality.mask(quality.POLICIES[r["policy"]])
        assert r["failed"] == sum(bool(x["fail_bits"] & bit) for x in rows)
        assert r["alone"] == sum(x["fail_bits"] & whole == bit for x in rows)


# --- SentencePiece and token counts --------------------------------------------------


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    texts = ["", None, "  Hello  wörld\n\tfoo ", "▁▁x ▁", "日本語テキスト 😀😀 don't stop... ((( ==== >>>>", "a" * 3000, " " * 37 + "x", " \n \n\n  ", "x² y³."]
    return texts + ["".join(rng.choice("aeinrst  .,'(\n)-=>_0123éßд日😀") for _ in range(200)) for _ in range(60)]


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The public model's pieces with other scores, as a unigram model."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(pieces.DEFAULT_MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    rng = random.Random(5)
    for i, p in enumerate(proto.pieces):
        if p.type == pieces.NORMAL:
            p.score = -6 - i / 3000 - rng.random()
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_ids_are_the_librarys(spark, odd_texts, unigram, kind):
    import sentencepiece

    path = pieces.DEFAULT_MODEL if kind == "bpe" else unigram
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = table(spark, [(i, t, "x") for i, t in enumerate(odd_texts)])
    got = {r["doc_id"]: r for r in lattice.decode(lattice.encode(rows, path, scores="model"), path).collect()}
    for i, t in enumerate(odd_texts):
        want = library.encode(t or "")
        if kind == "bpe":
            assert list(got[i]["ids"]) == want, t
        else:  # equal sums may be cut in several ways
            assert abs(sum(map(library.get_score, got[i]["ids"])) - sum(map(library.get_score, want))) < 1e-2
        assert got[i]["text"] == (t or "").replace("▁", " ")


def plain_viterbi(text, own):
    """The cheapest cut of a whole text, looked for at every place, without words."""
    text = " " + text.replace("▁", " ") if text else ""
    best = [(0, 0, [])]
    for e in range(1, len(text) + 1):
        options = []
        for s in range(max(0, e - own.longest), e):
            piece = text[s:e]
            if piece in own.id_of:
                options.append((best[s][0] - own.score_of[piece], s, [own.id_of[piece]]))
            elif s == e - 1:
                options.append((best[s][0] - own.unknown_score, s, [own.byte_id[x] for x in piece.encode()]))
        cost, s, ids = min(options)
        best.append((cost, s, ids))
    out, e = [], len(text)
    while e:
        out[:0] = best[e][2]
        e = best[e][1]
    return out


def test_cuts_by_rank_are_the_cheapest(spark, odd_texts, monkeypatch):
    """Whole texts against brute force, whatever the slices; repeats, null ids and wide words too."""
    own = pieces.load(scores="rank")
    texts = [*odd_texts, odd_texts[4], "x" * 1500 + "é" * 600 + " end", "it's a (tale) of " * 4000]
    rows = spark.createDataFrame([*[(i, t, 9) for i, t in enumerate(texts)], (None, "no id", 9), (3, texts[3], 9)], "doc_id bigint, text string, ids int")
    want = collections.Counter({(i, tuple(plain_viterbi(t or "", own))): 1 for i, t in enumerate(texts)})
    want.update([(None, tuple(plain_viterbi("no id", own))), (3, tuple(plain_viterbi(texts[3], own)))])
    for held in (lattice.HELD, 5):
        monkeypatch.setattr(lattice, "HELD", held)
        got = lattice.decode(lattice.encode(rows)).collect()
        assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
        assert all(r["text"] == (texts[r["doc_id"]] or "").replace("▁", " ") for r in got if r["doc_id"] is not None)
    counts = collections.Counter((r["doc_id"], r["n_tokens"]) for r in tokencounts.count_tokens(rows).collect())
    assert counts == collections.Counter((i, len(ids)) for i, ids in want.elements())
    assert lattice.encode(rows.limit(0)).count() == 0 and tokencounts.count_tokens(rows.limit(0)).count() == 0


def test_decode_of_ids_that_arent_there(spark):
    rows = spark.createDataFrame([(1, [-1, 500, 40000, None]), (2, None), (3, []), (4, [1, 0xE6 + 3, 0x97 + 3, 0xA5 + 3])], "doc_id bigint, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in lattice.decode(rows).collect()}
    piece = pieces.load().text_of[500]
    assert got == {1: f"�{piece}��", 2: "", 3: "", 4: "日"}


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_counts_are_the_librarys(spark, odd_texts, unigram, kind):
    import sentencepiece

    path = pieces.DEFAULT_MODEL if kind == "bpe" else unigram
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = table(spark, [(i, t, "x") for i, t in enumerate(odd_texts)])
    got = {r["doc_id"]: r["n_tokens"] for r in tokencounts.count_tokens(rows, path, scores="model").collect()}
    assert got == {i: len(library.encode(t or "")) for i, t in enumerate(odd_texts)}


def test_trie_shares_prefixes():
    trie = tokencounts.Trie(pieces.load())
    for w in sorted({" information", " informal", " inform", " informed"}):
        trie.insert(w)
    assert trie.nodes == len(" inform") + len("al") + len("tion") + len("ed")


# --- columns that clash ------------------------------------------------------------


def test_callers_columns_are_kept_or_refused(spark):
    names = ["shard", "slot", "size", "rate", "target", "source_size", "copies", "copy", "n_words", "kept", "fail_bits", "component_id", "ids", "key"]
    rows = [(i, " ".join(["w%d" % (k % 37) for k in range(40 * i)]), "en", "s", 7, *[99] * len(names)) for i in range(1, 4)] + [(9, None, "en", None, 0, *[99] * len(names))]
    clash = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} int" for n in names))
    for call in (lambda: sharding.shard(clash, 2), lambda: mixing.planned(clash), lambda: mixing.mix(clash), lambda: quality.quality(clash)):
        with pytest.raises(ValueError):
            call()
    for out in (mixing.mix(clash, number=None), quality.accepted(clash), substrings.remove(clash, substrings.find(clash))):
        assert out.columns == clash.columns
        assert all(r[n] == 99 for r in out.collect() for n in names)
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, "")
        assert out.columns == clash.columns and all(r[n] == 99 for r in out.collect() for n in names), name


def test_sharding_query_equals_the_law(spark, docs, tmp_path):
    import zlib

    from songfield.llm import queries

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op1_sharding(spark, str(tmp_path)).collect()
    want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


# --- nearest -----------------------------------------------------------------------


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(300, 16)).astype(np.float32)
    vectors[50:120] = vectors[50]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    rows += [(1000, None, 1), (1050, [0.0] * 16, 1), (1100, [float("nan")] * 16, 1), (1150, [None] + [1.0] * 15, 1), (1200, [1.0] * 8, 1), (1250, [2.0] * 8, 1), (None, [1.0] * 16, 1), (1300, [], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int")
    found = nearest.search(df, F.col("vec_id") % 50 == 0).collect()
    got = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    x = vectors.astype(np.float64)
    for q in range(0, 300, 50):
        score = [(-sum(a * b for a, b in zip(x[q], x[c])) / np.sqrt(sum(a * a for a in x[q]) * sum(a * a for a in x[c])), c) for c in range(300) if c != q]
        want = sorted(score)[:5]
        assert [c for c, _ in got[q]] == [c for _, c in want]
        assert np.allclose([s for _, s in got[q]], [-s for s, _ in want], atol=1e-14)
    assert [c for c, _ in got[1200]] == [1250] and not {1000, 1050, 1100, 1150, 1300} & set(got)
    assert nearest.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(40, 33))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    code, scale, lost = nearest.quantised(a)
    near = nearest.product(code, code) * scale[:, None] * scale[None, :]
    assert (np.abs(near - a @ a.T) <= lost[:, None] + (1 + lost)[:, None] * lost[None, :] + 1e-12).all()


# --- mixing ------------------------------------------------------------------------


def test_targets_fill_up(spark):
    rows = [(i, " ".join(["w"] * n), s) for i, (n, s) in enumerate([(100, "a"), (1, "b"), (30, "c"), (400, None), (0, "d")])]
    got = {r["source"]: r["target"] for r in mixing.targets(table(spark, rows).withColumn("size", mixing.word_count(F.col("text")))).collect()}
    # weights: a 1, b 2, c 3, d 1, null 2
    size = {"a": 100, "b": 1, "c": 30, "d": 0, None: 400}
    weight = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    full, level = set(), 0.0
    while True:
        level = (sum(size.values()) - sum(3 * size[s] for s in full)) / sum(weight[s] for s in size if s not in full)
        new = {s for s in size if weight[s] * level >= 3 * size[s]}
        if new <= full:
            break
        full |= new
    assert {s: round(t, 6) for s, t in got.items()} == {s: round(min(3.0 * size[s], weight[s] * level), 6) for s in size}


def test_mix_emits_copies(spark, docs):
    plan = mixing.planned(docs).collect()
    assert all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) and r["copies"] <= 3 for r in plan)
    mixed = mixing.mix(docs)
    assert mixed.count() == sum(r["copies"] for r in plan)
    assert mixed.columns == [*docs.columns, "copy"]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_sources_come_near_their_targets(spark):
    """One text holds a third of a source's words; ties, null sources and empty texts."""
    rng = random.Random(4)
    sizes = [(s, rng.choice([0, 1, 7, 40, 40, 300])) for s in ("a", "b", "c", "d", None) for _ in range(rng.choice([30, 200]))] + [("a", 4000), ("e", 0), (None, 0)]
    docs = table(spark, [(i, " ".join(["w"] * n) if n else rng.choice([None, ""]), s) for i, (s, n) in enumerate(sizes)] + [(7, "w w w", "b")] * 3)
    for seed in range(4):
        by = collections.defaultdict(list)
        for r in mixing.planned(docs, seed).collect():
            by[r["source"]].append(r)
            assert r["copies"] in (int(r["rate"]), int(r["rate"]) + 1)
        for rows in by.values():
            taken, most = sum(r["size"] * r["copies"] for r in rows), max(9, *(r["size"] for r in rows))
            assert abs(taken - rows[0]["target"]) <= most / 2 + 1e-6


# --- passages and copies -------------------------------------------------------------


def plain_components(rows, percent=85):
    sets, first = {}, {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        grams = frozenset(tuple(words[k : k + 4]) for k in range(len(words) - 3)) or (frozenset([tuple(words)]) if words else frozenset())
        sets.setdefault(i, []).append(grams)
    ids = [i for i in sets if i is not None]
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = find(a), find(b)
                up[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}, sets


@pytest.mark.parametrize("tile", [512, 3])
def test_jaccard_equals_brute_force(spark, docs, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, sets = plain_components(rows)
    got = jaccard.join(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]]
            assert r["n_shingles"] in [len(s) for s in sets[r["doc_id"]]]
    assert jaccard.join(docs.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_sets_that_may_link_are_in_bands_that_are_paired(spark, monkeypatch, percent):
    """Each size with the largest that it may link with, and tiles beside each other."""
    monkeypatch.setattr(jaccard, "TILE", 2)
    sizes = sorted({*range(1, 60), 10**4, *(100 * a // percent for a in (*range(1, 60), 10**4))})
    inside = spark.createDataFrame([(i, i, b"", s, 7) for i, s in enumerate(sizes)], "cls bigint, first bigint, digest binary, size bigint, block bigint")
    placed, bands = jaccard.banded(inside, percent)
    own = {r["first"]: (r["tile"], set(r["o"])) for r in placed.join(bands, ["block", "band"]).select("first", "tile", jaccard.others().alias("o")).collect()}
    assert len(own) == len(sizes)
    for i, a in enumerate(sizes):
        for j, b in enumerate(sizes):
            if 100 * a >= percent * b and 100 * b >= percent * a:
                assert own[i][0] in own[j][1] and own[j][0] in own[i][1], (a, b)
    assert max(len(o) for _, o in own.values()) < len({t for t, _ in own.values()})


def test_ids_are_right_whatever_order_rows_come_in(spark):
    """Rows that come in another order each time they are read, and slices that are made twice."""
    texts = {i: text(random.Random(i), 40 + i) for i in range(60)}

    def shuffled(batches):
        for batch in batches:
            yield batch.iloc[sorted(range(len(batch)), key=lambda _: os.urandom(8))]

    rows = table(spark, [(i, t, "x") for i, t in texts.items()]).repartition(3).select("doc_id", "text").mapInPandas(shuffled, "doc_id bigint, text string")
    spark.conf.set("spark.sql.exchange.reuse", "false")  # so that slices are made twice
    try:
        got = {r["doc_id"]: list(r["ids"]) for r in lattice.encode(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    own = pieces.load(scores="rank")
    assert got == {i: plain_viterbi(t, own) for i, t in texts.items()}


def test_texts_of_one_id_are_one_document(spark):
    a, b = text(random.Random(1), 60), text(random.Random(2), 60)
    rows = table(spark, [(3, a, "x"), (5, a, "x"), (5, b, "x"), (5, None, "x"), (9, b, "x"), (11, text(random.Random(3), 60), "x")])
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in jaccard.join(rows).collect())
    assert got == {(3, 3): 1, (5, 3): 3, (9, 3): 1, (11, 11): 1}


def test_prefix_tree_finds_what_pairs_do():
    rng = random.Random(2)
    for _ in range(60):
        base = [rng.sample(range(120), 40) for _ in range(3)]
        sets = []
        for b in base * 4:
            own = set(b)
            for _ in range(rng.randrange(5)):
                own.discard(rng.choice(b))
                own.add(rng.randrange(120))
            sets.append(np.array(sorted(own), np.uint64))
        ids = list(range(len(sets)))
        links = jaccard.join_sets(ids, sets, np.zeros(1 << (jaccard.BITS - 6), np.uint64), 70)
        up = {i: i for i in ids}

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in links:
            inter = len(np.intersect1d(sets[a], sets[b]))
            assert jaccard.linked(inter, len(sets[a]), len(sets[b]), 70)
            up[find(a)] = find(b)
        for a in ids:
            for b in ids:
                if jaccard.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), 70):
                    assert find(a) == find(b)


def test_compact_windows_cover_each_stretch_once():
    rng = random.Random(3)
    for _ in range(100):
        n, width = rng.randrange(1, 40), rng.randrange(1, 8)
        keys = np.array([(v << 24) | i for i, v in enumerate(rng.sample(range(1, 1000), n))], np.uint64)
        held = collections.Counter()
        for l, c, r in substrings.compact_windows(keys, width):
            for i in range(l, c + 1):
                for j in range(c, r + 1):
                    if j - i + 1 >= width:
                        held[i, j] += 1
                        assert keys[i : j + 1].min() == keys[c]
        assert held == collections.Counter((i, j) for i in range(n) for j in range(i + width - 1, n))


def test_passages_are_found_and_removed(spark, docs):
    got = substrings.find(docs).collect()
    found = collections.defaultdict(set)
    for r in got:
        found[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
        assert r["source_id"] < r["doc_id"] and r["similarity"] >= 0.8
    rows = {r["doc_id"]: (r["text"] or "").encode().split() for r in docs.filter("doc_id IS NOT NULL").collect()}
    first = {}
    for d in sorted(rows):
        w = rows[d]
        own = {tuple(w[i : i + 50]) for i in range(len(w) - 49)}
        for i in range(len(w) - 49):
            if first.get(tuple(w[i : i + 50]), d) != d:
                assert set(range(i, i + 50)) <= found[d]
        for k in own:
            first.setdefault(k, d)
    assert set(range(40, 100)) <= found[301] and not found.get(300)
    left = {r["doc_id"]: r for r in substrings.remove(docs, substrings.find(docs)).filter("doc_id >= 300").collect()}
    assert len(left[301]["text"].split()) <= 82 and len(left[300]["text"].split()) == 140
    assert left[301]["n_chars"] == len(left[301]["text"])
    assert substrings.find(docs.limit(0)).count() == 0


def test_near_passages_hold_whatever_word_is_changed():
    """Every stretch as similar as asked lies in one that is found, and no other is found."""
    rng = np.random.default_rng(5)
    width = 46

    def grams_of(words):
        return substrings.grams(np.array(words, np.uint64), 5)

    for size in (54, 60, 75, 94, 120):
        passage = rng.integers(1, 1 << 60, size).tolist()
        origin = rng.integers(1, 1 << 60, 20).tolist() + passage + rng.integers(1, 1 << 60, 20).tolist()
        changes = [(i,) for i in range(size)] + [(i, j) for i in range(0, size, 3) for j in range(i + 1, size, 4)]
        for places in changes:
            words = list(passage)
            for i in places:
                words[i] = 7
            copy = grams_of(rng.integers(1, 1 << 60, 30).tolist() + words + rng.integers(1, 1 << 60, 30).tolist())
            source = grams_of(origin)
            match = np.concatenate([np.zeros(30, bool), copy[30 : 26 + size] == source[20 : 16 + size], np.zeros(34, bool)])
            got = substrings.passages(copy, source, [-10], width, 0.8)
            sums = np.concatenate([[0], np.cumsum(np.where(match, 1, -8))])
            for s in np.nonzero(match)[0]:
                ends = np.nonzero((sums >= sums[s]) & (np.arange(len(sums)) >= s + width))[0]
                assert not len(ends) or any(a <= s and b >= np.nonzero(match[: ends[-1]])[0][-1] + 1 for a, b, _, _ in got)
            for a, b, d, like in got:
                same = int(match[a:b].sum())
                assert d == -10 and b - a >= width and like == same / (2 * (b - a) - same) >= 0.8
            if len(places) == 1:
                assert got


def test_passages_of_repeated_rows_and_ids(spark):
    """Equal rows are one text; different texts of one id don't mix."""
    rng = random.Random(21)
    whole, other, late = text(rng, 300), text(rng, 300), text(rng, 170)
    start = " ".join(late.split()[:60]) + " " + other
    docs = table(spark, [(1, whole, "s"), (1, whole, "s"), (2, other, "s"), (5, whole, "s"), (5, whole, "s"), (6, start, "s"), (6, late + " " + whole, "s"), (7, late, "s")])
    found = substrings.find(docs)
    got = collections.defaultdict(set)
    for r in found.collect():
        got[r["doc_id"], r["source_id"]].add((r["start_word"], r["end_word"], r["source_start"]))
    assert got[5, 1] == {(0, 300, 0)}
    assert got[6, 1] == {(170, 470, 0)} and got[6, 2] == {(60, 360, 0)}
    covered = {i for (d, s), spans in got.items() if d == 7 for a, b, _ in spans for i in range(a, b)}
    assert covered == set(range(170))
    left = sorted((r["doc_id"], r["text"]) for r in substrings.remove(docs, found).collect())
    assert left == [(1, whole), (1, whole), (2, other), (6, " ".join(late.split()[:60]) + " "), (6, late + " ")]


def test_pipeline_removes_near_copies_by_five_words_and_80_percent(spark):
    import corpus_pipeline

    rng = random.Random(31)
    whole = text(rng, 200).split()
    rows = [(1, " ".join(whole), "s"), (2, " ".join(whole[:90] + text(rng, 15).split() + whole[105:]), "s"), (3, " ".join(whole[:90] + text(rng, 30).split() + whole[120:]), "s")]
    kept = corpus_pipeline.near_duplicates(spark, table(spark, rows), "").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3]


def test_passages_are_found_behind_documents_that_share_less(spark):
    """The smallest documents hold each 5-gram, or pieces of 35 words, of what later ones share whole."""
    rng = random.Random(22)
    rows, near = [], {}
    for i in range(30):
        words = text(rng, 60).split()
        rows.append((i, " ".join(f"{' '.join(words[j : j + 5])} {text(rng, 8)}" for j in range(56)), "s"))
        rows += [(100 + i, f"{text(rng, 60)} {' '.join(words[:35])} {text(rng, 60)}", "s"), (200 + i, f"{text(rng, 60)} {' '.join(words[25:])} {text(rng, 60)}", "s")]
        rows += [(k + i, f"{text(rng, 10 + i)} {' '.join(words[:50])} {text(rng, 50)}", "s") for k in (300, 400)]
        words[rng.randrange(60)] = "changed"
        near[500 + i] = " ".join(words)
    rows += [(i, f"{text(rng, 30)} {near[i]} {text(rng, 30)}", "s") for i in near]
    rows += [(1000 + i, f"{text(rng, 20)} {t} {text(rng, 50)}".replace(t.split()[3], "other", 1), "s") for i, t in near.items()]
    held = collections.defaultdict(set)
    for r in substrings.find(table(spark, rows)).collect():
        held[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
        assert r["similarity"] >= 0.8
    assert all(set(range(10 + i, 60 + i)) <= held[400 + i] for i in range(30))
    assert not any(held[k + i] for k in (0, 100, 200) for i in range(30))
    assert sum(len(held[i + 1000] & set(range(20, 80))) >= 46 for i in near) >= 27


# --- toxicity ------------------------------------------------------------------------


def test_classifier_learns_and_scores_everything(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(10, 60))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(["scumbag", "scumlord", "vileness", "vilest"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    docs = table(spark, [*rows, (700, None, "x"), (701, "", "x"), (702, "?!", "x"), (703, "ka " * 200000, "x")])
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model, bars = toxicity.train(docs, known.filter("doc_id % 4 <> 2"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model, bars).collect()}
    assert len(got) == 604 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [(got[i]["score"] >= 0.3, bool(y)) for i, y in labels if i % 4 == 2]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    none, _ = toxicity.train(docs, known.limit(0))
    assert none.score(np.zeros(0, np.int64)) < 1e-6


def test_toxicity_query_loses_no_language(spark, tmp_path):
    """The query over two languages of which one has a tenth of the labels: recall by
    language on rows it held out, no clean text of either accused in numbers, and a
    defined row for nulls, repeated rows and a language without labels."""
    import zlib

    from songfield.llm import queries

    rng = random.Random(9)
    bad_words = {"aa": ["scumbag", "scumlord", "vileness", "vilest"], "bb": ["zorrask", "zorrimet", "krunfel", "krunfost"]}
    rows, labels = [], []
    for i in range(1500):
        lang = "bb" if i % 10 == 0 else "aa"
        words = [rng.choice(WORDS) + ("o" if lang == "bb" else "") for _ in range(rng.randrange(10, 60))]
        if bad := rng.random() < 0.2:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(bad_words[lang])
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(bad)))
    odd = [(None, "ka po", "aa"), (5, rows[5][1], "aa"), (9001, None, None), (9002, "", "cc")]
    spark.createDataFrame([*rows, *odd], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (9001, None), (None, 1)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = queries.op8_toxicity(spark, str(tmp_path)).collect()
    assert len(found) == len(rows) + len(odd)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in found)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert len({r["score"] for r in found if r["doc_id"] == 5}) == 1
    got, true = {r["doc_id"]: r for r in found}, dict(labels)
    for lang in ("aa", "bb"):
        held = [(got[i]["predicted"], true[i]) for i, _, x in rows if x == lang and got[i]["held_out"]]
        assert sum(p for p, y in held if y) >= 0.8 * sum(y for _, y in held)
        assert sum(p for p, y in held if not y) <= 0.1 * len(held)


def test_rows_of_the_table_go_round():
    numbers, tells = np.arange(0, 4000, 2), np.arange(2000)[::-1].astype(float)
    assert toxicity.table_rows(numbers, tells, 4096).tolist() == list(range(1, 2001))
    rows = toxicity.table_rows(numbers, tells, 256)
    assert rows.min() == 1 and rows.max() < 256
    assert len(set(rows[:192])) == 192 and not set(rows[:192]) & set(rows[192:])
    say = toxicity.even_say(np.array([1.0] * 8 + [0.0] * 8), ["a"] * 7 + [None] + ["a"] * 8)
    assert say[:7].sum() == pytest.approx(4) and say[7] == 4 and (say[8:] == 1).all()


# --- archives ------------------------------------------------------------------------


@pytest.mark.parametrize("version", [1, 2])
def test_archives_round_trip(spark, version):
    import hashlib

    bodies = ["<p>a</p>", "", None, "<p>a</p>", "é\r\n\r\nWARC/1.1\r\n\nhttp://x 0.0.0.0 1 text/html 5\n", "x" * 300000, "", "\n"]
    rows = [(10 + i, None if i == 3 else f"http://h/{i} b#t", b, "keep") for i, b in enumerate(bodies)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, date string")
    got = {r["page_id"]: r for r in archives.archived(pages, version).collect()}
    first = {}
    assert len(got) == len(rows)
    for page, url, body, _ in rows:
        data = (body or "").encode()
        first.setdefault(data, page)
        r = got[page]
        assert r["payload_bytes"] == len(data)
        assert r["payload_digest"] == archives.base32_sha1(data) and len(r["payload_digest"]) == 32
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[data] == page else ("revisit", first[data]))
        assert r["target_uri"] == (url.replace(" ", "%20") if url else "about:blank")
    assert hashlib.sha1(b"").digest()
    assert archives.archived(pages.limit(0), version).count() == 0


def test_broken_archives_are_errors():
    block = archives.version_block(1).encode()
    with pytest.raises(ValueError):
        list(archives.parse_arc(block + b"http://x 0.0.0.0 20240101000000 text/html 99\nshort"))
    with pytest.raises(ValueError):
        list(archives.parse_arc(block + b"http://x text/html 2\nab\n"))


# --- pipeline ------------------------------------------------------------------------


def test_pipeline_runs_on_all_rows(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns, name
        out.write.parquet(str(tmp_path / name.replace(" ", "")))
        now = spark.read.parquet(str(tmp_path / name.replace(" ", "")))
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == now.select("doc_id").distinct().count()


@pytest.mark.parametrize("most", [1, 3, 7, 1000])
def test_sorted_rows_come_in_whole_groups(most):
    import pyarrow as pa

    sizes = [1, 1, 9, 2, 30, 1]
    keys = [k for k, n in enumerate(sizes) for _ in range(n)]
    rows = pa.RecordBatch.from_arrays([pa.array([k // 2 for k in keys]), pa.array([k % 2 for k in keys]), pa.array(range(len(keys)))], ["a", "b", "v"])
    batches = [rows.slice(0, 0), *(rows.slice(at, 4) for at in range(0, len(keys), 4)), rows.slice(0, 0)]
    seen = []
    for group, part, begin in substrings.together(iter(batches), 2, most):
        whole = [2 * a + b for a, b in zip(part["a"].to_pylist(), part["b"].to_pylist())]
        assert [whole[i] for i in begin[group]] == whole and len(begin) == len(set(whole))
        seen += zip(whole, part["v"].to_pylist())
    assert seen == list(zip(keys, range(len(keys))))
    assert not list(substrings.together(iter([rows.slice(0, 0)]), 2, most))
