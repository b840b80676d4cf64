"""Divergence, personal data and filter audit against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from songfield.llm import divergence, filteraudit, personal

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SCHEMA = "doc_id bigint, text string, lang string, source string, part string, n bigint, digest string, term string, spans string, kept string"


def table(spark, rows):
    """Documents beside columns that are called as the operators' own."""
    return spark.createDataFrame([(*r, "x", 1, "y", "z", "s", "k") for r in rows], SCHEMA)


# --- divergence -------------------------------------------------------------------


def far_apart(rows, held, top):
    """Plain Python over (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [re.findall(divergence.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t)) for _, _, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        of = collections.Counter(w for r, t in zip(rows, terms) if r[0] == lang for w in set(t))
        kept = [w for w, n in of.items() if n >= held]
        counts = {s: collections.Counter() for la, s, _ in rows if la == lang}
        for r, t in zip(rows, terms):
            if r[0] == lang:
                counts[r[1]].update(w for w in t if w in set(kept))
        whole = sum(counts.values(), collections.Counter())
        p = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}  # noqa: E731, B023
        q, own = p(whole), {s: p(c) for s, c in counts.items()}
        for s in counts:
            pair = [(o, sum(abs(own[s][w] - own[o][w]) for w in kept)) for o in counts if o != s]
            term = [(w, own[s][w] - q[w]) for w in kept if counts[s][w] and own[s][w] > q[w]]
            for part, found in (("pair", pair), ("term", sorted(term, key=lambda x: (-x[1], x[0].encode()))[:top])):
                out += [(lang, s, part, w, v, k + 1) for k, (w, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())))]
    return sorted(out)


def test_divergence_is_brute_force(spark):
    rng = random.Random(3)
    words = ["Kalo", "neru", "été", "Été", "漢字", "ta", "\U00010400x", "￮y", "mivel", "ra-st", "o'gor", "zz9z"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "\U00010400", "￮", None, ""]), rng.choice([None, "", " 12 \n", " ".join(rng.choices(words, k=rng.choice([1, 5, 30])))])) for _ in range(300)]
    rows += [("fr", "alone", "once"), ("it", "x", None), ("it", "y", "7"), ("en", "long", "kalo " * 50_000)] + [("en", "s1", "copy ta ta")] * 40
    docs = table(spark, [(i, t, la, s) for i, (la, s, t) in enumerate(rows)])
    found = divergence.divergence(docs, held=20, top=4)
    assert sorted(map(tuple, found.select("lang", "source", "part", "item", "value", "rank").collect())) == far_apart(rows, 20, 4)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_probabilities_beyond_64_bits_are_exact(spark):
    cases = [(0, 0, 1), (9_223_372_031, 9_223_372_032, 7), (9_223_372_030_000, 10_000_000_000_000, 10**9), (10**18, 3 * 10**18, 10**6)]
    got = spark.createDataFrame(cases, "c bigint, n bigint, v bigint").select(divergence.probability(*map(__import__("pyspark.sql.functions", fromlist=["col"]).col, "cnv"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in cases]


# --- filter audit -----------------------------------------------------------------


def audited(rows, labels):
    """Plain Python over (doc_id, text, lang), row by row and order by order."""
    texts = [t or "" for _, t, _ in rows]
    firsts = {}
    for (i, _, _), t in zip(rows, texts):
        if i is not None:
            firsts[t] = min(i, firsts.get(t, i))
    fails = []
    for (i, _, _), t in zip(rows, texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append({"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and firsts[t] < i})
    good, toxic = ({i for i, *y in labels if i is not None and y[k] == 1} for k in (0, 1))
    out = []
    for part in {la or "" for _, _, la in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        removed_by = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone = [i for i, f in left if f[x]]
                left = [(i, f) for i, f in left if not f[x]]
                removed_by[x] += len(gone)
                out.append([part, "".join(order), k + 1, len(left), len(gone), sum(f[x] for _, f in own) - len(gone), sum(f[x] and sum(f.values()) == 1 for _, f in own), sum(i in good for i in gone), sum(i in toxic for i in gone), x])
        for r in out:
            if r[0] == part:
                r[-1] = removed_by[r[-1]]
    return sorted(map(tuple, out))


def test_filter_audit_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filteraudit, "BLOCK", 50)  # several blocks a partition
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["ka", "lo", "MI", "ne#", "Ru", f"w{rng.randrange(400)}"]) for _ in range(rng.choice([3, 90, 120, 300]))) for _ in range(60)]
    texts += [None, "", " \n\x0b ", "A" * 300_000, "word " * 100_000, "\x85 no space  here"]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None])) for i in range(400)]
    rows += [(None, "", "en"), (None, texts[0], "en"), (3, texts[0], "de"), (3, texts[0], "de"), (1000, texts[0], "xx")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 400, 2)] + [(None, 1, 1), (5, 0, 1), (5, 1, 0)]
    docs = table(spark, [(i, t, la, "s") for i, t, la in rows])
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, filteraudit.audit(docs.repartition(3), marks).select(*columns).collect())) == audited(rows, labels)
    assert len(audited(rows, labels)) == 4 * 600
    assert filteraudit.audit(docs.limit(0), marks).count() == 0
    assert filteraudit.audit(docs, marks.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


# --- personal data ----------------------------------------------------------------


def base(text):
    return sorted((m.start(), k, m.end()) for k, n in enumerate(personal.KINDS) for m in re.finditer(PATTERNS[n], text) if personal.passes(n, m.group()))


@pytest.mark.parametrize("alphabet", ["01.9 +-(a@é", "ab.@-%", "0123456789 -", "1.2\n"])
def test_base_spans_are_the_patterns(alphabet):
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert personal.base_spans(text)[0] == base(text)


def test_long_runs_take_no_square_of_their_length():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "a@" * 100_000, "+1" + "(" * 300_000, "1." * 100_000):
        personal.base_spans(text)
    assert personal.octets("0" * 5000 + "255.1.1.1") and not personal.octets("1" * 5000 + ".1.1.1")


def card(rng, n=16):
    digits = "".join(rng.choice("123456789") for _ in range(n - 1))
    return next(digits + d for d in "0123456789" if personal.luhn(digits + d))


def made(rng, kind):
    if kind == 0:
        return f"{rng.choice(['kalo', 'neru.st', 'ta'])}.{rng.randrange(100):02}@mail{rng.randrange(10)}.example.com"
    if kind == 1:
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    return card(rng) if kind == 2 else f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(10000):04}"


@pytest.fixture(scope="module")
def letters(spark):
    """Texts with personal data, of which every tenth has two neighbours that the
    patterns run together; and what lies where."""
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(["kalo", "neru", "ta", "mivel", "été"]) for _ in range(n))
    rows, lost = [], []
    for i in range(400):
        text = prose(30) + " " + made(rng, i % 4) + " " + prose(rng.choice([5, 60])) + " " + made(rng, rng.randrange(4)) + " " + prose(10)
        if i % 10 == 0:
            a, b = (card(rng), card(rng)) if i % 20 else (made(rng, 3), made(rng, 1))
            at = len(text) + 1
            text += f" {a} {b} " + prose(8)
            lost += [(i, at, at + len(a))] + ([(i, at + len(a) + 1, at + len(a) + 1 + len(b))] if i % 20 else [])
        rows.append((i, text, "en", "s"))
    rows += [(1000 + i, prose(80) + f' token = "{hashlib.sha1(str(i).encode()).hexdigest()}" ' + prose(5), "en", "s") for i in range(40)]
    rows += [(2000, None, "en", "s"), (2001, "", None, None), (None, "me a.b@c.d", "en", "s"), (5, rows[5][1], "en", "s"), (2002, ("x" * 997 + " 9 ") * 1200, "en", "s")]
    return rows, lost


def test_personal_data_keeps_the_base_and_finds_what_it_loses(spark, letters):
    rows, lost = letters
    got = personal.detect(table(spark, rows).repartition(4)).collect()
    assert len(got) == len(rows)
    texts = collections.defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(t or "")
    spans = collections.defaultdict(set)
    for r in got:
        text = texts[r["doc_id"]][0]
        own = base(text)
        assert [r[f"n_{k}"] for k in personal.KINDS] == [sum(k == x[1] for x in own) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in own).encode()).hexdigest()
        assert set(filter(None, r["spans"].split(","))) >= {f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in own}
        added = [(x["start"], x["end"], x["kind"]) for x in r["added"]]
        assert len(r["spans"].split(",")) == len(own) + len(added) or not r["spans"]
        taken = sorted([(s, e) for s, _, e in own] + [(s, e) for s, e, _ in added])
        for s, e, kind in added:
            assert personal.valid(personal.KINDS.index(kind), text[s:e])
            assert sum(a < e and s < b for a, b in taken) == 1
        spans[r["doc_id"]] |= {(s, e) for s, e in taken}
    found = sum((s, e) in spans[i] for i, s, e in lost)
    assert found >= 0.9 * len(lost), (found, len(lost))
    assert not any(r["added"] for r in got if r["doc_id"] is not None and r["doc_id"] >= 1000)
    again = personal.detect(table(spark, rows).repartition(2)).collect()
    assert collections.Counter(map(str, got)) == collections.Counter(map(str, again))
    assert personal.detect(table(spark, rows).limit(0)).count() == 0
    assert personal.detect(table(spark, [(1, "nothing here", "en", "s")])).first()["spans"] == ""


def test_gradients_are_those_of_the_likelihood():
    rng = np.random.default_rng(0)
    model = personal.Tagger.fresh(1)
    model.step += rng.normal(0, 0.3, model.step.shape).astype(np.float32)
    for name, value in vars(model).items():
        setattr(model, name, value.astype(np.float64))
    x = personal.symbols(["call +1 (509) 555-6973 now", "mail a.b@c.example.com"])
    tags = np.stack([personal._tagged(26, [(5, 3, 22)]), personal._tagged(22, [(5, 0, 22)])])

    def loss():
        y = model.emissions(x, model.hidden(x))
        move, start = model.step + personal.ALLOWED, np.where(np.arange(personal.TAGS) % 2 == 0, 0.0, 0.0)
        alpha = y[:, 0] + start
        gold = np.take_along_axis(y, tags[:, :, None], 2).sum()
        for t in range(1, x.shape[1]):
            alpha = y[:, t] + personal._logsum(alpha[:, :, None] + move, 1)
            gold += move[tags[:, t - 1], tags[:, t]].sum()
        return (personal._logsum(alpha, 1).sum() - gold) / len(x)

    grads = model.gradients(x, tags)
    for name, at in (("table", (0, personal.symbols(["5"])[0, 0], 3)), ("loop", (1, 2, 5)), ("out", (0, 4, 7)), ("bias", (8,)), ("step", (0, 7))):
        value, eps = getattr(model, name), 1e-4
        value[at] += eps
        high = loss()
        value[at] -= 2 * eps
        low = loss()
        value[at] += eps
        assert abs((high - low) / (2 * eps) - grads[name][at]) < 2e-3 * max(1, abs(grads[name][at])), name


def test_links_of_a_tile_lead_to_its_smallest_id():
    """A chain of links went on as a chain, which took rounds to be put together."""
    import random

    from songfield.llm import jaccard

    chain = [9, 3, 7, 1, 8, 2, 6, 5, 4]
    links = list(zip(chain, chain[1:])) + [(11, 10)]
    random.Random(1).shuffle(links)
    assert sorted(jaccard.stars(links)) == [(i, 1) for i in range(2, 10)] + [(11, 10)]
    assert jaccard.stars([(5, 5)]) == [] and jaccard.stars([]) == []


@pytest.mark.parametrize("few", [128, 2])
def test_what_links_meets_in_one_range_at_least(monkeypatch, few):
    """Sets of all sizes around the bounds from which they are dealt, some of them near copies."""
    from songfield.llm import jaccard

    monkeypatch.setattr(jaccard, "SPLIT", 20)
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "PAIRS", 50)
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**64, 4000, np.uint64)
    sets = []
    for size in [*range(1, 40), *range(66, 102), *range(300, 330), 1300]:
        own = rng.choice(pool, size, replace=False)
        sets.append(np.unique(own))
        for _ in range(2):
            most = size // 9 + 1
            sets.append(np.unique(np.concatenate([own[rng.integers(0, most) :], rng.choice(pool, rng.integers(0, most))])))
    bitmap = rng.integers(0, 2**64, 1 << 6, np.uint64) | np.uint64(0x1111111111111111)  # no n-gram is its set's own
    for percent in (80, 100):
        gram, number, size, at, *words = jaccard.heads(sets, bitmap, percent)
        order = np.lexsort((size, gram))
        met = jaccard.meeting(gram[order], number[order], size[order], at[order], np.stack(words, 1)[order], percent)
        block = {i: i for i in range(len(sets))}
        for a, b in jaccard.stars(met.tolist()):
            block[a] = b
        linked = [(a, b) for a in range(len(sets)) for b in range(a) if jaccard.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), percent)]
        assert all(block[a] == block[b] for a, b in linked) and (percent == 100 or len(linked) > 150)
        assert len(set(block.values())) > len(sets) / 4 and len(met) < 8 * len(sets)


def test_texts_that_have_halves_in_common_stay_out_of_blocks(spark, monkeypatch):
    """Each text is a half of the one before and a half of the next: a chain was one block,
    whose work grew with its square."""
    from songfield.llm import jaccard

    half = lambda n, i: [f"w{n}x{i}x{k}" for k in range(n)]
    texts = [" ".join(half(n, i) + half(n, i + 1)) for n in (50, 200, 700) for i in range(20)]
    rows = spark.createDataFrame([*enumerate(texts), (90, texts[7] + " more"), (91, texts[46] + " more")], "doc_id bigint, text string")
    held, written = {}, jaccard.written

    def counting(table, name):
        out = written(table, name)
        held[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "written", counting)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(rows, n=5, percent=80).collect()}
    assert got == {i: i for i in range(60)} | {90: 7, 91: 46}
    assert held["members"] == 4
