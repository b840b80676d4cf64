"""Personal data: patterns, and a character-level BiLSTM-CRF for what they lose.

1. One pass over whole texts finds the base spans of each kind, leftmost and non-
   overlapping, and cuts overlapping windows around every digit and at sign. A span
   of any kind holds one of these, so no other place can hold one, and a text
   without them costs a search for one character.
2. A bounded sample of windows, labelled with the base spans in them, trains a
   bidirectional LSTM over characters with CRF transitions, in numpy. Spans of
   several windows are put side by side and cut to other forms as well: there the
   patterns run on into a neighbour, fail their check and lose a span.
3. Every window is decoded by the CRF. A span at a window's edge is left to the
   window that holds it whole; a document's proposals of all its windows are then
   reconciled at once by weighted interval scheduling. One is added if it passes the
   check of its kind, has no letter or digit beside it, and overlaps no base span.

Base spans always stay, and alone make the counts and the digest. A span that the
model adds has up to ``STRIDE`` characters.

A null or empty text has no spans. Rows that repeat an id are each their own row; a
null id is kept. A very long text is one row, its windows are decoded in slices.
Without labelled windows there is no model, and only base spans are found; an empty
table has no rows. Other columns aren't read, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songfield.llm.common import written

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, from one window to the next, and around a digit or at sign.
WIDTH, STRIDE, AROUND = 96, 48, 40
#: Labelled windows that a fit reads at most, hidden units a direction, batches and their size.
SAMPLE, HIDDEN, STEPS, BATCH, RATE = 2000, 16, 220, 48, 0.02
#: Windows that are decoded at once.
TOGETHER = 512

# Each begins where a run of its characters begins: a start further on in the run would
# end alike, so nothing is tried twice however long a run is.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def passes(kind: str, text: str) -> bool:
    """Whether a match of the kind's pattern passes its check."""
    if kind == "ip":
        return octets(text)
    digits = DIGITS.sub("", text)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) of the base spans, sorted; and the matches of some length that
    fail their check, of which nothing can be said."""
    found, failed = [], []
    if "@" in text:
        found += [(s, 0, e) for s, e in emails(text)]
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        for m in pattern.finditer(text):
            if passes(KINDS[kind], m.group()):
                found.append((m.start(), kind, m.end()))
            elif m.end() - m.start() >= 10:
                failed.append(m.span())
    return sorted(found), failed


def windows(text: str) -> list[tuple[int, str]]:
    """(start, characters) of overlapping windows over every place near a trigger."""
    out, reach, begin, end = [], len(text), None, None

    def cut(a: int, b: int) -> None:
        a = max(0, min(a, reach - WIDTH))
        while True:
            out.append((a, text[a : a + WIDTH]))
            if a + WIDTH >= min(b, reach):
                return
            a += STRIDE

    for m in TRIGGER.finditer(text):
        if end is not None and m.start() <= end:
            end = m.start() + AROUND
        else:
            if end is not None:
                cut(begin, end)
            begin, end = max(0, m.start() - AROUND), m.start() + AROUND
    if end is not None:
        cut(begin, end)
    return out


# Symbols: 0 pads, then digits, small and capital letters, other letters, line ends, others, and each other ASCII character.
SYMBOLS = 7 + 95
_ASCII = np.array([2 if 97 <= c <= 122 else 3 if 65 <= c <= 90 else 1 if 48 <= c <= 57 else 5 if c in (9, 10, 13) else 7 + c - 32 if 32 <= c <= 126 else 6 for c in range(128)], np.int16)


def symbols(texts: list[str]) -> np.ndarray:
    """(texts, WIDTH) numbers of the characters' symbols."""
    out = np.zeros((len(texts), WIDTH), np.int16)
    for row, text in zip(out, texts):
        points = np.frombuffer(text[:WIDTH].encode("utf-32-le", "surrogatepass"), np.uint32)
        row[: len(points)] = np.where(points < 128, _ASCII[np.minimum(points, 127)], 4)
    return out


TAGS = 1 + 2 * len(KINDS)  # outside, then for each kind its first and its further characters
NEVER = -1e4
ALLOWED = np.zeros((TAGS, TAGS), np.float32)
for _k in range(len(KINDS)):
    _inside = 2 + 2 * _k
    ALLOWED[:, _inside] = NEVER
    ALLOWED[[_inside - 1, _inside], _inside] = 0


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    table: np.ndarray  # (direction, symbol, 4 * HIDDEN): what a symbol adds to the gates
    loop: np.ndarray  # (direction, HIDDEN, 4 * HIDDEN)
    out: np.ndarray  # (direction, HIDDEN, TAGS)
    bias: np.ndarray  # (TAGS,)
    step: np.ndarray  # (TAGS, TAGS) transitions

    @staticmethod
    def fresh(seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        part = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        table = part(2, SYMBOLS, 4 * HIDDEN, scale=0.3)
        table[:, :, HIDDEN : 2 * HIDDEN] += 1  # gates that keep start open
        return Tagger(table, part(2, HIDDEN, 4 * HIDDEN, scale=0.2), part(2, HIDDEN, TAGS, scale=0.2), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32))

    def hidden(self, x: np.ndarray, trace: list | None = None) -> np.ndarray:
        """(direction, texts, place, HIDDEN), places in the order of the text."""
        both = np.stack([x, x[:, ::-1]])
        n = x.shape[0]
        h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        every = np.empty((2, n, x.shape[1], HIDDEN), np.float32)
        for t in range(x.shape[1]):
            z = h @ self.loop
            z[0] += self.table[0][both[0, :, t]]
            z[1] += self.table[1][both[1, :, t]]
            gate = 1 / (1 + np.exp(-z[..., : 3 * HIDDEN]))
            new = np.tanh(z[..., 3 * HIDDEN :])
            i, f, o = gate[..., :HIDDEN], gate[..., HIDDEN : 2 * HIDDEN], gate[..., 2 * HIDDEN :]
            before, held = h, c
            c = f * c + i * new
            bent = np.tanh(c)
            h = o * bent
            every[:, :, t] = h
            if trace is not None:
                trace.append((before, held, i, f, o, new, bent))
        every[1] = every[1][:, ::-1]
        return every

    def emissions(self, x: np.ndarray, hidden: np.ndarray) -> np.ndarray:
        y = hidden[0] @ self.out[0] + hidden[1] @ self.out[1] + self.bias
        pad = x == 0
        y[pad] = NEVER
        y[pad, 0] = 0
        return y

    def marginals(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each place's tags and of each step's transitions summed over texts."""
        move = self.step + ALLOWED
        n, length, _ = y.shape
        alpha, beta = np.empty_like(y), np.zeros_like(y)
        start = np.where(np.arange(TAGS) % 2 == 0, NEVER, 0).astype(np.float32)
        start[0] = 0
        start[2::2] = 0  # a window may begin inside a span
        alpha[:, 0] = y[:, 0] + start
        for t in range(1, length):
            alpha[:, t] = y[:, t] + _logsum(alpha[:, t - 1, :, None] + move, 1)
        for t in range(length - 2, -1, -1):
            beta[:, t] = _logsum(move + (y[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        whole = _logsum(alpha[:, -1], 1)
        own = np.exp(alpha + beta - whole[:, None, None])
        steps = np.zeros((TAGS, TAGS), np.float64)
        for t in range(1, length):
            steps += np.exp(alpha[:, t - 1, :, None] + move + (y[:, t] + beta[:, t])[:, None, :] - whole[:, None, None]).sum(axis=0)
        return own, steps

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest tags of each place, and their probability there."""
        y = self.emissions(x, self.hidden(x))
        move = self.step + ALLOWED
        best, back = y[:, 0].copy(), np.zeros(y.shape, np.int8)
        for t in range(1, y.shape[1]):
            every = best[:, :, None] + move
            back[:, t] = every.argmax(axis=1)
            best = y[:, t] + every.max(axis=1)
        tags = np.zeros(x.shape, np.int64)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(y.shape[1] - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(len(x)), t, tags[:, t]]
        own, _ = self.marginals(y)
        return tags, np.take_along_axis(own, tags[:, :, None], 2)[:, :, 0]

    def gradients(self, x: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        """Of minus the tags' mean log-likelihood."""
        trace: list = []
        hidden = self.hidden(x, trace)
        own, steps = self.marginals(self.emissions(x, hidden))
        n, length = x.shape
        np.put_along_axis(own, tags[:, :, None], np.take_along_axis(own, tags[:, :, None], 2) - 1, 2)
        own[x == 0] = 0
        own = (own / n).astype(np.float32)
        np.subtract.at(steps, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        grads = {"step": (steps / n).astype(np.float32), "bias": own.sum(axis=(0, 1)), "out": np.stack([np.tensordot(hidden[d], own, ([0, 1], [0, 1])) for d in range(2)])}
        into = np.stack([own @ self.out[0].T, (own @ self.out[1].T)[:, ::-1]])
        both = np.stack([x, x[:, ::-1]])
        table, loop = np.zeros_like(self.table), np.zeros_like(self.loop)
        dh, dc = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        back = self.loop.transpose(0, 2, 1)
        for t in range(length - 1, -1, -1):
            before, held, i, f, o, new, bent = trace[t]
            dh = dh + into[:, :, t]
            dc = dc + dh * o * (1 - bent * bent)
            dz = np.concatenate([dc * new * i * (1 - i), dc * held * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - new * new)], axis=2)
            loop += before.transpose(0, 2, 1) @ dz
            for d in range(2):
                np.add.at(table[d], both[d, :, t], dz[d])
            dh, dc = dz @ back, dc * f
        return grads | {"table": table, "loop": loop}


def _tagged(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(WIDTH, np.int64)
    for s, kind, e in spans:
        a, b = max(0, s), min(e, WIDTH, length)
        tags[a:b] = 2 + 2 * kind
        if 0 <= s < b:
            tags[s] = 1 + 2 * kind
    return tags


def other_form(rng: np.random.Generator, kind: int, text: str) -> str:
    """A phone number without its plus sign or country, half of the time."""
    if kind != 3 or rng.random() < 0.5:
        return text
    bare = text[1:]
    return bare.split(" ", 1)[1] if " " in bare and rng.random() < 0.5 and len(DIGITS.sub("", bare.split(" ", 1)[1])) >= 10 else bare


def example(rng: np.random.Generator, rows: list[tuple[str, list]]) -> tuple[str, np.ndarray]:
    """A labelled window: one of the sample, or one whose span has others beside it."""
    text, spans = rows[rng.integers(len(rows))]
    whole = [x for x in spans if x[0] >= 0 and x[2] <= len(text)]
    if not whole or rng.random() < 0.4:
        return text, _tagged(len(text), spans)
    s, kind, e = whole[rng.integers(len(whole))]
    parts = [(kind, other_form(rng, kind, text[s:e]))]
    for _ in range(rng.integers(0, 3)):
        for _ in range(8):
            near, own = rows[rng.integers(len(rows))]
            fits = [x for x in own if x[0] >= 0 and x[2] <= len(near)]
            if fits:
                a, k, b = fits[rng.integers(len(fits))]
                parts.append((k, other_form(rng, k, near[a:b])))
                break
        if rng.random() < 0.3:
            parts.append((-1, str(rng.integers(1, 1000))))
    rng.shuffle(parts)
    before = text[:s] if not any(x[0] < s for x in spans if x != (s, kind, e)) else " "
    made, found = before[-int(rng.integers(1, 40)) :] or " ", []
    for n, (k, part) in enumerate(parts):
        if n:
            made += (" ", " ", ", ", "\n", " | ")[rng.integers(5)]
        if k >= 0:
            found.append((len(made), k, len(made) + len(part)))
        made += part
    after = text[e:] if not any(x[2] > e for x in spans if x != (s, kind, e)) else ""
    made += after
    return made[:WIDTH], _tagged(min(WIDTH, len(made)), found)


def fit(rows: list[tuple[str, list]], seed: int = 0) -> Tagger | None:
    """Trains on (window, its spans) by Adam; None where no window has a span."""
    if not any(spans for _, spans in rows):
        return None
    rng, model = np.random.default_rng(seed), Tagger.fresh(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in vars(model).items()}
    for number in range(1, STEPS + 1):
        chosen = [example(rng, rows) for _ in range(BATCH)]
        grads = model.gradients(symbols([t for t, _ in chosen]), np.stack([y for _, y in chosen]))
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = RATE * min(1.0, 2 * (1 - number / (STEPS + 1)))
        for name, g in grads.items():
            m, v = moments[name]
            g = g * min(1.0, 5 / max(size, 1e-9))
            m += 0.1 * (g - m)
            v += 0.005 * (g * g - v)
            vars(model)[name] -= rate * (m / (1 - 0.9**number)) / (np.sqrt(v / (1 - 0.995**number)) + 1e-8)
    return model


def valid(kind: int, text: str) -> bool:
    """Whether an added span is what its kind is: as a base span, or a phone number of
    several groups without its plus sign."""
    name = KINDS[kind]
    if name == "email":
        return next(emails(text), None) == (0, len(text))
    if name == "phone" and not text.startswith("+"):
        groups = re.fullmatch(r"(\(?[0-9]+\)?)([ .-]\(?[0-9]+\)?){2,5}|\([0-9]+\) ?[0-9]+([ .-][0-9]+)+", text)
        return groups is not None and text.count("(") == text.count(")") and passes(name, text) and max(map(len, DIGITS.split(text))) <= 5 and not IP.fullmatch(text)
    pattern = (None, IP, CARD, PHONE)[kind]
    return pattern.fullmatch(text) is not None and passes(name, text)


def proposals(model: Tagger, cuts: list[list[tuple[int, str]]], lengths: list[int]) -> list[list[tuple[int, int, int, float]]]:
    """(start, kind, end, weight) of the spans in the windows of each of several texts.
    Windows of all texts are decoded together."""
    out: list[list] = [[] for _ in cuts]
    every = [(n, start, text) for n, cut in enumerate(cuts) for start, text in cut]
    for at in range(0, len(every), TOGETHER):
        own = every[at : at + TOGETHER]
        tags, sure = model.decode(symbols([t for _, _, t in own]))
        for (n, start, text), row, p in zip(own, tags, sure):
            for s in np.nonzero(row % 2 == 1)[0].tolist():
                kind = int(row[s] - 1) // 2
                e = s + 1
                while e < len(text) and row[e] == 2 + 2 * kind:
                    e += 1
                # What reaches an edge may go on beyond it: another window holds it whole.
                if (s > 0 or start == 0) and (e < len(text) or start + e == lengths[n]):
                    out[n].append((start + s, kind, start + e, float(np.exp(np.log(np.maximum(p[s:e], 1e-9)).mean())) * (e - s)))
    return out


class _Text:
    """What is known of a text from its windows: characters by place."""

    def __init__(self, cut: list[tuple[int, str]], length: int):
        self.cut, self.length = cut, length
        self.starts = np.array([s for s, _ in cut])

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, at):
        s, e = (at.start, at.stop) if isinstance(at, slice) else (at, at + 1)
        n = int(np.searchsorted(self.starts, s, side="right")) - 1
        for a, text in self.cut[max(0, n - 2) : n + 1]:
            if a <= s and e <= a + len(text):
                return text[s - a : e - a]
        return ""


def reconciled(text: _Text, base: list[tuple[int, int, int]], proposed: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """What is added to the base spans: of valid proposals beside them the heaviest set
    without overlaps, over the whole text."""
    best: dict[tuple[int, int, int], float] = {}
    busy = sorted((s, e) for s, _, e in base)
    starts = np.array([s for s, _ in busy] or [0])
    ends = np.maximum.accumulate(np.array([e for _, e in busy] or [-1]))
    for s, kind, e, weight in proposed:
        before = int(np.searchsorted(starts, e, side="left")) - 1  # base spans that begin before e
        if before >= 0 and ends[before] > s:
            continue
        alone = not (s > 0 and text[s - 1].isalnum()) and not (e < len(text) and text[e].isalnum())
        if alone and valid(kind, text[s:e]):
            best[s, kind, e] = max(weight, best.get((s, kind, e), 0.0))
    rows = sorted(best, key=lambda x: (x[2], x))
    closing = [x[2] for x in rows]
    total, taken = [0.0], []
    for n, row in enumerate(rows):
        until = int(np.searchsorted(closing, row[0], side="right"))
        until = min(until, n)
        with_it = total[until] + best[row]
        taken.append((with_it > total[n], until))
        total.append(max(total[n], with_it))
    out, n = [], len(rows)
    while n:
        take, until = taken[n - 1]
        if take:
            out.append(rows[n - 1])
        n = until if take else n - 1
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


FOUND = "doc_id bigint, n_chars bigint, base array<struct<s:bigint,k:int,e:bigint>>, cut array<struct<s:bigint,t:string,known:boolean>>"
RESULT = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, added array<struct<kind:string,start:bigint,end:bigint>>"


def matched(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, base, cut) of every row: its base spans, and its windows, of
    which ``known`` says whether their spans can be told for certain."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.int64()), ("k", pa.int32()), ("e", pa.int64())])), pa.list_(pa.struct([("s", pa.int64()), ("t", pa.string()), ("known", pa.bool_())]))]
        for batch in batches:
            sizes, base, cut = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text))
                if not TRIGGER.search(text):
                    base.append([])
                    cut.append([])
                    continue
                spans, failed = base_spans(text)
                marks = np.array([p for s in failed for p in s] or [-1])
                base.append([{"s": s, "k": k, "e": e} for s, k, e in spans])
                cut.append([{"s": a, "t": t, "known": not failed or not bool(((marks >= a) & (marks <= a + len(t))).any())} for a, t in windows(text)])
            arrays = [batch.column(0), *(pa.array(x, k) for x, k in zip((sizes, base, cut), types[1:]))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_chars", "base", "cut"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, FOUND)


def labelled(found: DataFrame, sample: int = SAMPLE) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most ``sample`` distinct windows with their spans, three of four with one,
    in the order of a hash."""
    window = found.select("base", F.explode("cut").alias("w")).filter("w.known")
    own = F.filter("base", lambda x: (x["e"] > F.col("w.s")) & (x["s"] < F.col("w.s") + F.length("w.t")))
    rows = window.select(F.col("w.t").alias("t"), F.transform(own, lambda x: F.struct((x["s"] - F.col("w.s")).alias("s"), x["k"].alias("k"), (x["e"] - F.col("w.s")).alias("e"))).alias("spans"))
    order = F.xxhash64("t")
    out = []
    for some, most in ((F.size("spans") > 0, 3 * sample // 4), (F.size("spans") == 0, sample // 4)):
        got = rows.filter(some).groupBy("t").agg(F.min("spans").alias("spans")).orderBy(order, "t").limit(most).collect()
        out += [(r["t"], [(x["s"], x["k"], x["e"]) for x in r["spans"]]) for r in got]
    return out


def detect(docs: DataFrame, sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, added) of every row of
    ``docs``; positions are code points. ``added`` are the spans of the model."""
    spark = docs.sparkSession
    found = written(matched(docs), "personal")
    model = fit(labelled(found, sample), seed)
    shared = spark.sparkContext.broadcast(model and vars(model))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value and Tagger(**shared.value)
        for batch in batches:
            out = []
            docs, lengths, spans = (batch.column(i).to_pylist() for i in range(3))
            cuts = [[(w["s"], w["t"]) for w in cut] for cut in batch.column(3).to_pylist()]
            proposed = proposals(tagger, cuts, lengths) if tagger else [[]] * len(cuts)
            for doc, length, own, cut, new in zip(docs, lengths, spans, cuts, proposed):
                base = [(x["s"], x["k"], x["e"]) for x in own]
                extra = reconciled(_Text(cut, length), base, new) if new else []
                counts = [sum(k == n for _, k, _ in base) for n in range(len(KINDS))]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                out.append((doc, *counts, digest, joined(base + extra), [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in extra]))
            if out:
                struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [struct]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "added"])

    return found.mapInArrow(rows, RESULT)
