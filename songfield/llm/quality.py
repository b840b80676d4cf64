"""Quality rules as a bitmask ledger: every rule is evaluated once.

``measure`` reads each whole text once and leaves a handful of numbers;
``ledger`` turns them into one bit for each failed rule; ``apply_policy``
reads a versioned policy (a mask of rules) off the bits, and ``ablations``
tells for each rule of each policy how many documents it alone rejects. The
last two touch no text, so a new policy version costs no new measurement.

Everything is a built-in column function on one row: there is no exchange, and
a long text costs n log n of its own length. Nulls and empty texts have no
words and fail the base rule; repeated rows get equal results; an empty table
gives no rows; other columns pass through, and one that is called like a column
which the ledger adds is an error. ``accepted`` keeps documents as they are,
whatever their columns are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songfield.llm.common import SPACE, once, refuse_clash, words_of

#: Words in the windows whose repetition counts.
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


@dataclass(frozen=True)
class Rule:
    """A bit of the ledger and the condition that sets it, over MEASURES."""

    bit: int
    name: str
    fails: str


#: Bits are for ever: a changed rule gets a new one, and policies choose among them.
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 30 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
    Rule(6, "upper_case", "2 * n_upper > word_chars"),
)
BASE = ("few_words", "repeated_windows")
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines"),
    "v2": (*BASE, "symbols", "repeated_lines", "short_words", "long_words", "upper_case"),
}
CURRENT = "v2"


def mask(names: tuple[str, ...]) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in names)


def _repeated(windows: Column) -> Column:
    """Words covered by windows that occur twice, from (hash, position) in order."""
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(windows, F.lit(1), F.size(windows) - 1))
    after = F.concat(F.slice(windows, F.lit(2), F.size(windows) - 1), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    marked = F.zip_with(
        F.zip_with(windows, before, lambda x, y: F.struct(x["i"].alias("i"), x["h"].alias("h"), x["h"].eqNullSafe(y["h"]).alias("twice"))),
        after,
        lambda x, y: F.when(x["twice"] | x["h"].eqNullSafe(y["h"]), x["i"]),
    )
    at = F.array_sort(F.filter(marked, lambda i: i.isNotNull()))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(
        at,
        start,
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with MEASURES as bigint columns; a column of such a name is an error."""
    refuse_clash(docs.columns, *MEASURES, "__w", "__l", "__h", "__s")
    raw = F.coalesce(F.col(text), F.lit(""))
    with_words = docs.withColumns({"__w": once(words_of(F.col(text))), "__l": once(F.filter(F.split(raw, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))})
    hashed = F.when(
        F.size("__w") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("__w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__w", i, F.lit(WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = with_words.withColumns(
        {
            "n_words": F.size("__w").cast("bigint"),
            "word_chars": F.length(F.array_join("__w", "")).cast("bigint"),
            "n_symbols": F.length(F.regexp_replace(raw, r"[^#*$%&|<>]+", "")).cast("bigint"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint"),
            "n_lines": F.size("__l").cast("bigint"),
            "n_upper": F.length(F.regexp_replace(raw, r"[^\p{Lu}]+", "")).cast("bigint"),
            "__h": once(hashed),
        }
    ).drop("__w", "__l")
    # Most texts repeat no window: only the others are sorted.
    windows = F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = counted.withColumn("__s", once(F.when(F.size(F.array_distinct("__h")) < F.size("__h"), windows))).drop("__h")
    return some.withColumn("n_repeat_words", once(F.when(F.col("__s").isNull(), F.lit(0).cast("bigint")).otherwise(_repeated(F.col("__s"))))).drop("__s")


def ledger(measured: DataFrame) -> DataFrame:
    """Adds ``fail_bits``: bit r is set where rule r fails."""
    bits = F.lit(0).cast("bigint")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("bigint"))
    return measured.withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, version: str = CURRENT, flag: str = "kept") -> DataFrame:
    """Adds ``flag``: no rule of that policy version failed."""
    return led.withColumn(flag, F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version])).cast("bigint")) == 0)


def ablations(led: DataFrame) -> DataFrame:
    """(policy, rule, failed, alone): the documents that fail a rule, and those
    that this rule alone rejects, so that the policy without it would keep them.

    The ledger is first counted by its bits: at most 2 ** rules rows are left,
    however many documents there are. An empty ledger gives no rows.
    """
    counted = led.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rows = [(p, n, mask(names), mask((n,))) for p, names in POLICIES.items() for n in names]
    table = led.sparkSession.createDataFrame(rows, "policy string, rule string, policy_mask bigint, rule_mask bigint")
    both = counted.join(F.broadcast(table), F.col("fail_bits").bitwiseAND(F.col("rule_mask")) != 0)
    alone = F.col("fail_bits").bitwiseAND(F.col("policy_mask")) == F.col("rule_mask")
    return both.groupBy("policy", "rule").agg(F.sum("n").alias("failed"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("alone"))


def quality(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """``docs`` measured, with the ledger, ``base_failed`` and ``kept``."""
    refuse_clash(docs.columns, "fail_bits", "base_failed", "kept")
    led = apply_policy(ledger(measure(docs)), version)
    return led.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(mask(BASE)).cast("bigint")) != 0).withColumn("kept", F.col("kept") & ~F.col("base_failed"))


def accepted(docs: DataFrame, version: str = CURRENT, text: str = "text") -> DataFrame:
    """The documents that a policy keeps, with their own columns only."""
    own = [f"__own_{i}" for i in range(len(docs.columns))]  # so that none is called like a measure
    judged = quality(docs.toDF(*own).withColumn(text, F.col(own[docs.columns.index(text)])), version)
    return judged.filter("kept").select(*own).toDF(*docs.columns)
