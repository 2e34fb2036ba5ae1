"""Quality rules as a bitmask ledger.

Every rule is evaluated once. The ledger row of a document keeps its measurements and one bit per failed rule;
versioned policies are masks over those bits, and ablations come from the small histogram of bit patterns, so a new
policy never reads the texts again. DataFrame functions only.

Defined cases: null text counts as no words; an empty table gives an empty ledger; repeated rows each get their own
ledger row; other columns of the input are kept or dropped by the caller's choice of `keep`, and measurement names
are only produced here (clashing input columns are not carried over).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.words import carried

# Fixed values of the base rules: white space, symbols, window width.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """One bit of the ledger: `fails` is SQL over the measurements."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("repeated_lines", 3, "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", 4, "2 * word_chars < 5 * n_words"),
    Rule("long_words", 5, "word_chars > 12 * n_words"),
)
BASE_MASK = 0b000011
#: Policies by version: which bits reject a document. A policy always holds the base rules.
POLICIES = {1: BASE_MASK, 2: 0b111111}
CURRENT = 2


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it any number of times in `body`."""
    return F.transform(F.array(value), body)[0]


def _covered_words(words: Column) -> Column:
    """Words that lie in a window of five words found at least twice; sorting brings equal windows together."""

    def windows(w):
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
        )

    def repeated(s):
        same = lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False))
        twice = F.filter(s, lambda x, k: same(F.get(s, k - 1), x) | same(F.get(s, k + 1), x))
        return F.array_sort(F.transform(twice, lambda x: x["p"]))

    def covered(starts):
        return F.aggregate(
            starts,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    def measure(g):
        pairs = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("g"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(
            let(pairs, lambda s: covered(repeated(s)))
        )

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows(words), measure))


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measurements of every document, each computed once."""
    keep = carried(keep, ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "failed"))
    # The kept columns go along as one, so that none meets a helper's name.
    only = docs.select(F.struct(F.lit(0).alias("_"), *keep).alias("kept"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    words = F.filter(F.split("_text", SPACE), lambda w: w != "")
    lines = F.filter(F.split("_text", "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _covered_words(w).alias("r")))
    line_counts = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")
        ),
    )
    measured = F.struct(
        counts.alias("w"),
        line_counts.alias("l"),
        F.length(F.translate("_text", SPACE_CHARS, "")).cast("long").alias("c"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("s"),
    )
    # A filter on the verdict must not be pushed below the measurements, which would then be computed once per use;
    # it can't pass a generator.
    found = only.select("kept", F.explode(F.array(measured)).alias("_m"))
    return found.select(
        *[F.col(f"kept.`{c}`").alias(c) for c in keep],
        F.col("_m.w.n").alias("n_words"),
        F.col("_m.c").alias("word_chars"),
        F.col("_m.s").alias("n_symbols"),
        F.col("_m.l.n").alias("n_lines"),
        F.col("_m.l.d").alias("n_dup_lines"),
        F.col("_m.w.r").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules=RULES) -> DataFrame:
    """Measurements and `failed`, the bits of the rules that a document breaks."""
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in rules), F.lit(0))
    return measure(docs, text, keep).withColumn("failed", bits.cast("long"))


def apply_policy(rows: DataFrame, version: int = CURRENT, policies=POLICIES) -> DataFrame:
    """The verdict of one policy version: kept if none of its bits is set."""
    base = F.col("failed").bitwiseAND(F.lit(BASE_MASK)) != 0
    hit = F.col("failed").bitwiseAND(F.lit(policies[version])) != 0
    return rows.withColumns({"base_failed": base, "kept": ~base & ~hit, "policy": F.lit(version)})


def ablations(rows: DataFrame, version: int = CURRENT, policies=POLICIES, rules=RULES) -> DataFrame:
    """How many documents each rule rejects, rejects alone, and would be kept without it.

    Documents are first counted by bit pattern (at most 2 to the number of rules rows), then each rule is left out in
    turn by clearing its bit.
    """
    mask = policies[version]
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    used = [r for r in rules if mask >> r.bit & 1]
    per_rule = F.explode(
        F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).alias("bit")) for r in used])
    )
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit").cast("long")))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return (
        patterns.select("bits", "n", per_rule.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            count(hit)("rejected"),
            count(hit & (rest == 0))("rejected_alone"),
            count(rest == 0)("kept_without"),
        )
    )
