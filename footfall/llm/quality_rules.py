"""Quality rules as a ledger: measurements and one bit per failed rule, then policies over the bits.

Every rule is evaluated once per document. A policy is a named, versioned set of rules; a verdict
is one bitwise test, and ablations are worked out on the few distinct bit patterns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import fresh

WORDS = r"[^\x20\x09-\x0D]+"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A document fails where `fails`, SQL over the measurements, is true."""

    name: str
    fails: str


#: In the order of their bits; new rules go to the end, so that stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    Rule("shouting", "10 * n_capitals > 6 * n_letters"),
    Rule("exclamations", "10 * n_marks > 3 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("stuttering", "10 * n_same_next > 3 * n_words"),
)

#: Versioned policies: the names of the rules that reject.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "web-1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "shouting", "exclamations", "long_words", "stuttering"),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters", "n_marks", "n_same_next"]


def mask(policy: str, rules: tuple[Rule, ...] = RULES, without: str = "") -> int:
    bits = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(bits[name] for name in POLICIES[policy] if name != without)


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later expressions read instead of working it out anew: a generator of one row."""
    return df.withColumn(name, F.explode(F.array(value)))


def _repeated(df: DataFrame, words: str, hashes: str, ordered: str) -> DataFrame:
    """Add n_repeat_words from the column of words: words inside a window of eight words that occurs twice or more in the text.

    Windows are compared by one 64-bit hash first. Only texts in which hashes repeat sort their
    windows, by 128 hash bits; then the gaps between the starts of repeated windows give the words.
    """
    n = F.size(words)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    df = _held(df, hashes, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW))))
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    keyed = F.transform(
        F.col(hashes),
        lambda h, i: F.struct(h.alias("h"), F.xxhash64(F.lit("second"), F.slice(words, i + 1, WINDOW)).alias("g"), i.alias("i")),
    )
    df = _held(df, ordered, F.when(repeats, F.sort_array(keyed)))

    def same(x: Column, at: Column) -> Column:
        y = F.get(ordered, at)
        return F.coalesce((x["h"] == y["h"]) & (x["g"] == y["g"]), F.lit(False))

    twice = F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1))
    begun = F.sort_array(F.transform(twice, lambda x: x["i"]))
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(
        begun,
        state,
        lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop(hashes, ordered)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements, each worked out once over the whole text; null and empty texts give zeros.

    Rows stay as they are, repeated ones too; an empty table gives an empty one. Columns named like a
    measurement are replaced; all others keep name and value.
    """
    keep = [c for c in docs.columns if c not in MEASURES]
    body, words, lines, hashes, ordered = (fresh(docs, name) for name in ("text", "words", "lines", "hashes", "sorted"))
    df = docs.select(*keep).withColumn(body, F.coalesce(F.col(text), F.lit("")))
    df = _held(df, words, F.regexp_extract_all(body, F.lit(WORDS), F.lit(0)))
    df = _repeated(df, words, hashes, ordered)
    df = _held(df, lines, F.filter(F.split(body, "\n", -1), lambda x: F.regexp_like(x, F.lit(WORDS))))
    return df.select(
        *keep,
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _count(F.col(body), r"[#*$%&|<>]").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size(lines).cast("long").alias("n_lines"),
        _count(F.col(body), r"\p{Lu}").alias("n_capitals"),
        _count(F.col(body), r"\p{L}").alias("n_letters"),
        _count(F.col(body), "!").alias("n_marks"),
        F.size(F.filter(words, lambda w, i: w.eqNullSafe(F.get(words, i - 1)))).cast("long").alias("n_same_next"),
    )


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows with their measurements and `failed`, the bits of the rules that they fail.

    What `measure` says of odd rows holds here; a column named `failed` is replaced.
    """
    measured = measure(docs.drop("failed"), text)
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed)


def keeps(policy: str, failed: str = "failed") -> Column:
    """Whether a policy keeps a row of the ledger."""
    return F.col(failed).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(entries: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: rows that fail it, that fail it alone, and that would be kept without it.

    Rows are counted by bit pattern before anything else, so no more than 2^rules rows remain.
    """
    patterns = entries.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    bits = {r.name: 1 << i for i, r in enumerate(rules)}
    whole = mask(policy)
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bits[r]).cast("long").alias("bit")) for r in POLICIES[policy]]))
    fired = F.col("failed").bitwiseAND(F.lit(whole))
    return (
        patterns.select("failed", "n", each.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(fired.bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(fired == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(fired.bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )
