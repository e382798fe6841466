"""Quality rules in a ledger of failure bits, all in Spark SQL.

``evaluate`` measures a text and tries every rule once. Policies are versioned
masks over the failure bits: which documents stay under a policy, and what each
of its rules costs, are bit operations on the ledger that read no text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.session import durable


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; the rule's place in ``RULES`` is its bit."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 4 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("repeated_lines", "n_dup_lines > 3 AND 2 * n_dup_lines > n_lines"),
    Rule("shouting", "n_words >= 10 AND 2 * n_shouted > n_words"),
)
#: Policy versions and the names of the rules that reject under them.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "1": tuple(r.name for r in RULES),
}
WINDOW = 5
WORD = "[^\\x20\\x09-\\x0D]+"


def mask(policy: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    names = [r.name for r in rules]
    return sum(1 << names.index(name) for name in set(policy))


def _measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measurements, in steps so that no array is computed twice."""
    text = F.coalesce("text", F.lit(""))
    step = docs.select("doc_id", text.alias("_text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"))
    lines = F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(WORD))
    step = step.select(
        "doc_id",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count("_text", F.lit("(?<![^\\x20\\x09-\\x0D])\\p{Lu}{2,}(?!\\p{Ll})")).cast("bigint").alias("n_shouted"),
        lines.alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    window = f"transform(sequence(0, size(_hashes) - {WINDOW}), i -> xxhash64({', '.join(f'_hashes[i + {k}]' for k in range(WINDOW))}))"
    step = step.withColumn("_windows", F.expr(f"IF(size(_hashes) >= {WINDOW}, {window}, cast(array() AS array<bigint>))"))
    step = step.withColumn("n_lines", F.size("_lines").cast("bigint"))
    step = step.withColumn("n_dup_lines", (F.col("n_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"))
    # Only texts in which a window repeats are sorted to find out where.
    none = "cast(array() AS array<struct<h: bigint, at: int>>)"
    sort = f"IF(size(array_distinct(_windows)) = size(_windows), {none}, sort_array(transform(_windows, (h, at) -> struct(h AS h, at AS at))))"
    step = step.withColumn("_sorted", F.expr(sort)).drop("_windows", "_hashes", "_lines")
    twin = "filter(_sorted, (x, j) -> get(_sorted, j - 1).h <=> x.h OR get(_sorted, j + 1).h <=> x.h)"
    step = step.withColumn("_at", F.expr(f"sort_array(transform({twin}, x -> x.at))")).drop("_sorted")
    covered = f"aggregate(transform(_at, (p, j) -> IF(j = 0, {WINDOW}, least({WINDOW}, p - _at[j - 1]))), 0, (s, x) -> s + x)"
    return step.withColumn("n_repeat_words", F.expr(covered).cast("bigint")).drop("_at")


def evaluate(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger: for every row of ``docs(doc_id, text)`` its measurements and ``failed_bits``.

    n_words, word_chars (code points in words), n_symbols, n_shouted (words with
    capitals only), n_lines (lines with a word), n_dup_lines (those equal to an
    earlier one) and n_repeat_words (words in 5-word windows found twice or more in
    the text). Windows are compared by 64-bit hashes.

    A null text has no words. Repeated rows and null ids are kept as they are;
    further columns are ignored; an empty table gives an empty ledger.
    """
    measured = _measured(docs)
    bits = F.lit(0).cast("bigint")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    # Stored: a filter on the ledger must not be pushed into the measuring.
    return durable(measured.withColumn("failed_bits", bits))


def fails(policy: Sequence[str], rules: Sequence[Rule] = RULES) -> Column:
    """Whether the ledger row fails any rule of the policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("bigint")) != 0


def ablation(ledger: DataFrame, policy: Sequence[str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row for each rule of the policy: documents it fails, and those it alone rejects.

    Rows are counted by bit pattern first, of which there are few. An empty ledger gives zeros.
    """
    under = F.col("failed_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("bigint"))
    patterns = ledger.groupBy(under.alias("bits")).agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    names = [r.name for r in rules if r.name in set(policy)]
    bit = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask([n], rules)).cast("bigint").alias("bit")) for n in names]))
    rule = patterns.sparkSession.range(1).select(bit.alias("r")).select("r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    counted = patterns.select("n", "words", "bits", bit.alias("r")).select("n", "words", "bits", "r.rule", "r.bit").where(hit)
    totals = counted.groupBy("rule").agg(
        F.sum("n").alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("words")).otherwise(0)).alias("words_alone"),
    )
    zero = F.lit(0).cast("bigint")
    return rule.join(totals, "rule", "left").select("rule", *[F.coalesce(c, zero).alias(c) for c in ("failed", "failed_alone", "words_alone")])
