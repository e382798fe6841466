"""Benchmark passages in documents, found by spaced-seed hashing, all in Spark SQL.

A mask selects some positions of a span of tokens and ignores the others, so a
substituted token destroys only the seeds that select it. Hashes of all masked
spans of the benchmark meet those of the documents. Around each hit the item is
laid over the document's tokens, and the overlap is verified with substitutions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.session import broadcast_if_small, durable

#: Selected positions of the fixed masks. Wherever two of 13 tokens are substituted, one of them still fits.
MASKS = ((0, 1, 3, 5, 6, 8), (0, 2, 3, 7, 9, 10), (0, 1, 4, 5, 6, 7, 10, 11))
#: More masks for items of so many tokens, so that one fits whatever the rule lets be substituted: one token of 5 to 9, two of 10 to 12.
SHORT = {
    **{n: (tuple(range(n // 2)),) for n in range(5, 9)},
    9: ((0, 1, 2, 4, 6, 7), (0, 3, 5, 6, 7, 8)),
    10: ((0, 1, 3, 4, 5), (0, 1, 2, 6, 7)),
    11: ((0, 1, 2, 3, 4, 6), (0, 1, 4, 7, 8, 9)),
    12: ((0, 3, 4, 7, 8, 9),),
}
#: The shortest items that are searched by default; shorter ones are found in ordinary prose.
LEAST_TOKENS = 5
#: An overlap counts if some stretch of so many tokens (or the whole shorter item) ...
STRETCH = 13
#: ... has at least this percentage of equal tokens.
EQUAL_PERCENT = 80
#: Seeds of the benchmark that are broadcast at once, some 64 MB; more take another pass over the documents' seeds.
SEEDS_PER_BLOCK = 1_000_000


#: Scripts without blanks between words: each character is a token.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
TOKEN = rf"[{UNSPACED}]|[\p{{L}}\p{{M}}\p{{N}}&&[^{UNSPACED}]]+"


def tokens(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters, marks and digits, or single characters of unspaced scripts."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda token: F.xxhash64(token))


def _kept(value: Column) -> Column:
    """A value that is made once a row: Spark merges projections, also into functions that run for each token."""
    return F.explode_outer(F.array(value))


def _span(mask: Sequence[int]) -> int:
    return mask[-1] + 1


def _seeds(masks: Sequence[Sequence[int]]) -> Column:
    """The seeds of all masks over ``tokens``, one mask after the other, each at every position."""
    each = []
    for no, mask in enumerate(masks):
        picked = ", ".join(f"tokens[i + {k}]" for k in mask)
        seeds = f"transform(sequence(0, size(tokens) - {_span(mask)}), i -> xxhash64({no}, {picked}))"
        each.append(f"IF(size(tokens) >= {_span(mask)}, {seeds}, cast(array() AS array<bigint>))")
    return F.expr(f"concat({', '.join(each)})")


def _place(masks: Sequence[Sequence[int]], mask: Column, index: Column, size: Column) -> Column:
    """The position of a seed in the tokens, from its index in ``_seeds``."""
    before, begin = F.lit(0), []
    for m in masks:
        begin.append(before)
        before = before + F.greatest(size - F.lit(_span(m) - 1), F.lit(0))
    return index - F.element_at(F.array(*begin), mask + 1)


def _masks_for(lengths: Sequence[int]) -> list[tuple[int, tuple[int, ...]]]:
    """The fixed masks with 0, and with each length of short items its own ones: an unbroken one if all others are too long."""
    own = [(n, mask) for n in sorted(lengths) for mask in SHORT.get(n, (tuple(range(n)),))]  # below five tokens nothing may differ
    return [*((0, mask) for mask in MASKS), *own]


def overlaps(
    docs: DataFrame, benchmark: DataFrame, stretch: int = STRETCH, percent: int = EQUAL_PERCENT, least_tokens: int = LEAST_TOKENS
) -> DataFrame:
    """``(doc_id, item_id, n_tokens, n_equal)``: items of ``benchmark(item_id, text)`` met in ``docs(doc_id, text)``.

    A pair is in the result if, with the item laid over the document at a seed hit,
    some ``stretch`` consecutive tokens (the whole item if it is shorter) have at
    least ``percent`` % equal tokens. Tokens are lower-cased runs of letters, marks
    and digits, and single characters of scripts that have no blanks. n_equal is the most equal
    tokens at any one hit. Every position of whole texts is tried. With the given ``stretch`` and
    ``percent`` the masks hit every place that the rule accepts; for others they may miss some.

    Seeds leave a document as numbers, without its tokens, and only documents with hits are read
    again, so the time is linear in the length of a text.

    Null and empty texts have no tokens and meet nothing. Items below ``least_tokens`` are not
    searched. Rows that repeat an id count as one document or item; null ids are kept as null.
    Further columns are ignored; empty tables give an empty result.
    """
    items = durable(benchmark.select("item_id", tokens(F.col("text")).alias("tokens")).where(F.size("tokens") >= least_tokens).distinct())
    lengths = [r[0] for r in items.select(F.size("tokens").alias("n")).where(f"n <= {max(SHORT)}").distinct().collect()]
    of, masks = zip(*_masks_for(lengths), strict=True)
    meant = F.element_at(F.array(*map(F.lit, of)), F.col("mask") + 1).isin(F.lit(0), F.size("tokens"))
    seeds = durable(_positions(items, masks).where(meant).select("seed", "item_id", F.col("place").alias("item_at"), "mask", F.size("tokens").alias("length")))
    blocks = max(1, math.ceil(seeds.count() / SEEDS_PER_BLOCK))

    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    texts = docs.select("doc_id", "key", _kept(tokens(F.col("text"))).alias("tokens"))
    sized = texts.select("doc_id", "key", F.size("tokens").alias("n"), _seeds(masks).alias("seeds"))
    # The outer form: for the inner one Spark would make the seeds once more to test for empty lists.
    spread = sized.select("doc_id", "key", "n", F.posexplode_outer("seeds").alias("index", "seed"))
    begin = _place(masks, F.col("mask"), F.col("index"), F.col("n")) - F.col("item_at")
    met = None
    for block in range(blocks):
        # Dealt by item and place, so that a long item does not make a large block.
        part = F.broadcast(seeds.where(F.pmod(F.xxhash64("item_id", "item_at"), F.lit(blocks)) == block))
        hits = spread.join(part, "seed").select("doc_id", "key", "item_id", "length", begin.alias("begin"))
        met = hits if met is None else met.union(hits)
    # A document's hits go to its text, not its text to every hit.
    hit = F.struct("item_id", "length", "begin")
    lists = durable(met.distinct().groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).agg(F.collect_list(hit).alias("hits")))
    same = docs["doc_id"].eqNullSafe(F.col("_doc")) & (docs["key"] == F.col("_key"))
    found = docs.join(broadcast_if_small(lists), same).select("doc_id", "hits", _kept(tokens(F.col("text"))).alias("tokens"))
    at = "IF(h.begin + i < size(tokens), get(tokens, h.begin + i), NULL)"
    laid = f"transform(hits, h -> struct(h.item_id AS item_id, transform(sequence(0, h.length - 1), i -> {at}) AS laid))"
    laid = found.select("doc_id", F.explode_outer(F.expr(laid)).alias("hit")).select("doc_id", "hit.item_id", "hit.laid").distinct()
    equal = laid.join(items.select("item_id", "tokens"), laid["item_id"].eqNullSafe(items["item_id"])).select(
        laid["doc_id"], laid["item_id"], F.expr("transform(tokens, (t, i) -> IF(t <=> laid[i], 1, 0))").alias("equal")
    )
    checked = equal.withColumn("span", F.least(F.size("equal"), F.lit(stretch)))
    best = "array_max(transform(sequence(0, size(equal) - span), i -> aggregate(slice(equal, i + 1, span), 0, (s, x) -> s + x)))"
    whole = "aggregate(equal, 0, (s, x) -> s + x)"
    checked = checked.select("doc_id", "item_id", "span", F.size("equal").alias("n_tokens"), F.expr(best).alias("best"), F.expr(whole).alias("n_equal"))
    return checked.where(F.col("best") * 100 >= F.col("span") * percent).groupBy("doc_id", "item_id").agg(
        F.max("n_tokens").cast("bigint").alias("n_tokens"), F.max("n_equal").cast("bigint").alias("n_equal")
    )


def _positions(items: DataFrame, masks: Sequence[Sequence[int]]) -> DataFrame:
    """Every seed of the items with its mask and place."""
    spread = items.select("item_id", "tokens", F.posexplode(_seeds(masks)).alias("index", "seed"))
    ends, total = [], F.lit(0)
    for m in masks:
        total = total + F.greatest(F.size("tokens") - F.lit(_span(m) - 1), F.lit(0))
        ends.append(total)
    mask = F.lit(0)
    for end in ends[:-1]:
        mask = mask + F.when(F.col("index") >= end, 1).otherwise(0)
    spread = spread.withColumn("mask", mask)
    return spread.withColumn("place", _place(masks, F.col("mask"), F.col("index"), F.size("tokens")))
