"""Mixing sources to target weights, by blocks of tokens.

1. The documents of a source lie one after the other, in the order of their ids,
   and are cut into blocks of a fixed number of tokens.
2. A source's target gives its number of slots: whole passes over its blocks and
   a part of one more. The slots are dealt to the output shards by a multinomial
   draw of each source, so the source counts of a shard are multinomial with the
   target shares, while every source's total is exact.
3. A slot's place within its pass goes through a pseudorandom permutation of the
   source's block numbers, keyed by seed, source and pass. Nothing is sorted or
   stored to shuffle the blocks, and a rerun gives the same mix.
4. Blocks join slots by number. No block is taken more often than there are passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.ordering import numbered, running_total
from eventloom.llm.words import mix
from eventloom.session import broadcast_if_small, durable

WORD = "[^\\x20\\x09-\\x0D]+"
#: Tokens of a block, and slots of an output shard on average.
BLOCK = 128
SLOTS_PER_SHARD = 1 << 16
#: Slots that one task lays out.
SLOTS_PER_TASK = 1 << 16


STEPS = mix(np.arange(1, 5, dtype=np.uint64))


def permuted(index: np.ndarray, count: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The image of each index under a permutation of ``range(count)`` that the key picks.

    A four-round Feistel network on the next even number of bits; images beyond
    the range go through it again until they fall inside.
    """
    bits = np.frexp(np.maximum(count.astype(np.float64) - 1, 0))[1]
    half = np.maximum((bits + 1) // 2, 1).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, count, key = index.astype(np.uint64), count.astype(np.uint64), key.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m, k = half[todo], low[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            left, right = right, left ^ (mix(right + k + STEPS[turn]) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= count[todo]]
    return out.astype(np.int64)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``(source, source_no, source_size, target)`` from ``sizes(source, source_size)``, one row a source.

    Sources in code point order, null last, weigh ``weights`` in turn. Together they
    get ``share`` times all sizes, by weight; a source stops at ``most`` times its
    size and the excess goes to the others by weight until none is above. The level
    at which the others stand is found by a few sums over the sources.
    """
    rows = numbered(sizes.withColumn("_all", F.lit(0)), ["_all"], [F.col("source").asc_nulls_last()], "source_no").drop("_all")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    rows = durable(rows.withColumn("_weight", weight).withColumn("_cap", F.lit(float(most)) * F.col("source_size")))
    goal = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        above = (F.col("_weight") * F.lit(level) > F.col("_cap")) if stopped >= 0 else F.lit(False)
        capped, weighing, count = rows.agg(
            F.sum(F.when(above, F.col("_cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("_weight"))), F.count_if(above)
        ).first()
        if count == stopped or not weighing:
            break
        level, stopped = (goal - capped) / weighing, count
    return rows.select("source", "source_no", "source_size", F.least("_cap", F.col("_weight") * F.lit(level)).alias("target"))


def _drawn(shards: int, seed: int):
    """The slots of each source by shard, one draw a source."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source_no, blocks, slots in frame.itertuples(index=False):
                counts = np.random.default_rng([seed, int(source_no)]).multinomial(slots, np.full(shards, 1 / shards))
                used = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": used, "source_no": source_no, "blocks": blocks, "first": (np.cumsum(counts) - counts)[used], "slots": counts[used]})

    return run


def _placed(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, blocks, source = (batch.column(c).to_numpy() for c in ("slot", "blocks", "source_no"))
            turn = slot // blocks
            key = mix(mix(source.astype(np.uint64) + np.uint64(seed)) + turn.astype(np.uint64))
            block = permuted(slot % blocks, blocks, key)
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("source_no"), batch.column("slot"), pa.array(block)], ["shard", "source_no", "slot", "block"])

    return run


@dataclass
class Mix:
    """``sources`` with their targets; ``documents`` with their places; ``slots`` with the blocks they take."""

    sources: DataFrame
    documents: DataFrame
    slots: DataFrame
    block: int

    def pieces(self, documents: DataFrame) -> DataFrame:
        """One row for each document and block that share words: ``from`` is the place in the document."""
        first, last = F.floor(F.col("begin") / self.block), F.floor((F.col("begin") + F.col("size") - 1) / self.block)
        rows = documents.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
        lo = F.greatest(F.col("begin"), F.col("block") * self.block)
        hi = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * self.block)
        return rows.withColumns({"from": lo - F.col("begin"), "words": hi - lo})

    def taken(self) -> DataFrame:
        """``(doc_id, size, source_size, target, taken)`` for every document."""
        times = self.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
        used = self.pieces(self.documents).join(times, ["source_no", "block"], "left")
        used = used.groupBy("doc_id", "source_no", "begin", "size").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
        unused = self.documents.where("size = 0").select("doc_id", "source_no", "begin", "size", F.lit(0).cast("bigint").alias("taken"))
        target = broadcast_if_small(self.sources.select("source_no", "source_size", "target"))
        return used.unionByName(unused).join(target, "source_no").select("doc_id", "size", "source_size", "target", "taken")

    def text(self, docs: DataFrame) -> DataFrame:
        """The mix itself: ``(shard, slot, source, block, begin, doc_id, text)``, one row for each piece of a taken block.

        The pieces of a slot's block in the order of ``begin`` are its tokens. Texts
        meet their places once and blocks meet their slots once, by a shuffle: slots grow
        with the input, but Spark would judge them by the few rows that they are dealt from
        and broadcast them all.
        """
        key = ["_id", "_null", "text_key"]
        texts = _keyed(docs).groupBy(*key).agg(F.any_value("text").alias("text"))
        places = self.documents.select(*key, "doc_id", "source_no", "begin", "size")
        rows = self.pieces(texts.join(places, key).withColumn("_words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).drop("text"))
        words = F.array_join(F.slice("_words", F.col("from").cast("int") + 1, F.col("words").cast("int")), " ")
        rows = rows.select("source_no", "block", F.col("begin") + F.col("from"), "doc_id", words.alias("text")).toDF("source_no", "block", "begin", "doc_id", "text")
        mixed = rows.join(self.slots.hint("merge"), ["source_no", "block"]).join(broadcast_if_small(self.sources.select("source_no", "source")), "source_no")
        return mixed.select("shard", "slot", "source", "block", "begin", "doc_id", "text")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "source", "text", F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null"), F.xxhash64("text").alias("text_key")
    )


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("bigint")


def mixture(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = BLOCK, seed: int = 17, slots_per_shard: int = SLOTS_PER_SHARD) -> Mix:
    """Plan the mix of all rows of ``docs(doc_id, source, text)``.

    A document's size is its number of words; null and blank texts have none and
    are never taken. A null source is a source of its own, the last. Repeated rows
    and rows with a null id are documents of their own. A source's taken words differ
    from its target by less than a block and the rest of its last one, and no document is taken
    more than ``most`` times. Further columns are ignored; an empty table gives an empty mix.
    """
    sized = durable(_keyed(docs).select("_id", "_null", "text_key", "doc_id", "source", n_words(F.col("text")).alias("size")))
    sources = durable(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    of = sources.select(F.col("source").alias("_source"), "source_no")
    numbered_docs = sized.join(broadcast_if_small(of), sized["source"].eqNullSafe(of["_source"])).drop("_source")
    documents = running_total(numbered_docs, ["source_no"], [F.col("_null"), F.col("_id"), F.col("text_key")], F.col("size"), "_end")
    documents = durable(documents.withColumn("begin", F.col("_end") - F.col("size")).drop("_end"))

    whole = F.floor(F.col("target") / F.col("source_size"))
    blocks = F.ceil(F.col("source_size") / block)
    part = F.least(F.round((F.col("target") - whole * F.col("source_size")) / block).cast("bigint"), blocks)
    plan = durable(sources.where("source_size > 0").select("source_no", blocks.alias("blocks"), (whole * blocks + part).alias("slots")))
    total = plan.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, math.ceil(total / slots_per_shard))
    drawn = plan.mapInPandas(_drawn(shards, seed), "shard long, source_no long, blocks long, first long, slots long")
    # A number of tasks that follows the slots: adaptive execution would judge by the few rows that come in.
    tasks = max(1, math.ceil(total / SLOTS_PER_TASK))
    slots = drawn.repartition(tasks, "shard", "source_no").select("shard", "source_no", "blocks", F.explode(F.expr("sequence(first, first + slots - 1)")).alias("slot"))
    slots = slots.mapInArrow(_placed(seed), "shard long, source_no long, slot long, block long")
    return Mix(sources, documents, slots, block)
