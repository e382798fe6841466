"""Texts as rows that are told apart, and places found in them brought back to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.ordering import numbered
from eventloom.session import broadcast_if_small, durable

#: The largest table of places that is copied to every executor, in bytes; a larger one is shuffled with the texts.
PLACES = 48 << 20


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, text_no, copies)``: one row for equal rows of ``docs(doc_id, text)``.

    ``text_no`` numbers the different texts of a doc_id by their hash, so it is 0 nearly
    everywhere and costs next to nothing beside the id. Only texts of rows that occur more than
    once are shuffled.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    counts = docs.groupBy("doc_id", "_hash").agg(F.count("*").alias("copies"))
    several = counts.groupBy("doc_id").agg(F.count("*").alias("texts"), F.max("copies").alias("most")).where("texts > 1 OR most > 1")
    several = durable(several.select(F.col("doc_id").alias("_doc")))
    zero, one = F.lit(0), F.lit(1).cast("long")
    if several.isEmpty():
        return docs.select("doc_id", "text", zero.alias("text_no"), one.alias("copies"))
    odd = counts.join(broadcast_if_small(several, PLACES), F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    odd = numbered(odd, ["doc_id"], [F.col("_hash")]).select(
        F.col("doc_id").alias("_doc"), F.col("_hash").alias("_key"), "copies", (F.col("row_no") - 1).cast("int").alias("text_no")
    )
    odd = broadcast_if_small(durable(odd), PLACES)
    same = docs["doc_id"].eqNullSafe(odd["_doc"]) & (docs["_hash"] == odd["_key"])
    known = docs.join(odd, same, "left").select("doc_id", "text", F.coalesce("text_no", zero).alias("text_no"), F.coalesce("copies", one).alias("copies"))
    again = known.where("copies > 1").groupBy("doc_id", "text_no", "copies").agg(F.any_value("text").alias("text"))
    return known.where("copies = 1").unionByName(again.select(*known.columns))


def lists_of(found: DataFrame, one: str, many: str) -> DataFrame:
    """The values ``one`` that ``found(doc_id, text_no, one)`` has for each text, as a list ``many``."""
    return found.groupBy("doc_id", "text_no").agg(F.collect_list(one).alias(many))


def with_lists(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """``texts`` with what ``lists(doc_id, text_no, ...)`` has for them.

    The lists go to the texts if they are measured to be small, else both are shuffled.
    """
    lists = lists.withColumnsRenamed({"doc_id": "_doc", "text_no": "_key"})
    lists = broadcast_if_small(durable(lists), PLACES)
    same = texts["doc_id"].eqNullSafe(lists["_doc"]) & (texts["text_no"] == lists["_key"])
    return texts.join(lists, same, how).drop("_doc", "_key")
