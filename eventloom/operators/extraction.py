"""From model responses to event rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.text import title_key
from eventloom.schemas import EVENT_FIELDS, EXTRACTION


def parse_responses(responses: DataFrame) -> DataFrame:
    """Parse ``content``; cut a truncated answer back to its last complete event.

    Adds ``events``, ``next_page_url`` and ``status`` (``ok``, ``salvaged`` or
    ``failed``). A salvage counts only if it yields events.
    """
    content, usable = F.coalesce("content", F.lit("")), F.col("_usable")
    tail = F.substring_index(content, "},", -1)
    cut = F.substring(content, F.lit(1), F.length(content) - F.length(tail) - 1)
    repaired = F.when(F.contains(content, F.lit("},")), F.concat(cut, F.lit("]}")))

    # Each step is a column of its own and is used by the next ones, so every text is
    # parsed once for validity and once for its content.
    steps = (
        responses.withColumn("_valid", F.try_parse_json(content).isNotNull())
        .withColumn("_usable", F.when(F.col("_valid"), content).otherwise(repaired))
        .withColumn("_sound", usable.rlike(r"^\s*\{") & (F.col("_valid") | F.try_parse_json(usable).isNotNull()))
        .withColumn("_parsed", F.from_json(F.when(F.col("_sound"), usable), EXTRACTION))
        .withColumn(
            "status",
            F.when(F.col("_sound") & F.col("_valid"), "ok")
            .when(F.col("_sound") & (F.size("_parsed.events") > 0), "salvaged")
            .otherwise("failed"),
        )
    )
    good = F.col("status") != "failed"
    return steps.select(
        *responses.columns,
        F.when(good, F.col("_parsed.events")).alias("events"),
        F.when(good, F.col("_parsed.next_page_url")).alias("next_page_url"),
        "status",
    )


def explode_events(parsed: DataFrame) -> DataFrame:
    """One row per event with its page, chunk and position."""
    keys = [c for c in parsed.columns if c in ("site_key", "page_id", "chunk_no", "is_last")]
    # The outer form with a filter behind it: the inner form makes Spark test the array
    # in a filter below, which would parse every response a second time.
    rows = parsed.select(*keys, F.posexplode_outer("events").alias("pos", "event")).where(F.col("pos").isNotNull())
    return rows.select(
        *keys, F.col("pos").cast("bigint").alias("pos"), *[F.col(f"event.{name}").alias(name) for name in EVENT_FIELDS]
    )


def dedup_in_page(events: DataFrame) -> DataFrame:
    """On pages of several chunks keep the first event of each title; drop untitled ones.

    A page whose first chunk is also its last was read in one go and stays as it
    is, which each row shows by itself. The rows are read once and sorted by page and title
    only; a row that stays anyway is a group of its own.
    """
    single = F.coalesce((F.col("chunk_no") == 1) & F.col("is_last"), F.lit(False))
    marked = events.withColumn("_key", title_key(F.col("title"))).withColumn("_alone", F.when(single, F.col("pos")))
    first = Window.partitionBy("page_id", "_key", "_alone").orderBy("chunk_no", "pos")
    kept = marked.where((F.col("_key") != "") | F.col("_alone").isNotNull()).withColumn("_no", F.row_number().over(first))
    return kept.where(F.col("_no") == 1).drop("_key", "_alone", "_no")


def next_page(parsed: DataFrame) -> DataFrame:
    """The follow-up link of each page, which only its last chunk may give."""
    keys = [c for c in parsed.columns if c in ("site_key", "page_id")]
    return parsed.where("is_last").select(*keys, "next_page_url")
