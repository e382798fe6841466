"""From extracted events to the catalog: dates, outcomes, links and the merge.

Rows arrive with a unique ``row_id`` whose order is the arrival order; the first
arrival of a ``(title, date)`` wins. Winners are found with an aggregate and
joined back on ``row_id``, so a title repeated in a third of all rows never
meets in one task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from eventloom.functions.dates import day_only, with_parsed_date
from eventloom.functions.ordering import numbered
from eventloom.functions.text import blank, empty, strip
from eventloom.functions.times import midnight, moment, ntz, sentinel_day
from eventloom.functions.urls import join_url
from eventloom.session import broadcast_if_small, durable, scratch_path

KEY = ["title", "date"]


def normalize_dates(events: DataFrame, *, as_of: datetime | str) -> DataFrame:
    """Add ``event_dt``, read from the ``date`` and ``time`` texts.

    Unreadable dates become the ``as_of`` day at the all-day mark.
    """
    return with_parsed_date(events, "event_dt").withColumn(
        "event_dt", F.coalesce("event_dt", ntz(sentinel_day(as_of)))
    )


def date_quality(events: DataFrame) -> DataFrame:
    """Unreadable dates, missing links and missing titles per source."""
    return with_parsed_date(events, "_found").groupBy("source").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("_found").isNull()).alias("unparseable"),
        F.count_if(empty(F.col("url"))).alias("missing_url"),
        F.count_if(empty(F.col("title"))).alias("missing_title"),
    )


def clamp_ongoing(events: DataFrame, *, as_of: datetime | str) -> DataFrame:
    """Move events that started earlier and still run to today's midnight."""
    today = ntz(midnight(as_of))
    running = (F.col("event_dt") < today) & (day_only(F.col("end_date")) >= today)
    return events.withColumn("is_ongoing", F.coalesce(running, F.lit(False))).withColumn(
        "event_dt", F.when(F.col("is_ongoing"), today).otherwise(F.col("event_dt"))
    )


def resolve_urls(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Strip links and make relative ones absolute against the site's start address."""
    sites = registry.select(F.col("site_key").alias("source"), F.col("url").alias("_base"))
    link = F.coalesce(strip(F.col("url")), F.lit(""))
    keep = (link == "") | link.startswith("http") | F.col("_base").isNull()
    return (
        events.join(broadcast_if_small(sites), "source", "left")
        .withColumn("url", F.when(keep, link).otherwise(join_url(F.col("_base"), link)))
        .drop("_base")
    )


def _first_arrivals(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Ids of the rows that enter the catalog: first of their key and not stored yet.

    Rows with a null ``row_id`` do not compete. The catalog is first cut down to the
    keys at hand: while those are few they are broadcast and the catalog is only
    scanned, never shuffled.
    """
    first = durable(candidates.groupBy(*KEY).agg(F.min("row_id").alias("row_id")).where(F.col("row_id").isNotNull()))
    known = catalog.select(*KEY).join(broadcast_if_small(first.select(*KEY)), KEY, "left_semi").distinct()
    return first.join(known, KEY, "left_anti").select("row_id")


def classify_save(events: DataFrame, catalog: DataFrame, *, as_of: datetime | str) -> DataFrame:
    """Add ``outcome``: ``no_title``, ``past``, ``duplicate`` or ``added``.

    Expects the output of ``clamp_ongoing``.
    """
    rows = events.withColumn("title", F.coalesce(strip(F.col("title")), F.lit("")))
    past = (F.col("event_dt") < ntz(midnight(as_of))) & ~F.col("is_ongoing")
    rows = rows.withColumn("early", F.when(F.col("title") == "", "no_title").when(past, "past"))
    # Not a filter: Spark would push it below the projection and write out the date
    # parsing once more inside it. Rows out of the running share one empty key.
    running = F.col("early").isNull()
    kept = rows.select(
        F.when(running, F.col("row_id")).alias("row_id"),
        F.when(running, F.col("title")).alias("title"),
        F.when(running, F.col("event_dt")).alias("date"),
    )
    added = _first_arrivals(kept, catalog).withColumn("_added", F.lit(True))
    return (
        rows.join(added, "row_id", "left")
        .withColumn("outcome", F.coalesce("early", F.when(F.col("_added"), "added").otherwise("duplicate")))
        .drop("early", "_added")
    )


def prepare_events(extracted: DataFrame, catalog: DataFrame, *, as_of: datetime | str) -> DataFrame:
    """``normalize_dates``, ``clamp_ongoing`` and ``classify_save`` in a row."""
    dated = clamp_ongoing(normalize_dates(extracted, as_of=as_of), as_of=as_of)
    return classify_save(dated, catalog, as_of=as_of)


def catalog_rows(classified: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows with outcome ``added`` in catalog columns, still without an id."""
    added = resolve_urls(classified.where(F.col("outcome") == "added"), registry)

    def text(name: str) -> Column:
        return F.coalesce(strip(F.col(name)), F.lit("")).alias(name)

    return added.select(
        "row_id",
        "title",
        text("description"),
        text("venue"),
        F.col("event_dt").alias("date"),
        "url",
        "source",
        F.lit("general").alias("category"),
        F.lit(None).cast("double").alias("score"),
        F.lit(False).alias("pinned"),
    )


def with_ids(added: DataFrame, highest: int) -> DataFrame:
    """Rows of ``catalog_rows`` with ids after ``highest``, in arrival order."""
    return numbered(added, [], [F.col("row_id")]).withColumn("id", F.lit(highest).cast("bigint") + F.col("row_no")).drop("row_id", "row_no")


def insert_added(catalog: DataFrame, added: DataFrame) -> DataFrame:
    """The catalog with the rows that ``classify_save`` found to be new; no second search for them."""
    highest = catalog.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = with_ids(added, highest)
    return catalog.unionByName(fresh.select(*[c for c in catalog.columns if c in fresh.columns]), allowMissingColumns=True)


def new_catalog_rows(catalog: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming rows whose exact title and date are new, in catalog columns.

    Ids continue after the highest existing one in arrival order. For rows that ``classify_save``
    has not seen; it has searched the winners already.
    """
    incoming = durable(incoming)  # read for the winners and for their content
    winners = incoming.join(_first_arrivals(incoming.select("row_id", *KEY), catalog), "row_id")
    fresh = with_ids(winners, catalog.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
    return fresh.select(*[c for c in catalog.columns if c in fresh.columns])


def merge_catalog(catalog: DataFrame, incoming: DataFrame) -> DataFrame:
    """The catalog with the new rows of ``incoming`` inserted."""
    return catalog.unionByName(new_catalog_rows(catalog, incoming), allowMissingColumns=True)


def purge_unpinned(catalog: DataFrame) -> DataFrame:
    """What a full rebuild starts from: the pinned events."""
    return catalog.where("pinned")


def run_summary(classified: DataFrame, pages: DataFrame, *, as_of: datetime | str) -> DataFrame:
    """One row per source: pages, characters, outcomes, missing fields and months.

    ``pages`` has ``site_key`` and the trimmed ``text``. Field counters cover every
    titled event, also past ones; the month counts cover all that are not past.
    """
    outcome = F.col("outcome")
    titled = outcome != "no_title"
    month = F.when(outcome.isin("added", "duplicate"), F.date_format("event_dt", "yyyy-MM"))
    # First per source and month: afterwards a source has only a handful of rows.
    by_month = classified.groupBy("source", month.alias("month")).agg(
        F.count("*").alias("found"),
        F.count_if(outcome == "added").alias("added"),
        F.count_if(outcome == "past").alias("past"),
        F.count_if(outcome == "duplicate").alias("duplicate"),
        F.count_if(outcome == "no_title").alias("no_title"),
        F.count_if(titled & blank(F.col("url"))).alias("missing_url"),
        F.count_if(titled & empty(F.col("time"))).alias("missing_time"),
        F.count_if(titled & blank(F.col("venue"))).alias("missing_venue"),
    )
    entry = F.when(F.col("month").isNotNull(), F.struct("month", "found"))
    events = by_month.groupBy("source").agg(
        F.sum("found").alias("events_found"),
        F.sum("added").alias("events_added"),
        F.sum("past").alias("skipped_past"),
        F.sum("duplicate").alias("skipped_duplicate"),
        F.sum("no_title").alias("skipped_no_title"),
        F.sum("missing_url").alias("missing_url"),
        F.sum("missing_time").alias("missing_time"),
        F.sum("missing_venue").alias("missing_venue"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("months"),
    )
    read = pages.groupBy(F.col("site_key").alias("source")).agg(
        F.count("*").alias("pages_scraped"), F.sum(F.length("text")).alias("text_chars")
    )
    counters = [c for c in (*events.columns, *read.columns) if c not in ("source", "months")]
    return (
        events.join(read, "source", "full")
        .fillna(0, counters)
        .withColumn("month_distribution", F.coalesce(F.to_json("months"), F.lit("{}")))
        .withColumn("run_timestamp", ntz(moment(as_of)))
        .drop("months")
    )


def save_run(classified: DataFrame, registry: DataFrame, pages: DataFrame, *, as_of: datetime | str) -> tuple[DataFrame, DataFrame, dict]:
    """The rows to add, the summary per source and the totals of a run, from one evaluation of its extraction.

    The classified rows are stored once; Spark counts their outcomes on the way, and both
    results read what was stored.
    """
    spark, totals = classified.sparkSession, Observation("run")
    outcomes = ("added", "duplicate", "past", "no_title")
    path = scratch_path(spark, "classified")
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in outcomes]
    classified.observe(totals, F.count(F.lit(1)).alias("found"), *counts).write.parquet(path)
    stored = spark.read.schema(classified.schema).parquet(path)
    return catalog_rows(stored, registry), run_summary(stored, pages, as_of=as_of), totals.get


def run_log(sites: DataFrame, summary: DataFrame, outcomes: DataFrame, *, as_of: datetime | str) -> DataFrame:
    """One row per source of a run's ``sites`` (site_key), whether it succeeded or not.

    ``outcomes`` has source, success, error_message and duration_seconds as the fetcher saw
    them, and counts come from ``run_summary``. A site that failed has zero counts, and so has one
    without events; a site without an outcome did not run and counts as failed.
    """
    known = outcomes.select("source", "success", "error_message", "duration_seconds")
    counts = summary.select("source", "events_found", "events_added")
    done = F.coalesce("success", F.lit(False))

    def count(name: str) -> Column:
        return F.when(done, F.coalesce(name, F.lit(0).cast("bigint"))).otherwise(0).cast("bigint").alias(name)

    return (
        sites.select(F.col("site_key").alias("source"))
        .join(known, "source", "left")
        .join(counts, "source", "left")
        .select(
            "source",
            ntz(moment(as_of)).alias("run_timestamp"),
            count("events_found"),
            count("events_added"),
            done.alias("success"),
            F.when(F.col("success").isNull(), "not run").when(~F.col("success"), F.col("error_message")).alias("error_message"),
            "duration_seconds",
        )
    )
