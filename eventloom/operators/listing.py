"""Event listing, shortlist, source list and the month calendar."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.text import clip, title_case
from eventloom.functions.times import midnight, ntz
from eventloom.session import broadcast_if_small

#: Score shown for events that were not scored yet.
NEUTRAL_SCORE = 0.5


def _day_or_none(text: str | None) -> datetime | None:
    """A ``YYYY-MM-DD`` request parameter; malformed values are ignored."""
    try:
        return datetime.strptime(text, "%Y-%m-%d") if text else None
    except ValueError:
        return None


def list_events(
    catalog: DataFrame,
    *,
    as_of: datetime | str,
    sources: Sequence[str] = (),
    start: str | None = None,
    end: str | None = None,
    sort: str = "date",
) -> DataFrame:
    """Events from today's midnight on, filtered and sorted, with a neutral score where none is known."""
    out = catalog.where(F.col("date") >= ntz(midnight(as_of)))
    if sources:
        out = out.where(F.col("source").isin(list(sources)))
    if first := _day_or_none(start):
        out = out.where(F.col("date") >= ntz(first))
    if last := _day_or_none(end):
        out = out.where(F.col("date") <= ntz(last.replace(hour=23, minute=59, second=59)))
    out = out.withColumn("match", F.coalesce("score", F.lit(NEUTRAL_SCORE)))
    return out.orderBy(F.desc("match"), "id") if sort == "score" else out.orderBy("date", "id")


def list_pinned(catalog: DataFrame, *, as_of: datetime | str) -> DataFrame:
    """The shortlist: pinned events from today's midnight on, by date."""
    return catalog.where(F.col("pinned") & (F.col("date") >= ntz(midnight(as_of)))).orderBy("date", "id")


def list_sources(catalog: DataFrame, registry: DataFrame) -> DataFrame:
    """Distinct sources sorted by display name."""
    return (
        catalog.select("source")
        .distinct()
        .join(registry.select(F.col("site_key").alias("source"), "display_name"), "source", "left")
        .select("source", F.coalesce("display_name", "source").alias("display_name"))
        .orderBy("display_name", "source")
    )


def source_names(catalog: DataFrame, registry: DataFrame) -> DataFrame:
    """Events with their source's display name; unknown keys are title-cased.

    The registry is broadcast while its measured size allows; beyond that Spark joins
    by shuffle with skewed sources split.
    """
    names = broadcast_if_small(registry.select(F.col("site_key").alias("source"), "display_name"))
    return catalog.join(names, "source", "left").withColumn(
        "display_name", F.coalesce("display_name", title_case(F.col("source")))
    )


def month_bounds(year: int, month: int) -> tuple[datetime, datetime]:
    """First moment and last counted second of a month; month 0 and 13 wrap."""
    if month < 1:
        year, month = year - 1, 12
    if month > 12:
        year, month = year + 1, 1
    first = datetime(year, month, 1)
    following = datetime(year + month // 12, month % 12 + 1, 1)
    return first, following - timedelta(seconds=1)


def calendar_month(catalog: DataFrame, year: int, month: int, *, sources: Sequence[str] = ()) -> DataFrame:
    """Events of one month, by date."""
    first, last = month_bounds(year, month)
    out = catalog.where(F.col("date").between(ntz(first), ntz(last)))
    if sources:
        out = out.where(F.col("source").isin(list(sources)))
    return out.orderBy("date", "id")


def calendar_grid(catalog: DataFrame) -> DataFrame:
    """Sunday-first weeks of every month that has events; 0 marks padding."""
    names = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]
    day = F.col("day")
    lead_in = F.dayofweek("month")
    return (
        catalog.select(F.trunc("date", "month").alias("month"))
        .distinct()
        .select("month", F.explode(F.sequence("month", F.last_day("month"), F.expr("INTERVAL 1 DAY"))).alias("day"))
        .select(
            "month",
            F.floor((F.dayofmonth(day) + lead_in - 2) / 7).cast("int").alias("week"),
            F.dayofweek(day).alias("weekday"),
            F.dayofmonth(day).alias("number"),
        )
        .groupBy("month", "week")
        .pivot("weekday", list(range(1, 8)))
        .agg(F.max("number"))
        .select("month", "week", *[F.coalesce(F.col(str(i + 1)), F.lit(0)).alias(n) for i, n in enumerate(names)])
    )


def day_counts(events: DataFrame) -> DataFrame:
    """Events per calendar day with the total of the day's month."""
    month = Window.partitionBy("month")  # at most 31 rows each
    return (
        events.groupBy(F.to_date("date").alias("day"))
        .agg(F.count("id").alias("events"))
        .withColumn("month", F.trunc("day", "month"))
        .withColumn("month_total", F.sum("events").over(month))
    )


def day_top3(events: DataFrame, *, n: int = 3) -> DataFrame:
    """The first events of each day as short chips, with the count of the rest.

    The rank filter sits directly on the window, so Spark trims every map task to
    ``n`` rows per day before the shuffle. The counts are a separate aggregate.
    """
    by_day = Window.partitionBy("day").orderBy("date", "id")
    chips = (
        events.withColumn("day", F.to_date("date")).withColumn("rank", F.row_number().over(by_day)).where(F.col("rank") <= n)
    )
    clock = F.regexp_replace(F.date_format("date", "hh:mma"), "^0+", "")
    short = F.concat(clip(F.col("title"), 26), F.when(F.length("title") > 26, "…").otherwise(""))
    counts = events.groupBy(F.to_date("date").alias("day")).agg(F.count("id").alias("events"))
    return chips.join(counts, "day").select(
        "day",
        "rank",
        "id",
        F.concat_ws(" ", clock, short).alias("chip"),
        F.greatest(F.col("events") - n, F.lit(0)).alias("more"),
    )

