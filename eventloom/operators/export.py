"""Calendar exports: add-to-calendar links and calendar files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.ordering import numbered
from eventloom.functions.text import clip, form_encode, nullif_empty
from eventloom.functions.times import LOCAL_OFFSET_HOURS, hours, is_all_day, moment

DAY = "yyyyMMdd"
SECOND = "yyyyMMdd'T'HHmmss"

# The link endpoint, the block length in hours and the description cut.
LINK_BASE = "https://calendar.google.com/calendar/render?"
BLOCK_HOURS = 2
DESCRIPTION_CHARS = 1500


def _details() -> Column:
    """Description and source link, separated by a blank line; null when both are empty."""
    body = nullif_empty(clip(F.col("description"), DESCRIPTION_CHARS))
    link = F.concat(F.lit("Source: "), nullif_empty(F.col("url")))
    return nullif_empty(F.concat_ws("\n\n", body, link))


def export_gcal(events: DataFrame, *, zone: str = "America/Phoenix") -> DataFrame:
    """One add-to-calendar link per event."""
    start = F.col("date")
    dates = F.when(
        is_all_day(start),
        F.concat_ws("/", F.date_format(start, DAY), F.date_format(F.date_add(start, 1), DAY)),
    ).otherwise(F.concat_ws("/", F.date_format(start, SECOND), F.date_format(start + hours(BLOCK_HOURS), SECOND)))

    def param(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}="), form_encode(value))

    query = F.concat_ws(
        "&",
        F.lit("action=TEMPLATE"),
        param("text", F.coalesce(nullif_empty(F.col("title")), F.lit("Event"))),
        param("dates", dates),
        param("ctz", F.lit(zone)),
        param("details", _details()),
        param("location", nullif_empty(F.col("venue"))),
    )
    return events.select("id", F.concat(F.lit(LINK_BASE), query).alias("gcal_url"))


def ics_escape(text: Column) -> Column:
    out = text
    # Fixed values, in the order they have to be applied.
    for raw, escaped in [("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\n", "\\n"), ("\r", "\\n")]:
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def ics_fold(line: Column) -> Column:
    """Lines over 75 characters continue on lines of one space and 74 characters."""
    return F.concat(clip(line, 75), F.regexp_replace(F.substring(line, 76, 2**31 - 1), r"(?s)(.{1,74})", "\r\n $1"))


def vevents(events: DataFrame, *, as_of: datetime | str, uid: str, offset_hours: int = LOCAL_OFFSET_HOURS) -> DataFrame:
    """Events with their calendar entry text in ``vevent``. Local times are written in UTC."""
    stamp = moment(as_of).strftime("%Y%m%dT%H%M%SZ")
    start = F.col("date")
    utc = start + hours(offset_hours)
    all_day = is_all_day(start)

    def clock(ts: Column) -> Column:
        return F.concat(F.date_format(ts, SECOND), F.lit("Z"))

    def prop(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}:"), value)

    begin = F.when(all_day, prop("DTSTART;VALUE=DATE", F.date_format(start, DAY))).otherwise(prop("DTSTART", clock(utc)))
    finish = F.when(all_day, prop("DTEND;VALUE=DATE", F.date_format(F.date_add(start, 1), DAY))).otherwise(
        prop("DTEND", clock(utc + hours(BLOCK_HOURS)))
    )
    lines = [
        F.lit("BEGIN:VEVENT"),
        prop("UID", F.concat(F.lit(f"{uid}-"), F.col("id").cast("string"), F.lit("@localhost"))),
        F.lit(f"DTSTAMP:{stamp}"),
        begin,
        finish,
        prop("SUMMARY", F.coalesce(ics_escape(F.col("title")), F.lit(""))),
        prop("DESCRIPTION", ics_escape(_details())),
        prop("LOCATION", ics_escape(nullif_empty(F.col("venue")))),
        prop("URL", nullif_empty(F.col("url"))),
        F.lit("END:VEVENT"),
    ]
    # concat_ws leaves out the null (absent) properties.
    return events.withColumn("vevent", F.concat_ws("\r\n", *[ics_fold(line) for line in lines]))


def export_ics(
    events: DataFrame,
    calendar: Column,
    *,
    as_of: datetime | str,
    name: Column | None = None,
    producer: str = "-//eventloom//EN",
    uid: str = "eventloom",
    offset_hours: int = LOCAL_OFFSET_HOURS,
) -> DataFrame:
    """One calendar document for each calendar, as rows ``(calendar, seq, text)``.

    The texts of a calendar in the order of ``seq``, each ended by a line break, are
    its document: the head, one entry per event by date, and the end. No task has to
    hold a whole calendar. Events without a calendar form one of their own.
    """
    rows = vevents(events, as_of=as_of, uid=uid, offset_hours=offset_hours).select(
        calendar.cast("string").alias("calendar"),
        (calendar.cast("string") if name is None else name).alias("calendar_name"),
        "date",
        "id",
        "vevent",
    )
    # The numbering travels on the narrow columns only; the text joins back by event.
    order = numbered(rows.select("calendar", "date", "id"), ["calendar"], [F.col("date"), F.col("id")])
    order = order.select(F.col("calendar").alias("_calendar"), F.col("id").alias("_id"), "row_no")
    placed = rows.join(order, F.col("calendar").eqNullSafe(F.col("_calendar")) & (F.col("id") == F.col("_id")))
    entries = placed.select("calendar", F.col("row_no").alias("seq"), F.col("vevent").alias("text"))
    head = F.concat_ws(
        "\r\n",
        F.lit("BEGIN:VCALENDAR"),
        F.lit("VERSION:2.0"),
        F.lit(f"PRODID:{producer}"),
        F.lit("CALSCALE:GREGORIAN"),
        F.lit("METHOD:PUBLISH"),
        F.concat(F.lit("X-WR-CALNAME:"), ics_escape(F.col("calendar_name"))),
    )
    calendars = rows.groupBy("calendar").agg(F.min("calendar_name").alias("calendar_name"), F.count("id").alias("events"))
    first = F.struct(F.lit(0).cast("bigint").alias("seq"), head.alias("text"))
    last = F.struct((F.col("events") + 1).alias("seq"), F.lit("END:VCALENDAR").alias("text"))
    return calendars.select("calendar", F.inline(F.array(first, last))).unionByName(entries)
