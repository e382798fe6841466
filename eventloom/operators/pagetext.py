"""Page text: clean, trim, date, chunk, check and build prompts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.html import COUNTED, read_page
from eventloom.functions.text import clip, nullif_empty, strip
from eventloom.functions.times import moment
from eventloom.schemas import EVENT_FIELDS
from eventloom.session import broadcast_if_small

CHUNK_SIZE, CHUNK_OVERLAP = 6000, 300
#: Pages that are read as Python objects at once.
PAGES_AT_ONCE = 64
CHARS_PER_TOKEN = 2.2

# Calendar export links, which are not content.
_EXPORT_LINKS = [
    r"Google Calendar \[http://www\.google\.com/calendar/event\?[^\]]+\]",
    r"ICS \[/[^\]]+\?format=ical\]",
]


def read_html(pages: DataFrame) -> DataFrame:
    """Parse ``html`` in Arrow batches and replace it by ``raw_text``, ``tags`` and ``root``.

    The page itself does not travel back to the JVM. Page sizes vary widely; Spark
    closes a batch at 64 MB (``spark.sql.execution.arrow.maxBytesPerBatch``), and of a batch
    only ``PAGES_AT_ONCE`` pages are Python objects at a time. Rows are independent, so any
    partitioning will do.
    """
    schema = T.StructType(
        [field for field in pages.schema.fields if field.name != "html"]
        + [
            T.StructField("raw_text", T.StringType()),
            T.StructField("tags", T.MapType(T.StringType(), T.LongType())),
            T.StructField("root", T.StringType()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(start, PAGES_AT_ONCE)
                seen = [read_page(page or "") for page in part.column("html").to_pylist()]
                kept = [name for name in part.schema.names if name != "html"]
                new = {
                    "raw_text": pa.array([text for text, _, _ in seen], pa.string()),
                    "tags": pa.array([list(zip(COUNTED, counts)) for _, counts, _ in seen], pa.map_(pa.string(), pa.int64())),
                    "root": pa.array([root for _, _, root in seen], pa.string()),
                }
                yield pa.RecordBatch.from_arrays([*[part.column(name) for name in kept], *new.values()], [*kept, *new])

    return pages.mapInArrow(read, schema)


def tidy(text: Column) -> Column:
    """Drop export links and squeeze blank lines, spaces and tabs."""
    out = F.regexp_replace(text, r"\n{3,}", "\n\n")
    for pattern in _EXPORT_LINKS:
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"[ \t]+", " ")


def clean_pages(pages: DataFrame) -> DataFrame:
    """Readable text of each page in ``text``, links written as ``label [address]``."""
    return read_html(pages).withColumn("text", tidy(F.col("raw_text"))).drop("raw_text", "tags", "root")


def clean_stats(pages: DataFrame) -> DataFrame:
    """Sizes, reduction, token estimate, tag counts and content root per page."""
    sized = pages.select("page_id", "site_key", F.length("html").cast("bigint").alias("raw_chars"), "html")
    return (
        read_html(sized)
        .withColumn("clean_chars", F.length(tidy(F.col("raw_text"))).cast("bigint"))
        .select(
            "page_id",
            "site_key",
            "raw_chars",
            "clean_chars",
            F.expr("100 - clean_chars * 100 div greatest(raw_chars, 1)").alias("reduction"),
            tokens(F.col("clean_chars")).alias("tokens"),
            *[F.col("tags")[name].alias(f"n_{name}") for name in COUNTED],
            "root",
        )
    )


def tokens(chars: Column) -> Column:
    return F.floor(chars / CHARS_PER_TOKEN).cast("bigint")


def _with_markers(texts: DataFrame, registry: DataFrame) -> DataFrame:
    markers = registry.select(
        "site_key", nullif_empty(F.col("head")).alias("head"), nullif_empty(F.col("tail")).alias("tail")
    )
    # Beyond the measured bound Spark decides; the texts must not move to meet a few sites.
    return texts.join(broadcast_if_small(markers), "site_key", "left")


def _trimmed() -> Column:
    """``text`` behind the head marker and before the first tail marker that follows."""
    head_at = F.coalesce(F.expr("locate(head, text)"), F.lit(0))
    body = F.when(head_at > 0, F.expr("substring(text, locate(head, text) + length(head))")).otherwise(F.col("text"))
    return F.when(F.col("tail").isNotNull() & F.contains(body, F.col("tail")), F.split_part(body, F.col("tail"), F.lit(1))).otherwise(
        body
    )


def trim_boilerplate(texts: DataFrame, registry: DataFrame) -> DataFrame:
    """Cut each site's boilerplate. A marker that is missing cuts nothing."""
    return _with_markers(texts, registry).withColumn("text", _trimmed()).drop("head", "tail")


def trim_impact(texts: DataFrame, registry: DataFrame) -> DataFrame:
    """Characters removed by trimming, and their share, per site."""
    sized = _with_markers(texts, registry).select(
        "site_key", F.length("text").alias("before"), F.length(_trimmed()).alias("after")
    )
    return (
        sized.groupBy("site_key")
        .agg(F.sum("before").alias("chars_before"), F.sum(F.col("before") - F.col("after")).alias("chars_removed"))
        .withColumn("pct_removed", F.coalesce(F.try_divide(F.col("chars_removed") * 100, "chars_before"), F.lit(0.0)))
    )


def trim_audit(texts: DataFrame, registry: DataFrame) -> DataFrame:
    """Whether each marker occurs exactly once on every page of its site."""
    marked = _with_markers(texts, registry)
    marker = F.explode(
        F.array(
            F.struct(F.lit("head").alias("part"), F.col("head").alias("marker")),
            F.struct(F.lit("tail").alias("part"), F.col("tail").alias("marker")),
        )
    )
    # Count before exploding, so the text itself is not copied per marker.
    counts = marked.select(
        "site_key",
        *[
            F.when(
                F.col(m).isNotNull(),
                F.expr(f"(length(text) - length(replace(text, {m}, ''))) div length({m})"),
            ).alias(m)
            for m in ("head", "tail")
        ],
    )
    return (
        counts.select("site_key", marker.alias("m"))
        .select("site_key", "m.part", F.col("m.marker").alias("times"))
        .where(F.col("times").isNotNull())
        .groupBy("site_key", "part")
        .agg(
            F.count("*").alias("pages"),
            F.min("times").alias("min_times"),
            F.max("times").alias("max_times"),
            F.bool_and(F.col("times") == 1).alias("once_everywhere"),
        )
    )


def inject_dates(texts: DataFrame) -> DataFrame:
    """On month pages write lines that are only a day number as ``March 5, 2024:``.

    Needs ``year`` and ``month``. Numbers past the month's end stay as they are.
    """
    first = F.make_date("year", "month", F.lit(1))
    tail_days = {28: "", 29: "|29", 30: "|29|30", 31: "|29|30|31"}
    pattern = F.lit(None).cast("string")
    for last, extra in tail_days.items():
        days = rf"(?md)^([1-9]|1\d|2[0-8]{extra})$"
        pattern = F.when(F.dayofmonth(F.last_day(first)) == last, F.lit(days)).otherwise(pattern)
    dated = F.concat(F.date_format(first, "MMMM"), F.lit(" $1, "), F.col("year").cast("string"), F.lit(":"))
    return texts.withColumn("text", F.regexp_replace("text", pattern, dated))


def chunk_text(texts: DataFrame, *, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Overlapping windows of each text, numbered from 1. A short or empty text is one chunk."""
    step = size - overlap
    length = F.length("text")
    n = F.when(length <= size, 1).otherwise(1 + F.ceil((length - size) / step)).cast("int")
    windows = F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("text"), i * step + 1, F.lit(size))
    )
    keep = [c for c in texts.columns if c != "text"]
    return texts.select(*keep, n.alias("n_chunks"), F.posexplode(windows).alias("pos", "text")).select(
        *keep,
        (F.col("pos") + 1).cast("bigint").alias("chunk_no"),
        (F.col("pos") + 1 == F.col("n_chunks")).alias("is_last"),
        "text",
    )


def overlap_zones(chunks: DataFrame, *, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """The text each chunk shares with the following one: its own last characters."""
    return chunks.where(~F.col("is_last")).select(
        "page_id", "chunk_no", (F.col("chunk_no") + 1).alias("next_chunk_no"), F.right("text", F.lit(overlap)).alias("shared")
    )


def _flags(flags: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in flags.items()]))


def bot_block_flags(pages: DataFrame) -> DataFrame:
    """Signs that a fetch was blocked: wording near the top of the page, or a very short page."""
    top = F.lower(clip(F.col("html"), 3000))
    # The signs looked for.
    flags = {
        "access denied": F.contains(top, F.lit("access denied")),
        "captcha": F.contains(top, F.lit("captcha")),
        "just a moment": F.contains(top, F.lit("just a moment")),
        "title 403": F.contains(top, F.lit("<title>403")),
        "very short": F.length("html") < 2000,
    }
    return pages.select("page_id", "site_key", _flags(flags).alias("flags"))


# Wording of pages whose content was still loading.
PLACEHOLDERS = [
    "loading events",
    "loading...",
    "please wait",
    "javascript is required",
    "enable javascript",
    "calendar is loading",
    "fetching events",
    "events are loading",
]


def placeholder_flags(texts: DataFrame) -> DataFrame:
    """Empty, very short or still-loading page texts."""
    flags = {"very short": F.length("_body") < 100}
    flags |= {phrase: F.contains("_lower", F.lit(phrase)) for phrase in PLACEHOLDERS}
    warnings = F.when(F.col("_body") == "", F.array(F.lit("empty"))).otherwise(_flags(flags))
    return (
        texts.withColumn("_body", strip(F.coalesce("text", F.lit(""))))
        .withColumn("_lower", F.lower("_body"))
        .select("page_id", "site_key", warnings.alias("flags"))
    )


#: What the answer may hold for each key of an event; the keys are those of the stored schema.
FIELD_NOTES = {
    "title": "the event's name",
    "venue": "hall, park or room, else null",
    "description": "one or two sentences from the page, else null",
    "url": "link of the event's own page, unchanged, else null",
    "time": "start of the event on a twelve-hour clock, like 6:45 PM, else null",
    "date": "first day, as year-month-day: 2031-06-09",
    "end_date": "last day in the same form if the event spans several days, else null",
}
EXTRACT_TASK = "\n".join(
    [
        "Below is a piece of a web page. Collect the events it announces.",
        'Put them into the array "events", one object an event, with these keys and no others:',
        *[f"- {name}: {FIELD_NOTES[name]}" for name in EVENT_FIELDS],
        "Calendars may give the month once, above the days; a clock time may be near its date and not beside it.",
        "Of a span of hours take the beginning.",
        "",
    ]
)
LAST_CHUNK_TASK = """\
This piece ends the page. If the list of events goes on elsewhere (numbered pages, an arrow, a button for more), set
"next_page_url" to that whole address, else to null. Addresses stand in square brackets behind their labels.
"""
INNER_CHUNK_TASK = """\
The page goes on after this piece, so "next_page_url" is null.
"""
ANSWER_TASK = """\
Reply with JSON alone, one object with the keys "events" and "next_page_url".
"""


def build_prompts(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """The extraction request of each chunk. Only the last chunk is asked for the next page."""
    names = registry.select("site_key", nullif_empty(F.col("display_name")).alias("_hint"))
    source = F.concat(
        F.lit("Site: "), F.coalesce("_hint", F.lit("unknown")), F.lit("\nPage: "), F.coalesce("url", F.lit("")), F.lit("\n")
    )
    prompt = F.concat_ws(
        "\n",
        F.lit(EXTRACT_TASK),
        F.when(F.col("is_last"), F.lit(LAST_CHUNK_TASK)).otherwise(F.lit(INNER_CHUNK_TASK)),
        F.lit(ANSWER_TASK),
        source,
        F.concat(F.lit("PAGE TEXT:\n"), F.col("text")),
    )
    return chunks.join(broadcast_if_small(names), "site_key", "left").withColumn("prompt", prompt).drop("_hint")
