"""Analysis of logged limit errors: what was hit, and for how long to wait."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.ordering import running_total
from eventloom.functions.times import floor_to, hours, ntz, since
from eventloom.operators.usage import PAIR, call_tokens
from eventloom.session import broadcast_if_small, durable

# Defaults for unknown models and the decision thresholds.
FALLBACK_TPM, FALLBACK_TPD = 6000, 100_000
NEAR_DAILY = 0.80
DEFAULT_RETRY, LONG_RETRY, CAPPED_RETRY = 60, 120, 90

# The wordings of a retry time, in the order they are tried. Each
# has the seconds its groups stand for and the seconds added on top. "450ms" is
# read as 450 minutes by the last wording; that is kept as it is.
_RETRY_WORDINGS = [
    (r"try again in (\d+)h(\d+)m([\d.]+)s", (3600, 60, 1), 1),
    (r"try again in (\d+)h(\d+)m", (3600, 60), 1),
    (r"try again in (\d+)h", (3600,), 60),
    (r"try again in ([\d.]+)s", (1,), 1),
    (r"try again in (\d+)m([\d.]+)s", (60, 1), 1),
    (r"try again in (\d+)m", (60,), 1),
]
_HEADER = r"(?i)'retry-after':\s*'(\d+)'"


def _seconds(text: Column) -> Column:
    waits = []
    for pattern, units, extra in _RETRY_WORDINGS:
        parts = [
            F.floor(F.regexp_extract(text, pattern, i + 1).try_cast("double")) * unit for i, unit in enumerate(units)
        ]
        waits.append(F.when(text.rlike(pattern), sum(parts[1:], parts[0]) + extra))
    return F.coalesce(*waits, F.lit(DEFAULT_RETRY)).cast("bigint")


def limit_parse(errors: DataFrame) -> DataFrame:
    """What the error text says: which limit, and the seconds to wait."""
    text = F.coalesce("error_text", F.lit(""))
    lower = F.lower(text)
    header = F.when(text.rlike(_HEADER), F.regexp_extract(text, _HEADER, 1).try_cast("bigint"))
    return errors.select(
        "*",
        (F.contains(lower, F.lit("tokens per day")) | F.contains(lower, F.lit("(tpd)"))).alias("says_daily"),
        (F.contains(lower, F.lit("tokens per minute")) | F.contains(lower, F.lit("(tpm)"))).alias("says_minute"),
        _seconds(text).alias("text_retry"),
        header.alias("header_retry"),
        F.greatest(_seconds(text), header).alias("retry_after"),  # greatest skips nulls
    )


def _minute(ts: Column) -> Column:
    return floor_to("minute", ts)


def limit_usage_join(errors: DataFrame, calls: DataFrame) -> DataFrame:
    """Tokens the error's key and model used in the 60 seconds and 24 hours up to the error.

    A range join would pair each error with a day of calls. Instead an error has three
    probe points (now, a minute ago, a day ago), and usage is the difference of running
    totals at two of them. The total has two levels: whole minutes, summed up on the map side
    and then added up over time, and the raw calls of the probes' own minutes, which alone
    are looked at one by one. Only calls of the errors' keys, models and days are read.
    """
    at = F.col("timestamp")
    zero = F.lit(0).cast("bigint")
    # A call at the very start of a window counts, one at the error's own moment too.
    before, call, after = 0, 1, 2

    points = F.explode(
        F.array(
            F.struct(F.lit("now").alias("probe"), at.alias("ts"), F.lit(after).alias("rank")),
            F.struct(F.lit("minute").alias("probe"), (at - F.expr("INTERVAL '60' SECOND")).alias("ts"), F.lit(before).alias("rank")),
            F.struct(F.lit("day").alias("probe"), (at - hours(24)).alias("ts"), F.lit(before).alias("rank")),
        )
    )
    probes = durable(errors.select("id", *PAIR, points.alias("p")).select("id", *PAIR, "p.*", _minute(F.col("p.ts")).alias("minute")))
    first, last = probes.agg(F.min("ts"), F.max("ts")).first()
    nothing = F.lit(None).cast("string").alias("probe")
    if first is None:
        return errors.withColumns({c: zero for c in ("tokens_60s", "tokens_24h")})
    asked = broadcast_if_small(durable(probes.select(*PAIR).distinct()))
    in_time = since(calls, "timestamp", _minute_of(first)).where(at <= ntz(last))
    spent = in_time.select("id", *PAIR, at.alias("ts"), _minute(at).alias("minute"), F.coalesce(call_tokens(), zero).alias("tokens"))
    spent = spent.join(asked, PAIR, "left_semi")

    by_minute = spent.groupBy(*PAIR, "minute").agg(F.sum("tokens").alias("tokens")).select(*PAIR, "minute", F.lit(call).alias("rank"), "tokens")
    marks = durable(probes.select(*PAIR, "minute").distinct())
    minutes = by_minute.unionByName(marks.select(*PAIR, "minute", F.lit(before).alias("rank"), zero.alias("tokens")))
    until = running_total(minutes, PAIR, [F.col("minute"), F.col("rank")], F.col("tokens"), "earlier").where(F.col("rank") == before)

    edges = spent.join(broadcast_if_small(marks), [*PAIR, "minute"], "left_semi").select(
        F.col("id").cast(dict(errors.dtypes)["id"]).alias("id"), *PAIR, "minute", nothing, "ts", F.lit(call).alias("rank"), "tokens"
    )
    line = probes.withColumn("tokens", zero).unionByName(edges)
    order = [F.col("ts"), F.col("rank"), F.col("id"), F.col("probe")]
    total = running_total(line, [*PAIR, "minute"], order, F.col("tokens"), "inside").where(F.col("probe").isNotNull())
    total = total.join(until.select(*PAIR, "minute", "earlier"), [*PAIR, "minute"]).withColumn("total", F.col("earlier") + F.col("inside"))

    def seen(probe: str) -> Column:
        return F.max(F.when(F.col("probe") == probe, F.col("total")))

    used = total.groupBy("id").agg(
        (seen("now") - seen("minute")).alias("tokens_60s"), (seen("now") - seen("day")).alias("tokens_24h")
    )
    return errors.join(used, "id", "left").withColumns({c: F.coalesce(c, zero) for c in ("tokens_60s", "tokens_24h")})


def _minute_of(moment: datetime) -> datetime:
    return moment.replace(second=0, microsecond=0)


def limit_classify(errors: DataFrame, calls: DataFrame, limits: DataFrame) -> DataFrame:
    """Daily or per-minute limit, and the wait.

    The text decides if it names a limit. Otherwise heavy use over the day means
    daily, and anything else is taken as passing, with long waits cut.
    """
    known = limits.select("model", "tpm", "tpd", F.lit(True).alias("_known"))
    parsed = limit_parse(limit_usage_join(errors, calls)).join(known, "model", "left")
    unknown = F.col("_known").isNull()
    tpd = F.when(unknown, FALLBACK_TPD).otherwise(F.col("tpd"))
    # Integer form of "used more than 80 % of the limit".
    near_daily = F.coalesce(F.col("tokens_24h") * 5 > tpd * 4, F.lit(False))
    daily = F.col("says_daily") | (~F.col("says_minute") & near_daily)
    unclear = ~F.col("says_daily") & ~F.col("says_minute") & ~near_daily
    return parsed.select(
        "id",
        "timestamp",
        *PAIR,
        F.when(daily, "daily").otherwise("tpm").alias("classified_as"),
        F.when(unclear & (F.col("retry_after") > LONG_RETRY), CAPPED_RETRY)
        .otherwise(F.col("retry_after"))
        .cast("bigint")
        .alias("retry_after_sec"),
        "tokens_60s",
        "tokens_24h",
        F.when(unknown, FALLBACK_TPM).otherwise(F.col("tpm")).alias("tpm"),
        tpd.alias("tpd"),
        F.substring("error_text", 1, 500).alias("error_snippet"),
    )


def error_classify(errors: DataFrame) -> DataFrame:
    """Class of other failures, by the status code found in the text."""
    kind = F.lit("error")
    for code in ("413", "503", "400"):  # the last one tested first
        kind = F.when(F.contains("error_text", F.lit(code)), f"error_{code}").otherwise(kind)
    return errors.withColumn("classified_as", kind)


def error_rows(failures: DataFrame, calls: DataFrame, limits: DataFrame) -> DataFrame:
    """Failed calls as rows of the error log: their class and, for limit errors, the seconds to wait.

    ``failures`` has call_key, timestamp, key, model and error_text (``inference.call_log``) and, if the
    caller knows the status of the answer, ``is_limit``; else an error is a limit error if its text says 429.
    """
    known = "is_limit" in failures.columns
    limited = F.coalesce(F.col("is_limit") if known else F.contains("error_text", F.lit("429")), F.lit(False))
    rows = failures.select(F.col("call_key").alias("id"), "timestamp", *PAIR, "error_text", limited.alias("is_limit"))
    columns = ["id", "timestamp", *PAIR, "classified_as", "retry_after_sec"]
    hit = limit_classify(rows.where("is_limit").drop("is_limit"), calls, limits).select(*columns)
    other = error_classify(rows.where("NOT is_limit")).withColumn("retry_after_sec", F.lit(None).cast("bigint")).select(*columns)
    return hit.unionByName(other).join(rows.select("id", "error_text"), "id").withColumnRenamed("id", "call_key")
