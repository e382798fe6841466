"""Token usage of model calls: rolling budget, daily, hourly and all-time views.

Tokens of a call are ``prompt + completion``; a call with either side missing
counts as a call but adds no tokens.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.times import (
    LOCAL_OFFSET_HOURS,
    ago,
    floor_to,
    hours,
    moment,
    ntz,
    since,
    to_local,
)

PAIR = ["api_key_label", "model"]


def call_tokens() -> Column:
    return F.col("prompt_tokens") + F.col("completion_tokens")


def _of_provider(calls: DataFrame, provider: str | None) -> DataFrame:
    return calls if provider is None else calls.where(F.col("provider") == provider)


def _window(calls: DataFrame, start: datetime, provider: str | None) -> DataFrame:
    return since(_of_provider(calls, provider), "timestamp", start)


def _pair_stats(calls: DataFrame, as_of: datetime | str, provider: str | None) -> DataFrame:
    """Everything one pass over the last 24 hours tells about each key and model."""
    oldest = F.min_by(F.struct("timestamp", F.coalesce(call_tokens(), F.lit(0)).alias("tokens")), F.struct("timestamp", "id"))
    return (
        _window(calls, ago(as_of, hours=24), provider)
        .groupBy(*PAIR)
        .agg(
            F.count("*").alias("calls"),
            F.coalesce(F.sum(call_tokens()), F.lit(0)).alias("tokens"),
            F.avg("duration_seconds").alias("avg_dur"),
            oldest.alias("oldest"),
        )
        .withColumn("next_tick_at", F.col("oldest.timestamp") + hours(24))
        .withColumn("next_tick_tokens", F.col("oldest.tokens"))
        .drop("oldest")
    )


def usage_24h(calls: DataFrame, *, as_of: datetime | str, provider: str | None = None) -> DataFrame:
    """Calls, tokens and mean duration per key and model over the last 24 hours."""
    return _pair_stats(calls, as_of, provider).select(*PAIR, "calls", "tokens", "avg_dur")


def budget_next_tick(calls: DataFrame, *, as_of: datetime | str, provider: str | None = None) -> DataFrame:
    """When the oldest call leaves the 24-hour window, and the tokens that frees."""
    return _pair_stats(calls, as_of, provider).select(*PAIR, "next_tick_at", "next_tick_tokens")


def budget_free_at(
    calls: DataFrame, limits: DataFrame, *, as_of: datetime | str, provider: str | None = None
) -> DataFrame:
    """When each over-limit pair drops below its daily limit again.

    The call whose leaving brings the sum below the limit is found by zooming in:
    first the minute, then the millisecond, then the microsecond. A pair has at
    most 1441, 60,000 and 1,000 of these, so no window ever holds a pair's calls
    and every aggregation combines on the map side.
    """
    # Key labels may be missing. As fields of one struct two missing labels are equal in a join.
    recent = _window(calls, ago(as_of, hours=24), provider).select(
        F.struct(*PAIR).alias("pair"), "timestamp", F.coalesce(call_tokens(), F.lit(0)).alias("tokens")
    )
    in_order = Window.partitionBy("pair").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)

    def crossing(steps: DataFrame) -> DataFrame:
        """The first step after which more than ``excess`` tokens have left, and what is still over before it."""
        return (
            steps.withColumn("left", F.col("excess") - F.sum("freed").over(in_order))
            .where(F.col("left") < 0)
            .groupBy("pair")
            .agg(F.min(F.struct("step", (F.col("left") + F.col("freed")).alias("excess"))).alias("first"))
            .select("pair", F.col("first.step").alias("slot"), F.col("first.excess").alias("excess"))
        )

    minutes = recent.groupBy("pair", floor_to("minute", F.col("timestamp")).alias("step")).agg(F.sum("tokens").alias("freed"))
    used = F.sum("freed").over(Window.partitionBy("pair"))
    found = crossing(
        minutes.withColumn("model", F.col("pair.model"))
        .join(limits.select("model", "tpd").where(F.col("tpd") > 0), "model")
        .withColumn("excess", used - F.col("tpd"))
        .where(F.col("excess") >= 0)
    )
    for coarse, fine in (("minute", "millisecond"), ("millisecond", "microsecond")):
        rows = recent.withColumn("slot", floor_to(coarse, F.col("timestamp"))).join(found, ["pair", "slot"])
        steps = rows.groupBy("pair", "excess", floor_to(fine, F.col("timestamp")).alias("step"))
        found = crossing(steps.agg(F.sum("tokens").alias("freed")))
    return found.select("pair.*", (F.col("slot") + hours(24)).alias("free_at"))


def usage_budget(
    calls: DataFrame, limits: DataFrame, *, as_of: datetime | str, provider: str | None = None
) -> DataFrame:
    """One card per key and model: usage, share of the daily limit, next tick, free-at and band."""
    shown = F.round("pct", 1)
    free = budget_free_at(calls, limits, as_of=as_of, provider=provider).select(F.struct(*PAIR).alias("pair"), "free_at")
    return (
        _pair_stats(calls, as_of, provider)
        .withColumn("pair", F.struct(*PAIR))
        .join(limits.select("model", F.when(F.col("tpd") > 0, F.col("tpd")).alias("tpd")), "model", "left")
        .join(free, "pair", "left")
        .withColumn("pct", F.col("tokens") / F.col("tpd") * 100)
        .withColumn(
            "band",
            F.when(F.col("pct").isNull(), "none").when(shown < 60, "green").when(shown < 85, "yellow").otherwise("red"),
        )
        .select(
            *PAIR, "calls", "tokens", "tpd", "pct", "avg_dur", "next_tick_at", "next_tick_tokens", "free_at", "band"
        )
    )


def usage_daily(
    calls: DataFrame,
    *,
    as_of: datetime | str,
    provider: str | None = None,
    days: int = 7,
    offset_hours: int = LOCAL_OFFSET_HOURS,
) -> DataFrame:
    """Calls and tokens per local day, key and model."""
    day = F.date_format(to_local(F.col("timestamp"), offset_hours), "yyyy-MM-dd")
    return (
        _window(calls, ago(as_of, days=days), provider)
        .groupBy(day.alias("local_day"), *PAIR)
        .agg(F.count("*").alias("calls"), F.coalesce(F.sum(call_tokens()), F.lit(0)).alias("tokens"))
    )


def local_days(as_of: datetime | str, days: int = 7, offset_hours: int = LOCAL_OFFSET_HOURS) -> list[str]:
    """The local calendar days the last ``days`` days touch."""
    end = moment(as_of) - timedelta(hours=offset_hours)
    start = end - timedelta(days=days)
    span = (end.date() - start.date()).days
    return [(start.date() + timedelta(days=i)).isoformat() for i in range(span + 1)]


def usage_daily_pivot(
    calls: DataFrame,
    *,
    as_of: datetime | str,
    provider: str | None = None,
    days: int = 7,
    offset_hours: int = LOCAL_OFFSET_HOURS,
) -> DataFrame:
    """``usage_daily`` with one column per day (null: no calls) and a row total."""
    daily = usage_daily(calls, as_of=as_of, provider=provider, days=days, offset_hours=offset_hours)
    names = local_days(as_of, days, offset_hours)
    # The day list is known from as_of, so the pivot needs no extra pass to find it.
    wide = daily.groupBy(*PAIR).pivot("local_day", names).agg(F.sum("tokens"))
    total = sum((F.coalesce(F.col(f"`{n}`"), F.lit(0)) for n in names), F.lit(0).cast("bigint"))
    return wide.withColumn("row_total", total)


def usage_hourly(
    calls: DataFrame,
    *,
    as_of: datetime | str,
    provider: str | None = None,
    days: int = 8,
    offset_hours: int = LOCAL_OFFSET_HOURS,
) -> DataFrame:
    """Tokens per local hour and model."""
    hour = floor_to("hour", to_local(F.col("timestamp"), offset_hours))
    return (
        _window(calls, ago(as_of, days=days), provider)
        .groupBy(hour.alias("hour"), "model")
        .agg(F.coalesce(F.sum(call_tokens()), F.lit(0)).alias("tokens"))
    )


def usage_rolling(
    calls: DataFrame,
    limits: DataFrame,
    *,
    as_of: datetime | str,
    provider: str | None = None,
    days: int = 7,
    offset_hours: int = LOCAL_OFFSET_HOURS,
) -> DataFrame:
    """Trailing 24-hour tokens for each hour of the last week and model, as % of the daily limit.

    Works on hourly sums, of which a model has at most 193: they are gathered per
    model and every hour of the timeline adds up its own 24. One scan, and hours
    without calls come out as they should. The percentage is rounded half up on
    exact integers.
    """
    hourly = usage_hourly(calls, as_of=as_of, provider=provider, days=days + 1, offset_hours=offset_hours)
    end = (moment(as_of) - timedelta(hours=offset_hours)).replace(minute=0, second=0, microsecond=0)
    start = (moment(as_of) - timedelta(hours=offset_hours, days=days)).replace(minute=0, second=0, microsecond=0)
    timeline = F.sequence(ntz(start), ntz(end), hours(1))
    trailing = F.filter(
        "sums", lambda s: (s["hour"] <= F.col("hour")) & (s["hour"] >= F.col("hour") - hours(23))
    )
    total = F.aggregate(trailing, F.lit(0).cast("bigint"), lambda so_far, s: so_far + s["tokens"])
    hundredths = F.expr("(rolling_tokens * 20000 + tpd) div (2 * tpd)")
    return (
        hourly.groupBy("model")
        .agg(F.collect_list(F.struct("hour", "tokens")).alias("sums"))
        .withColumn("hour", F.explode(timeline))
        .select("model", "hour", total.alias("rolling_tokens"))
        .join(limits.select("model", F.when(F.col("tpd") > 0, F.col("tpd")).alias("tpd")), "model", "left")
        .select("model", "hour", "rolling_tokens", "tpd", (hundredths / 100).alias("pct"))
    )


def usage_totals(calls: DataFrame, limits: DataFrame, *, provider: str | None = None) -> DataFrame:
    """All-time calls, tokens, mean duration and tokens per call of each model, busiest first."""
    return (
        _of_provider(calls, provider)
        .groupBy("model")
        .agg(
            F.count("*").alias("calls"),
            F.coalesce(F.sum(call_tokens()), F.lit(0)).alias("tokens"),
            F.avg("duration_seconds").alias("avg_dur"),
        )
        .join(limits.select("model", "tpd"), "model", "left")
        .withColumn("tokens_per_call", F.try_divide("tokens", "calls"))
        .orderBy(F.desc("calls"), "model")
    )


def recent_calls(calls: DataFrame, *, provider: str | None = None, n: int = 100) -> DataFrame:
    """The newest calls."""
    return _of_provider(calls, provider).orderBy(F.desc("id")).limit(n)


def recent_errors(errors: DataFrame, *, n: int = 50) -> DataFrame:
    """The newest logged errors."""
    return errors.orderBy(F.desc("id")).limit(n)
