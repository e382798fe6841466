"""Time helpers. Nothing here reads the clock: callers pass ``as_of``."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Local time is a fixed seven hours behind UTC, without daylight saving.
LOCAL_OFFSET_HOURS = 7

#: 12:34 on an event date means "no time known".
ALL_DAY_HOUR, ALL_DAY_MINUTE = 12, 34


def moment(as_of: datetime | str) -> datetime:
    return datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of


def ntz(value: datetime | str) -> Column:
    """A constant TIMESTAMP_NTZ column."""
    return F.lit(moment(value).isoformat(sep=" ")).cast("timestamp_ntz")


def midnight(as_of: datetime | str) -> datetime:
    return moment(as_of).replace(hour=0, minute=0, second=0, microsecond=0)


def sentinel_day(as_of: datetime | str) -> datetime:
    return midnight(as_of).replace(hour=ALL_DAY_HOUR, minute=ALL_DAY_MINUTE)


def hours(n: int) -> Column:
    return F.expr(f"INTERVAL '{n}' HOUR")


def to_local(ts: Column, offset_hours: int = LOCAL_OFFSET_HOURS) -> Column:
    return ts - hours(offset_hours)


def floor_to(unit: str, ts: Column) -> Column:
    """``date_trunc`` that stays TIMESTAMP_NTZ."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def is_all_day(ts: Column) -> Column:
    return (F.hour(ts) == ALL_DAY_HOUR) & (F.minute(ts) == ALL_DAY_MINUTE)


def since(df: DataFrame, column: str, start: datetime) -> DataFrame:
    """Rows at or after ``start``. Tables laid out by ``day`` are pruned as well."""
    out = df.where(F.col(column) >= ntz(start))
    if "day" in df.columns:
        out = out.where(F.col("day") >= F.lit(start.date()))
    return out


def ago(as_of: datetime | str, **span: int) -> datetime:
    return moment(as_of) - timedelta(**span)
