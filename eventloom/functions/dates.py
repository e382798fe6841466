"""Reading the dates and times that extraction returns as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import empty, strip
from eventloom.functions.times import ALL_DAY_HOUR, ALL_DAY_MINUTE

# The accepted shapes. A one-digit day may be padded with a space.
_YEAR = r"((?!0000)\d{4})"
_MONTH = r"(1[0-2]|0?[1-9])"
_DAY = r"(?: (?=[1-9]\b))?(3[01]|[12]\d|0?[1-9])"
_ISO = rf"{_YEAR}-{_MONTH}-{_DAY}"
_NUMERIC = rf"^{_MONTH}/{_DAY}/{_YEAR}$"
_TWELVE_HOUR = rf"(?i)^{_ISO}\s+(1[0-2]|0?[1-9]):([0-5]?\d)\s*([ap]m)$"
_DAY_CLOCK = rf"^{_ISO}\s+(2[0-3]|[01]?\d):([0-5]?\d)$"
_MONTH_NAME = (
    r"((?:jan(?=(?:uary)?\s)|feb(?=(?:ruary)?\s)|mar(?=(?:ch)?\s)|apr(?=(?:il)?\s)|may(?=\s)|jun(?=e?\s)|jul(?=y?\s)"
    r"|aug(?=(?:ust)?\s)|sep(?=(?:tember)?\s)|oct(?=(?:ober)?\s)|nov(?=(?:ember)?\s)|dec(?=(?:ember)?\s)))[a-z]*"
)
_WEEKDAY = r"(?:(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday),\s+)?"
_NAMED = rf"(?i)^{_WEEKDAY}{_MONTH_NAME}\s+{_DAY},\s+{_YEAR}$"


def _read(text: Column, pattern: str, order: str, layout: str) -> Column:
    """The moment in ``text`` if it has the shape ``pattern`` and names a real day."""
    ordered = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, order))
    return F.try_to_timestamp(ordered, F.lit(layout)).cast("timestamp_ntz")


def day_only(text: Column) -> Column:
    """``YYYY-MM-DD`` at midnight, else null."""
    return _read(strip(text), f"^{_ISO}$", "$1-$2-$3", "yyyy-M-d")


def start_time(text: Column) -> Column:
    """The start of a time range with its am/pm mark written as `` AM`` / `` PM``."""
    out = strip(F.split_part(text, F.lit("-"), F.lit(1)))
    out = F.regexp_replace(out, r"(?i)\s*p\.m\.", " PM")
    out = F.regexp_replace(out, r"(?i)\s*a\.m\.", " AM")
    return F.regexp_replace(out, r"(?i)(\d)([ap]m)$", "$1 $2")


def with_parsed_date(df: DataFrame, out: str, *, date: str = "date", time: str = "time") -> DataFrame:
    """Add ``out``: the moment named by the two texts, or null when the date cannot be read.

    A date without a readable time is placed at the all-day mark. The stripped texts
    are columns of their own, so the plan computes them once and stays small.
    """
    day, both = F.col("_day"), F.col("_both")
    all_day = F.expr(f"INTERVAL '{ALL_DAY_HOUR}:{ALL_DAY_MINUTE}' HOUR TO MINUTE")
    moment = F.coalesce(
        _read(both, _TWELVE_HOUR, "$1-$2-$3 $4:$5 $6", "yyyy-M-d h:m a"),
        _read(both, _DAY_CLOCK, "$1-$2-$3 $4:$5", "yyyy-M-d H:m"),
        _read(day, f"^{_ISO}$", "$1-$2-$3", "yyyy-M-d") + all_day,
        _read(day, _NAMED, "$3-$1-$2", "yyyy-MMM-d") + all_day,
        _read(day, _NUMERIC, "$3-$1-$2", "yyyy-M-d") + all_day,
    )
    return (
        df.withColumn("_day", F.when(~empty(F.col(date)), strip(F.col(date))))
        .withColumn("_clock", F.when(~empty(F.col(time)), start_time(F.col(time))))
        .withColumn("_both", F.concat("_day", F.lit(" "), "_clock"))
        .withColumn(out, moment)
        .drop("_day", "_clock", "_both")
    )
