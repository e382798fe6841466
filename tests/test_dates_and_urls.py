import random
import re
from datetime import datetime
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from eventloom.functions.urls import join_url
from eventloom.operators.catalog import clamp_ongoing, normalize_dates

AS_OF = "2024-02-15 09:00:00"
ALL_DAY = datetime(2024, 2, 15, 12, 34)

DATES = [
    ("2024-03-05", "8:00 PM", datetime(2024, 3, 5, 20, 0)),
    ("2024-03-05", "8:00 PM - 10:00 PM", datetime(2024, 3, 5, 20, 0)),
    ("2024-3-5", "1:30pm", datetime(2024, 3, 5, 13, 30)),
    ("2024-03-05", "1:30 p.m.", datetime(2024, 3, 5, 13, 30)),
    ("2024-03-05", "12:15 A.M.", datetime(2024, 3, 5, 0, 15)),
    ("2024-03-05", "12:15 pm", datetime(2024, 3, 5, 12, 15)),
    ("2024-03-05", "19:30", datetime(2024, 3, 5, 19, 30)),
    ("2024-03-05", "7 PM", datetime(2024, 3, 5, 12, 34)),
    ("2024-03-05", "7:00 PM – 9:00 PM", datetime(2024, 3, 5, 12, 34)),
    ("2024-03-05", "25:00", datetime(2024, 3, 5, 12, 34)),
    ("2024-03-05", None, datetime(2024, 3, 5, 12, 34)),
    (" 2024-03-05 ", "", datetime(2024, 3, 5, 12, 34)),
    ("2024-02-30", "8:00 PM", ALL_DAY),
    ("March 5, 2024", "8:00 PM", datetime(2024, 3, 5, 12, 34)),
    ("mar 5, 2024", None, datetime(2024, 3, 5, 12, 34)),
    ("Tuesday, March 5, 2024", None, datetime(2024, 3, 5, 12, 34)),
    ("Friday, Mar 05, 2024", None, datetime(2024, 3, 5, 12, 34)),
    ("Tues, March 5, 2024", None, ALL_DAY),
    ("Marc 5, 2024", None, ALL_DAY),
    ("3/5/2024", None, datetime(2024, 3, 5, 12, 34)),
    ("13/5/2024", None, ALL_DAY),
    ("2024-03-05 extra", None, ALL_DAY),
    ("soon", "8:00 PM", ALL_DAY),
    ("", "8:00 PM", ALL_DAY),
    (None, None, ALL_DAY),
]


def test_normalize_dates(spark):
    rows = [(i, d, t) for i, (d, t, _) in enumerate(DATES)]
    df = normalize_dates(spark.createDataFrame(rows, "i INT, date STRING, time STRING"), as_of=AS_OF)
    got = {r.i: r.event_dt for r in df.collect()}
    assert {i: (DATES[i][:2], got[i]) for i in got} == {i: (d[:2], d[2]) for i, d in enumerate(DATES)}


def by_hand(date, time):
    """The rules once more in plain Python, for texts drawn at random."""
    day = (date or "").strip()
    start = (time or "").split("-")[0].strip()
    start = re.sub(r"\s*([ap])\.m\.", r" \1M", start, flags=re.I)
    start = re.sub(r"(\d)([ap]m)$", r"\1 \2", start, flags=re.I)
    tries = [(f"{day} {start}", f) for f in ("%Y-%m-%d %I:%M %p", "%Y-%m-%d %H:%M")] if time else []
    tries += [(day, f) for f in ("%Y-%m-%d", "%B %d, %Y", "%b %d, %Y", "%A, %B %d, %Y", "%A, %b %d, %Y", "%m/%d/%Y")]
    for text, layout in tries:
        try:
            found = datetime.strptime(text, layout)
        except ValueError:
            continue
        return found if "M" in layout else found.replace(hour=12, minute=34)
    return ALL_DAY


def test_normalize_dates_at_random(spark):
    rng = random.Random(3)
    days = ["{y}-{m}-{d}", "{y}-{m:02d}-{d:02d}", "{m}/{d}/{y}", "{B} {d}, {y}", "{b} {d:02d}, {y}", "Monday, {B} {d}, {y}", "x{y}"]
    clocks = ["{h}:{n:02d} PM", "{h}:{n}am", "{h}:{n:02d}", "{h} PM", "{h}:{n:02d} p.m. - 11:00 PM", "", None]
    rows = []
    for i in range(400):
        when = datetime(2024, rng.randint(1, 12), 1)
        v = {"y": rng.choice([2023, 2024, 2025]), "m": rng.randint(1, 13), "d": rng.randint(0, 32), "h": rng.randint(0, 25), "n": rng.randint(0, 61)}
        v |= {"B": when.strftime("%B"), "b": when.strftime("%b")}
        clock = rng.choice(clocks)
        rows.append((i, rng.choice(days).format(**v), clock and clock.format(**v)))
    df = normalize_dates(spark.createDataFrame(rows, "i INT, date STRING, time STRING"), as_of=AS_OF)
    got = {r.i: r.event_dt for r in df.collect()}
    wrong = [(d, t, got[i], by_hand(d, t)) for i, d, t in rows if got[i] != by_hand(d, t)]
    assert wrong == []


def test_clamp_ongoing(spark):
    rows = [
        (1, datetime(2024, 2, 1, 20), "2024-03-01", datetime(2024, 2, 15), True),
        (2, datetime(2024, 2, 1, 20), "2024-02-15", datetime(2024, 2, 15), True),
        (3, datetime(2024, 2, 1, 20), "2024-02-14", datetime(2024, 2, 1, 20), False),
        (4, datetime(2024, 2, 1, 20), "TBD", datetime(2024, 2, 1, 20), False),
        (5, datetime(2024, 2, 20), "2024-03-01", datetime(2024, 2, 20), False),
        (6, datetime(2024, 2, 1), None, datetime(2024, 2, 1), False),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "i INT, event_dt TIMESTAMP_NTZ, end_date STRING")
    got = sorted((r.i, r.event_dt, r.is_ongoing) for r in clamp_ongoing(df, as_of=AS_OF).collect())
    assert got == [(r[0], r[3], r[4]) for r in rows]


BASES = ["https://h.org/a/b/c?q=1", "https://h.org", "https://h.org/", "http://h.org:80/dir/", "https://h.org/page.aspx?x=2"]
LINKS = [
    "/x/y", "x", "x/y?z=1", "./x", "../x", "../../x", "../../../x", "/a/../b", "/a/./b/", "?p=2", "#f", "x#f", "//o.org/p",
    "mailto:a@b.c", "javascript:void(0)", "/", ".", "..", "x/..", "/a/b/..", "e/1//2", "ftp://f/x", "x?u=/../y",
]


def test_join_url_like_the_standard_library(spark):
    rows = [(b, link) for b in BASES for link in LINKS]
    df = spark.createDataFrame(rows, "base STRING, link STRING").withColumn("got", join_url(F.col("base"), F.col("link")))
    wrong = [(r.base, r.link, r.got, urljoin(r.base, r.link)) for r in df.collect() if r.got != urljoin(r.base, r.link)]
    assert wrong == []
