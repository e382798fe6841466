"""Listing, calendar and export jobs."""

from pyspark.sql import functions as F

from eventloom.operators import export, listing
from eventloom.plans.fixtures import CATALOG_AS_OF as AS_OF
from eventloom.plans.jobs import job

_TODAY = f"date >= TIMESTAMP '{AS_OF}'"


@job(
    "list_events",
    "fx_catalog",
    sql=f"SELECT *, coalesce(score, 0.5) AS match FROM fx_catalog WHERE {_TODAY}",
)
def _list(x):
    return listing.list_events(x.catalog, as_of=AS_OF, start="not a date")


@job(
    "list_events_filtered",
    "fx_catalog",
    sql=f"""SELECT *, coalesce(score, 0.5) AS match FROM fx_catalog
            WHERE {_TODAY} AND source IN ('src1', 'src3', 'src12') AND date >= TIMESTAMP '2024-02-20 00:00:00'
              AND date <= TIMESTAMP '2024-03-31 23:59:59'""",
)
def _list_filtered(x):
    return listing.list_events(
        x.catalog, as_of=AS_OF, sources=["src1", "src3", "src12"], start="2024-02-20", end="2024-03-31", sort="score"
    )


@job("list_pinned", "fx_catalog", sql=f"SELECT * FROM fx_catalog WHERE pinned AND {_TODAY}")
def _pinned(x):
    return listing.list_pinned(x.catalog, as_of=AS_OF)


@job(
    "list_sources",
    "fx_catalog",
    "fx_registry",
    sql="""SELECT DISTINCT source, coalesce(display_name, source) AS display_name
           FROM fx_catalog LEFT JOIN fx_registry ON source = site_key""",
)
def _sources(x):
    return listing.list_sources(x.catalog, x.registry)


@job(
    "source_names",
    "fx_catalog",
    "fx_registry",
    sql="""SELECT c.*, coalesce(display_name, concat(upper(source[1]), source[2:])) AS display_name
           FROM fx_catalog c LEFT JOIN fx_registry ON source = site_key""",
)
def _names(x):
    return listing.source_names(x.catalog, x.registry)


@job(
    "calendar_month",
    "fx_catalog",
    sql="SELECT * FROM fx_catalog WHERE date >= TIMESTAMP '2024-03-01' AND date <= TIMESTAMP '2024-03-31 23:59:59'",
)
def _month(x):
    return listing.calendar_month(x.catalog, 2024, 3)


_GRID_DAYS = ", ".join(
    f"CAST(coalesce(max(CASE WHEN dayofweek(day) = {i} THEN dayofmonth(day) END), 0) AS INT) AS {name}"
    for i, name in enumerate(["sun", "mon", "tue", "wed", "thu", "fri", "sat"])
)


@job(
    "calendar_grid",
    "fx_catalog",
    sql=f"""WITH m AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS month FROM fx_catalog),
    d AS (SELECT month, CAST(unnest(generate_series(CAST(month AS TIMESTAMP), CAST(last_day(month) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
          FROM m)
    SELECT month, CAST((dayofmonth(day) + dayofweek(month) - 1) // 7 AS INT) AS week, {_GRID_DAYS} FROM d GROUP BY 1, 2""",
)
def _grid(x):
    return listing.calendar_grid(x.catalog)


_COUNTS = "SELECT CAST(date AS DATE) AS day, count(id) AS events FROM fx_catalog GROUP BY 1"


@job(
    "day_counts",
    "fx_catalog",
    sql=f"""SELECT *, CAST(date_trunc('month', day) AS DATE) AS month,
                   CAST(sum(events) OVER (PARTITION BY date_trunc('month', day)) AS BIGINT) AS month_total
            FROM ({_COUNTS})""",
)
def _day_counts(x):
    return listing.day_counts(x.catalog)


@job(
    "day_top3",
    "fx_catalog",
    sql=f"""SELECT r.day, CAST(rank AS INT) AS rank, id,
                   concat(ltrim(strftime(date, '%I:%M%p'), '0'), ' ', substr(title, 1, 26),
                          CASE WHEN length(title) > 26 THEN '…' ELSE '' END) AS chip,
                   greatest(events - 3, 0) AS more
            FROM (SELECT *, CAST(date AS DATE) AS day,
                         row_number() OVER (PARTITION BY CAST(date AS DATE) ORDER BY date, id) AS rank FROM fx_catalog) r
            JOIN ({_COUNTS}) c ON r.day = c.day WHERE rank <= 3""",
)
def _day_top3(x):
    return listing.day_top3(x.catalog)


_DETAILS = """concat_ws(chr(10) || chr(10), nullif(substr(description, 1, 1500), ''),
                        CASE WHEN url <> '' THEN 'Source: ' || url END)"""
_ALL_DAY = "hour(date) = 12 AND minute(date) = 34"


def _form(text: str) -> str:
    return f"replace(replace(url_encode({text}), '%20', '+'), '*', '%2A')"


@job(
    "export_gcal",
    "fx_catalog",
    sql=f"""SELECT id, concat('https://calendar.google.com/calendar/render?action=TEMPLATE&text=',
              {_form("coalesce(nullif(title, ''), 'Event')")}, '&dates=', {_form(f'''CASE WHEN {_ALL_DAY}
                THEN strftime(date, '%Y%m%d') || '/' || strftime(date + INTERVAL 1 DAY, '%Y%m%d')
                ELSE strftime(date, '%Y%m%dT%H%M%S') || '/' || strftime(date + INTERVAL 2 HOUR, '%Y%m%dT%H%M%S') END''')},
              '&ctz=America%2FPhoenix',
              CASE WHEN {_DETAILS} <> '' THEN '&details=' || {_form(_DETAILS)} ELSE '' END,
              CASE WHEN venue <> '' THEN '&location=' || {_form('venue')} ELSE '' END) AS gcal_url
            FROM fx_catalog""",
)
def _gcal(x):
    return export.export_gcal(x.catalog)


def _escaped(text: str) -> str:
    for raw, out in [("'\\'", "'\\\\'"), ("';'", "'\\;'"), ("','", "'\\,'"), ("chr(13) || chr(10)", "'\\n'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\n'")]:
        text = f"replace({text}, {raw}, {out})"
    return text


_CRLF = "chr(13) || chr(10)"
_ICS = f"""
lines AS (SELECT id, source, date, unnest([
    {{'n': 1, 't': 'BEGIN:VEVENT'}}, {{'n': 2, 't': concat('UID:eventloom-', id, '@localhost')}},
    {{'n': 3, 't': 'DTSTAMP:20240215T000000Z'}},
    {{'n': 4, 't': CASE WHEN {_ALL_DAY} THEN 'DTSTART;VALUE=DATE:' || strftime(date, '%Y%m%d')
                        ELSE 'DTSTART:' || strftime(date + INTERVAL 7 HOUR, '%Y%m%dT%H%M%SZ') END}},
    {{'n': 5, 't': CASE WHEN {_ALL_DAY} THEN 'DTEND;VALUE=DATE:' || strftime(date + INTERVAL 1 DAY, '%Y%m%d')
                        ELSE 'DTEND:' || strftime(date + INTERVAL 9 HOUR, '%Y%m%dT%H%M%SZ') END}},
    {{'n': 6, 't': 'SUMMARY:' || {_escaped('title')}}},
    {{'n': 7, 't': CASE WHEN {_DETAILS} <> '' THEN 'DESCRIPTION:' || {_escaped(_DETAILS)} END}},
    {{'n': 8, 't': CASE WHEN venue <> '' THEN 'LOCATION:' || {_escaped('venue')} END}},
    {{'n': 9, 't': CASE WHEN url <> '' THEN 'URL:' || url END}},
    {{'n': 10, 't': 'END:VEVENT'}}]) AS l FROM fx_catalog),
folded AS (SELECT id, source, date, l.n AS n,
                  CASE WHEN length(l.t) <= 75 THEN l.t
                       ELSE array_to_string(list_concat([substr(l.t, 1, 75)],
                              list_transform(range(76, length(l.t) + 1, 74), lambda i: ' ' || substr(l.t, i, 74))), {_CRLF})
                  END AS line FROM lines WHERE l.t IS NOT NULL),
entries AS (SELECT id, source, date, string_agg(line, {_CRLF} ORDER BY n) AS vevent FROM folded GROUP BY 1, 2, 3)"""
_HEAD = " || chr(13) || chr(10) || ".join(
    ["'BEGIN:VCALENDAR'", "'VERSION:2.0'", "'PRODID:-//eventloom//EN'", "'CALSCALE:GREGORIAN'", "'METHOD:PUBLISH'"]
)


@job(
    "export_ics",
    "fx_catalog",
    sql=f"""WITH {_ICS.strip()},
    placed AS (SELECT source AS calendar, row_number() OVER (PARTITION BY source ORDER BY date, id) AS seq, vevent AS text FROM entries)
    SELECT * FROM placed UNION ALL
    SELECT source, 0, {_HEAD} || {_CRLF} || 'X-WR-CALNAME:' || source FROM entries GROUP BY source UNION ALL
    SELECT source, count(*) + 1, 'END:VCALENDAR' FROM entries GROUP BY source""",
)
def export_ics(x):
    return export.export_ics(x.catalog, F.col("source"), as_of=AS_OF)
