"""Jobs from extracted events to the catalog."""

from pyspark.sql import functions as F

from eventloom.operators import catalog, health
from eventloom.plans.fixtures import CATALOG_AS_OF as AS_OF
from eventloom.plans.jobs import job
from eventloom.session import durable, scratch_path
from eventloom.sources import sinks, tables

_TODAY = f"TIMESTAMP '{AS_OF}'"
_CLOCK = r"""regexp_replace(regexp_replace(trim(split_part(time, '-', 1)), '\s*p\.m\.', ' PM', 'gi'), '(\d)pm$', '\1 PM', 'i')"""
_PARSED = f"""
parsed AS (SELECT *,
    coalesce(try_strptime(date || ' ' || {_CLOCK}, ['%Y-%m-%d %I:%M %p', '%Y-%m-%d %H:%M']),
             try_strptime(date, ['%Y-%m-%d', '%m/%d/%Y']) + INTERVAL 754 MINUTE) AS found
  FROM fx_extracted),
dated AS (SELECT * EXCLUDE (found), coalesce(found, {_TODAY} + INTERVAL 754 MINUTE) AS event_dt FROM parsed)"""
_CLAMPED = f"""{_PARSED},
clamped AS (SELECT * EXCLUDE (event_dt), CASE WHEN running THEN {_TODAY} ELSE event_dt END AS event_dt,
                   running AS is_ongoing
            FROM (SELECT *, coalesce(event_dt < {_TODAY} AND try_strptime(end_date, '%Y-%m-%d') >= {_TODAY}, false)
                         AS running FROM dated))"""
_CLASSED = f"""{_CLAMPED},
early AS (SELECT * EXCLUDE (title, running), trim(title) AS title,
                 CASE WHEN trim(title) = '' THEN 'no_title' WHEN event_dt < {_TODAY} AND NOT is_ongoing THEN 'past' END
                 AS verdict FROM clamped),
classed AS (SELECT e.* EXCLUDE (verdict),
              coalesce(verdict, CASE WHEN EXISTS (SELECT 1 FROM fx_catalog c WHERE c.title = e.title AND c.date = e.event_dt)
                                       OR row_number() OVER (PARTITION BY verdict IS NULL, title, event_dt ORDER BY row_id) > 1
                                     THEN 'duplicate' ELSE 'added' END) AS outcome
            FROM early e)"""
_LINK = r"""CASE WHEN coalesce(trim(e.url), '') = '' THEN '' WHEN starts_with(trim(e.url), 'http') OR r.url IS NULL THEN trim(e.url)
                ELSE regexp_extract(r.url, '^https?://[^/]*') || trim(e.url) END"""


@job("normalize_dates", "fx_extracted", sql=f"WITH {_PARSED.strip()} SELECT * FROM dated")
def _normalize(x):
    return catalog.normalize_dates(x.extracted, as_of=AS_OF)


@job(
    "date_quality",
    "fx_extracted",
    sql=f"""WITH {_PARSED.strip()} SELECT source, count(*) AS events, count(*) - count(found) AS unparseable,
              count(CASE WHEN coalesce(url, '') = '' THEN 1 END) AS missing_url,
              count(CASE WHEN coalesce(title, '') = '' THEN 1 END) AS missing_title
            FROM parsed GROUP BY 1""",
)
def _quality(x):
    return catalog.date_quality(x.extracted)


@job("clamp_ongoing", "fx_extracted", sql=f"WITH {_CLAMPED.strip()} SELECT * EXCLUDE (running) FROM clamped")
def _clamp(x):
    return catalog.clamp_ongoing(catalog.normalize_dates(x.extracted, as_of=AS_OF), as_of=AS_OF)


@job(
    "resolve_urls",
    "fx_extracted",
    "fx_registry",
    sql=f"SELECT e.* EXCLUDE (url), {_LINK} AS url FROM fx_extracted e LEFT JOIN fx_registry r ON e.source = r.site_key",
)
def _urls(x):
    return catalog.resolve_urls(x.extracted, x.registry)


@job("classify_save", "fx_extracted", "fx_catalog", sql=f"WITH {_CLASSED.strip()} SELECT * FROM classed")
def classify_save(x):
    return catalog.prepare_events(x.extracted, x.catalog, as_of=AS_OF)


@job(
    "merge_catalog",
    "fx_extracted",
    "fx_catalog",
    "fx_registry",
    sql=f"""WITH {_CLASSED.strip()}
    SELECT * FROM fx_catalog UNION ALL BY NAME
    SELECT (SELECT max(id) FROM fx_catalog) + row_number() OVER (ORDER BY row_id) AS id, title, trim(description) AS description,
           trim(venue) AS venue, e.source, 'general' AS category, event_dt AS date, {_LINK} AS url,
           CAST(NULL AS DOUBLE) AS score, false AS pinned
    FROM classed e LEFT JOIN fx_registry r ON e.source = r.site_key WHERE outcome = 'added'""",
)
def merge_catalog(x):
    classed = catalog.prepare_events(x.extracted, x.catalog, as_of=AS_OF)
    return catalog.insert_added(x.catalog, catalog.catalog_rows(classed, x.registry))


@job("purge_unpinned", "fx_catalog", sql="SELECT * FROM fx_catalog WHERE pinned")
def _purge(x):
    return catalog.purge_unpinned(x.catalog)


_COUNTERS = (
    "events_found events_added skipped_past skipped_duplicate skipped_no_title missing_url missing_time missing_venue "
    "pages_scraped text_chars"
).split()
_ZEROS = ", ".join(f"coalesce({c}, 0) AS {c}" for c in _COUNTERS)
_SUMMARY = f"""{_CLASSED},
pages_read AS (SELECT site_key AS source, count(*) AS pages_scraped, CAST(sum(length(text)) AS BIGINT) AS text_chars
               FROM fx_texts GROUP BY 1),
months AS (SELECT source, '{{' || string_agg('"' || month || '":' || n, ',' ORDER BY month) || '}}' AS month_distribution
           FROM (SELECT source, strftime(event_dt, '%Y-%m') AS month, count(*) AS n FROM classed
                 WHERE outcome IN ('added', 'duplicate') GROUP BY 1, 2) GROUP BY 1),
counted AS (SELECT source, count(*) AS events_found, count(CASE WHEN outcome = 'added' THEN 1 END) AS events_added,
    count(CASE WHEN outcome = 'past' THEN 1 END) AS skipped_past,
    count(CASE WHEN outcome = 'duplicate' THEN 1 END) AS skipped_duplicate,
    count(CASE WHEN outcome = 'no_title' THEN 1 END) AS skipped_no_title,
    count(CASE WHEN title <> '' AND trim(coalesce(url, '')) = '' THEN 1 END) AS missing_url,
    count(CASE WHEN title <> '' AND coalesce(time, '') = '' THEN 1 END) AS missing_time,
    count(CASE WHEN title <> '' AND trim(coalesce(venue, '')) = '' THEN 1 END) AS missing_venue
  FROM classed GROUP BY 1),
-- A source whose pages held no event at all has a run as well.
summary AS (SELECT coalesce(c.source, p.source) AS source, {_ZEROS},
              coalesce(month_distribution, '{{}}') AS month_distribution, {_TODAY} AS run_timestamp
            FROM counted c FULL JOIN pages_read p ON c.source = p.source LEFT JOIN months m ON c.source = m.source)"""


@job(
    "run_summary",
    "fx_extracted",
    "fx_catalog",
    "fx_texts",
    sql=f"WITH {_SUMMARY.strip()} SELECT * FROM summary",
)
def run_summary(x):
    return catalog.save_run(classify_save(x), x.registry, x.texts, as_of=AS_OF)[1]


# Every registered site runs; some fail, and some are not listed at all.
_OUTCOMES = """
outcomes AS (SELECT site_key AS source, wait_secs % 5 <> 2 AS success, CASE WHEN wait_secs % 5 = 2 THEN concat('no answer from ', url) END AS error_message,
               wait_secs / 4 AS duration_seconds FROM fx_registry WHERE wait_secs % 7 <> 3)"""
_RUN_LOG = f"""{_SUMMARY}, {_OUTCOMES.strip()},
runs AS (SELECT site_key AS source, {_TODAY} AS run_timestamp, CASE WHEN success THEN coalesce(events_found, 0) ELSE 0 END AS events_found,
           CASE WHEN success THEN coalesce(events_added, 0) ELSE 0 END AS events_added, coalesce(success, false) AS success,
           CASE WHEN success IS NULL THEN 'not run' ELSE error_message END AS error_message, duration_seconds
         FROM fx_registry r LEFT JOIN outcomes o ON r.site_key = o.source LEFT JOIN summary s ON r.site_key = s.source),
logged AS (SELECT CAST('0x' || md5('run-1|' || source)[1:15] AS BIGINT) AS id, * FROM runs UNION ALL
           SELECT CAST('0x' || md5('run-2|' || source)[1:15] AS BIGINT) AS id, * REPLACE (run_timestamp + INTERVAL 1 DAY AS run_timestamp) FROM runs)"""


def logged_runs(x):
    """The path of a run log after two runs, the second one logged twice."""
    outcomes = x.registry.selectExpr(
        "site_key AS source",
        "wait_secs % 5 <> 2 AS success",
        "CASE WHEN wait_secs % 5 = 2 THEN concat('no answer from ', url) END AS error_message",
        "wait_secs / 4 AS duration_seconds",
    ).where("wait_secs % 7 <> 3")
    path = scratch_path(x.spark, "source_runs")
    rows = durable(catalog.run_log(x.registry, run_summary(x), outcomes, as_of=AS_OF))
    sinks.sink_run_log(rows, path, run="run-1")
    tomorrow = rows.withColumn("run_timestamp", F.expr("run_timestamp + INTERVAL '1' DAY"))
    for _ in range(2):
        sinks.sink_run_log(tomorrow, path, run="run-2")
    return path


@job("sink_run_log", "fx_extracted", "fx_catalog", "fx_texts", "fx_registry", sql=f"WITH {_RUN_LOG.strip()} SELECT * FROM logged")
def _run_log(x):
    return tables.scan_table(x.spark, "source_runs", logged_runs(x)).drop("day")


@job(
    "run_stats_logged",
    "fx_extracted",
    "fx_catalog",
    "fx_texts",
    "fx_registry",
    sql=f"""WITH {_RUN_LOG.strip()},
    newest AS (SELECT * FROM logged WHERE run_timestamp > {_TODAY})
    SELECT l.source, count(*) AS total_runs, count(*) FILTER (l.success) AS successful_runs, count(*) FILTER (l.success) / count(*) * 100 AS success_rate,
           coalesce(sum(CASE WHEN l.events_found > 0 THEN l.events_found END), 0) / greatest(count(*) FILTER (l.events_found > 0), 1) AS avg_events,
           round(avg(l.duration_seconds), 6) AS avg_duration, any_value(n.run_timestamp) AS last_run, any_value(n.success) AS last_success,
           any_value(n.events_found) AS last_events_found, any_value(n.events_added) AS last_events_added,
           any_value(n.duration_seconds) AS last_duration, any_value(n.error_message) AS last_error
    FROM logged l JOIN newest n ON l.source = n.source GROUP BY 1""",
)
def _logged_stats(x):
    runs = tables.scan_table(x.spark, "source_runs", logged_runs(x))
    return health.run_stats(runs).withColumn("avg_duration", F.round("avg_duration", 6))
