"""Source health jobs."""

from pyspark.sql import functions as F

from eventloom.operators import health
from eventloom.plans.fixtures import CATALOG_AS_OF as AS_OF
from eventloom.plans.jobs import job

_NOW = f"TIMESTAMP '{AS_OF}'"
_COUNTS = f"""SELECT source, count(id) AS total, CAST(count(CASE WHEN date >= {_NOW} THEN 1 END) AS BIGINT) AS future
              FROM fx_catalog GROUP BY 1"""
_SPREAD = f"""SELECT source, count(DISTINCT strftime(date, '%Y-%m')) AS months FROM fx_catalog WHERE date >= {_NOW}
              GROUP BY 1"""
_LATEST = """SELECT source, run_timestamp AS last_run, success AS last_success, events_found AS last_events_found,
                    events_added AS last_events_added, duration_seconds AS last_duration, error_message AS last_error
             FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run_timestamp DESC, id DESC) AS rn
                   FROM fx_scraper_runs) WHERE rn = 1"""
_STATS = f"""SELECT s.source, total_runs, successful_runs, success_rate, avg_events, avg_duration,
                    last_run, last_success, last_events_found, last_events_added, last_duration, last_error
             FROM (SELECT source, count(*) AS total_runs, count(CASE WHEN success THEN 1 END) AS successful_runs,
                          count(CASE WHEN success THEN 1 END) / count(*) * 100 AS success_rate,
                          coalesce(sum(CASE WHEN events_found > 0 THEN events_found END), 0)
                            / greatest(count(CASE WHEN events_found > 0 THEN 1 END), 1) AS avg_events,
                          round(avg(duration_seconds), 6) AS avg_duration
                   FROM fx_scraper_runs GROUP BY 1) s JOIN ({_LATEST}) l ON s.source = l.source"""
_FILLED = f"""SELECT r.site_key AS source, display_name, coalesce(total_runs, 0) AS total_runs,
                     coalesce(successful_runs, 0) AS successful_runs, coalesce(success_rate, 0) AS success_rate,
                     coalesce(avg_events, 0) AS avg_events, coalesce(avg_duration, 0) AS avg_duration, last_run,
                     last_success, coalesce(last_events_found, 0) AS last_events_found,
                     coalesce(last_events_added, 0) AS last_events_added, coalesce(last_duration, 0) AS last_duration,
                     last_error
              FROM fx_registry r LEFT JOIN ({_STATS}) s ON r.site_key = s.source"""


def _rounded(df):
    return df.withColumn("avg_duration", F.round("avg_duration", 6))


@job("events_per_source", "fx_catalog", sql=_COUNTS)
def _counts(x):
    return health.events_per_source(x.catalog, as_of=AS_OF)


@job("month_spread", "fx_catalog", sql=_SPREAD)
def _spread(x):
    return health.month_spread(x.catalog, as_of=AS_OF)


@job("latest_run", "fx_scraper_runs", sql=_LATEST)
def _latest(x):
    return health.latest_run(x.scraper_runs)


@job("run_stats", "fx_scraper_runs", sql=_STATS)
def _stats(x):
    return _rounded(health.run_stats(x.scraper_runs))


@job("health_zero_fill", "fx_scraper_runs", "fx_registry", sql=_FILLED)
def _filled(x):
    return _rounded(health.health_zero_fill(x.registry, x.scraper_runs))


@job(
    "health_totals",
    "fx_catalog",
    "fx_scraper_runs",
    sql=f"""SELECT (SELECT count(*) FROM fx_catalog) AS total_events,
                   (SELECT count(*) FROM fx_catalog WHERE date >= {_NOW}) AS total_future,
                   count(*) AS total_runs, count(CASE WHEN success THEN 1 END) / count(*) * 100 AS success_rate
            FROM fx_scraper_runs""",
)
def _totals(x):
    return health.health_totals(x.catalog, x.scraper_runs, as_of=AS_OF)


_LOW = "avg_events > 0 AND last_events_found < avg_events * 0.5"


@job(
    "status_health",
    "fx_catalog",
    "fx_scraper_runs",
    "fx_registry",
    sql=f"""WITH s AS ({_FILLED}), labelled AS (
      SELECT s.source, display_name,
             CASE WHEN total_runs = 0 THEN 'No Runs' WHEN NOT last_success THEN 'Error'
                  WHEN last_events_found = 0 THEN 'Empty' WHEN {_LOW} THEN 'Low Yield'
                  WHEN success_rate < 50 THEN 'Flaky' ELSE 'Healthy' END AS label,
             CASE WHEN last_run IS NULL THEN 'neutral' WHEN last_events_found = 0 THEN 'zero' WHEN {_LOW} THEN 'low'
                  ELSE 'good' END AS yield_class,
             coalesce(months, 0) = 1 AND coalesce(future, 0) > 0 AS single_month, coalesce(future, 0) AS future
      FROM s LEFT JOIN ({_COUNTS}) c ON s.source = c.source LEFT JOIN ({_SPREAD}) m ON s.source = m.source)
    SELECT *, CASE label WHEN 'Error' THEN 'error' WHEN 'Healthy' THEN 'healthy' ELSE 'warning' END AS status
    FROM labelled""",
)
def _status(x):
    return health.status_health(x.registry, x.scraper_runs, x.catalog, as_of=AS_OF)
