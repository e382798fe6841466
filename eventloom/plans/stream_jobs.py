"""Streaming jobs over the given tables as file streams, run until all files are read."""

from datetime import timedelta

from pyspark.sql import functions as F

from eventloom.plans import catalog_jobs, profile_jobs, text_jobs  # noqa: F401 (their checks are reused)
from eventloom.plans.fixtures import CATALOG_AS_OF
from eventloom.plans.jobs import CHECKS, job
from eventloom.session import scratch_path
from eventloom.streaming import catalog, feedback, pages, usage


def _finish(query) -> None:
    query.awaitTermination()


def _paths(x, name: str) -> tuple[str, str]:
    return scratch_path(x.spark, name), scratch_path(x.spark, f"{name}-progress")


_TRIMMED = """
m AS (SELECT c.*, r.head, r.tail FROM cleaned c LEFT JOIN fx_registry r USING (site_key)),
h AS (SELECT *, CASE WHEN head IS NOT NULL AND strpos(text, head) > 0 THEN substr(text, strpos(text, head) + length(head))
                     ELSE text END AS body FROM m),
t AS (SELECT page_id, site_key, url, CASE WHEN tail IS NOT NULL AND strpos(body, tail) > 0
        THEN substr(body, 1, strpos(body, tail) - 1) ELSE body END AS text FROM h),
n AS (SELECT *, unnest(range(CASE WHEN length(text) <= 6000 THEN 1
                                  ELSE 1 + CAST(ceil((length(text) - 6000) / 5700) AS BIGINT) END)) AS i FROM t)"""


@job(
    "stream_pages",
    "fx_pages",
    "fx_registry",
    sql=f"""WITH {text_jobs._CLEAN.strip()}, {_TRIMMED.strip()}
    SELECT page_id, site_key, url, i + 1 AS chunk_no, i = max(i) OVER (PARTITION BY page_id) AS is_last,
           substr(text, i * 5700 + 1, 6000) AS text FROM n""",
)
def _pages(x):
    out, progress = _paths(x, "chunks")
    chunks = pages.stream_pages(x.stream("pages"), x.registry)
    _finish(pages.write_chunks(chunks, out, progress))
    return x.spark.read.schema(chunks.schema).parquet(out)


@job("stream_catalog", sql=CHECKS["merge_catalog"])
def _catalog(x):
    out, progress = _paths(x, "catalog")
    query = catalog.stream_catalog(x.stream("extracted"), x.catalog, x.registry, out, progress, as_of=CATALOG_AS_OF)
    _finish(query)
    return catalog.stored_catalog(x.spark, out)


@job(
    "stream_usage",
    "fx_llm_calls",
    sql="""WITH h AS (SELECT date_trunc('hour', timestamp) AS hour, api_key_label, model, count(id) AS calls,
                             coalesce(sum(prompt_tokens + completion_tokens), 0) AS tokens FROM fx_llm_calls GROUP BY 1, 2, 3)
    SELECT hour - CAST(b AS INT) * INTERVAL 1 HOUR AS window_start, hour - CAST(b AS INT) * INTERVAL 1 HOUR + INTERVAL 24 HOUR AS window_end,
           api_key_label, model, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens
    FROM (SELECT *, unnest(range(24)) AS b FROM h) GROUP BY 1, 2, 3, 4
    HAVING window_end <= (SELECT max(timestamp) - INTERVAL 1 HOUR FROM fx_llm_calls)""",
)
def _usage(x):
    out, progress = _paths(x, "usage")
    windows = usage.stream_usage(x.stream("llm_calls"))
    _finish(usage.write_closed(windows, out, progress))
    return x.spark.read.schema(windows.schema).parquet(out)


def _stored_feedback(x) -> str:
    """The path of the feedback table after all clicks and events have arrived; nothing waits longer than a minute."""
    clicks = x.stream("feedback_clicks").withColumn("arrived_at", F.col("created_at").cast("timestamp"))
    events = x.stream("catalog").withColumn("arrived_at", F.expr("TIMESTAMP'2024-01-01 00:00:00'"))
    out, progress = _paths(x, "feedback")
    rows = feedback.stream_feedback(clicks, events, wait=timedelta(0))
    _finish(feedback.write_stream(rows, out, progress, by="status"))
    return out


# Clicks of the last minute on unknown events still wait when the stream ends.
@job(
    "stream_snapshots",
    "fx_feedback_clicks",
    "fx_catalog",
    sql="""SELECT click_id, user_id, event_id, e.title AS event_title, e.venue AS event_venue, interested, c.created_at,
                  CASE WHEN e.id IS NULL THEN 'rejected' ELSE 'kept' END AS status, CASE WHEN e.id IS NULL THEN 'Event not found' END AS reason
           FROM fx_feedback_clicks c LEFT JOIN fx_catalog e ON c.event_id = e.id
           WHERE e.id IS NOT NULL OR date_trunc('milliseconds', c.created_at)
                 <= (SELECT date_trunc('milliseconds', max(created_at)) FROM fx_feedback_clicks) - INTERVAL 1 MINUTE""",
)
def _snapshots(x):
    rows = x.spark.read.schema(feedback.FEEDBACK).parquet(_stored_feedback(x))
    return rows.select("click_id", "user_id", "event_id", "event_title", "event_venue", "interested", "created_at", "status", "reason")


@job(
    "stream_feedback",
    "fx_feedback_clicks",
    "fx_catalog",
    "fx_profile",
    sql=f"""WITH {profile_jobs._SNAPSHOT.strip()},
    counts AS (SELECT f.user_id, count(*) AS total, coalesce(any_value(feedback_count_at_last_summary), 0) AS counted
               FROM feedback f LEFT JOIN fx_profile p ON f.user_id = p.user_id GROUP BY 1)
    SELECT user_id, counted + 10 * unnest(range(1, (total - counted) // 10 + 1)) AS total, CAST(10 AS BIGINT) AS new_feedback
    FROM counts WHERE total - counted >= 10""",
)
def _feedback(x):
    kept = x.spark.readStream.schema(feedback.FEEDBACK).parquet(_stored_feedback(x)).where("status = 'kept'")
    out, progress = _paths(x, "due")
    due = feedback.stream_due(kept, x.profile)
    _finish(feedback.write_stream(due, out, progress))
    return x.spark.read.schema(due.schema).parquet(out)
