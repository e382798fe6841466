"""Usage jobs over the call log."""

from pyspark.sql import functions as F

from eventloom.operators import usage
from eventloom.plans.fixtures import USAGE_AS_OF as AS_OF
from eventloom.plans.jobs import job

GROQ = "groq"
DAYS = usage.local_days(AS_OF)

_RECENT = "provider = 'groq' AND timestamp >= TIMESTAMP '2024-01-30 00:00:00'"
_SUM = "CAST(coalesce(sum(prompt_tokens + completion_tokens), 0) AS BIGINT)"

_USAGE = f"""
u AS (SELECT api_key_label, model, count(id) AS calls, {_SUM} AS tokens, round(avg(duration_seconds), 6) AS avg_dur
      FROM fx_llm_calls WHERE {_RECENT} GROUP BY 1, 2)"""
_TICK = f"""
t AS (SELECT api_key_label, model, timestamp + INTERVAL 24 HOUR AS next_tick_at,
             coalesce(prompt_tokens + completion_tokens, 0) AS next_tick_tokens
      FROM (SELECT *, row_number() OVER (PARTITION BY api_key_label, model ORDER BY timestamp, id) AS rn
            FROM fx_llm_calls WHERE {_RECENT}) WHERE rn = 1)"""
_FREE = f"""
f AS (SELECT api_key_label, model, min(timestamp) + INTERVAL 24 HOUR AS free_at
      FROM (SELECT c.*, l.tpd,
                   sum(coalesce(prompt_tokens + completion_tokens, 0)) OVER (PARTITION BY api_key_label, c.model) AS used,
                   sum(coalesce(prompt_tokens + completion_tokens, 0)) OVER (
                     PARTITION BY api_key_label, c.model ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS running
            FROM fx_llm_calls c JOIN fx_limits l ON c.model = l.model WHERE {_RECENT})
      WHERE tpd > 0 AND used >= tpd AND used - running < tpd GROUP BY 1, 2)"""


@job("usage_24h", "fx_llm_calls", sql=f"WITH {_USAGE} SELECT * FROM u")
def _usage_24h(x):
    return usage.usage_24h(x.llm_calls, as_of=AS_OF, provider=GROQ).withColumn("avg_dur", F.round("avg_dur", 6))


@job("budget_next_tick", "fx_llm_calls", sql=f"WITH {_TICK} SELECT * FROM t")
def _next_tick(x):
    return usage.budget_next_tick(x.llm_calls, as_of=AS_OF, provider=GROQ)


@job("budget_free_at", "fx_llm_calls", "fx_limits", sql=f"WITH {_FREE} SELECT * FROM f")
def _free_at(x):
    return usage.budget_free_at(x.llm_calls, x.limits, as_of=AS_OF, provider=GROQ)


@job(
    "usage_budget",
    "fx_llm_calls",
    "fx_limits",
    sql=f"""WITH {_USAGE}, {_TICK}, {_FREE}
    SELECT u.*, l.tpd, u.tokens / l.tpd * 100 AS pct, next_tick_at, next_tick_tokens, free_at,
           CASE WHEN l.tpd IS NULL THEN 'none' WHEN round(u.tokens / l.tpd * 100, 1) < 60 THEN 'green'
                WHEN round(u.tokens / l.tpd * 100, 1) < 85 THEN 'yellow' ELSE 'red' END AS band
    FROM u LEFT JOIN fx_limits l ON u.model = l.model
    LEFT JOIN t ON u.model = t.model AND u.api_key_label = t.api_key_label
    LEFT JOIN f ON u.model = f.model AND u.api_key_label = f.api_key_label""",
)
def usage_budget(x):
    return usage.usage_budget(x.llm_calls, x.limits, as_of=AS_OF, provider=GROQ).withColumn(
        "avg_dur", F.round("avg_dur", 6)
    )


_DAILY = f"""
SELECT strftime(timestamp - INTERVAL 7 HOUR, '%Y-%m-%d') AS local_day, api_key_label, model, count(id) AS calls,
       {_SUM} AS tokens
FROM fx_llm_calls WHERE provider = 'groq' AND timestamp >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1, 2, 3"""


@job("usage_daily", "fx_llm_calls", sql=_DAILY)
def _daily(x):
    return usage.usage_daily(x.llm_calls, as_of=AS_OF, provider=GROQ)


_DAY_COLUMNS = ", ".join(f"""CAST(sum(CASE WHEN local_day = '{d}' THEN tokens END) AS BIGINT) AS "{d}" """ for d in DAYS)


@job(
    "usage_daily_pivot",
    "fx_llm_calls",
    sql=f"""SELECT api_key_label, model, {_DAY_COLUMNS}, CAST(sum(tokens) AS BIGINT) AS row_total
            FROM ({_DAILY}) GROUP BY 1, 2""",
)
def _daily_pivot(x):
    return usage.usage_daily_pivot(x.llm_calls, as_of=AS_OF, provider=GROQ)


_HOURLY = f"""
SELECT date_trunc('hour', timestamp - INTERVAL 7 HOUR) AS hour, model, {_SUM} AS tokens
FROM fx_llm_calls WHERE provider = 'groq' AND timestamp >= TIMESTAMP '2024-01-23 00:00:00' GROUP BY 1, 2"""


@job("usage_hourly", "fx_llm_calls", sql=_HOURLY)
def _hourly(x):
    return usage.usage_hourly(x.llm_calls, as_of=AS_OF, provider=GROQ)


@job(
    "usage_rolling",
    "fx_llm_calls",
    "fx_limits",
    sql=f"""WITH h AS ({_HOURLY}),
    grid AS (SELECT model, unnest(generate_series(TIMESTAMP '2024-01-23 17:00:00', TIMESTAMP '2024-01-30 17:00:00',
                                                  INTERVAL 1 HOUR)) AS hour FROM (SELECT DISTINCT model FROM h)),
    r AS (SELECT g.model, g.hour, CAST(coalesce(sum(h.tokens), 0) AS BIGINT) AS rolling_tokens
          FROM grid g LEFT JOIN h ON h.model = g.model AND h.hour <= g.hour AND h.hour > g.hour - INTERVAL 24 HOUR
          GROUP BY 1, 2)
    SELECT r.*, l.tpd, ((rolling_tokens * 20000 + tpd) // (2 * tpd)) / 100 AS pct
    FROM r LEFT JOIN fx_limits l ON r.model = l.model""",
)
def _rolling(x):
    return usage.usage_rolling(x.llm_calls, x.limits, as_of=AS_OF, provider=GROQ)


@job(
    "usage_totals",
    "fx_llm_calls",
    "fx_limits",
    sql=f"""SELECT c.model, calls, tokens, avg_dur, tpd, tokens / calls AS tokens_per_call
            FROM (SELECT model, count(id) AS calls, {_SUM} AS tokens, round(avg(duration_seconds), 6) AS avg_dur
                  FROM fx_llm_calls WHERE provider = 'groq' GROUP BY 1) c LEFT JOIN fx_limits l ON c.model = l.model""",
)
def _totals(x):
    return usage.usage_totals(x.llm_calls, x.limits, provider=GROQ).withColumn("avg_dur", F.round("avg_dur", 6))


@job(
    "recent_calls",
    "fx_llm_calls",
    sql="SELECT * FROM fx_llm_calls WHERE provider = 'groq' ORDER BY id DESC LIMIT 100",
)
def _recent_calls(x):
    return usage.recent_calls(x.llm_calls, provider=GROQ)


@job("recent_errors", "fx_limit_errors", sql="SELECT * FROM fx_limit_errors ORDER BY id DESC LIMIT 50")
def _recent_errors(x):
    return usage.recent_errors(x.limit_errors)
