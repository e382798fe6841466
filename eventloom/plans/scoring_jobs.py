"""Scoring and limit-log jobs."""

from pyspark.sql import functions as F

from eventloom.operators import export, limits, scoring
from eventloom.plans.fixtures import CATALOG_AS_OF as AS_OF
from eventloom.plans.jobs import job
from eventloom.plans.text_jobs import no_model
from eventloom.session import durable, scratch_path
from eventloom.sources import sinks, tables
from eventloom.sources.answers import AnswerStore

_OPEN = f"SELECT * FROM fx_catalog WHERE date >= TIMESTAMP '{AS_OF}' AND score IS NULL"
_LINE = r"""json_object('id', id, 'title', title, 'desc', replace(substr(description, 1, 150), chr(10), ' '), 'venue', venue,
                      'category', category)"""


@job("score_candidates", "fx_catalog", sql=_OPEN)
def candidates(x):
    return scoring.score_candidates(x.catalog, as_of=AS_OF)


@job(
    "score_batches",
    "fx_catalog",
    sql=f"""SELECT batch_no, count(*) AS events, '[' || chr(10) || string_agg(line, ',' || chr(10) ORDER BY id) || chr(10) || ']' AS events_json
            FROM (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 40 AS batch_no, {_LINE} AS line FROM ({_OPEN})) GROUP BY 1""",
)
def _batches(x):
    return scoring.score_batches(candidates(x))


def shown(x):
    """Open events each user has clicked on: the candidates when every user has a profile."""
    pairs = x.feedback_clicks.select("user_id", F.col("event_id").alias("id")).distinct()
    return candidates(x).join(pairs, "id")


def user_prompts(x):
    return scoring.score_prompt(scoring.score_batches(shown(x), per=["user_id"]), x.profile)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_USER_BATCHES = f"""
shown AS (SELECT c.*, p.user_id FROM ({_OPEN}) c JOIN (SELECT DISTINCT user_id, event_id FROM fx_feedback_clicks) p ON c.id = p.event_id),
batches AS (SELECT user_id, batch_no, count(*) AS events,
              '[' || chr(10) || string_agg(line, ',' || chr(10) ORDER BY id) || chr(10) || ']' AS events_json
            FROM (SELECT user_id, id, (row_number() OVER (PARTITION BY user_id ORDER BY id) - 1) // 40 AS batch_no, {_LINE} AS line
                  FROM shown) GROUP BY 1, 2)"""


@job(
    "score_prompt",
    "fx_catalog",
    "fx_feedback_clicks",
    "fx_profile",
    sql=f"""WITH {_USER_BATCHES.strip()}
    SELECT b.user_id, batch_no, events,
      concat(CASE WHEN taste_prompt <> '' THEN concat('USER INTERESTS:', chr(10), taste_prompt, chr(10), chr(10)) END,
             CASE WHEN preference_summary <> '' THEN concat('LEARNED PREFERENCES:', chr(10), preference_summary, chr(10), chr(10)) END,
             {_quoted(scoring.SCORE_TASK)}, chr(10), 'EVENTS:', chr(10), events_json) AS prompt
    FROM batches b JOIN fx_profile p ON b.user_id = p.user_id WHERE taste_prompt <> '' OR preference_summary <> ''""",
)
def _prompt(x):
    return user_prompts(x)


# Every request has a stored answer, which scores id n with n % 11 / 10.
_GIVEN = """
SELECT user_id, batch_no, sha2(prompt, 256) AS prompt_hash,
  to_json(transform(regexp_extract_all(prompt, '"id":(\\\\d+)', 1), i -> named_struct('id', CAST(i AS BIGINT), 'score', CAST(i AS BIGINT) % 11 / 10D))) AS content,
  CAST(length(prompt) AS BIGINT) AS prompt_tokens, CAST(1 AS BIGINT) AS completion_tokens, 0.5D AS duration_seconds,
  CAST(NULL AS STRING) AS error, TIMESTAMP_NTZ'2024-02-15 00:00:00' AS asked_at
FROM {requests}"""


@job(
    "score_infer",
    "fx_catalog",
    "fx_feedback_clicks",
    "fx_profile",
    sql="""SELECT c.user_id, c.event_id AS id, least(c.event_id % 11 / 10, 1) AS score
           FROM (SELECT DISTINCT user_id, event_id FROM fx_feedback_clicks) c
           JOIN fx_catalog e ON e.id = c.event_id JOIN fx_profile p ON p.user_id = c.user_id
           WHERE e.score IS NULL AND e.date >= TIMESTAMP '2024-02-15' AND (taste_prompt <> '' OR preference_summary <> '')""",
)
def _infer(x):
    store = AnswerStore(x.spark, scratch_path(x.spark, "score-answers"), scoring.BATCH_KEYS)
    requests = durable(user_prompts(x))
    store.commit(x.spark.sql(_GIVEN, requests=requests), "given")
    replies = scoring.score_infer(requests, store, no_model)
    members = scoring.batch_members(shown(x), per=["user_id"])
    return scoring.parse_scores(replies, members, per=["user_id"]).select("user_id", "id", "score")


_SCORES = r"""
bare AS (SELECT batch_no, CASE WHEN starts_with(trim(reply), '```') THEN regexp_replace(split_part(trim(reply), '```', 2), '^json', '')
                               ELSE reply END AS reply FROM fx_score_replies),
items AS (SELECT batch_no, i, json_extract(reply, '$[' || i || '].id') AS id, json_extract(reply, '$[' || i || '].score') AS score
          FROM (SELECT *, unnest(range(CAST(json_array_length(reply) AS BIGINT))) AS i FROM bare WHERE json_valid(reply))),
valid AS (SELECT batch_no, i, CAST(CAST(id AS DOUBLE) AS BIGINT) AS id,
                 CASE WHEN json_type(score) = 'BOOLEAN' THEN CAST(CAST(score AS BOOLEAN) AS DOUBLE) ELSE CAST(score AS DOUBLE) END AS score
          FROM items WHERE json_type(id) IN ('UBIGINT', 'BIGINT', 'DOUBLE')
            AND json_type(score) IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN')),
scores AS (SELECT v.batch_no, v.id, greatest(0, least(1, arg_max(v.score, v.i))) AS score
           FROM valid v JOIN fx_score_members m ON v.batch_no = m.batch_no AND v.id = m.id GROUP BY 1, 2)"""


@job("parse_scores", "fx_score_replies", "fx_score_members", sql=f"WITH {_SCORES.strip()} SELECT * FROM scores")
def parsed_scores(x):
    return scoring.parse_scores(x.score_replies, x.score_members)


@job(
    "score_coverage",
    "fx_score_replies",
    "fx_score_members",
    sql=f"""WITH {_SCORES.strip()}
    SELECT m.batch_no, CAST(count(s.id) AS INT) AS scored, CAST(count(*) AS INT) AS expected,
           coalesce(string_agg(m.id, ',' ORDER BY m.id) FILTER (WHERE s.id IS NULL), '') AS missing_ids
    FROM fx_score_members m LEFT JOIN scores s ON m.batch_no = s.batch_no AND m.id = s.id GROUP BY 1""",
)
def _coverage(x):
    found = scoring.score_coverage(parsed_scores(x), x.score_members)
    return found.withColumn("missing_ids", F.array_join("missing_ids", ","))


@job(
    "score_writeback",
    "fx_catalog",
    "fx_scores",
    sql="""SELECT c.* EXCLUDE (score), coalesce(s.score, c.score) AS score
           FROM fx_catalog c LEFT JOIN fx_scores s ON c.id = s.id""",
)
def _writeback(x):
    return scoring.score_writeback(x.catalog, x.scores)


# -- limit errors ------------------------------------------------------------

_PARSED = r"""
said AS (SELECT *, contains(lower(error_text), 'tokens per day') OR contains(lower(error_text), '(tpd)') AS says_daily,
    contains(lower(error_text), 'tokens per minute') OR contains(lower(error_text), '(tpm)') AS says_minute,
    CAST(CASE WHEN error_text LIKE '%2h15m30.5s%' THEN 2 * 3600 + 15 * 60 + 30 + 1 WHEN error_text LIKE '%2h15m%' THEN 2 * 3600 + 15 * 60 + 1
         WHEN error_text LIKE '%in 3h%' THEN 3 * 3600 + 60 WHEN error_text LIKE '%45.2s%' THEN 46
         WHEN error_text LIKE '%2m30.5s%' THEN 151 ELSE 60 END AS BIGINT) AS text_retry,
    TRY_CAST(nullif(regexp_extract(error_text, '''retry-after'':\s*''(\d+)''', 1), '') AS BIGINT) AS header_retry
  FROM fx_limit_errors),
told AS (SELECT *, greatest(text_retry, coalesce(header_retry, 0)) AS retry_after FROM said)"""
_USED = """
used AS (SELECT e.id, CAST(coalesce(sum(CASE WHEN c.timestamp >= e.timestamp - INTERVAL 60 SECOND THEN prompt_tokens + completion_tokens END), 0)
                           AS BIGINT) AS tokens_60s,
                CAST(coalesce(sum(prompt_tokens + completion_tokens), 0) AS BIGINT) AS tokens_24h
         FROM fx_limit_errors e LEFT JOIN fx_llm_calls c ON c.api_key_label = e.api_key_label AND c.model = e.model
           AND c.timestamp BETWEEN e.timestamp - INTERVAL 24 HOUR AND e.timestamp GROUP BY 1)"""


@job("limit_parse", "fx_limit_errors", sql=f"WITH {_PARSED.strip()} SELECT * FROM told")
def _limit_parse(x):
    return limits.limit_parse(x.limit_errors)


@job(
    "limit_usage_join",
    "fx_limit_errors",
    "fx_llm_calls",
    sql=f"WITH {_USED.strip()} SELECT e.*, tokens_60s, tokens_24h FROM fx_limit_errors e JOIN used u ON e.id = u.id",
)
def _limit_usage(x):
    return limits.limit_usage_join(x.limit_errors, x.llm_calls)


@job(
    "limit_classify",
    "fx_limit_errors",
    "fx_llm_calls",
    "fx_limits",
    sql=f"""WITH {_PARSED.strip()}, {_USED.strip()},
    known AS (SELECT t.*, tokens_60s, tokens_24h, CASE WHEN l.model IS NULL THEN 6000 ELSE l.tpm END AS tpm,
                     CASE WHEN l.model IS NULL THEN 100000 ELSE l.tpd END AS tpd
              FROM told t JOIN used u ON t.id = u.id LEFT JOIN fx_limits l ON t.model = l.model),
    near AS (SELECT *, coalesce(tokens_24h > 0.8 * tpd, false) AS near_daily FROM known)
    SELECT id, timestamp, api_key_label, model, tokens_60s, tokens_24h, tpm, tpd, substr(error_text, 1, 500) AS error_snippet,
           CASE WHEN says_daily OR (NOT says_minute AND near_daily) THEN 'daily' ELSE 'tpm' END AS classified_as,
           CASE WHEN NOT says_daily AND NOT says_minute AND NOT near_daily AND retry_after > 120 THEN 90 ELSE retry_after END
             AS retry_after_sec FROM near""",
)
def _limit_classify(x):
    return limits.limit_classify(x.limit_errors, x.llm_calls, x.limits)


_CLASS = """CASE WHEN contains(error_text, '400') THEN 'error_400' WHEN contains(error_text, '503') THEN 'error_503'
                 WHEN contains(error_text, '413') THEN 'error_413' ELSE 'error' END"""
_FAILED = "concat('status ', CAST(400 + id % 120 AS VARCHAR_T), ' from call ', id, ': ', error_text)"


def _failures(x):
    text = F.expr(_FAILED.replace("VARCHAR_T", "STRING"))
    return x.limit_errors.withColumn("error_text", text)


_FAILURES = f"failed AS (SELECT * EXCLUDE (error_text), {_FAILED.replace('VARCHAR_T', 'VARCHAR')} AS error_text FROM fx_limit_errors)"


@job("error_classify", "fx_limit_errors", sql=f"WITH {_FAILURES} SELECT *, {_CLASS} AS classified_as FROM failed")
def _error_classify(x):
    return limits.error_classify(_failures(x))


_LOG_ROWS = f"""{_FAILURES}, hit AS (SELECT * FROM failed WHERE contains(error_text, '429')), {_PARSED.strip().replace("FROM fx_limit_errors", "FROM hit")}, {_USED.strip()},
known AS (SELECT t.*, tokens_24h, CASE WHEN l.model IS NULL THEN 100000 ELSE l.tpd END AS tpd
          FROM told t JOIN used u ON t.id = u.id LEFT JOIN fx_limits l ON t.model = l.model),
near AS (SELECT *, coalesce(tokens_24h > 0.8 * tpd, false) AS near_daily FROM known),
classes AS (
    SELECT id, CASE WHEN says_daily OR (NOT says_minute AND near_daily) THEN 'daily' ELSE 'tpm' END AS classified_as,
        CASE WHEN NOT says_daily AND NOT says_minute AND NOT near_daily AND retry_after > 120 THEN 90 ELSE retry_after END AS retry_after_sec FROM near
    UNION ALL SELECT id, {_CLASS}, NULL FROM failed WHERE NOT contains(error_text, '429')),
log_rows AS (SELECT CAST('0x' || md5('a-run|call-' || f.id)[1:15] AS BIGINT) AS id, timestamp, api_key_label, model, classified_as,
               retry_after_sec, substr(error_text, 1, 500) AS error_snippet FROM failed f JOIN classes c ON f.id = c.id)"""


@job("sink_error_log", "fx_limit_errors", "fx_llm_calls", "fx_limits", sql=f"WITH {_LOG_ROWS} SELECT * FROM log_rows")
def _error_log(x):
    path = scratch_path(x.spark, "limit_errors")
    failures = _failures(x).withColumn("call_key", F.concat(F.lit("call-"), "id"))
    rows = durable(limits.error_rows(failures, x.llm_calls, x.limits))
    for _ in range(2):
        sinks.sink_error_log(rows, path, run="a-run")
    return tables.scan_table(x.spark, "limit_errors", path).drop("day")


@job(
    "sink_ics",
    "fx_catalog",
    sql=f"""SELECT source AS calendar, count(*) AS events FROM fx_catalog
            WHERE pinned AND date >= TIMESTAMP '{AS_OF}' GROUP BY 1""",
)
def _sink_ics(x):
    path = scratch_path(x.spark, "ics")
    shortlist = x.catalog.where(F.col("pinned") & (F.col("date") >= F.lit(AS_OF).cast("timestamp_ntz")))
    sinks.sink_ics(export.export_ics(shortlist, F.col("source"), as_of=AS_OF), path)
    lines = x.spark.read.text(path)
    return (
        lines.where(F.col("value").startswith("BEGIN:VEVENT")).groupBy("calendar").agg(F.count("*").alias("events"))
    )
