"""Page-text and extraction jobs."""

from pyspark.sql import functions as F

from eventloom.functions.html import COUNTED
from eventloom.operators import extraction, inference, pagetext, usage
from eventloom.plans.fixtures import USAGE_AS_OF
from eventloom.plans.jobs import job
from eventloom.session import scratch_path
from eventloom.sources import sinks, tables
from eventloom.sources.answers import AnswerStore

# The given pages have no <main>, no links outside <nav> and three kinds of entity,
# so their reading can also be written as SQL.
_CLEAN = r"""
cleaned AS (SELECT page_id, site_key, url, html, regexp_replace(array_to_string(list_filter(list_transform(
    string_split_regex(
      regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*)', 1), '(?s)<nav>.*?</nav>', '<nav>', 'g'),
                     '(?s)<footer>.*?</footer>', '<footer>', 'g'), '(?s)<!--.*?-->|<[^>]*>'),
    lambda t: trim(replace(regexp_replace(t, '&amp(;|\b)', '&', 'g'), '&quot;', '"'), chr(10) || chr(13) || chr(9) || ' ')),
    lambda t: t <> ''), chr(10)), '[ \t]+', ' ', 'g') AS text FROM fx_pages)"""


@job("clean_pages", "fx_pages", sql=f"WITH {_CLEAN.strip()} SELECT page_id, site_key, url, text FROM cleaned")
def _clean(x):
    return pagetext.clean_pages(x.pages)


_TAGS = ", ".join(f"len(regexp_extract_all(html, '<{t}[ >]')) AS n_{t}" for t in COUNTED)


@job(
    "clean_stats",
    "fx_pages",
    sql=f"""WITH {_CLEAN.strip()}
    SELECT page_id, site_key, length(html) AS raw_chars, length(text) AS clean_chars,
           100 - length(text) * 100 // greatest(length(html), 1) AS reduction,
           CAST(floor(length(text) / 2.2) AS BIGINT) AS tokens, {_TAGS}, 'body' AS root FROM cleaned""",
)
def _stats(x):
    return pagetext.clean_stats(x.pages)


_TRIM = """
t1 AS (SELECT t.*, r.head, r.tail,
              CASE WHEN head IS NOT NULL AND strpos(text, head) > 0 THEN substr(text, strpos(text, head) + length(head))
                   ELSE text END AS body FROM fx_texts t LEFT JOIN fx_registry r USING (site_key)),
trimmed AS (SELECT page_id, site_key, month, year, text AS before,
                   CASE WHEN tail IS NOT NULL AND strpos(body, tail) > 0 THEN substr(body, 1, strpos(body, tail) - 1)
                        ELSE body END AS text FROM t1)"""


@job(
    "trim_boilerplate",
    "fx_texts",
    "fx_registry",
    sql=f"WITH {_TRIM.strip()} SELECT page_id, site_key, month, year, text FROM trimmed",
)
def trimmed(x):
    return pagetext.trim_boilerplate(x.texts, x.registry)


@job(
    "trim_impact",
    "fx_texts",
    "fx_registry",
    sql=f"""WITH {_TRIM.strip()} SELECT site_key, CAST(sum(length(before)) AS BIGINT) AS chars_before,
              CAST(sum(length(before) - length(text)) AS BIGINT) AS chars_removed,
              sum(length(before) - length(text)) * 100 / sum(length(before)) AS pct_removed FROM trimmed GROUP BY 1""",
)
def _impact(x):
    return pagetext.trim_impact(x.texts, x.registry)


def _times(part: str) -> str:
    return f"""SELECT site_key, '{part}' AS part, (length(text) - length(replace(text, {part}, ''))) // length({part}) AS times
               FROM fx_texts JOIN fx_registry USING (site_key) WHERE {part} IS NOT NULL"""


@job(
    "trim_audit",
    "fx_texts",
    "fx_registry",
    sql=f"""SELECT site_key, part, count(*) AS pages, min(times) AS min_times, max(times) AS max_times,
                   bool_and(times = 1) AS once_everywhere
            FROM ({_times('head')} UNION ALL {_times('tail')}) GROUP BY 1, 2""",
)
def _audit(x):
    return pagetext.trim_audit(x.texts, x.registry)


_FIRST = "make_date(year, month, 1)"
_DATED = " ".join(
    rf"WHEN {last} THEN regexp_replace(text, '(?m)^({days})$', strftime({_FIRST}, '%B') || ' \1, ' || year || ':', 'g')"
    for last, days in [
        (28, "[1-9]|1[0-9]|2[0-8]"),
        (29, "[1-9]|1[0-9]|2[0-9]"),
        (30, "[1-9]|1[0-9]|2[0-9]|30"),
        (31, "[1-9]|1[0-9]|2[0-9]|30|31"),
    ]
)


@job(
    "inject_dates",
    "fx_texts",
    sql=f"""SELECT page_id, site_key, month, year, CASE day(last_day({_FIRST})) {_DATED} END AS text FROM fx_texts""",
)
def _inject(x):
    return pagetext.inject_dates(x.texts)


_CHUNKS = """
chunks AS (SELECT page_id, site_key, month, year, i + 1 AS chunk_no, i + 1 = n AS is_last, substr(text, i * 5700 + 1, 6000) AS text
           FROM (SELECT *, unnest(range(n)) AS i FROM
                  (SELECT *, CASE WHEN length(text) <= 6000 THEN 1
                                  ELSE 1 + CAST(ceil((length(text) - 6000) / 5700) AS BIGINT) END AS n FROM fx_texts)))"""


@job("chunk_text", "fx_texts", sql=f"WITH {_CHUNKS.strip()} SELECT * FROM chunks")
def _chunks(x):
    return pagetext.chunk_text(x.texts)


@job(
    "overlap_zones",
    "fx_texts",
    sql=f"""WITH {_CHUNKS.strip()} SELECT page_id, chunk_no, chunk_no + 1 AS next_chunk_no, shared FROM
              (SELECT *, substr(lead(text) OVER (PARTITION BY page_id ORDER BY chunk_no), 1, 300) AS shared FROM chunks)
            WHERE NOT is_last""",
)
def _overlap(x):
    return pagetext.overlap_zones(pagetext.chunk_text(x.texts))


_TOP = "lower(substr(html, 1, 3000))"


@job(
    "bot_block_flags",
    "fx_pages",
    sql=f"""SELECT page_id, site_key, array_to_string(list_filter([
              CASE WHEN contains({_TOP}, 'access denied') THEN 'access denied' END,
              CASE WHEN contains({_TOP}, 'captcha') THEN 'captcha' END,
              CASE WHEN contains({_TOP}, 'just a moment') THEN 'just a moment' END,
              CASE WHEN contains({_TOP}, '<title>403') THEN 'title 403' END,
              CASE WHEN length(html) < 2000 THEN 'very short' END], lambda f: f IS NOT NULL), ',') AS flags FROM fx_pages""",
)
def _bots(x):
    return pagetext.bot_block_flags(x.pages).withColumn("flags", F.array_join("flags", ","))


_PHRASES = ", ".join(f"CASE WHEN contains(lower(text), '{p}') THEN '{p}' END" for p in pagetext.PLACEHOLDERS)


@job(
    "placeholder_flags",
    "fx_texts",
    sql=rf"""SELECT page_id, site_key, CASE WHEN text = '' THEN 'empty' ELSE array_to_string(list_filter([
               CASE WHEN length(text) < 100 THEN 'very short' END, {_PHRASES}], lambda f: f IS NOT NULL), ',') END AS flags
             FROM (SELECT page_id, site_key, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM fx_texts)""",
)
def _placeholders(x):
    return pagetext.placeholder_flags(x.texts).withColumn("flags", F.array_join("flags", ","))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_ASKED = "2024-01-30 01:00:00"
_PROMPTS = f"""{_CHUNKS},
prompts AS (SELECT page_id, site_key, month, year, chunk_no, is_last, text, c.url,
      concat({_quoted(pagetext.EXTRACT_TASK)}, chr(10),
        CASE WHEN is_last THEN {_quoted(pagetext.LAST_CHUNK_TASK)} ELSE {_quoted(pagetext.INNER_CHUNK_TASK)} END, chr(10),
        {_quoted(pagetext.ANSWER_TASK)}, chr(10), 'Site: ', coalesce(display_name, 'unknown'), chr(10), 'Page: ', c.url, chr(10), chr(10),
        'PAGE TEXT:', chr(10), text) AS prompt
    FROM (SELECT *, concat('https://ex.org/p/', page_id) AS url FROM chunks) c LEFT JOIN fx_registry r USING (site_key)),
-- Stored answers have one event per line with an ISO day; a tenth of the pages has none.
told AS (SELECT *, length(prompt) * 5 // 11 AS prompt_tokens, page_id % 10 = 3 AS open_,
           len(list_filter(string_split(text, chr(10)), lambda t: regexp_matches(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'))) AS n_events,
           TIMESTAMP '{_ASKED}' + (page_id % 80000) * INTERVAL 1 SECOND AS asked_at
         FROM prompts),
calls AS (SELECT md5(concat_ws('|', site_key, page_id, chunk_no, is_last, sha256(prompt), asked_at)) AS call_key, asked_at AS timestamp,
            'stored' AS provider, concat('model_', page_id % 3) AS model, 'scraping' AS call_type, prompt_tokens,
            CAST(10 * n_events AS BIGINT) AS completion_tokens, chunk_no / 8 AS duration_seconds, 'key_1' AS api_key_label
          FROM told WHERE NOT open_)"""


@job(
    "build_prompts",
    "fx_texts",
    "fx_registry",
    sql=f"WITH {_PROMPTS.strip()} SELECT * FROM prompts",
)
def prompts(x):
    url = F.concat(F.lit("https://ex.org/p/"), F.col("page_id"))
    return pagetext.build_prompts(pagetext.chunk_text(x.texts).withColumn("url", url), x.registry)


#: A stored answer for every request but those of a tenth of the pages.
_DAY = "-".join(["[0-9]" * 4, "[0-9]" * 2, "[0-9]" * 2])
_STORED = f"""
SELECT site_key, page_id, chunk_no, is_last, sha2(prompt, 256) AS prompt_hash,
  to_json(named_struct('events', transform(filter(split(text, '\n'), t -> t rlike '{_DAY}'),
    t -> named_struct('title', t, 'date', regexp_extract(t, '{_DAY}', 0))))) AS content,
  CAST(length(prompt) * 5 div 11 AS BIGINT) AS prompt_tokens,
  CAST(10 * size(filter(split(text, '\n'), t -> t rlike '{_DAY}')) AS BIGINT) AS completion_tokens,
  CAST(chunk_no AS DOUBLE) / 8 AS duration_seconds, CAST(NULL AS STRING) AS error,
  TIMESTAMP_NTZ'{_ASKED}' + make_dt_interval(0, 0, 0, page_id % 80000) AS asked_at
FROM {{requests}} WHERE page_id % 10 <> 3"""


def no_model(prompt: str):
    raise RuntimeError("status 429 from a model that is not there")


def answers(x):
    store = AnswerStore(x.spark, scratch_path(x.spark, "answers"), inference.CHUNK_KEYS)
    store.commit(x.spark.sql(_STORED, requests=prompts(x)), "given")
    return inference.infer_chunks(prompts(x), store, no_model)


@job(
    "infer_chunks",
    "fx_texts",
    "fx_registry",
    sql=f"""WITH {_PROMPTS.strip()} SELECT site_key, page_id, chunk_no, is_last, CASE WHEN NOT open_ THEN prompt_tokens END AS prompt_tokens,
              CASE WHEN NOT open_ THEN CAST(n_events AS INT) END AS n_events, CASE WHEN NOT open_ THEN chunk_no / 8 END AS duration_seconds,
              CASE WHEN NOT open_ THEN asked_at END AS asked_at, CASE WHEN open_ THEN 'status 429 from a model that is not there' END AS error
            FROM told""",
)
def _infer(x):
    parsed = extraction.parse_responses(answers(x))
    stored = F.col("error").isNull()
    return parsed.select(
        "site_key", "page_id", "chunk_no", "is_last", "prompt_tokens", F.when(stored, F.size("events")).alias("n_events"),
        F.when(stored, F.col("duration_seconds")).alias("duration_seconds"), F.when(stored, F.col("asked_at")).alias("asked_at"), "error",
    )


def logged_calls(x):
    """The path of a call log that two runs have written, the second one twice."""
    path = scratch_path(x.spark, "llm_calls")
    keys = ["site_key", "page_id", "chunk_no", "is_last"]
    log = inference.call_log(answers(x), keys, provider="stored", model="none", call_type="scraping", api_key_label="key_1")
    log = log.withColumn("model", F.expr("concat('model_', page_id % 3)"))
    for run, part in (("first", 0), ("second", 1), ("second", 1)):
        sinks.sink_call_log(log.where(F.col("page_id") % 2 == part), path, run=run)
    return path


_ID = "CAST('0x' || md5(concat_ws('|', {run}, {key}))[1:15] AS BIGINT)"
_LOGGED = f"""{_PROMPTS},
logged AS (SELECT {_ID.format(run="CASE WHEN page_id % 2 = 0 THEN 'first' ELSE 'second' END", key="call_key")} AS id, c.* EXCLUDE (call_key)
           FROM (SELECT page_id, calls.* FROM calls JOIN (SELECT page_id, md5(concat_ws('|', site_key, page_id, chunk_no, is_last, sha256(prompt), asked_at)) AS call_key
                                              FROM told) USING (call_key)) c)"""


@job("sink_call_log", "fx_texts", "fx_registry", sql=f"WITH {_LOGGED.strip()} SELECT * EXCLUDE (page_id) FROM logged")
def _call_log(x):
    return tables.scan_table(x.spark, "llm_calls", logged_calls(x)).drop("day")


@job(
    "usage_totals_logged",
    "fx_texts",
    "fx_registry",
    sql=f"""WITH {_LOGGED.strip()} SELECT model, count(*) AS calls, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens,
              round(avg(duration_seconds), 6) AS avg_dur, CAST(NULL AS BIGINT) AS tpd,
              sum(prompt_tokens + completion_tokens) / count(*) AS tokens_per_call FROM logged GROUP BY 1""",
)
def _logged_totals(x):
    calls = tables.scan_table(x.spark, "llm_calls", logged_calls(x))
    return usage.usage_totals(calls, x.limits).withColumn("avg_dur", F.round("avg_dur", 6))


@job(
    "usage_24h_logged",
    "fx_texts",
    "fx_registry",
    sql=f"""WITH {_LOGGED.strip()} SELECT api_key_label, model, count(*) AS calls, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens,
              round(avg(duration_seconds), 6) AS avg_dur FROM logged WHERE timestamp >= TIMESTAMP '{USAGE_AS_OF}' - INTERVAL 24 HOUR GROUP BY 1, 2""",
)
def _logged_day(x):
    calls = tables.scan_table(x.spark, "llm_calls", logged_calls(x))
    return usage.usage_24h(calls, as_of=USAGE_AS_OF).withColumn("avg_dur", F.round("avg_dur", 6))


# The second run covers every site, but finds nothing for some of them.
@job(
    "sink_stage",
    "fx_texts",
    "fx_registry",
    sql=f"""WITH {_TRIM.strip()} SELECT page_id, site_key, CASE WHEN site_key >= 'src5' THEN 'kept' ELSE text END AS text FROM trimmed
            WHERE site_key >= 'src5' OR page_id % 3 = 0""",
)
def _stage(x):
    path = scratch_path(x.spark, "stage")
    sites = [r.site_key for r in x.texts.select("site_key").distinct().collect()]
    sinks.sink_stage(x.texts.select("page_id", "site_key", F.lit("kept").alias("text")), path, sites=sites, run="1")
    again = [s for s in sites if s < "src5"]
    rows = trimmed(x).where("page_id % 3 = 0 AND site_key < 'src5'").select("page_id", "site_key", "text")
    sinks.sink_stage(rows, path, sites=again, run="2")
    return sinks.read_stage(x.spark, path)


# -- responses ---------------------------------------------------------------

_CUT = "content[1:length(content) - strpos(reverse(content), ',}')] || ']}'"
_PARSED = f"""
parsed AS (SELECT page_id, chunk_no, is_last,
             CASE WHEN json_valid(content) THEN 'ok'
                  WHEN contains(content, '}},') AND json_valid({_CUT}) THEN 'salvaged' ELSE 'failed' END AS status,
             CASE WHEN json_valid(content) THEN content
                  WHEN contains(content, '}},') AND json_valid({_CUT}) THEN {_CUT} END AS usable
           FROM fx_responses),
read AS (SELECT page_id, chunk_no, is_last, status, from_json(usable,
           '{{"events": [{{"title": "VARCHAR", "date": "VARCHAR"}}], "next_page_url": "VARCHAR"}}') AS j FROM parsed),
found AS (SELECT page_id, chunk_no, is_last, i - 1 AS pos, j.events[i].title AS title, j.events[i].date AS date,
            CAST(NULL AS VARCHAR) AS end_date, CAST(NULL AS VARCHAR) AS time, CAST(NULL AS VARCHAR) AS description,
            CAST(NULL AS VARCHAR) AS venue, CAST(NULL AS VARCHAR) AS url
          FROM (SELECT *, unnest(range(1, len(j.events) + 1)) AS i FROM read))"""


@job(
    "parse_responses",
    "fx_responses",
    sql=f"""WITH {_PARSED.strip()} SELECT page_id, chunk_no, is_last, status, CAST(coalesce(len(j.events), 0) AS INT) AS n_events,
                   j.next_page_url AS next_page_url FROM read""",
)
def _parse(x):
    return extraction.parse_responses(x.responses).select(
        "page_id",
        "chunk_no",
        "is_last",
        "status",
        F.coalesce(F.array_size("events"), F.lit(0)).alias("n_events"),
        "next_page_url",
    )


@job("explode_events", "fx_responses", sql=f"WITH {_PARSED.strip()} SELECT * FROM found")
def _explode(x):
    return extraction.explode_events(extraction.parse_responses(x.responses))


@job(
    "dedup_in_page",
    "fx_responses",
    sql=f"""WITH {_PARSED.strip()} SELECT * EXCLUDE (rn) FROM
              (SELECT *, row_number() OVER (PARTITION BY page_id, lower(trim(title)) ORDER BY chunk_no, pos) AS rn
               FROM found) WHERE (chunk_no = 1 AND is_last) OR (rn = 1 AND trim(title) <> '')""",
)
def _dedup(x):
    return extraction.dedup_in_page(extraction.explode_events(extraction.parse_responses(x.responses)))


@job(
    "next_page",
    "fx_responses",
    sql=f"WITH {_PARSED.strip()} SELECT page_id, j.next_page_url AS next_page_url FROM read WHERE is_last",
)
def next_pages(x):
    return extraction.next_page(extraction.parse_responses(x.responses))
