"""The reference tables as views over the given tables.

Each view is one SELECT list used twice: as ``selectExpr`` on Spark and as a
common table expression in the check SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.sources.tables import limits_table

USAGE_AS_OF = "2024-01-31 00:00:00"
CATALOG_AS_OF = "2024-02-15 00:00:00"

#: Daily and per-minute token limits used with the call views.
LIMIT_ROWS = [("view", 30, 1000, 6000, 2000), ("click", 30, 1000, 6000, 500000), ("signup", 30, 1000, 6000, None)]


@dataclass(frozen=True)
class View:
    table: str
    columns: list[str]
    where: str | None = None


VIEWS = {
    "fx_catalog": View(
        "documents_labels",
        [
            "doc_id AS id",
            "trim(substr(text, 1, 40)) AS title",
            "text AS description",
            "lang AS venue",
            "source",
            "'general' AS category",
            """TIMESTAMP_LIT + (n_chars % 120) * INTERVAL '1' DAY
               + (CASE WHEN n_chars % 5 = 0 THEN 754 ELSE (n_chars % 24) * 60 END) * INTERVAL '1' MINUTE AS date""",
            "CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat('https://ex.org/e/', doc_id) END AS url",
            "CASE WHEN quality = 1 THEN CAST(0.9 AS DOUBLE) WHEN quality = 0 THEN CAST(0.2 AS DOUBLE) END AS score",
            "doc_id % 50 = 0 AS pinned",
        ],
    ),
    "fx_llm_calls": View(
        "events",
        [
            "event_id AS id",
            "ts AS timestamp",
            "CASE WHEN event_type = 'error' THEN 'ollama' ELSE 'groq' END AS provider",
            "event_type AS model",
            "CASE user_id % 3 WHEN 0 THEN 'scraping' WHEN 1 THEN 'scoring' ELSE 'summary' END AS call_type",
            "CAST(floor(value * 10) AS BIGINT) AS prompt_tokens",
            "CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS completion_tokens",
            "value / 100 AS duration_seconds",
            "concat('key_', user_id % 2 + 1) AS api_key_label",
        ],
    ),
    "fx_scraper_runs": View(
        "events",
        [
            "event_id AS id",
            "concat('src', user_id % 19) AS source",
            "ts AS run_timestamp",
            "CASE WHEN event_id % 11 = 0 THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS events_found",
            "CASE WHEN event_id % 11 = 0 THEN 0 ELSE CAST(floor(value / 2) AS BIGINT) END AS events_added",
            "event_type <> 'error' AS success",
            "CASE WHEN event_type = 'error' THEN props END AS error_message",
            "value AS duration_seconds",
        ],
    ),
    "fx_feedback_clicks": View(
        "events",
        [
            "event_id AS click_id",
            "user_id",
            # Spread over all events, a tenth of them beyond the last one.
            "CAST(floor(event_id / 9) AS BIGINT) AS event_id",
            "event_type <> 'view' AS interested",
            "ts AS created_at",
        ],
        "event_type IN ('view', 'click', 'purchase')",
    ),
    "fx_limit_errors": View(
        "events",
        [
            "event_id AS id",
            "ts AS timestamp",
            "concat('key_', user_id % 2 + 1) AS api_key_label",
            """CASE user_id % 4 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'signup' ELSE 'unlisted' END
               AS model""",
            """CASE event_id % 7
                 WHEN 0 THEN 'on tokens per day (TPD): Limit 100000, Used 99847. Please try again in 2h15m30.5s'
                 WHEN 1 THEN 'on tokens per minute (TPM): Limit 12000, Used 11963. Please try again in 45.2s'
                 WHEN 2 THEN 'Please try again in 2h15m' WHEN 3 THEN 'Please try again in 2m30.5s'
                 WHEN 4 THEN 'Service busy' WHEN 5 THEN 'Please try again in 3h'
                 ELSE concat('busy ''retry-after'': ''', CAST(floor(value) AS BIGINT), '''') END AS error_text""",
        ],
        "event_type = 'error'",
    ),
    "fx_extracted": View(
        "events",
        [
            "event_id AS row_id",
            "concat('src', user_id % 20) AS source",
            "CASE WHEN event_id % 29 = 0 THEN '  ' ELSE concat('Show ', user_id, ' ', event_type) END AS title",
            """CASE event_id % 8
                 WHEN 0 THEN NULL WHEN 1 THEN 'soon'
                 WHEN 2 THEN concat(month(ts) + 1, '/', day(ts), '/', year(ts))
                 ELSE concat(year(ts), '-', lpad(CAST(month(ts) + 1 AS VARCHAR_T), 2, '0'), '-',
                             lpad(CAST(day(ts) % 28 + 1 AS VARCHAR_T), 2, '0')) END AS date""",
            """CASE WHEN event_id % 6 = 0 THEN concat(year(ts), '-03-15') WHEN event_id % 6 = 1 THEN 'TBD' END
               AS end_date""",
            """CASE event_id % 9
                 WHEN 0 THEN NULL WHEN 1 THEN '7 PM' WHEN 2 THEN '1:30pm' WHEN 3 THEN '1:30 p.m.' WHEN 4 THEN '19:30'
                 ELSE '8:00 PM - 10:00 PM' END AS time""",
            """CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN concat('/e/', event_id)
                    ELSE concat('https://ex.org/e/', event_id) END AS url""",
            "CASE WHEN event_id % 4 = 0 THEN '' ELSE 'Hall' END AS venue",
            "props AS description",
        ],
    ),
    "fx_responses": View(
        "events_x3",
        [
            "event_id AS page_id",
            "chunk_no",
            # Every eleventh page was read in one go.
            "chunk_no = CASE WHEN event_id % 11 = 0 THEN 1 ELSE 3 END AS is_last",
            """CASE WHEN event_id % 11 = 0 THEN concat('{"events":[{"title":"Show ', user_id, '","date":"2024-03-05"},{"title":" show ', user_id, '"},{"title":" "}]}')
                    WHEN event_id % 10 = 0 AND chunk_no = 1
                    THEN concat('{"events":[{"title":"Show ', user_id, '","date":"2024-03-05"},{"title":"Cut ', event_id)
                    WHEN event_id % 10 = 1 AND chunk_no = 1 THEN 'not json'
                    ELSE concat('{"events":[{"title":"Show ', user_id, '","date":"2024-03-05"},{"title":" SHOW ',
                                user_id + chunk_no - 1, ' ","date":"2024-03-06"}],"next_page_url":',
                                CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '"https://ex.org/p2"' END, '}') END
               AS content""",
        ],
        "chunk_no = 1 OR event_id % 11 <> 0",
    ),
    "fx_texts": View(
        "documents",
        [
            "doc_id AS page_id",
            "source AS site_key",
            """CASE WHEN doc_id % 3 = 0 THEN text
                    ELSE concat('Home', chr(10), 'Reset all filters', chr(10), text, chr(10), 'Past events', chr(10),
                                '5', chr(10), 'old') END AS text""",
            "CAST(doc_id % 12 + 1 AS INT) AS month",
            "CAST(2024 - doc_id % 2 AS INT) AS year",
        ],
    ),
    "fx_pages": View("pages", ["page_id", "concat('src', page_id % 20) AS site_key", "url", "html"]),
    # One registry row per distinct source of the documents, a few under another key so that
    # some sources are unregistered and some registered sites have no data.
    "fx_registry": View(
        "sites",
        [
            "site_key",
            "concat('Venue ', chr(CAST(65 + n % 26 AS INT))) AS display_name",
            """concat('https://', site_key, '.example.org/',
                      CASE n % 4 WHEN 0 THEN 'events?start={today}&end={plus90}' WHEN 1 THEN '{month_name}-classes/'
                                 WHEN 2 THEN 'list' ELSE 'grid?d={today_long}' END,
                      CASE WHEN n % 8 = 2 THEN '?page=1' WHEN n % 8 = 6 THEN '?q=a' ELSE '' END) AS url""",
            "n % 2 = 1 AS use_browser",
            "CAST(n AS INT) AS wait_secs",
            "CAST(1 + n % 5 AS INT) AS max_pages",
            """CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN 'multi_month' WHEN 2 THEN 'url_param' ELSE 'calendar_grid' END
               AS p_type""",
            "CASE WHEN n % 4 = 1 THEN CAST(2 + n % 3 AS INT) END AS p_months",
            """CASE n % 4 WHEN 1 THEN concat('https://', site_key, '.example.org/{month_name}/{month:02d}-{year}')
                          WHEN 3 THEN concat('https://', site_key, '.example.org/grid/{month}/{year}') END
               AS p_url_template""",
            "CASE WHEN n % 4 = 2 THEN 'page' END AS p_param_name",
            "CASE WHEN n % 4 = 2 THEN CAST(n % 3 AS INT) END AS p_start_index",
            "n % 4 = 3 AS p_inject_dates",
            "CASE WHEN n % 10 <> 8 THEN concat(chr(10), 'Reset all filters', chr(10)) END AS head",
            "CASE WHEN n % 10 <> 9 THEN concat('Past events', chr(10)) END AS tail",
        ],
    ),
    "fx_profile": View(
        "users",
        [
            "user_id",
            "CASE WHEN user_id % 5 = 0 THEN '' ELSE concat('Likes ', first_type, ' nights') END AS taste_prompt",
            "CASE WHEN user_id % 3 = 0 THEN '' ELSE concat('Enjoys things like ', last_type) END AS preference_summary",
            "user_id % 20 AS feedback_count_at_last_summary",
        ],
    ),
    "fx_profile_edits": View(
        "documents",
        [
            "doc_id AS edit_id",
            "CAST(floor(doc_id / 6) AS BIGINT) AS user_id",
            "CASE WHEN doc_id % 2 = 0 THEN 'taste' ELSE 'summary' END AS field",
            "concat('  ', text, ' ') AS content",
            "TIMESTAMP_LIT + (doc_id % 1000) * INTERVAL '1' HOUR AS edited_at",
        ],
    ),
    "fx_scores": View(
        "labels", ["doc_id AS id", "CASE WHEN toxic = 1 THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END AS score"]
    ),
    # Model replies to score batches of four ids each, with the faults real replies have.
    "fx_score_replies": View(
        "documents",
        [
            "doc_id AS batch_no",
            """CASE doc_id % 7
                 WHEN 0 THEN concat('[{"id": ', doc_id * 10, ', "score": 0.9}, {"id": ', doc_id * 10 + 1,
                                    ', "score": 1.7}]')
                 WHEN 1 THEN concat('```json', chr(10), '[{"id": ', doc_id * 10, ', "score": 0.25}]', chr(10), '```')
                 WHEN 2 THEN 'Sorry, I cannot do that'
                 WHEN 3 THEN concat('[{"id": ', doc_id * 10, ', "score": "0.5"}, {"id": ', doc_id * 10 + 1,
                                    ', "score": true}, {"id": 999999999999, "score": 0.4}]')
                 WHEN 4 THEN concat('[{"id": ', doc_id * 10, ', "score": 0.125}, {"id": ', doc_id * 10,
                                    ', "score": 0.75}, {"id": ', doc_id * 10 + 2, ', "score": -3}]')
                 WHEN 5 THEN concat('  [{"id": ', doc_id * 10 + 3, '.0, "score": 1}, {"score": 0.3}]  ')
                 ELSE concat('[{"id": ', doc_id * 10, ', "score": null}, {"id": "', doc_id * 10 + 1,
                             '", "score": 0.5}, {"id": ', doc_id * 10 + 2, ', "score": 0.0625}]') END AS reply""",
        ],
    ),
    "fx_score_members": View("documents_x4", ["doc_id AS batch_no", "doc_id * 10 + k AS id"]),
}

# Row sources that are not a single given table: (Spark builder, SQL text).
_DERIVED_SQL = {
    "documents_labels": "documents LEFT JOIN labels USING (doc_id)",
    "events_x3": "(SELECT *, unnest([1, 2, 3]) AS chunk_no FROM events)",
    "documents_x4": "(SELECT doc_id, unnest([0, 1, 2, 3]) AS k FROM documents)",
    "sites": """(SELECT DISTINCT CASE WHEN substr(source, 4) IN ('6', '13') THEN concat('spare', substr(source, 4)) ELSE source END
                       AS site_key, CAST(substr(source, 4) AS BIGINT) AS n FROM documents)""",
    "users": "(SELECT user_id, min(event_type) AS first_type, max(event_type) AS last_type FROM events GROUP BY user_id)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "documents_labels":
        return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    if name == "events_x3":
        return table(spark, sf_dir, "events").withColumn("chunk_no", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    if name == "documents_x4":
        four = F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3))
        return table(spark, sf_dir, "documents").select("doc_id", F.explode(four).alias("k"))
    if name == "sites":
        return (
            table(spark, sf_dir, "documents")
            .select(
                F.expr("""CASE WHEN substr(source, 4) IN ('6', '13') THEN concat('spare', substr(source, 4))
                               ELSE source END AS site_key"""),
                F.expr("CAST(substr(source, 4) AS BIGINT) AS n"),
            )
            .distinct()
        )
    if name == "users":
        return (
            table(spark, sf_dir, "events")
            .groupBy("user_id")
            .agg(F.min("event_type").alias("first_type"), F.max("event_type").alias("last_type"))
        )
    return table(spark, sf_dir, name)


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, one file or a folder of them, read as a file stream."""
    schema = table(spark, sf_dir, name).schema
    # As a pattern, since a stream takes a plain path for a folder.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}[.]parquet")


def _arriving_rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "documents_labels":
        return arriving(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return arriving(spark, sf_dir, name)


def view(spark: SparkSession, sf_dir: str, name: str, *, stream: bool = False) -> DataFrame:
    """A fixture view as a DataFrame, or as a stream where it reads one given table, with labels at rest."""
    v = VIEWS[name]
    df = _arriving_rows(spark, sf_dir, v.table) if stream else _rows(spark, sf_dir, v.table)
    if v.where:
        df = df.where(v.where)
    spark_text = [
        c.replace("TIMESTAMP_LIT", "TIMESTAMP_NTZ'2024-01-01 00:00:00'").replace("VARCHAR_T", "STRING") for c in v.columns
    ]
    return df.selectExpr(*spark_text)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_registry`` with its pagination settings nested as in a stored registry."""
    return view(spark, sf_dir, "fx_registry").selectExpr(
        "site_key", "display_name", "url", "use_browser", "wait_secs", "max_pages", "CAST(NULL AS STRING) AS note",
        """CASE WHEN p_type IS NOT NULL THEN
             named_struct('type', p_type, 'months', p_months, 'url_template', p_url_template, 'param_name', p_param_name,
                          'start_index', p_start_index, 'param_pattern', CAST(NULL AS STRING),
                          'inject_dates', p_inject_dates) END AS pagination""",
        "head", "tail",
    )


def limits(spark: SparkSession) -> DataFrame:
    return limits_table(spark, LIMIT_ROWS)


LIMITS_SQL = """fx_limits AS (SELECT model, CAST(rpm AS BIGINT) AS rpm, CAST(rpd AS BIGINT) AS rpd, CAST(tpm AS BIGINT) AS tpm,
    CAST(tpd AS BIGINT) AS tpd FROM (VALUES {}) AS t(model, rpm, rpd, tpm, tpd))""".format(
    ", ".join("({!r}, {}, {}, {}, {})".format(m, a, b, c, "NULL" if d is None else d) for m, a, b, c, d in LIMIT_ROWS)
)


def ctes(*names: str) -> str:
    """``WITH`` clause that defines the named views for the check SQL."""
    parts = []
    for name in names:
        if name == "fx_limits":
            parts.append(LIMITS_SQL)
            continue
        v = VIEWS[name]
        cols = ", ".join(v.columns).replace("TIMESTAMP_LIT", "TIMESTAMP '2024-01-01 00:00:00'").replace("VARCHAR_T", "VARCHAR")
        where = f" WHERE {v.where}" if v.where else ""
        parts.append(f"{name} AS (SELECT {cols} FROM {_DERIVED_SQL.get(v.table, v.table)}{where})")
    return "WITH " + ",\n".join(parts)
