"""Declared schemas of the stored tables."""

from __future__ import annotations

CATALOG = """
    id BIGINT, title STRING, description STRING, venue STRING, date TIMESTAMP_NTZ, url STRING, source STRING,
    category STRING, price STRING, score DOUBLE, pinned BOOLEAN, created_at TIMESTAMP_NTZ
"""

FEEDBACK = """
    click_id BIGINT, user_id BIGINT, event_id BIGINT, event_title STRING, event_description STRING,
    event_source STRING, event_category STRING, event_venue STRING, interested BOOLEAN, created_at TIMESTAMP_NTZ
"""

PROFILE = """
    user_id BIGINT, taste_prompt STRING, preference_summary STRING, feedback_count_at_last_summary BIGINT,
    last_summarized_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ
"""

PROFILE_HISTORY = """
    user_id BIGINT, taste_prompt STRING, preference_summary STRING, feedback_count BIGINT, created_at TIMESTAMP_NTZ
"""

SOURCE_RUNS = """
    id BIGINT, source STRING, run_timestamp TIMESTAMP_NTZ, events_found BIGINT, events_added BIGINT, success BOOLEAN,
    error_message STRING, duration_seconds DOUBLE
"""

LLM_CALLS = """
    id BIGINT, timestamp TIMESTAMP_NTZ, provider STRING, model STRING, call_type STRING, prompt_tokens BIGINT,
    completion_tokens BIGINT, duration_seconds DOUBLE, api_key_label STRING
"""

LIMIT_ERRORS = """
    id BIGINT, timestamp TIMESTAMP_NTZ, api_key_label STRING, model STRING, classified_as STRING,
    retry_after_sec BIGINT, error_snippet STRING
"""

MODEL_LIMITS = "model STRING, rpm BIGINT, rpd BIGINT, tpm BIGINT, tpd BIGINT"

PAGES = "page_id BIGINT, site_key STRING, url STRING, html STRING"

REGISTRY = """
    site_key STRING, display_name STRING, url STRING, use_browser BOOLEAN, wait_secs INT, max_pages INT, note STRING,
    pagination STRUCT<type: STRING, months: INT, url_template: STRING, param_name: STRING, start_index: INT,
                      param_pattern: STRING, inject_dates: BOOLEAN>,
    head STRING, tail STRING
"""

EXTRACTION = """
    STRUCT<events: ARRAY<STRUCT<title: STRING, date: STRING, end_date: STRING, time: STRING, description: STRING,
                                venue: STRING, url: STRING>>,
           next_page_url: STRING>
"""

EVENT_FIELDS = ["title", "date", "end_date", "time", "description", "venue", "url"]

TABLES = {
    "catalog": CATALOG,
    "feedback": FEEDBACK,
    "profile": PROFILE,
    "profile_history": PROFILE_HISTORY,
    "source_runs": SOURCE_RUNS,
    "llm_calls": LLM_CALLS,
    "limit_errors": LIMIT_ERRORS,
    "model_limits": MODEL_LIMITS,
    "pages": PAGES,
    "registry": REGISTRY,
}
