"""Crawl-plan, registry and stored-table jobs."""

from pyspark.sql import functions as F

from eventloom.operators import crawlplan, extraction
from eventloom.plans.fixtures import CATALOG_AS_OF as AS_OF
from eventloom.plans.jobs import job
from eventloom.session import scratch_path
from eventloom.sources import tables

_FLAT = """
sites AS (SELECT site_key, display_name, url, split_part(url, '{', 1) AS start_url, use_browser, wait_secs, max_pages,
            coalesce(p_type, 'llm') AS pagination_type, coalesce(p_months, 3) AS months, p_url_template AS url_template,
            coalesce(p_param_name, 'page') AS param_name, coalesce(p_start_index, 1) AS start_index,
            CAST(NULL AS VARCHAR) AS param_pattern, p_inject_dates AND p_type IS NOT NULL AS inject_dates, head, tail
          FROM fx_registry)"""


@job("scan_registry", "fx_registry", sql=f"WITH {_FLAT.strip()} SELECT * FROM sites")
def _registry(x):
    # Through the JSON-lines form in which a registry is kept.
    path = scratch_path(x.spark, "registry")
    x.registry.write.json(path)
    return tables.scan_registry(tables.read_registry(x.spark, path))


@job("scan_pages", "fx_pages", sql="SELECT * FROM fx_pages")
def _pages(x):
    path = scratch_path(x.spark, "pages")
    x.pages.write.parquet(path)
    return tables.scan_pages(x.spark, path)


_EVERY_TABLE = {
    "catalog": ("fx_catalog", "id", "title"),
    "feedback": ("fx_feedback_clicks", "click_id", "created_at"),
    "profile": ("fx_profile", "user_id", "taste_prompt"),
    "profile_history": ("fx_profile_edits", "user_id", "created_at"),
    "source_runs": ("fx_scraper_runs", "id", "source"),
    "llm_calls": ("fx_llm_calls", "id", "model"),
    "limit_errors": ("fx_limit_errors", "id", "api_key_label"),
    "model_limits": ("fx_limits", "rpd", "model"),
}
_STORED_AS = {"fx_profile_edits": "edited_at AS created_at, user_id, content AS preference_summary"}


@job(
    "scan_tables",
    *dict.fromkeys(view for view, *_ in _EVERY_TABLE.values()),
    sql=" UNION ALL ".join(
        f"""SELECT '{name}' AS stored, {number} AS number, CAST({text} AS VARCHAR) AS label
            FROM (SELECT {_STORED_AS.get(view, '*')} FROM {view})"""
        for name, (view, number, text) in _EVERY_TABLE.items()
    ),
)
def _tables(x):
    out = None
    for name, (view, number, text) in _EVERY_TABLE.items():
        path = scratch_path(x.spark, name)
        rows = getattr(x, view.removeprefix("fx_"))
        rows = rows.selectExpr(*_STORED_AS[view].split(", ")) if view in _STORED_AS else rows
        rows.write.parquet(path)
        read = tables.scan_table(x.spark, name, path)
        own = read.select(F.lit(name).alias("stored"), F.col(number).alias("number"), F.col(text).cast("string").alias("label"))
        out = own if out is None else out.unionByName(own)
    return out


_SEED = ", ".join(
    "({!r}, {}, {}, {}, {})".format(m, *["NULL" if v is None else v for v in numbers])
    for m, *numbers in [*tables.DEFAULT_LIMITS, ("view", 1, 1, 1, 1)]
)
_EDITED = "SELECT event_type AS model, CAST(30 AS BIGINT) AS rpm, count(*) AS rpd, CAST(6000 AS BIGINT) AS tpm, CAST(max(event_id) AS BIGINT) AS tpd FROM events GROUP BY 1"


@job(
    "seed_limits",
    sql=f"""WITH edited AS ({_EDITED}), seed AS (SELECT * FROM (VALUES {_SEED}) AS t(model, rpm, rpd, tpm, tpd))
            SELECT * FROM edited UNION ALL SELECT * FROM seed WHERE model NOT IN (SELECT model FROM edited)""",
)
def _seed(x):
    from eventloom.plans.fixtures import table

    edited = (
        table(x.spark, x.sf_dir, "events")
        .groupBy(F.col("event_type").alias("model"))
        .agg(
            F.lit(30).cast("bigint").alias("rpm"),
            F.count("*").alias("rpd"),
            F.lit(6000).cast("bigint").alias("tpm"),
            F.max("event_id").alias("tpd"),
        )
    )
    seed = tables.limits_table(x.spark, [*tables.DEFAULT_LIMITS, ("view", 1, 1, 1, 1)])
    return tables.seed_limits(edited, seed)


@job(
    "resolve_placeholders",
    "fx_registry",
    sql=f"""WITH {_FLAT.strip()} SELECT * EXCLUDE (url),
              replace(replace(replace(url, '{{today}}', '2024-02-15'), '{{plus90}}', '2024-05-15'),
                      '{{today_long}}', 'Feb%2015%202024') AS url FROM sites""",
)
def _resolve(x):
    return crawlplan.resolve_placeholders(tables.scan_registry(x.registry), as_of=AS_OF)


@job(
    "expand_month_urls",
    "fx_registry",
    sql=f"""WITH {_FLAT.strip()},
    m AS (SELECT *, CAST(DATE '2024-02-15' + CAST(30 * i AS INT) AS DATE) AS d
          FROM (SELECT *, unnest(range(months)) AS i FROM sites WHERE pagination_type IN ('multi_month', 'calendar_grid')))
    SELECT site_key, CAST(i + 1 AS INT) AS page_no, CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month, inject_dates,
      replace(replace(replace(replace(url_template, '{{month}}', CAST(month(d) AS VARCHAR)), '{{month:02d}}', strftime(d, '%m')),
                      '{{year}}', CAST(year(d) AS VARCHAR)), '{{month_name}}', lower(strftime(d, '%B'))) AS url FROM m""",
)
def _months(x):
    return crawlplan.expand_month_urls(tables.scan_registry(x.registry), as_of=AS_OF)


@job(
    "expand_param_urls",
    "fx_registry",
    sql=f"""WITH {_FLAT.strip()}
    SELECT site_key, CAST(i AS INT) AS page_no,
      CASE WHEN i = 0 AND start_index = 1 THEN url
           WHEN regexp_matches(url, 'page=\\d+') THEN regexp_replace(url, 'page=\\d+', 'page=' || (start_index + i), 'g')
           WHEN contains(url, '?') THEN url || '&page=' || (start_index + i) ELSE url || '?page=' || (start_index + i) END AS url
    FROM (SELECT *, unnest(range(max_pages)) AS i FROM sites WHERE pagination_type = 'url_param')""",
)
def _params(x):
    return crawlplan.expand_param_urls(tables.scan_registry(x.registry))


# Each page of the response view belongs to a site and has a page number; its own
# address counts as read, as does a third of the addresses the answers point to.
_ONWARD = """
CASE WHEN next_page_url IS NOT NULL THEN concat(CASE WHEN page_id % 5 = 0 THEN '/rel' ELSE next_page_url END, '?from=', page_id % 700) END"""


@job(
    "advance_frontier",
    "fx_responses",
    "fx_registry",
    sql=f"""WITH last AS (SELECT page_id, json_extract_string(content, '$.next_page_url') AS next_page_url
                          FROM fx_responses WHERE is_last),
    answers AS (SELECT concat('src', page_id % 20) AS site_key, page_id % 4 + 1 AS page_no, {_ONWARD} AS next_page_url FROM last),
    visited AS (SELECT DISTINCT concat('src', page_id % 20) AS site_key, concat('https://ex.org/p2?from=', page_id % 210) AS url FROM last)
    SELECT a.site_key, a.next_page_url AS url, min(a.page_no) + 1 AS page_no
    FROM answers a JOIN fx_registry r ON a.site_key = r.site_key
    WHERE starts_with(next_page_url, 'http') AND page_no < max_pages
      AND NOT EXISTS (SELECT 1 FROM visited v WHERE v.site_key = a.site_key AND v.url = a.next_page_url)
    GROUP BY 1, 2""",
)
def _frontier(x):
    last = extraction.next_page(extraction.parse_responses(x.responses))
    site = F.expr("concat('src', page_id % 20) AS site_key")
    answers = last.select(site, F.expr("page_id % 4 + 1 AS page_no"), F.expr(f"{_ONWARD.strip()} AS next_page_url"))
    visited = last.select(site, F.expr("concat('https://ex.org/p2?from=', page_id % 210) AS url"))
    return crawlplan.advance_frontier(answers, visited, tables.scan_registry(x.registry))


# Pages of a site link to each other: page k to pages further on, some to themselves, some to nothing.
_LINKS = """
CASE WHEN page_id % 13 = 0 THEN '/rel' WHEN page_id % 17 = 0 THEN NULL ELSE concat('https://ex.org/p/', page_id % 20 + 20 * (CAST(floor(page_id / 20) AS BIGINT) * 3 % 41)) END"""


@job(
    "follow_links",
    "fx_pages",
    "fx_registry",
    sql=f"""WITH RECURSIVE links AS (SELECT site_key, concat('https://ex.org/p/', page_id) AS url, {_LINKS} AS next_page_url FROM fx_pages),
    visited(site_key, url, page_no) AS (
        SELECT DISTINCT site_key, url, 1 FROM links WHERE CAST(split_part(url, '/p/', 2) AS BIGINT) < 100
        UNION
        SELECT v.site_key, l.next_page_url, v.page_no + 1
        FROM visited v JOIN links l ON v.site_key = l.site_key AND v.url = l.url JOIN fx_registry r ON r.site_key = v.site_key
        WHERE starts_with(l.next_page_url, 'http') AND v.page_no < r.max_pages)
    SELECT site_key, url, CAST(min(page_no) AS INT) AS page_no FROM visited GROUP BY 1, 2""",
)
def _follow(x):
    links = x.pages.selectExpr("site_key", "page_id", "concat('https://ex.org/p/', page_id) AS url", f"{_LINKS.strip()} AS next_page_url")
    return crawlplan.follow_links(links.where("page_id < 100"), links, tables.scan_registry(x.registry))


@job(
    "crawl_estimate",
    "fx_registry",
    sql=f"""WITH {_FLAT.strip()},
    n AS (SELECT *, CASE WHEN pagination_type IN ('llm', 'url_param') THEN max_pages WHEN pagination_type = 'multi_month' THEN months
                         ELSE 1 END AS urls, CASE WHEN use_browser THEN 2 ELSE 1 END AS per_page,
                 CASE WHEN use_browser THEN wait_secs + 5 ELSE 2 END AS wait FROM sites)
    SELECT site_key, pagination_type, urls, urls * per_page AS model_calls, urls * wait AS fetch_seconds,
           urls * per_page * 5 AS model_seconds, urls * wait + urls * per_page * 5 AS total_seconds FROM n""",
)
def _estimate(x):
    return crawlplan.crawl_estimate(tables.scan_registry(x.registry))
