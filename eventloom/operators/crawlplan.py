"""Crawl plans: which addresses to read next. Registry rows come from ``scan_registry``."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.times import moment
from eventloom.session import scratch_path


def _filled(text: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def resolve_placeholders(registry: DataFrame, *, as_of: datetime | str) -> DataFrame:
    """Fill the date placeholders of the start address; other placeholders stay."""
    today = moment(as_of)
    values = {
        "today": today.strftime("%Y-%m-%d"),
        "plus90": (today + timedelta(days=90)).strftime("%Y-%m-%d"),
        "today_long": f"{today:%b}%20{today.day}%20{today.year}",
    }
    return registry.withColumn("url", _filled(F.col("url"), {k: F.lit(v) for k, v in values.items()}))


def expand_month_urls(registry: DataFrame, *, as_of: datetime | str) -> DataFrame:
    """Month pages of month-wise sites. Month i is 30*i days ahead, so it may skip or repeat one."""
    ahead = F.sequence(F.lit(0), F.col("months") - 1)
    day = F.date_add(F.lit(moment(as_of).date()), F.col("i") * 30)
    month = F.month(day).cast("string")
    values = {
        "month": month,
        "month:02d": F.lpad(month, 2, "0"),
        "year": F.year(day).cast("string"),
        "month_name": F.lower(F.date_format(day, "MMMM")),
    }
    return (
        registry.where(F.col("pagination_type").isin("multi_month", "calendar_grid") & (F.col("months") > 0))
        .select("site_key", "url_template", "inject_dates", F.explode(ahead).alias("i"))
        .select(
            "site_key",
            (F.col("i") + 1).alias("page_no"),
            F.year(day).alias("year"),
            F.month(day).alias("month"),
            "inject_dates",
            _filled(F.col("url_template"), values).alias("url"),
        )
    )


def expand_param_urls(registry: DataFrame) -> DataFrame:
    """Pages of sites that count in a query parameter, numbered from 0."""
    index = (F.col("start_index") + F.col("page_no")).cast("string")
    value = F.concat(F.col("param_name"), F.lit("="), index)
    pattern = F.coalesce("param_pattern", F.concat("param_name", F.lit(r"=\d+")))
    url = F.col("url")
    counted = F.when(F.regexp_like(url, pattern), F.regexp_replace(url, pattern, value)).otherwise(
        F.concat(url, F.when(F.contains(url, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), value)
    )
    untouched = (F.col("page_no") == 0) & (F.col("start_index") == 1)
    return (
        registry.where((F.col("pagination_type") == "url_param") & (F.col("max_pages") > 0))
        .withColumn("page_no", F.explode(F.sequence(F.lit(0), F.col("max_pages") - 1)))
        .select("site_key", "page_no", F.when(untouched, url).otherwise(counted).alias("url"))
    )


def advance_frontier(answers: DataFrame, visited: DataFrame, registry: DataFrame) -> DataFrame:
    """The next page of each crawl: ``answers`` has site_key, page_no and next_page_url.

    A crawl stops without a full http link, at its page limit, or at a page it has
    already read.
    """
    onward = (
        answers.where(F.col("next_page_url").startswith("http"))
        .join(registry.select("site_key", "max_pages"), "site_key")
        .where(F.col("page_no") < F.col("max_pages"))
        .select("site_key", F.col("next_page_url").alias("url"), (F.col("page_no") + 1).alias("page_no"))
        # Two answers of a site may name the same page; read it once, at its first number.
        .groupBy("site_key", "url")
        .agg(F.min("page_no").alias("page_no"))
    )
    return onward.join(visited.select("site_key", "url").distinct(), ["site_key", "url"], "left_anti")


def follow_links(starts: DataFrame, links: DataFrame, registry: DataFrame) -> DataFrame:
    """Pages reached over stored links (site_key, url, next_page_url), round by round.

    Each round follows the links of the last round's new pages only and appends what is new to a
    scratch table, one folder a round; what was written is read but never written again, so bytes
    written grow with the pages. The page limits of the registry end every crawl; the rounds go on
    until no site has a next page.
    """
    spark = starts.sparkSession
    path = scratch_path(spark, "visited")
    schema = "site_key STRING, url STRING, page_no INT"

    def append(pages: DataFrame, number: int) -> DataFrame:
        pages.select("site_key", "url", F.col("page_no").cast("int").alias("page_no")).write.parquet(f"{path}/round={number}")
        return spark.read.schema(schema).parquet(f"{path}/round={number}")

    number = 1
    frontier = append(starts.select("site_key", "url").distinct().withColumn("page_no", F.lit(1)), number)
    while not frontier.isEmpty():
        answers = frontier.join(links, ["site_key", "url"]).select("site_key", "page_no", "next_page_url")
        visited = spark.read.schema(f"{schema}, round INT").parquet(path)
        number += 1
        frontier = append(advance_frontier(answers, visited, registry), number)
    return spark.read.schema(f"{schema}, round INT").parquet(path).drop("round")


def crawl_estimate(registry: DataFrame) -> DataFrame:
    """Addresses, model calls and seconds each source will take."""
    urls = (
        F.when(F.col("pagination_type").isin("llm", "url_param"), F.col("max_pages"))
        .when(F.col("pagination_type") == "multi_month", F.col("months"))
        .otherwise(1)
    )
    # Chunks per page, fetch and model seconds.
    return (
        registry.select("site_key", "pagination_type", "use_browser", "wait_secs", urls.alias("urls"))
        .withColumn("model_calls", F.col("urls") * F.when(F.col("use_browser"), 2).otherwise(1))
        .withColumn("fetch_seconds", F.col("urls") * F.when(F.col("use_browser"), F.col("wait_secs") + 5).otherwise(2))
        .withColumn("model_seconds", F.col("model_calls") * 5)
        .withColumn("total_seconds", F.col("fetch_seconds") + F.col("model_seconds"))
        .drop("use_browser", "wait_secs")
    )
