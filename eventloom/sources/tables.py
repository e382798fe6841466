"""Scans of stored tables with their declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.schemas import PAGES, REGISTRY, TABLES

#: Published request and token limits per model: rpm, rpd, tpm, tpd. Fixed values.
DEFAULT_LIMITS = [
    ("allam-2-7b", 30, 7000, 6000, 500000),
    ("canopylabs/orpheus-arabic-saudi", 10, 100, 1200, 3600),
    ("canopylabs/orpheus-v1-english", 10, 100, 1200, 3600),
    ("groq/compound", 30, 250, 70000, None),
    ("groq/compound-mini", 30, 250, 70000, None),
    ("llama-3.1-8b-instant", 30, 14400, 6000, 500000),
    ("llama-3.3-70b-versatile", 30, 1000, 12000, 100000),
    ("meta-llama/llama-4-scout-17b-16e-instruct", 30, 1000, 30000, 500000),
    ("meta-llama/llama-prompt-guard-2-22m", 30, 14400, 15000, 500000),
    ("meta-llama/llama-prompt-guard-2-86m", 30, 14400, 15000, 500000),
    ("moonshotai/kimi-k2-instruct", 60, 1000, 10000, 300000),
    ("moonshotai/kimi-k2-instruct-0905", 60, 1000, 10000, 300000),
    ("openai/gpt-oss-120b", 30, 1000, 8000, 200000),
    ("openai/gpt-oss-20b", 30, 1000, 8000, 200000),
    ("openai/gpt-oss-safeguard-20b", 30, 1000, 8000, 200000),
    ("qwen/qwen3-32b", 60, 1000, 6000, 500000),
    ("whisper-large-v3", 20, 2000, None, None),
    ("whisper-large-v3-turbo", 20, 2000, None, None),
]


def scan_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Read a stored table. Tables laid out by day keep ``day`` as a pruning column."""
    rows = spark.read.schema(TABLES[name] + (", day DATE" if name in LAID_OUT_BY_DAY else "")).parquet(path)
    return rows.drop("run")


#: Append-only logs are written one folder per day and run.
LAID_OUT_BY_DAY = {"llm_calls", "limit_errors", "source_runs"}


def scan_pages(spark: SparkSession, path: str, layout: str = "parquet") -> DataFrame:
    """Stored raw pages, so that later stages rerun without fetching again.

    ``layout="html"`` reads a folder of raw files, one row per file, taking the
    site from the parent folder's name.
    """
    if layout == "parquet":
        return spark.read.schema(PAGES).parquet(path)
    files = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(path)
    location = F.col("_metadata.file_path")
    return files.select(
        F.xxhash64(location).alias("page_id"),
        F.element_at(F.split(location, "/"), -2).alias("site_key"),
        location.alias("url"),
        F.col("value").alias("html"),
    )


def scan_registry(registry: DataFrame) -> DataFrame:
    """One flat row per site: names, trim markers and the link shown to people.

    The shown link is the address up to its first placeholder.
    """
    p = F.col("pagination")
    return registry.select(
        "site_key",
        "display_name",
        "url",
        F.element_at(F.split("url", r"\{", 2), 1).alias("start_url"),
        "use_browser",
        "wait_secs",
        "max_pages",
        F.coalesce(p.type, F.lit("llm")).alias("pagination_type"),
        F.coalesce(p.months, F.lit(3)).alias("months"),
        p.url_template.alias("url_template"),
        F.coalesce(p.param_name, F.lit("page")).alias("param_name"),
        F.coalesce(p.start_index, F.lit(1)).alias("start_index"),
        p.param_pattern.alias("param_pattern"),
        F.coalesce(p.inject_dates, F.lit(False)).alias("inject_dates"),
        "head",
        "tail",
    )


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry as JSON lines, one site per line."""
    return spark.read.schema(REGISTRY).json(path)


def limits_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Limit rows as literal values, whose size the optimizer knows, so it can broadcast them."""
    literals = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in rows)
    numbers = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("rpm", "rpd", "tpm", "tpd"))
    return spark.sql(f"SELECT model, {numbers} FROM VALUES {literals} AS t(model, rpm, rpd, tpm, tpd)")


def default_limits(spark: SparkSession) -> DataFrame:
    return limits_table(spark, DEFAULT_LIMITS)


def seed_limits(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """Add models that are missing; rows that exist keep their manual edits."""
    return existing.unionByName(seed.join(existing.select("model"), "model", "left_anti"))
