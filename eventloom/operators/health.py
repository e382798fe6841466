"""Source health: event counts, run statistics and a status per source."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import title_case
from eventloom.functions.times import ntz

LATEST = ["last_run", "last_success", "last_events_found", "last_events_added", "last_duration", "last_error"]


def events_per_source(catalog: DataFrame, *, as_of: datetime | str) -> DataFrame:
    """Total and future events of each source."""
    return catalog.groupBy("source").agg(
        F.count("id").alias("total"), F.count_if(F.col("date") >= ntz(as_of)).alias("future")
    )


def month_spread(catalog: DataFrame, *, as_of: datetime | str) -> DataFrame:
    """Number of distinct months with future events per source."""
    return (
        catalog.where(F.col("date") >= ntz(as_of))
        .select("source", F.date_format("date", "yyyy-MM").alias("month"))
        .distinct()
        .groupBy("source")
        .agg(F.count("month").alias("months"))
    )


def spread_sketches(catalog: DataFrame) -> DataFrame:
    """``(source, day, sketch)``: mergeable distinct-count sketches of the months, to be stored and added to.

    An opt-in for catalogs too large to count anew; ``month_spread`` stays exact.
    """
    return (
        catalog.where(F.col("date").isNotNull())
        .groupBy("source", F.to_date("date").alias("day"))
        .agg(F.hll_sketch_agg(F.date_format("date", "yyyy-MM")).alias("sketch"))
    )


def month_spread_estimate(sketches: DataFrame, *, as_of: datetime | str) -> DataFrame:
    """``month_spread`` from stored sketches, by whole days from the day of ``as_of`` on."""
    merged = sketches.where(F.col("day") >= F.to_date(ntz(as_of))).groupBy("source").agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("source", F.hll_sketch_estimate("sketch").alias("months"))


def _latest() -> Column:
    newest = F.struct(
        F.col("run_timestamp").alias("last_run"),
        F.col("success").alias("last_success"),
        F.col("events_found").alias("last_events_found"),
        F.col("events_added").alias("last_events_added"),
        F.col("duration_seconds").alias("last_duration"),
        F.col("error_message").alias("last_error"),
    )
    return F.max_by(newest, F.struct("run_timestamp", "id"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of each source. An aggregate, so a source's runs combine map-side."""
    return runs.groupBy("source").agg(_latest().alias("latest")).select("source", "latest.*")


def run_stats(runs: DataFrame) -> DataFrame:
    """Counts, success rate, mean non-zero yield, mean duration and the newest run per source."""
    yielding = F.col("events_found") > 0
    return (
        runs.groupBy("source")
        .agg(
            F.count("*").alias("total_runs"),
            F.count_if("success").alias("successful_runs"),
            F.coalesce(F.sum(F.when(yielding, F.col("events_found"))), F.lit(0)).alias("found"),
            F.count_if(yielding).alias("yielding"),
            F.avg("duration_seconds").alias("avg_duration"),
            _latest().alias("latest"),
        )
        .select(
            "source",
            "total_runs",
            "successful_runs",
            (F.try_divide("successful_runs", "total_runs") * 100).alias("success_rate"),
            (F.col("found") / F.greatest("yielding", F.lit(1))).alias("avg_events"),
            "avg_duration",
            "latest.*",
        )
    )


def health_zero_fill(registry: DataFrame, runs: DataFrame) -> DataFrame:
    """Every registered source, with zeros where nothing ran yet."""
    zeros = {
        "total_runs": 0,
        "successful_runs": 0,
        "success_rate": 0.0,
        "avg_events": 0.0,
        "avg_duration": 0.0,
        "last_events_found": 0,
        "last_events_added": 0,
    }
    never = F.col("total_runs").isNull()
    return (
        registry.select(F.col("site_key").alias("source"), "display_name")
        .join(run_stats(runs), "source", "left")
        .withColumn("last_duration", F.when(never, F.lit(0.0)).otherwise(F.col("last_duration")))
        .fillna(zeros)
    )


def health_totals(catalog: DataFrame, runs: DataFrame, *, as_of: datetime | str) -> DataFrame:
    """Totals over all sources and runs in one row."""
    none = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    parts = catalog.select(
        one.alias("event"),
        F.when(F.col("date") >= ntz(as_of), one).otherwise(none).alias("future"),
        none.alias("run"),
        none.alias("ok"),
    ).unionByName(
        runs.select(
            none.alias("event"), none.alias("future"), one.alias("run"), F.col("success").cast("bigint").alias("ok")
        )
    )
    return parts.agg(
        F.coalesce(F.sum("event"), none).alias("total_events"),
        F.coalesce(F.sum("future"), none).alias("total_future"),
        F.coalesce(F.sum("run"), none).alias("total_runs"),
        F.coalesce(F.try_divide(F.sum("ok"), F.sum("run")) * 100, F.lit(0.0)).alias("success_rate"),
    )


def status_health(registry: DataFrame, runs: DataFrame, catalog: DataFrame, *, as_of: datetime | str) -> DataFrame:
    """Status label, yield class and single-month flag of every registered source.

    The label follows the newest run first; older failures only show as "Flaky".
    """
    # Events, future events and future months of a source in one pass over the catalog.
    month = F.when(F.col("date") >= ntz(as_of), F.date_format("date", "yyyy-MM"))
    counts = (
        catalog.groupBy("source", month.alias("month"))
        .agg(F.count("id").alias("n"))
        .groupBy("source")
        .agg(
            F.coalesce(F.sum(F.when(F.col("month").isNotNull(), F.col("n"))), F.lit(0)).alias("future"),
            F.count("month").alias("months"),
        )
    )
    low = (F.col("avg_events") > 0) & (F.col("last_events_found") < F.col("avg_events") * 0.5)
    return (
        health_zero_fill(registry, runs)
        .join(counts, "source", "left")
        .fillna(0, ["future", "months"])
        .select(
            "source",
            F.coalesce("display_name", title_case(F.col("source"))).alias("display_name"),
            F.when(F.col("total_runs") == 0, "No Runs")
            .when(~F.col("last_success"), "Error")
            .when(F.col("last_events_found") == 0, "Empty")
            .when(low, "Low Yield")
            .when(F.col("success_rate") < 50, "Flaky")
            .otherwise("Healthy")
            .alias("label"),
            F.when(F.col("last_run").isNull(), "neutral")
            .when(F.col("last_events_found") == 0, "zero")
            .when(low, "low")
            .otherwise("good")
            .alias("yield_class"),
            ((F.col("months") == 1) & (F.col("future") > 0)).alias("single_month"),
            "future",
        )
        .withColumn(
            "status",
            F.when(F.col("label") == "Error", "error").when(F.col("label") == "Healthy", "healthy").otherwise("warning"),
        )
    )
