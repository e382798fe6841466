"""Writes. Logs are append-only by day and run; a stage is replaced site by site.

Every partitioned write is rebalanced on its partition column first: small
partitions end up in few files, and a day or site that holds most of the rows is
split over several tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventloom.functions.text import clip
from eventloom.sources.manifest import Folders


def append_log(rows: DataFrame, path: str, ts: str, *, run: str, key: Sequence[str]) -> None:
    """Append the rows of one run, each with an ``id`` made of the run and the row's key.

    The rows of a day and run have a folder of their own, so a replay of the run
    replaces what it wrote before and adds nothing, and ids stay the same.
    """
    name = F.md5(F.concat_ws("|", F.lit(run), *[F.col(k).cast("string") for k in key]))
    number = F.conv(F.substring(name, 1, 15), 16, 10).cast("bigint")
    marked = rows.withColumn("id", number).withColumn("day", F.to_date(ts)).withColumn("run", F.lit(run))
    (
        marked.hint("rebalance", "day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day", "run")
        .parquet(path)
    )


def sink_stage(rows: DataFrame, path: str, *, sites: Iterable[str], run: str) -> None:
    """Replace what is stored of every site in the run's list, also of those without rows now.

    Rows go to the run's own folder; the manifest then says which run holds each site. Until
    that moment the old state is what ``read_stage`` shows. A repeated run writes its folder
    anew under another name.
    """
    folders = Folders(rows.sparkSession, path)
    state = folders.read()
    tries = state.get("tries", 0) + 1
    folder = f"run-{run}-{tries}"
    sites = sorted(set(sites))
    rows.where(F.col("site_key").isin(sites)).hint("rebalance", "site_key").write.mode("overwrite").partitionBy("site_key").parquet(
        f"{path}/{folder}"
    )
    holders = {**state.get("sites", {}), **dict.fromkeys(sites, folder)}
    unused = set(state.get("sites", {}).values()) - set(holders.values())
    # Readers that opened the last state may still be at work, so a folder goes one commit after its last use.
    for old in state.get("unused", []):
        folders.drop(old)
    folders.commit({"sites": holders, "tries": tries, "schema": rows.schema.json(), "unused": sorted(unused)})


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """The rows of every site as its last run left them. Filters on ``site_key`` prune folders."""
    state = Folders(spark, path).read()
    schema = StructType.fromJson(json.loads(state["schema"]))
    out = spark.createDataFrame([], schema)
    for folder in sorted(set(state["sites"].values())):
        own = sorted(site for site, holder in state["sites"].items() if holder == folder)
        part = spark.read.schema(schema).parquet(f"{path}/{folder}").where(F.col("site_key").isin(own))
        out = out.unionByName(part)
    return out


def sink_run_log(runs: DataFrame, path: str, *, run: str) -> None:
    """Append one audit row per source of a run (``operators.catalog.run_log``), failed ones included."""
    columns = ("source", "run_timestamp", "events_found", "events_added", "success", "error_message", "duration_seconds")
    append_log(runs.select(*columns), path, "run_timestamp", run=run, key=["source"])


def sink_call_log(calls: DataFrame, path: str, *, run: str) -> None:
    """Append one usage row per model call that answered (``operators.inference.call_log``)."""
    columns = ("timestamp", "provider", "model", "call_type", "prompt_tokens", "completion_tokens", "duration_seconds", "api_key_label")
    append_log(calls.where(F.col("error").isNull()).select("call_key", *columns), path, "timestamp", run=run, key=["call_key"])


def sink_error_log(errors: DataFrame, path: str, *, run: str) -> None:
    """Append failed calls with their class, the seconds to wait and the first 500 characters of the text.

    ``errors`` comes from ``operators.limits.error_rows``, which says which calls hit a limit.
    """
    columns = ("timestamp", "api_key_label", "model", "classified_as", "retry_after_sec")
    rows = errors.select("call_key", *columns, clip(F.col("error_text"), 500).alias("error_snippet"))
    append_log(rows, path, "timestamp", run=run, key=["call_key"])


def sink_ics(lines: DataFrame, path: str) -> None:
    """Calendar documents as text, one folder per calendar.

    The part files of a folder in the order of their names are one document; a large
    calendar is written by several tasks.
    """
    (
        lines.repartitionByRange("calendar", "seq")
        .sortWithinPartitions("calendar", "seq")
        .select("calendar", F.col("text").alias("value"))
        .write.mode("overwrite")
        .partitionBy("calendar")
        .option("lineSep", "\r\n")
        .text(path)
    )
