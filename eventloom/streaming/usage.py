"""The rolling 24-hour token budget as a stream of calls."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from eventloom.operators.usage import PAIR, call_tokens


def stream_usage_hourly(calls: DataFrame, *, lateness: str = "1 hour") -> DataFrame:
    """Tokens per hour, key and model, emitted once the hour is closed.

    Calls that arrive later than ``lateness`` are dropped and counted by Spark in
    the query progress; ``LateRows`` stores these counts.
    """
    # Windows need TIMESTAMP; under the pinned UTC session the clock values are the same.
    return (
        calls.withColumn("ts", F.col("timestamp").cast("timestamp"))
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 hour").alias("hour"), *PAIR)
        .agg(F.count("*").alias("calls"), F.coalesce(F.sum(call_tokens()), F.lit(0)).alias("tokens"))
    )


def stream_usage(calls: DataFrame, *, lateness: str = "1 hour") -> DataFrame:
    """Calls and tokens of every 24-hour window, sliding by the hour.

    The sliding windows run over closed hours, so the 24-fold fan-out applies to
    one row per hour and pair and not to every call.
    """
    hourly = stream_usage_hourly(calls, lateness=lateness)
    return (
        hourly.groupBy(F.window(F.window_time("hour"), "24 hours", "1 hour").alias("w"), *PAIR)
        .agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            *PAIR,
            "calls",
            "tokens",
        )
    )


def write_closed(windows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append closed windows to a table."""
    return (
        windows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


class LateRows(StreamingQueryListener):
    """Stores how many rows each batch dropped for being late, one small file a batch below ``path``.

    Add it with ``spark.streams.addListener`` before the queries start. A file is named by
    query and batch, so a batch that is replayed counts once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        # The first stateful operator alone sees the calls; later ones see its sums.
        dropped = progress.stateOperators[-1].numRowsDroppedByWatermark if progress.stateOperators else 0
        if dropped:
            row = {"query_id": str(progress.id), "batch_id": progress.batchId, "dropped": dropped}
            hadoop = self._spark.sparkContext._jvm.org.apache.hadoop.fs
            file = hadoop.Path(f"{self._path}/{row['query_id']}-{row['batch_id']}.json")
            stream = file.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).create(file, True)
            stream.write(bytearray(json.dumps(row).encode()))
            stream.close()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """What ``LateRows`` stored: query_id, batch_id and dropped."""
    return spark.read.schema("query_id STRING, batch_id BIGINT, dropped BIGINT").json(path)
