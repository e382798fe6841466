"""Session settings, shared scratch space and lineage cuts."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Settings every job relies on. All of them can be changed on a live session.
RUNTIME_CONF = {
    # Timestamps are TIMESTAMP_NTZ throughout; functions that detour through
    # TIMESTAMP (date_trunc) are only neutral under a fixed UTC zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot source or event id is split even when that costs a later shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Streaming state lives on disk, not on the executors' heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


#: Bytes of stored rows that one task reads, and tasks that measure them at least.
PART_BYTES = 1 << 20
MEASURING_TASKS = 32


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "eventloom", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def durable_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, whose
    executors share one disk, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    root = context.getCheckpointDir()
    if root is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(named)
        root = context.getCheckpointDir()
    return root


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage so that every later reader sees the same placement of rows."""
    durable_root(df.sparkSession)
    return df.checkpoint()


def _bytes_of(column: Column, kind: DataType) -> Column:
    """About how many bytes a value takes, nested ones included."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column).cast("bigint"), F.lit(0)) + 16
    if isinstance(kind, StructType):
        return sum((_bytes_of(column[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("bigint"))
    if isinstance(kind, MapType):
        return _bytes_of(F.map_keys(column), ArrayType(kind.keyType)) + _bytes_of(F.map_values(column), ArrayType(kind.valueType))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, StructType, MapType, ArrayType)):
            inside = F.aggregate(column, F.lit(0).cast("bigint"), lambda total, x: total + _bytes_of(x, kind.elementType))
        else:
            inside = F.size(column).cast("bigint") * 8
        return F.coalesce(inside, F.lit(0)) + 24
    return F.lit(16).cast("bigint")


def stored_bytes(df: DataFrame) -> int:
    """About how many bytes the rows of ``df`` take.

    Measures by one pass over ``df``, so hand in something durable or stored. The pass has some
    tasks for each core and not one for each partition, most of which may be empty.
    """
    width = sum((_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0).cast("bigint"))
    tasks = max(MEASURING_TASKS, 2 * df.sparkSession.sparkContext.defaultParallelism)
    return df.coalesce(tasks).agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def parts_for(size: int) -> int:
    """How many partitions ``size`` bytes of rows need: each holds some ``PART_BYTES``, however large the table."""
    return max(2, math.ceil(size / PART_BYTES))


def gathered(df: DataFrame) -> DataFrame:
    """Stored rows in no more partitions than their measured bytes need.

    A shuffle leaves as many partitions as it was told to, and each of them is a task and some files
    in every later stage, also where it holds a few rows or none.
    """
    return df.coalesce(parts_for(stored_bytes(df)))


def broadcast_if_small(df: DataFrame, max_bytes: int = 64 * 1024 * 1024, size: int | None = None) -> DataFrame:
    """Hint a broadcast if the rows fit into ``max_bytes``; else leave the join to Spark.

    ``size`` is what ``stored_bytes`` gave for these rows or for more; without it they are measured now.
    """
    return F.broadcast(df) if (stored_bytes(df) if size is None else size) <= max_bytes else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{durable_root(spark)}/{name}-{uuid.uuid4().hex}"
