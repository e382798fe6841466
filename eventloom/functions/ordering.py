"""Running totals and row numbers that do not pull a whole group into one task.

``row_number() over (partition by k order by o)`` sorts all rows of ``k`` in a
single task. Here the rows are range-partitioned on ``(k, o)`` instead, so a hot
key is cut into as many slices as its size needs. Totals per (key, slice) are
tiny; their prefix sums shift each slice-local result into the global one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import durable


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the key up to this one.

    ``order`` must be a total order within the key. A null key is a key of its own.
    """
    keys = list(keys)
    placed = df.withColumn("_value", value).repartitionByRange(*[F.col(k) for k in keys], *order)
    # Slice ids come from sampled range bounds, so the placement has to be made
    # durable before it is read twice.
    placed = durable(placed.withColumn("_slice", F.spark_partition_id()))

    inside = Window.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_slice", *keys)
        .agg(F.sum("_value").alias("_sum"))
        .select(
            F.col("_slice").alias("_of"),
            *[F.col(k).alias(f"_of_{k}") for k in keys],
            F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
        )
    )
    same = F.col("_slice") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return (
        placed.withColumn("_local", F.sum("_value").over(inside))
        .join(offsets, same)
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_slice", "_value", "_local", "_before", "_of", *[f"_of_{k}" for k in keys])
    )


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "row_no") -> DataFrame:
    """Add ``out``: 1, 2, 3, ... within the key in the given total order."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), out)
