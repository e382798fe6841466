"""Insert-if-absent as a stream of extracted events, into a catalog kept by month."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom.operators.catalog import catalog_rows, clamp_ongoing, classify_save, normalize_dates, with_ids
from eventloom.session import durable
from eventloom.sources.manifest import Folders

#: Parts from which all but the largest one are merged.
PARTS = 20
UNDATED = "undated"


def _month() -> Column:
    return F.coalesce(F.date_format("date", "yyyy-MM"), F.lit(UNDATED))


class CatalogStore:
    """A catalog below ``path``: a part for each batch, in folders by month, named by a manifest.

    The manifest says which months a part has, how many rows, what the highest id is
    and which batch was last, so that a batch opens the months it touches and nothing else.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._folders = Folders(spark, path)

    def start(self, catalog: DataFrame) -> None:
        """Store the first rows, unless the store has begun before."""
        if not self._folders.read():
            self._add("part-start", catalog, {"parts": {}, "highest": 0, "last_batch": -1})

    def read(self, months: Iterable[str] | None = None) -> DataFrame:
        """The stored rows, or those of some months, from these months' folders alone."""
        state = self._folders.read()
        schema = state["schema"]
        wanted = None if months is None else set(months)
        found = [
            f"{self.path}/{part}/month={month}"
            for part, known in sorted(state["parts"].items())
            for month in sorted(known["months"])
            if wanted is None or month in wanted
        ]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def highest(self) -> int:
        return self._folders.read()["highest"]

    def has(self, batch_id: int) -> bool:
        return batch_id <= self._folders.read()["last_batch"]

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Add the rows of a batch, once: a batch that is known changes nothing."""
        state = self._folders.read()
        if batch_id <= state["last_batch"]:
            return
        state = self._add(f"part-{batch_id}", rows, {**state, "last_batch": batch_id})
        if len(state["parts"]) > PARTS:
            self._merge(state)

    def _add(self, part: str, rows: DataFrame, state: dict, replaced: Iterable[str] = ()) -> dict:
        schema = state.get("schema") or ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
        path = f"{self.path}/{part}"
        rows.withColumn("month", _month()).hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(path)
        written = self.spark.read.schema(f"{schema}, month STRING").parquet(path)
        counts = written.groupBy("month").agg(F.count("*").alias("n"), F.max("id").alias("high")).collect()
        parts = {name: known for name, known in state["parts"].items() if name not in replaced}
        parts[part] = {"months": [r.month for r in counts], "rows": sum(r.n for r in counts)}
        highest = max([state["highest"], *(r.high for r in counts if r.high is not None)])
        state = {**state, "parts": parts, "schema": schema, "highest": highest}
        self._folders.commit(state)
        return state

    def _merge(self, state: dict) -> None:
        small = sorted(state["parts"], key=lambda part: state["parts"][part]["rows"])[:-1]
        paths = [f"{self.path}/{part}/month={month}" for part in small for month in state["parts"][part]["months"]]
        rows = self.spark.read.schema(state["schema"]).parquet(*paths)
        # Plans made before may still read the merged parts, so they go with the next merge.
        stale, state = state.get("stale", []), {**state, "stale": small}
        self._add(f"part-to-{state['last_batch']}", rows, state, replaced=small)
        for old in stale:
            self._folders.drop(old)


def stored_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The whole catalog kept below ``path``."""
    return CatalogStore(spark, path).read()


def merge_batch(registry: DataFrame, path: str, as_of: datetime | str) -> Callable[[DataFrame, int], None]:
    """Adds the new rows of a batch to the store; what is stored is not rewritten.

    Winners are searched once, among the batch and the stored rows of its months. A batch replayed
    after a failure is skipped if it was committed and written again if not.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        store = CatalogStore(batch.sparkSession, path)
        if store.has(batch_id):
            return
        dated = durable(clamp_ongoing(normalize_dates(batch, as_of=as_of), as_of=as_of))
        months = [r.month for r in dated.select(F.date_format("event_dt", "yyyy-MM").alias("month")).distinct().collect()]
        added = catalog_rows(classify_save(dated, store.read(months), as_of=as_of), registry)
        store.append(with_ids(added, store.highest()), batch_id)

    return merge


def stream_catalog(
    extracted: DataFrame,
    catalog: DataFrame,
    registry: DataFrame,
    path: str,
    checkpoint: str,
    *,
    as_of: datetime | str,
    **trigger,
) -> StreamingQuery:
    """Merge arriving events into the catalog below ``path``, which starts as ``catalog``.

    ``row_id`` orders events within a batch; across batches the earlier batch wins.
    """
    CatalogStore(catalog.sparkSession, path).start(catalog)
    return (
        extracted.writeStream.foreachBatch(merge_batch(registry, path, as_of))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
