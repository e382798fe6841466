"""Model answers kept by request, so that no answered request is sent twice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.inference import ANSWER, Completer, complete
from eventloom.session import durable
from eventloom.sources.manifest import Folders

#: Requests that are answered and stored as one part.
BATCH = 10_000
#: Parts from which a new one is merged with the old ones.
PARTS = 50


class AnswerStore:
    """Answers below ``path``, in parts that count once the manifest names them.

    A request is known by ``keys`` and a hash of its text, so a changed request is a new
    one. A failed call is kept with its error and sent again by the next ``complete``.
    """

    def __init__(self, spark: SparkSession, path: str, keys: str):
        self.spark, self.path = spark, path
        self.schema = f"{keys}, prompt_hash STRING, {ANSWER}"
        columns = spark.createDataFrame([], self.schema).columns
        self.keys = columns[: columns.index("prompt_hash")]
        self._folders = Folders(spark, path)

    def answers(self) -> DataFrame:
        """Every stored answer; of several to one request the last good one, else the last failure."""
        parts = self._folders.read().get("parts", [])
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{part}" for part in parts])
        value = F.struct(*[c for c in rows.columns if c not in (*self.keys, "prompt_hash")])
        best = F.max_by(value, F.struct(F.col("error").isNull(), F.col("asked_at"))).alias("best")
        return rows.groupBy(*self.keys, "prompt_hash").agg(best).select(*self.keys, "prompt_hash", "best.*")

    def commit(self, answers: DataFrame, name: str | None = None) -> None:
        """Store answers as one part. A part of a known name has been stored before and changes nothing."""
        state = self._folders.read()
        parts = state.get("parts", [])
        part = f"part-{name or uuid.uuid4().hex}"
        if part in parts or part in state.get("merged", []):
            return
        answers.select(*self.keys, "prompt_hash", *_names(ANSWER)).write.mode("overwrite").parquet(f"{self.path}/{part}")
        self._folders.commit({**state, "parts": [*parts, part]})
        if len(parts) + 1 > PARTS:
            self._merge()

    def _merge(self) -> None:
        state = self._folders.read()
        part = f"part-{uuid.uuid4().hex}"
        self.answers().write.parquet(f"{self.path}/{part}")
        # Results handed out earlier may still read the merged parts, so they go with the next merge.
        self._folders.commit({"parts": [part], "stale": state["parts"], "merged": state.get("merged", []) + state["parts"]})
        for old in state.get("stale", []):
            self._folders.drop(old)

    def complete(
        self, requests: DataFrame, completer: Completer, *, prompt: str = "prompt", batch: int = BATCH, partitions: int | None = None
    ) -> DataFrame:
        """One answer for each request; only those without a stored good answer are sent.

        Open requests go out in batches of about ``batch``, and each batch is committed
        before the next one starts: a crash costs one batch at most.
        """
        asked = requests.select(*self.keys, F.col(prompt).alias("prompt"), F.sha2(F.col(prompt), 256).alias("prompt_hash"))
        asked = durable(asked)
        same = [*self.keys, "prompt_hash"]
        open_ = durable(asked.join(self.answers().where("error IS NULL").select(same), same, "left_anti").dropDuplicates(same))
        batches = -(-open_.count() // batch)
        number = F.pmod(F.xxhash64(*same), F.lit(max(batches, 1)))
        for i in range(batches):
            self.commit(complete(open_.where(number == i), same, completer, partitions=partitions))
        return asked.select(same).join(self.answers(), same)


def _names(ddl: str) -> list[str]:
    return [field.strip().split()[0] for field in ddl.split(",")]
