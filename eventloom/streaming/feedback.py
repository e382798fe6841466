"""Feedback clicks as streams: content snapshots, rejects, and who is due for a new summary.

Clicks and events arrive as two streams in any order. ``stream_feedback`` keeps the content
of each event and the clicks that came before it; ``stream_due`` keeps one counter
per user. Both run on ``transformWithState``, so state lives in RocksDB and a restarted
query goes on where it was. A call of Python handles a group of events at a time, since a call
for each of them takes far longer than its rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from eventloom.operators.profile import SUMMARY_THRESHOLD, accepted, rejected

CONTENT = ["event_title", "event_description", "event_source", "event_category", "event_venue"]
#: A click as whole numbers: created_at in microseconds, what is true or null of it in bits, and until when it waits, in milliseconds.
CLICK = ["event_id", "click_id", "user_id", "created", "bits", "until"]
INTERESTED, NO_CLICK_ID, NO_USER, NO_TIME = 1, 2, 4, 8
WAIT = timedelta(days=7)
#: Groups into which the keys of the state are dealt.
GROUPS = 1 << 11

_TEXTS = ", ".join(f"{name} STRING" for name in CONTENT)
_CLICKS = "click_id ARRAY<BIGINT>, user_id ARRAY<BIGINT>, created ARRAY<BIGINT>, bits ARRAY<BIGINT>"
#: Feedback rows with ``status`` kept, and clicks with ``status`` rejected and the reason.
FEEDBACK = f"""
    click_id BIGINT, user_id BIGINT, event_id BIGINT, {_TEXTS}, interested BOOLEAN, created_at TIMESTAMP_NTZ,
    status STRING, reason STRING
"""


def _group(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int").alias("group")


class _Resolve(StatefulProcessor):
    """Gives each click the content of its event, whichever of the two comes first.

    Clicks that wait lie in parts. A part is known by the earliest time at which one of its
    clicks is up, and a timer of that time wakes it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.content = handle.getMapState("content", "event_id BIGINT", _TEXTS)
        self.waiting = handle.getMapState("waiting", "until BIGINT", "clicks BINARY")

    def _rows(self, parts: list[np.ndarray], contents: dict[int, tuple | None], reason: str | None) -> pd.DataFrame:
        """A row for each event: its content once and all its clicks."""
        ids = [int(part[0, 0]) for part in parts]
        texts = [contents.get(event_id) or (None,) * len(CONTENT) for event_id in ids]
        rows = {"event_id": ids, **{name: [text[i] for text in texts] for i, name in enumerate(CONTENT)}}
        rows |= {name: [part[:, i] for part in parts] for i, name in enumerate(CLICK[1:5], 1)}
        return pd.DataFrame({**rows, "reason": reason})

    def _by_event(self, clicks: np.ndarray) -> list[np.ndarray]:
        clicks = clicks[np.argsort(clicks[:, 0], kind="stable")]
        return np.split(clicks, np.flatnonzero(np.diff(clicks[:, 0])) + 1)

    def _wait(self, clicks: np.ndarray) -> None:
        if not len(clicks):
            return
        until = int(clicks[:, 5].min())
        before = self.waiting.getValue((until,))
        if before is None:
            self.handle.registerTimer(until)
        self.waiting.updateValue((until,), ((bytes(before[0]) if before else b"") + clicks.tobytes(),))

    def _met(self, event_ids: list[int]) -> list[np.ndarray]:
        """The waiting clicks on these events, taken out of the state."""
        out = []
        for (until,), (data,) in list(self.waiting.iterator()):
            clicks = np.frombuffer(data, np.int64).reshape(-1, len(CLICK))
            met = np.isin(clicks[:, 0], event_ids)
            if met.any():
                out.append(clicks[met])
                self.waiting.removeKey((until,))
                self.handle.deleteTimer(until)
                self._wait(clicks[~met])
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived, newest, contents = [], {}, {}
        for part in rows:
            is_event = part["is_event"].to_numpy(bool)
            if not is_event.all():
                arrived.append(part.loc[~is_event, CLICK].to_numpy(np.int64))
            for event_id, at, *texts in part.loc[is_event, ["event_id", "arrived_at", *CONTENT]].itertuples(index=False, name=None):
                if event_id not in newest or at >= newest[event_id]:
                    newest[event_id], contents[event_id] = at, tuple(None if pd.isna(text) else text for text in texts)
        for event_id, texts in contents.items():
            self.content.updateValue((event_id,), texts)
        if contents and self.waiting.exists():
            arrived += self._met(list(contents))
        unknown = []
        for clicks in arrived:
            known = []
            for part in self._by_event(clicks):
                event_id = int(part[0, 0])
                if event_id not in contents:
                    contents[event_id] = self.content.getValue((event_id,))
                (unknown if contents[event_id] is None else known).append(part)
            if known:
                yield self._rows(known, contents, None)
        if unknown:
            self._wait(np.concatenate(unknown))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        clicks = np.frombuffer(self.waiting.getValue((at,))[0], np.int64).reshape(-1, len(CLICK))
        self.waiting.removeKey((at,))
        up = clicks[:, 5] <= max(at, timerValues.getCurrentWatermarkInMs())
        self._wait(clicks[~up])
        yield self._rows(self._by_event(clicks[up]), {}, "Event not found")

    def close(self) -> None:
        pass


def stream_feedback(
    clicks: DataFrame, events: DataFrame, *, arrived: str = "arrived_at", wait: timedelta = WAIT, slack: str = "1 minute"
) -> DataFrame:
    """Feedback rows and rejects, as clicks and catalog rows arrive (append mode).

    Both streams have a TIMESTAMP column ``arrived`` that says when a row came in, such as the
    file's modification time; it may run back by ``slack`` at most. A click whose event is not
    known yet waits for it; after ``wait`` it leaves as a reject. Malformed clicks are rejected
    at once. A click keeps the content its event had when both were known. A busy event's clicks
    leave Python some thousand to a copy of its content, and are 48 bytes each until then.
    """
    wait_ms = int(wait.total_seconds() * 1000)

    def bit(value: Column, number: int) -> Column:
        return F.when(value, F.lit(number)).otherwise(F.lit(0)).cast("bigint")

    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    numbers = [
        *[F.coalesce(F.col(name).cast("bigint"), F.lit(0)).alias(name) for name in ("click_id", "user_id")], F.coalesce(at, F.lit(0)).alias("created"),
        (bit(F.col("interested"), INTERESTED) + bit(F.col("click_id").isNull(), NO_CLICK_ID) + bit(F.col("user_id").isNull(), NO_USER)
         + bit(F.col("created_at").isNull(), NO_TIME)).alias("bits"),
        F.coalesce(F.unix_millis(F.col("_arrived").cast("timestamp")) + wait_ms, F.lit(0)).alias("until"),
    ]
    none = [F.lit(None).cast("string").alias(name) for name in CONTENT]
    packed = accepted(clicks.withColumn("_arrived", F.col(arrived)), "_arrived").select(
        _group("event_id"), "event_id", F.lit(False).alias("is_event"), F.col("_arrived").cast("timestamp").alias("arrived_at"), *numbers, *none
    )
    content = [F.col(name.removeprefix("event_")).alias(name) for name in CONTENT]
    known = events.where(F.col("id").isNotNull()).select(F.col("id").cast("bigint").alias("event_id"), F.lit(True).alias("is_event"), F.col(arrived).cast("timestamp").alias("arrived_at"), *content)
    known = known.select(_group("event_id"), "*", *[F.lit(0).cast("bigint").alias(name) for name in CLICK[1:]])
    resolved = (
        packed.unionByName(known)
        .withWatermark("arrived_at", slack)
        .groupBy("group")
        .transformWithStateInPandas(_Resolve(), f"event_id BIGINT, {_TEXTS}, {_CLICKS}, reason STRING", "Append", "EventTime")
    )
    click = F.explode(F.arrays_zip(*CLICK[1:5])).alias("click")

    def unless(number: int, value: Column) -> Column:
        return F.when(F.col("click.bits").bitwiseAND(F.lit(number)) == 0, value)

    opened = resolved.select("event_id", *CONTENT, "reason", click).select(
        unless(NO_CLICK_ID, F.col("click.click_id")).alias("click_id"), unless(NO_USER, F.col("click.user_id")).alias("user_id"), "event_id", *CONTENT,
        (F.col("click.bits").bitwiseAND(F.lit(INTERESTED)) != 0).alias("interested"),
        unless(NO_TIME, F.timestamp_micros("click.created").cast("timestamp_ntz")).alias("created_at"),
        F.when(F.col("reason").isNull(), "kept").otherwise("rejected").alias("status"), "reason",
    )
    malformed = rejected(clicks).select(
        "click_id", "user_id", F.lit(None).cast("bigint").alias("event_id"), *none, F.lit(None).cast("boolean").alias("interested"),
        "created_at", F.lit("rejected").alias("status"), "reason",
    )
    return opened.unionByName(malformed)


class _Due(StatefulProcessor):
    """Counts the clicks of each user in a group and reports each time a summary is due."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "user_id BIGINT", "total BIGINT, reported BIGINT")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for user_id, counted in zip(initialState["user_id"].tolist(), initialState["counted"].tolist(), strict=True):
            self.counts.updateValue((user_id,), (0, counted))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        clicks: Counter[int] = Counter()
        for part in rows:
            for user_id, n in zip(part["user_id"].tolist(), part["clicks"].tolist(), strict=True):
                clicks[user_id] += n
        due = []
        for user_id, new in clicks.items():
            total, reported = self.counts.getValue((user_id,)) or (0, 0)
            total += new
            crossings = range(reported + self.threshold, total + 1, self.threshold)
            if len(crossings):
                reported = crossings[-1]
                due += [(user_id, crossing, self.threshold) for crossing in crossings]
            self.counts.updateValue((user_id,), (total, reported))
        if due:
            yield pd.DataFrame(due, columns=["user_id", "total", "new_feedback"])

    def close(self) -> None:
        pass


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        users = batch.column("user_id").value_counts()
        yield pa.RecordBatch.from_arrays([users.field("values"), users.field("counts")], ["user_id", "clicks"])


def stream_due(feedback: DataFrame, profile: DataFrame, *, threshold: int = SUMMARY_THRESHOLD) -> DataFrame:
    """A row each time a user has ``threshold`` more clicks than at the last report (append mode).

    ``feedback`` streams the rows that ``stream_feedback`` kept; ``profile`` says how many clicks
    the last summary of each user covered when the stream first starts (none without a profile).
    ``total`` is the number of clicks the summary has to cover. Reports do not depend on how
    clicks fall into batches. Clicks are counted within a task first, so a busy user is a few
    rows of state input.
    """
    clicks = feedback.where(F.col("user_id").isNotNull()).select("user_id").mapInArrow(_counted, "user_id BIGINT, clicks BIGINT")
    counted = F.coalesce("feedback_count_at_last_summary", F.lit(0)).cast("bigint").alias("counted")
    before = profile.where(F.col("user_id").isNotNull()).select(_group("user_id"), F.col("user_id").cast("bigint").alias("user_id"), counted).groupBy("group")
    return clicks.select(_group("user_id"), "*").groupBy("group").transformWithStateInPandas(
        _Due(threshold), "user_id BIGINT, total BIGINT, new_feedback BIGINT", "Append", "None", initialState=before
    )


def write_stream(rows: DataFrame, path: str, checkpoint: str, *, by: str | None = None, **trigger) -> StreamingQuery:
    """Append to a table of files whose log names the committed ones, so that a replayed batch adds nothing twice."""
    out = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    out = out.partitionBy(by) if by else out
    return out.trigger(**(trigger or {"availableNow": True})).start()
