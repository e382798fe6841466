"""Batched model calls through a pluggable function.

A completer takes one request (text) and returns the answer with its token
counts; it runs inside tasks and does its own retrying. A failed call becomes a
row with ``error`` set and never fails the job. A second evaluation would call the
model again, so answers go through ``sources.answers.AnswerStore``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import TYPE_CHECKING, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from eventloom.sources.answers import AnswerStore


class Completion(NamedTuple):
    content: str
    prompt_tokens: int | None = None
    completion_tokens: int | None = None


Completer = Callable[[str], Completion]

#: ``asked_at`` is the moment of the call (UTC), measured where it is made.
ANSWER = (
    "content STRING, prompt_tokens BIGINT, completion_tokens BIGINT, duration_seconds DOUBLE, error STRING, asked_at TIMESTAMP_NTZ"
)


def complete(
    requests: DataFrame, keys: list[str], completer: Completer, *, prompt: str = "prompt", partitions: int | None = None
) -> DataFrame:
    """One answer row per request row, identified by ``keys``.

    Requests are spread over all tasks by their keys first, since a page with many
    chunks costs far more than one with few.
    """
    narrow = requests.select(*keys, F.col(prompt).alias("prompt"))
    spread = narrow.repartition(partitions, *keys) if partitions else narrow.repartition(*keys)
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.select(*keys).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for text in batch["prompt"]:
                began, asked_at = time.monotonic(), datetime.now(UTC).replace(tzinfo=None)
                try:
                    answer, error = completer(text), None
                except Exception as failure:  # recorded, the other requests go on
                    answer, error = Completion(None), str(failure)
                answers.append((*answer, time.monotonic() - began, error, asked_at))
            columns = ["content", "prompt_tokens", "completion_tokens", "duration_seconds", "error", "asked_at"]
            out = pd.DataFrame(answers, columns=columns, index=batch.index).astype(
                {"prompt_tokens": "Int64", "completion_tokens": "Int64"}
            )
            yield pd.concat([batch[keys], out], axis=1)

    return spread.mapInPandas(run, f"{key_schema}, {ANSWER}")


#: What a chunk's extraction request is known by.
CHUNK_KEYS = "site_key STRING, page_id BIGINT, chunk_no BIGINT, is_last BOOLEAN"


def infer_chunks(prompts: DataFrame, store: AnswerStore, completer: Completer, *, partitions: int | None = None) -> DataFrame:
    """Extraction answers per chunk: content, tokens, duration, error and time of the call.

    ``store`` has ``CHUNK_KEYS``; requests it can answer are not sent again.
    """
    return store.complete(prompts, completer, partitions=partitions)


def call_log(answers: DataFrame, keys: list[str], *, provider: str, model: str, call_type: str, api_key_label: str) -> DataFrame:
    """Answers as rows for the usage and error logs, each with its own time.

    ``call_key`` names the call the same way in every replay: its request and when it was sent.
    """
    labels = {"provider": provider, "model": model, "call_type": call_type, "api_key_label": api_key_label}
    return answers.select(
        *keys,
        F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in (*keys, "prompt_hash", "asked_at")])).alias("call_key"),
        F.col("asked_at").alias("timestamp"),
        *[F.lit(value).alias(name) for name, value in labels.items()],
        "prompt_tokens",
        "completion_tokens",
        "duration_seconds",
        "error",
        F.col("error").alias("error_text"),
    )
