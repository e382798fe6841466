"""Token totals as rollups that batches of signed changes maintain.

A change adds or takes back the counts of one document under one tokenizer
version: +1 on insert, -1 on delete, both on a revised count. A batch is summed by
source, language and tokenizer version and committed under its id. Committing the
same id again replaces the same folder, so replays add nothing. Totals are the sum
over committed batches.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.words import slices

VOCABULARIES = "/opt/tokenizers"
#: Tokenizer versions and their vocabulary files.
VERSIONS = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}
#: Fixed value: how the byte-level vocabularies split a text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of so many blanks are cut out before the splitting, whose look-ahead fails on very long ones.
LONG_BLANKS = 10_000
BLANKS = re.compile("[ \\t\\n\\r\\f\\v\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % LONG_BLANKS)
KEYS = ("source", "lang", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, documents long, tokens long"


def _encoders(path: str, split: str):
    """The tokenizer, and one that takes a whole text as a single piece."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return [tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) for pattern in (split, r"[\s\S]+")]


def _length(text: str, whole, piece) -> int:
    """The number of tokens. A long run of blanks is one piece by itself but for a last blank that goes to what follows it."""
    total = at = 0
    for run in BLANKS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += len(whole(text[at : run.start()])) + len(piece(text[run.start() : end]))
        at = end
    return total + len(whole(text[at:]))


def _counter(path: str, split: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, piece = (encoder.encode_ordinary for encoder in _encoders(path, split))  # read once a task
        for part in slices(batches, "text"):
            counts = [_length(t, whole, piece) if t else 0 for t in part.column("text").to_pylist()]
            at = part.schema.get_field_index("text")
            yield part.set_column(at, "tokens", pa.array(counts, pa.int64()))

    return run


def counted(docs: DataFrame, tokenizer: str, folder: str = VOCABULARIES, split: str = SPLIT, more: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, source, lang, tokenizer, tokens)`` for every row of ``docs``; a null or empty text has none.

    Whole texts are encoded, also very long ones and long runs of blanks. Every executor needs the vocabulary below ``folder``.
    The columns ``more`` of ``docs`` come along.
    """
    types = dict(docs.dtypes)
    rows = docs.select("doc_id", "source", "lang", "text", *more).mapInArrow(
        _counter(f"{folder}/{VERSIONS[tokenizer]}", split),
        ", ".join(["doc_id long, source string, lang string, tokens long", *[f"{name} {types[name]}" for name in more]]),
    )
    return rows.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), "tokens", *more)


def changes(inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Signed changes from counts that came and counts that went; a revised count is in both."""
    parts = [df.withColumn("sign", F.lit(sign)) for df, sign in ((inserted, 1), (deleted, -1)) if df is not None]
    if not parts:
        raise ValueError("no changes given")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def summed(rows: DataFrame, documents: Column, tokens: Column) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return rows.groupBy(*KEYS).agg(F.coalesce(F.sum(documents), zero).alias("documents"), F.coalesce(F.sum(tokens), zero).alias("tokens"))


class Rollup:
    """Committed batches below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def commit(self, batch: str, rows: DataFrame) -> None:
        """Sum the signed changes ``(source, lang, tokenizer, sign, tokens)`` into the batch's own folder.

        A second commit of the id replaces the first. Null sources and languages
        are keys of their own; null counts add no tokens; repeated rows all count.
        """
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"batch ids have letters, digits, - and _ only: {batch!r}")
        delta = summed(rows, F.col("sign"), F.col("sign") * F.col("tokens"))
        delta.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, documents, tokens)`` over all batches; keys that are back at nothing go."""
        batches = self.spark.read.schema(TOTALS).parquet(self.path)
        return summed(batches, F.col("documents"), F.col("tokens")).where("documents <> 0 OR tokens <> 0")
