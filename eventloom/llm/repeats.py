"""Repeated passages across and within documents, by seed and extend.

A passage repeats if a window of ``length`` consecutive words starts at two
places or more. Every window is represented by an anchor: the ``seed``-word run
with the smallest hash among those inside it. Equal windows have equal anchors at
equal offsets, so only windows whose anchors occur twice can repeat.

1. One pass over the texts emits an anchor for each stretch of windows that share
   it, with a hash of the whole stretch (the seed extended both ways as far as
   the anchor reaches).
2. Anchors are counted, combined before the shuffle. If all occurrences of a
   repeated anchor extend to the same stretch, all windows of it repeat.
3. Elsewhere the extension differs from copy to copy. There the single windows
   around the anchor are counted in the same way, and windows met twice repeat.
4. A document's repeating windows are joined into maximal repeats.

Occurrences meet counts, never each other, so a passage in a third of all
documents costs no more than other text. Equal rows are one text with a number of
copies; texts that share a doc_id are told apart by a number. Spans go to the texts
where they are measured to be small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.texts import distinct_texts, lists_of, with_lists
from eventloom.llm.words import Runs, bytes_of, signed, slices, word_hashes, words_of
from eventloom.session import durable

SEED = 12


def _smallest(values: np.ndarray, span: int) -> np.ndarray:
    """The leftmost position of the smallest of each ``span`` consecutive values."""
    best, reach = np.arange(len(values)), 1
    while reach < span:
        step = min(reach, span - reach)
        left, right = best[:-step], best[step:]
        best, reach = np.where(values[left] <= values[right], left, right), reach + step
    return best


def _anchors(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = words_of(part.column("text"))
            total = len(words.starts)
            windows = np.maximum(words.counts - length + 1, 0)
            if not windows.any():
                continue
            runs = Runs(word_hashes(words))
            begin = np.arange(total - seed + 1)
            seeds = runs(begin, begin + seed)
            # The windows of all texts in order, each with its text.
            text = np.repeat(np.arange(part.num_rows), windows)
            start = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows - words.first[:-1], windows)
            anchor = _smallest(seeds, length - seed + 1)[start]
            new = np.ones(len(text), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
            lo = np.flatnonzero(new)
            hi = np.append(lo[1:], len(text)) - 1
            # The hash covers the stretch's length too; equal stretches have their anchor at the same place.
            stretch = runs(start[lo], start[hi] + length)
            base = words.first[:-1][text[lo]]
            yield pa.RecordBatch.from_arrays(
                [
                    signed(seeds[anchor[lo]]),
                    signed(stretch),
                    part.column("doc_id").take(pa.array(text[lo])),
                    part.column("text_no").take(pa.array(text[lo])),
                    pa.array((start[lo] - base).astype(np.int32)),
                    pa.array((start[hi] - base).astype(np.int32)),
                ],
                ["anchor", "stretch", "doc_id", "text_no", "first_window", "last_window"],
            )

    return run


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans in a list column, with the row of each."""
    row = np.repeat(np.arange(len(lists)), np.diff(np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy()))))
    spans = lists.flatten()
    return row, spans.field("first_window").to_numpy(), spans.field("last_window").to_numpy()


def _windows(length: int):
    """Every window of the given stretches, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = words_of(part.column("text"))
            runs = Runs(word_hashes(words))
            row, lo, hi = _flat(part.column("spans"))
            count = hi - lo + 1
            row, lo, ends = np.repeat(row, count), np.repeat(lo, count), np.cumsum(count)
            window = lo + np.arange(len(row)) - np.repeat(ends - count, count)
            start = words.first[:-1][row] + window
            yield pa.RecordBatch.from_arrays(
                [
                    signed(runs(start, start + length)),
                    part.column("doc_id").take(pa.array(row)),
                    part.column("text_no").take(pa.array(row)),
                    pa.array(window.astype(np.int32)),
                ],
                ["window", "doc_id", "text_no", "at"],
            )

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = words_of(part.column("text"))
            row, lo, hi = _flat(part.column("spans"))
            depth = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(depth, words.first[:-1][row] + lo, 1)
            np.add.at(depth, words.first[:-1][row] + hi + length, -1)
            gone = np.cumsum(depth[:-1]) > 0
            texts, offsets = bytes_of(part.column("text"))
            kept, repeats = [], []
            for i in range(part.num_rows):
                first, last = words.first[i], words.first[i + 1]
                own = gone[first:last]
                content = texts[offsets[i] : offsets[i + 1]].tobytes().split()
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                repeats.append([{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                kept.append(b" ".join(w for w, g in zip(content, own.tolist(), strict=True) if not g) if len(edges) else b" ".join(content))
            removed = np.diff(np.append(0, np.cumsum(gone))[words.first]) if len(gone) else np.zeros(part.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("copies"),
                    part.column("doc_id"),
                    pa.array(words.counts),
                    pa.array(removed),
                    pa.array([k.decode() for k in kept]),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                    pa.array(repeats, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                ],
                ["copies", "doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", "repeats"],
            )

    return run


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys met twice or more; stored, so that a join has its own exchange and can split a hot key."""
    return durable(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").drop("n"))


def repeated_windows(docs: DataFrame, length: int = 35, seed: int = SEED) -> DataFrame:
    """``(doc_id, text_no, first_window, last_window)``: stretches of windows that start elsewhere too.

    ``docs`` has ``doc_id``, ``text`` and ``text_no`` and no row twice.
    """
    if not 0 < seed <= length:
        raise ValueError("the seed must fit into the window")
    schema = "anchor long, stretch long, doc_id long, text_no int, first_window int, last_window int"
    docs = docs.select("doc_id", "text_no", "text")
    found = docs.mapInArrow(_anchors(length, seed), schema)
    extent = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("stretch").alias("low"), F.max("stretch").alias("high"))
    # Stored, so that the join has its own exchange and can split a hot anchor.
    extent = durable(extent.where("n > 1").select("anchor", (F.col("low") == F.col("high")).alias("same")))
    found = durable(found.join(extent, "anchor").select("doc_id", "text_no", "first_window", "last_window", "same"))

    unsure = _spans(found.where("not same").drop("same"), length)
    schema = "window long, doc_id long, text_no int, at int"
    windows = with_lists(docs, unsure, "inner").mapInArrow(_windows(length), schema)
    sure = windows.join(_repeated(windows, "window"), "window").select("doc_id", "text_no", F.col("at").alias("first_window"), F.col("at").alias("last_window"))
    return found.where("same").drop("same").unionByName(sure)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's stretches of windows, those that meet joined into one."""
    for batch in batches:
        row, lo, hi = _flat(batch.column("spans"))
        order = np.lexsort((lo, row))
        row, lo, hi = row[order], lo[order], hi[order]
        out = [[] for _ in range(batch.num_rows)]
        for r, a, b in zip(row.tolist(), lo.tolist(), hi.tolist(), strict=True):
            if out[r] and a <= out[r][-1]["last_window"] + 1:
                out[r][-1]["last_window"] = max(b, out[r][-1]["last_window"])
            else:
                out[r].append({"first_window": a, "last_window": b})
        kind = pa.list_(pa.struct([("first_window", pa.int32()), ("last_window", pa.int32())]))
        yield batch.drop_columns(["spans"]).append_column("spans", pa.array(out, kind))


def _spans(rows: DataFrame, length: int) -> DataFrame:
    """``(doc_id, text_no, spans)``: each text's stretches of windows, joined where they meet."""
    lists = lists_of(rows.withColumn("span", F.struct("first_window", "last_window")), "span", "spans")
    return lists.mapInArrow(_merged, "doc_id long, text_no int, spans array<struct<first_window: int, last_window: int>>")


def without_repeats(docs: DataFrame, length: int = 35, seed: int = SEED) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` without the words that a repeated window covers.

    Gives doc_id, n_words, n_removed, kept_text (kept words joined by one space),
    kept_sha256 (of its UTF-8 bytes) and repeats (maximal repeats as word spans,
    end exclusive). All occurrences go, the first included; windows are judged on
    the input. Words are compared unchanged.

    A null text has no words. Texts shorter than the window lose nothing. Repeated
    rows count as occurrences of each other, also with the same or a null doc_id.
    Further columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    texts = distinct_texts(docs)
    spans = _spans(repeated_windows(texts, length, seed), length)
    schema = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, repeats array<struct<start: int, stop: int>>"
    out = with_lists(texts, spans, "left").mapInArrow(_cut(length), f"copies long, {schema}")
    # All windows of a text that is there twice repeat.
    out = out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    whole = (F.col("copies") > 1) & (F.col("n_words") >= length)
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("stop")))
    return out.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(whole, all_of_it).otherwise(F.col("repeats")).alias("repeats"),
    )
