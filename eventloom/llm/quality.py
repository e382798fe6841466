"""Text quality by a byte-level convolutional network in numpy.

A document is cut into overlapping chunks that cover all of its bytes. Learned
filters slide over a chunk's embedded bytes and each keeps its strongest response
there. The mean, the largest and the smallest response over the chunks go through
a small layer into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.langmix import held_out
from eventloom.llm.words import bytes_of, slices
from eventloom.session import broadcast_if_small, durable

CHUNK, OVERLAP = 256, 32
EMBED, SPAN, STRIDE, FILTERS, HIDDEN = 8, 8, 2, 24, 16
POINTS = (CHUNK - SPAN) // STRIDE + 1
#: Bounds of the training sample: rows, and bytes of a text that may be in it.
TRAIN_ROWS, TRAIN_BYTES = 1500, 200_000
STEPS, BATCH, RATE = 600, 24, 0.01
#: Chunks that are convolved at once.
TOGETHER = 256
THRESHOLD = 0.3


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of all texts, padded with zeros, the bytes in each, and where each text's chunks begin. An empty text has one."""
    hop = CHUNK - OVERLAP
    sizes = np.diff(offsets)
    count = np.maximum(-(-(sizes - OVERLAP) // hop), 1)
    first = np.append(0, np.cumsum(count))
    start = (np.arange(first[-1]) - np.repeat(first[:-1], count)) * hop
    length = np.minimum(np.repeat(sizes, count) - start, CHUNK)
    at = (np.repeat(offsets[:-1], count) + start)[:, None] + np.arange(CHUNK)
    inside = np.arange(CHUNK) < length[:, None]
    padded = np.append(data, np.uint8(0))
    return np.where(inside, padded[np.minimum(at, len(data))], 0).astype(np.uint8), length, first


class Network:
    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights

    @classmethod
    def drawn(cls, seed: int) -> Network:
        draw = np.random.default_rng(seed).normal
        weights = (
            draw(0, 0.5, (256, EMBED)),
            draw(0, (2 / (EMBED * SPAN)) ** 0.5, (SPAN * EMBED, FILTERS)),
            np.zeros(FILTERS),
            draw(0, (1 / (3 * FILTERS)) ** 0.5, (3 * FILTERS, HIDDEN)),
            np.zeros(HIDDEN),
            draw(0, HIDDEN**-0.5, HIDDEN),
            np.zeros(1),
        )
        return cls([w.astype(np.float32) for w in weights])

    def pooled(self, chunks: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's strongest response in each chunk and the point where it is."""
        embed, kernel, bias = self.weights[:3]
        windows = np.lib.stride_tricks.sliding_window_view(embed[chunks].reshape(len(chunks), -1), SPAN * EMBED, axis=1)[:, :: STRIDE * EMBED]
        response = (windows.reshape(-1, SPAN * EMBED) @ kernel).reshape(len(chunks), POINTS, FILTERS)
        # Points that would see padding only do not count, but for the first.
        response[np.arange(POINTS) * STRIDE >= np.maximum(length, 1)[:, None]] = -np.inf
        where = response.argmax(axis=1)
        return np.take_along_axis(response, where[:, None], 1)[:, 0] + bias, where

    def combined(self, responses: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        active = np.maximum(responses, 0)
        begin, count = first[:-1], np.diff(first)[:, None]
        features = np.hstack([np.add.reduceat(active, begin) / count, np.maximum.reduceat(active, begin), np.minimum.reduceat(active, begin)])
        hidden = np.tanh(features @ self.weights[3] + self.weights[4])
        return features, hidden, 1 / (1 + np.exp(-np.clip(hidden @ self.weights[5] + self.weights[6], -30, 30)))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        chunks, length, first = chunked(data, offsets)
        responses = [self.pooled(chunks[i : i + TOGETHER], length[i : i + TOGETHER])[0] for i in range(0, len(chunks), TOGETHER)]
        return self.combined(np.concatenate(responses), first)[2]

    def gradients(self, data: np.ndarray, offsets: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        embed, kernel, _, layer, _, out, _ = self.weights
        chunks, length, first = chunked(data, offsets)
        parts = [self.pooled(chunks[i : i + TOGETHER], length[i : i + TOGETHER]) for i in range(0, len(chunks), TOGETHER)]
        responses, where = (np.concatenate(x) for x in zip(*parts, strict=True))
        features, hidden, p = self.combined(responses, first)
        d_logit = (p - target) / len(target)
        d_hidden = np.outer(d_logit, out) * (1 - hidden**2)
        d_mean, d_most, d_least = np.hsplit(d_hidden @ layer.T, 3)
        count, row = np.diff(first), np.repeat(np.arange(len(target)), np.diff(first))
        most, least = features[:, FILTERS : 2 * FILTERS], features[:, 2 * FILTERS :]
        active = np.maximum(responses, 0)
        d = d_mean[row] / count[row][:, None]
        for grad, edge in ((d_most, most), (d_least, least)):
            tied = active == edge[row]
            d += grad[row] * tied / np.add.reduceat(tied.astype(np.float32), first[:-1])[row]
        d = (d * (responses > 0)).astype(np.float32)
        # Only the strongest points pass a gradient on.
        seen = chunks[np.arange(len(chunks))[:, None, None], where[:, :, None] * STRIDE + np.arange(SPAN)]
        d_kernel = np.einsum("cf,cfk->kf", d, embed[seen].reshape(len(chunks), FILTERS, -1), optimize=True)
        d_embed = np.zeros_like(embed)
        back = np.einsum("cf,kf->cfk", d, kernel).reshape(-1, EMBED)
        for k in range(EMBED):
            d_embed[:, k] = np.bincount(seen.ravel(), back[:, k], 256)
        return [d_embed, d_kernel, d.sum(axis=0), features.T @ d_hidden, d_hidden.sum(axis=0), hidden.T @ d_logit, np.array([d_logit.sum()])]


def fit(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 5) -> Network:
    """Adam on the cross entropy: a fixed number of batches of whole texts, in a new seeded order each time all were seen."""
    net, pick = Network.drawn(seed), np.random.default_rng(seed)
    first, second = ([np.zeros_like(w) for w in net.weights] for _ in range(2))
    queue = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(queue) < min(BATCH, len(texts)):
            queue = np.append(queue, pick.permutation(len(texts)))
        batch, queue = queue[:BATCH], queue[BATCH:]
        offsets = np.append(0, np.cumsum([len(texts[i]) for i in batch]))
        data = np.frombuffer(b"".join(texts[i] for i in batch), np.uint8)
        rate = RATE * (1 - step / (steps + 1)) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
        for i, g in enumerate(net.gradients(data, offsets, labels[batch])):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            net.weights[i] = (net.weights[i] - rate * first[i] / (np.sqrt(second[i]) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text_bytes: int = TRAIN_BYTES) -> Network | float:
    """A network fitted to ``labels(doc_id, quality)``; the share of good labels if only one or no class was seen.

    The driver receives a sample of ``rows`` labelled documents that are not held
    out, the first by a hash of their ids; texts beyond ``text_bytes`` are not sampled.
    A document with several labels counts as good if any is. Null labels, ids and
    texts are not learned from.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    short = docs.where(F.octet_length("text") <= text_bytes).select("doc_id")
    known = known.join(short, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = docs.join(broadcast_if_small(durable(known)), "doc_id").where(F.octet_length("text") <= text_bytes)
    # One text an id before anything leaves Spark, however many rows repeat it.
    sample = chosen.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")
    target = sample["quality"].to_numpy(np.float32)
    if len(np.unique(target)) < 2:
        return float(target.mean()) if len(target) else 0.5
    return fit([t.encode() for t in sample["text"]], target)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value if isinstance(model.value, float) else Network(model.value)
        for part in slices(batches, "text", limit=1 << 18):
            score = np.full(part.num_rows, net) if isinstance(net, float) else net.score(*bytes_of(part.column("text"))).astype(np.float64)
            predicted = pa.array((score >= THRESHOLD).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), predicted], ["doc_id", "held_out", "score", "predicted"])

    return run


def predict(docs: DataFrame, model: Network | float) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs(doc_id, text)``.

    ``score`` is the probability of a good label, ``predicted`` 1 from ``THRESHOLD``
    on. doc_id may have any type. Null and empty texts are one chunk of padding and get a score like any
    other. Rows are scored one by one, so repeated rows and null ids (held out) stay
    as they are; no other column is read; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    # Plain arrays need no package to be read.
    shared = docs.sparkSession.sparkContext.broadcast(model if isinstance(model, float) else model.weights)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scored(shared), f"doc_id {kind}, held_out boolean, score double, predicted int")
