"""Words of whole texts as numpy arrays, for use inside Arrow tasks.

A word is a run of characters other than the six ASCII blanks (space and
\\x09-\\x0D). A null text has no words. Texts are read as UTF-8 bytes, a slice
of rows at a time, and hashed in blocks, so that memory follows the longest
text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are handled at once, unless one text alone is longer.
SLICE_BYTES = 2 << 20
#: Bytes that are hashed at once, unless one word alone is longer.
BLOCK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]
BASE = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    if count:
        out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """``first[i]:first[i + 1]`` are the words of text ``i``; they lie at ``starts:ends`` in ``data``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(texts: pa.Array) -> Words:
    data, offsets = bytes_of(texts)
    inside = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(begins)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    ends = np.flatnonzero(last) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def word_hashes(words: Words, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """One 64-bit hash a word; ``LOWER_VALUES`` folds A-Z."""
    out = np.empty(len(words.starts), np.uint64)
    at = 0
    up, down = powers(BASE, BLOCK_BYTES), powers(INVERSE, BLOCK_BYTES)
    while at < len(out):
        origin = words.starts[at]
        stop = max(at + 1, int(np.searchsorted(words.ends, origin + BLOCK_BYTES, "right")))
        piece = words.data[origin : words.ends[stop - 1]]
        if len(piece) > len(up):
            up, down = powers(BASE, len(piece)), powers(INVERSE, len(piece))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(values[piece] * up[: len(piece)], out=sums[1:])
        s, e = words.starts[at:stop] - origin, words.ends[at:stop] - origin
        out[at:stop] = (sums[e] - sums[s]) * down[s]
        at = stop
    return mix(out)


class Runs:
    """Hashes of runs of words, each in a few operations, from running sums."""

    def __init__(self, hashes: np.ndarray):
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers(BASE, len(hashes)), out=self.sums[1:])
        self.down = powers(INVERSE, len(hashes) + 1)

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64) * GOLDEN)


def shingles(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingle hashes of each text, sorted within it, and where each text's begin.

    A text with fewer words has its whole sequence as its only shingle; a text without words has none.
    """
    run, counts = Runs(hashes), words.counts
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(made, out=first[1:])
    start = np.arange(first[-1]) - np.repeat(first[:-1] - words.first[:-1], made)
    out = run(start, start + np.repeat(np.minimum(counts, width), made))
    new = np.ones(len(out), bool)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo > 1:
            out[lo:hi].sort()
            new[lo + 1 : hi] = out[lo + 1 : hi] != out[lo : hi - 1]
    kept = np.zeros(len(out) + 1, np.int64)
    np.cumsum(new, out=kept[1:])
    return out[new], kept[first]


def slices(batches: Iterator[pa.RecordBatch], *columns: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, in slices of a bounded number of text bytes, never empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.zeros(batch.num_rows + 1, np.int64)
        for name in columns:
            total += bytes_of(batch.column(name))[1]
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop


def signed(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's bigint."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))
