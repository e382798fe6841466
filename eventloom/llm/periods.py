"""Runs of periodic words, by recursive frequency splitting and a scan of lags.

A run is a maximal stretch of consecutive words with smallest period ``q`` that is
at least ``max(least_length, repeats * q)`` long. Each of its words occurs
``repeats`` times or more inside it.

1. **Splitting.** A word met fewer than ``repeats`` times within the current segment
   joins no run of it and cuts the segment there. The parts are counted again, and
   so on until no part has such a word. Rounds handle all open segments of all
   texts of a slice at once, and only segments that changed are counted again. A
   text can be built so that every round frees a few words only; after ``ROUNDS``
   rounds what is left is scanned as it stands, which costs time and changes
   nothing: splitting saves work, the scan decides.
2. **Lag scan.** For lags in (g/2, g], g = 1, 2, 4, ..., stretches of g words get
   exact ranks by doubling, and each place looks for the next place with an equal
   rank. Inside a run with smallest period q <= g the next one is q words on, since
   the word sequence of a smallest period meets itself nowhere else. So a run is a
   stretch of places whose next equal one has the same distance, and no other lag
   has to be tried. Places whose stretch occurs once leave the scan.

The work is O(n log^2 n) for n words, whatever they repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.words import bytes_of, slices, word_hashes, words_of

LEAST_LENGTH, REPEATS = 6, 4
ROUNDS = 64


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys (equal ones by place) and a dense rank for each place."""
    order = np.argsort(keys, kind="stable")
    step = np.ones(len(keys), bool)
    step[1:] = keys[order[1:]] != keys[order[:-1]]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(step) - 1
    return order, rank


def split(ids: np.ndarray, segment: np.ndarray, repeats: int, least_length: int) -> np.ndarray:
    """The segment of each word in the end, -1 for words that no run can hold.

    ``segment`` says where the words begin: consecutive ones with the same number.
    """
    out = np.full(len(ids), -1, np.int64)
    place, names, made = np.arange(len(ids)), segment.astype(np.int64), int(segment.max(initial=-1)) + 1
    for _ in range(ROUNDS):
        if not len(place):
            return out
        _, names = _ranks(names)
        _, word = _ranks(names * (ids.max() + 1) + ids[place])
        rare = np.bincount(word)[word] < repeats
        touched = np.bincount(names, rare)[names] > 0
        done = place[~touched]
        out[done] = made + names[~touched]
        made += int(names.max()) + 1
        # The words between two cuts, or between a cut and an end, are the next segments.
        open_ = touched & ~rare
        cut = np.cumsum(rare)[open_]
        place, names = place[open_], names[open_]
        new = np.ones(len(place), bool)
        new[1:] = (names[1:] != names[:-1]) | (cut[1:] != cut[:-1])
        names = np.cumsum(new) - 1
        long_enough = np.bincount(names)[names] >= least_length if len(names) else np.zeros(0, bool)
        place, names = place[long_enough], names[long_enough]
    out[place] = made + names
    return out


def scan(ids: np.ndarray, segment: np.ndarray, repeats: int, least_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run; words with segment -1 are in none."""
    place = np.flatnonzero(segment >= 0)
    found = [np.zeros((3, 0), np.int64)]
    if len(place):
        _, own = _ranks(segment[place])
        stop = np.zeros(int(own.max()) + 1, np.int64)
        np.maximum.at(stop, own, place + 1)
        longest = int(np.bincount(own).max())
        order, rank = _ranks(own * (ids.max() + 1) + ids[place])
        of = np.full(len(ids) + 1, -1, np.int64)
        g = 1
        while len(place) and repeats * (g // 2 + 1) <= longest:
            same = rank[order[1:]] == rank[order[:-1]]
            left, right = order[:-1][same], order[1:][same]
            gap = np.zeros(len(place), np.int64)
            gap[left] = place[right] - place[left]
            fits = (gap > g // 2) & (gap <= g)
            at, lag = place[fits], gap[fits]
            if len(at):
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1])
                lo = np.flatnonzero(new)
                hi = np.append(lo[1:], len(at)) - 1
                start, period = at[lo], lag[lo]
                length = at[hi] - start + g + period
                keep = length >= np.maximum(least_length, repeats * period)
                found.append(np.stack([start[keep], length[keep], period[keep]]))
            # Stretches of twice the length: both halves have to occur again and to lie in the segment.
            again = np.zeros(len(place), bool)
            again[left] = again[right] = True
            of[place[again]] = rank[again]
            second = np.minimum(place + g, len(ids))
            live = again & (place + 2 * g <= stop[own]) & (of[second] >= 0)
            keys = rank[live] * (int(rank.max()) + 1) + of[second[live]]
            of[place[again]] = -1
            place, own = place[live], own[live]
            order, rank = _ranks(keys)
            g *= 2
    start, length, period = np.concatenate(found, axis=1)
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def _best(length: np.ndarray, period: np.ndarray) -> int:
    """The first run, by start and period, with the greatest exact length over period."""
    ratio = length / period
    near = np.flatnonzero(ratio >= ratio.max() * (1 - 1e-9))
    return int(max(near.tolist(), key=lambda i: (Fraction(int(length[i]), int(period[i])), -i)))


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _runs(repeats: int, least_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = words_of(part.column("text"))
            _, ids = np.unique(word_hashes(words), return_inverse=True)
            start, length, period = scan(ids, split(ids, words.owner, repeats, least_length), repeats, least_length)
            first = np.searchsorted(start, words.first)
            depth = np.zeros(len(ids) + 1, np.int64)
            np.add.at(depth, start + period, 1)
            np.add.at(depth, start + length, -1)
            kept = np.cumsum(depth[:-1]) == 0
            texts, offsets = bytes_of(part.column("text"))
            rows = []
            for i in range(part.num_rows):
                lo, hi = first[i], first[i + 1]
                own = [start[lo:hi] - words.first[i], length[lo:hi], period[lo:hi]]
                content = texts[offsets[i] : offsets[i + 1]].tobytes().split()
                if hi > lo:
                    content = [content[k] for k in np.flatnonzero(kept[words.first[i] : words.first[i + 1]]).tolist()]
                listed = list(zip(*(x.tolist() for x in own), strict=True))
                top = listed[_best(*own[1:])] if listed else (None, None, None)
                collapsed = b" ".join(content)
                rows.append(
                    (
                        len(listed),
                        *top,
                        1000 * top[1] // top[2] if listed else None,
                        hashlib.sha256("".join("%d,%d,%d\n" % r for r in listed).encode()).hexdigest(),
                        hashlib.sha256(collapsed).hexdigest(),
                        collapsed.decode(),
                        [dict(zip(("start", "length", "period"), r, strict=True)) for r in listed],
                    )
                )
            kinds = [pa.int64()] * 5 + [pa.string()] * 3 + [pa.list_(RUN)]
            made = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed_text", "runs"]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], ["doc_id", *names])

    return run


def periodic_runs(docs: DataFrame, repeats: int = REPEATS, least_length: int = LEAST_LENGTH) -> DataFrame:
    """The runs of every row of ``docs(doc_id, text)``, one result row for each.

    Words are runs of characters other than the six ASCII blanks, compared by 64-bit
    hashes of their bytes, and numbered from 0. ``start``, ``length`` and ``period`` are
    those of the run with the greatest length over period (ties: smallest start, then
    period), all null if there is none, like ``exponent_milli``, the floor of 1000 times
    that ratio. ``runs`` lists every run by start and period, ``runs_sha256`` is the hash
    of its lines ``start,length,period``. ``collapsed_text`` holds the words joined by one
    space, without those that some run contains after its first ``period`` words.

    Null, empty and blank texts have no words and no runs. Rows are judged on their own,
    so repeated rows and repeated or null ids give the same result for each row. Further
    columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    if repeats < 4 or least_length < 1:
        raise ValueError("at least four repeats are needed to tell a period by its first recurrence")
    schema = (
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
        "collapsed_sha256 string, collapsed_text string, runs array<struct<start: long, length: long, period: long>>"
    )
    return docs.select("doc_id", "text").mapInArrow(_runs(repeats, least_length), schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, with a period planted where crc32 of the decimal id is divisible by ten.

    With h the checksum, g = h / 10 and n words, word a + (i - a) % p takes the place of word i from
    a = g % n on, for p = 1 + (n - a) / (3 + g % 8); all divisions are whole. Words are then joined
    by one space. Texts without words and rows with a null id stay as they are.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n = F.size(words).cast("long")
    a = g % F.greatest(n, F.lit(1))
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    times = F.ceil((n - a) / p).cast("int")
    tail = F.flatten(F.array_repeat(period, times))
    head = F.when(a > 0, F.slice(words, F.lit(1), F.greatest(a, F.lit(1)).cast("int"))).otherwise(F.slice(words, 1, 0))
    changed = F.array_join(F.slice(F.concat(head, tail), F.lit(1), n.cast("int")), " ")
    return F.when((h % 10 == 0) & (n > 0), changed).otherwise(text)
