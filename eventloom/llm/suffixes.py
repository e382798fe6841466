"""Repeated byte strings of ``length`` bytes or more, by prefix doubling over sampled positions.

Sorting all suffixes to a depth of ``length`` bytes takes a row for each byte in every
round. Here the rounds are those of prefix doubling: names of short strings first,
names of longer ones from pairs of shorter ones, only for positions that are not yet
told apart, until the threshold is passed. A row, however, stands for a *stretch* of
positions that have to be told apart together:

1. Every window of ``length`` bytes has an anchor, the ``seed`` bytes inside it with the
   smallest hash. Equal windows have equal anchors at equal offsets. Windows that
   follow each other and share their anchor are one stretch, some 30 bytes wide.
2. A round names each stretch by its *core*, the bytes that all its windows have in
   common, and by its *reach*, the bytes of all its windows together. A core met once
   leaves. Among stretches with equal reach all windows are equal; the earliest one
   stands for them, and the others are wholly repeats. Where the stretches
   that are left differ although their cores are equal, the earliest ones are cut into
   blocks by the distance from the anchor and go into the next round.
3. Smaller blocks have longer cores: with the blocks of ``BLOCKS``, names cover 40, 69,
   93 and in the end all 100 bytes, each a pair of the names of its first and last
   64, 32 or 16 bytes. In the last round a block is one window and core and reach are the same.

Spark groups the pairs in each round: places meet names and counts, never each other,
so a passage in a third of all documents costs as much as other text. Order among
names is not needed to find repeats, so ranks are names and not numbers in a sorted order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.texts import PLACES, distinct_texts, lists_of, with_lists
from eventloom.llm.words import BYTE_VALUES, GOLDEN, Runs, bytes_of, mix, signed, slices
from eventloom.session import broadcast_if_small, durable

#: Long enough that prose rarely repeats it by chance.
SEED = 40
#: Windows of a block in each round after the first; the last has to be 1.
BLOCKS = (32, 8, 1)
#: Windows that are handled at once, unless one slice of short texts has more.
AT_ONCE = 1 << 20
#: Stretches whose bytes are handled at once.
STRETCHES = 1 << 12
#: Bytes of text in a slice: a byte takes some 100 bytes of working memory.
SLICE = 1 << 19
#: A place is a position with the distances from its first and to its last window, in a byte each.
FIRST, LAST = 8, 16


class Names:
    """Names of strings in ``data``: the pair of names of the first and last bytes, a power of two each."""

    def __init__(self, data: np.ndarray):
        self.runs = Runs(BYTE_VALUES[data])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        half = np.int64(1) << (np.frexp(np.maximum(stop - start, 1) - 0.5)[1].astype(np.int64) - 1).clip(0)
        first, last = self.runs(start, start + half), self.runs(stop - half, stop)
        return mix(first + mix(last ^ GOLDEN) + (stop - start).astype(np.uint64) * GOLDEN)


def _smallest(values: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each ``span`` consecutive values."""
    best, reach = values, 1
    while reach < span:
        step = min(reach, span - reach)
        best, reach = np.minimum(best[:-step], best[step:]), reach + step
    return best


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, where each text's bytes end in them, and what to add for a place in the whole text."""
    if len(offsets) > 2 or len(data) <= AT_ONCE:
        yield data, offsets, np.zeros(len(offsets) - 1, np.int64)
        return
    for at in range(0, max(len(data) - length + 1, 1), AT_ONCE):
        piece = data[at : at + AT_ONCE + length - 1]
        yield piece, np.array([0, len(piece)]), np.array([at])


def _stretches(length: int, seed: int, whole: bool):
    """Stretches of windows with the same anchor; only their cores unless ``whole``."""
    window = length - seed + 1
    low = np.uint64((1 << 24) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", limit=SLICE):
            for data, offsets, base in _pieces(*bytes_of(part.column("text")), length):
                counts = np.maximum(np.diff(offsets) - length + 1, 0)
                if not counts.any():
                    continue
                runs = Runs(BYTE_VALUES[data])
                begin = np.arange(len(data) - seed + 1)
                seeds = runs(begin, begin + seed)
                best = (_smallest((seeds & ~low) | begin.astype(np.uint64), window) & low).astype(np.int64)
                text = np.repeat(np.arange(len(counts)), counts)
                start = np.arange(len(text)) + np.repeat(offsets[:-1] - np.cumsum(counts) + counts, counts)
                anchor = best[start]
                new = np.ones(len(text), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                lo = np.flatnonzero(new)
                hi = np.append(lo[1:], len(text)) - 1
                text, anchor, lo, hi = text[lo], anchor[lo], start[lo], start[hi]
                core = signed(seeds[anchor])
                if not whole:
                    yield pa.RecordBatch.from_arrays([core], ["core"])
                    continue
                place = (anchor - offsets[:-1][text] + base[text]) << 2 * FIRST | (hi - lo) << FIRST | anchor - hi
                keys = [part.column(c).take(pa.array(text)) for c in ("doc_id", "text_no")]
                yield pa.RecordBatch.from_arrays([core, signed(runs(lo, hi + length)), *keys, pa.array(place)], ["core", "reach", "doc_id", "text_no", "place"])

    return run


def _windows_of(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window of packed places."""
    anchor, wide, right = place >> 2 * FIRST, place >> FIRST & 255, place & 255
    return anchor, anchor - right - wide, anchor - right


def _finer(length: int, block: int):
    """The stretches of each row, cut into blocks by their distance from the anchor, with longer cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts, offsets = bytes_of(part.column("text"))
            lists = part.column("places")
            all_rows = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
            all_places = lists.flatten().to_numpy()
            for at in range(0, len(all_places), STRETCHES):
                row = all_rows[at : at + STRETCHES]
                anchor, lo, hi = _windows_of(all_places[at : at + STRETCHES])
                # The bytes of the stretches, one after the other.
                size = hi - lo + length
                begin = np.cumsum(size) - size
                names = Names(texts[np.arange(begin[-1] + size[-1]) + np.repeat(offsets[row] + lo - begin, size)])
                # Blocks count the windows' distances before the anchor.
                near, far = (anchor - hi) // block, (anchor - lo) // block
                made = far - near + 1
                of = np.repeat(np.arange(len(row)), made)
                number = np.arange(len(of)) - np.repeat(np.cumsum(made) - made - near, made)
                last = anchor[of] - np.maximum(number * block, (anchor - hi)[of])
                first = anchor[of] - np.minimum(number * block + block - 1, (anchor - lo)[of])
                shift = begin[of] - lo[of]
                core = names(anchor[of] - number * block + shift, anchor[of] - (number + 1) * block + 1 + length + shift)
                reach = names(first + shift, last + length + shift)
                place = anchor[of] << 2 * FIRST | (last - first) << FIRST | anchor[of] - last
                keys = [part.column(c).take(pa.array(row[of])) for c in ("doc_id", "text_no")]
                yield pa.RecordBatch.from_arrays([signed(core), signed(reach), *keys, pa.array(place)], ["core", "reach", "doc_id", "text_no", "place"])

    return run


SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])


def _removed(length: int):
    """The bytes that the stretches of each row cover, as maximal runs in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("places")
            ends = np.cumsum(lists.value_lengths().to_numpy())
            _, lo, hi = _windows_of(lists.flatten().to_numpy())
            out = []
            for at, end in zip(np.append(0, ends[:-1]), ends, strict=True):
                order = np.argsort(lo[at:end])
                start, stop = lo[at:end][order], np.maximum.accumulate(hi[at:end][order] + length)
                new = np.ones(len(start), bool)
                new[1:] = start[1:] > stop[:-1]
                last = np.append(new[1:], True)
                out.append([{"start": a, "stop": b} for a, b in zip(start[new].tolist(), stop[last].tolist(), strict=True)])
            yield batch.drop_columns(["places"]).append_column("removed", pa.array(out, pa.list_(SPAN)))

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        texts, offsets = bytes_of(part.column("text"))
        out = []
        for i, spans in enumerate(part.column("removed").to_pylist()):
            own, at, kept = texts[offsets[i] : offsets[i + 1]], 0, []
            for span in spans or ():
                kept.append(own[at : span["start"]].tobytes())
                at = span["stop"]
            rest = b"".join([*kept, own[at:].tobytes()])
            out.append((len(own), len(own) - len(rest), len(spans or ()), hashlib.sha256(rest).hexdigest(), rest, spans or []))
        kinds = [pa.int64()] * 3 + [pa.string(), pa.large_binary(), pa.list_(SPAN)]
        made = [pa.array(column, kind) for column, kind in zip(zip(*out, strict=True), kinds, strict=True)]
        names = ["doc_id", "copies", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("copies"), *made], names)


STRETCH = "core long, reach long, doc_id long, text_no int, place long"


def _order() -> Column:
    """Where a stretch lies: documents by doc_id (null last), then by the number of the text."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_no", "place")


def _settled(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stretches that repeat an earlier one, and the earliest ones of each reach that need shorter blocks."""
    # Stored, so that joins have their own exchanges and can split a name that very many stretches have.
    kinds = durable(live.groupBy("core", "reach").agg(F.count("*").alias("n"), F.min(_order()).alias("first")))
    several = durable(kinds.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
    later = live.join(kinds.where("n > 1").select("core", "reach", "first"), ["core", "reach"]).where(_order() > F.col("first"))
    open_ = kinds.join(several, "core").select("first.doc_id", "first.text_no", "first.place")
    return later.select("doc_id", "text_no", "place"), open_


def repeats(docs: DataFrame, length: int = 100, seed: int = SEED) -> DataFrame:
    """``(doc_id, text_no, place)``: stretches of windows of ``length`` bytes that also start earlier.

    ``docs`` has ``doc_id``, ``text`` and ``text_no`` and no row twice.
    """
    if not 1 < seed <= length or length - seed > 255:
        raise ValueError("the seed must be two bytes or more and at most 255 bytes shorter than the window")
    cores = docs.select("text").mapInArrow(_stretches(length, seed, False), "core long")
    shared = durable(cores.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
    found_at = docs.select("doc_id", "text_no", "text").mapInArrow(_stretches(length, seed, True), STRETCH)
    live = durable(found_at.join(broadcast_if_small(shared, PLACES), "core"))
    later, open_ = _settled(live)
    found = [later]
    for block in BLOCKS:
        open_ = durable(open_)
        rows = with_lists(docs, lists_of(open_, "place", "places"), "inner").mapInArrow(_finer(length, block), STRETCH)
        later, open_ = _settled(durable(rows))
        found.append(later)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def without_repeats(docs: DataFrame, length: int = 100, seed: int = SEED) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` without the bytes that a repeated string of ``length`` bytes covers.

    Texts are UTF-8 bytes, and strings do not cross texts. A string is repeated if it also
    starts earlier: in a row with a smaller doc_id, or before it in the same text. Strings are
    judged on the input, overlaps count. Gives doc_id, n_bytes, n_removed, n_spans (removed runs),
    kept_sha256, kept (the remaining bytes, which may cut a character) and spans
    (removed runs, end exclusive).

    A null text is empty. Texts shorter than ``length`` lose nothing. Rows with a null doc_id come
    last. Rows with equal ids and different texts are ordered by a hash of the text; of equal
    rows one comes first and the others lose all they can. Further columns of ``docs`` are ignored.
    An empty table gives an empty result.
    """
    texts = distinct_texts(docs)
    found = repeats(texts, length, seed)
    schema = (
        "doc_id long, copies long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: long, stop: long>>"
    )
    removed = lists_of(found, "place", "places").mapInArrow(_removed(length), "doc_id long, text_no int, removed array<struct<start: long, stop: long>>")
    out = with_lists(texts, removed, "left").mapInArrow(_cut, schema)
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    out = out.select("*", copy)
    whole = (F.col("copy") > 1) & (F.col("n_bytes") >= length)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        F.when(whole, all_of_it).otherwise(F.col("spans")).alias("spans"),
    )
