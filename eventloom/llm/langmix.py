"""Languages of a document as a mixture, by expectation-maximisation.

Training counts hashed byte trigrams of all labelled rows by language. A document
is then a mixture of these n-gram distributions: expectation-maximisation fits its
language proportions, and among nested sets of languages the one with the best
likelihood less a penalty for each further language is selected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.words import bytes_of, slices

BUCKETS = 1 << 16
SMOOTHING = 0.5
ROUNDS = 10
#: What a further language costs, in units of the logarithm of the number of trigrams.
PENALTY = 3.0
UNKNOWN = "und"
FOLDS = 5

#: All ASCII but letters reads as a blank; bytes of other characters stay.
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)


def held_out(doc_id: Column) -> Column:
    """Rows of the first of five folds; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _prepared(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.concat(F.lit(" "), F.lower("text"), F.lit(" ")).alias("text"))


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the row of every trigram whose middle byte belongs to a letter."""
    data, offsets = bytes_of(texts)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    folded = _FOLD[data]
    code = ((folded[:-2] << np.uint32(16)) | (folded[1:-1] << np.uint32(8)) | folded[2:]) * np.uint32(0x9E3779B1)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    keep = (folded[1:-1] != 32) & (row[:-2] == row[2:])
    return (code[keep] >> np.uint32(16)).astype(np.int64), row[:-2][keep]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for part in slices(batches, "text"):
        bucket, row = _trigrams(part.column("text"))
        lang = part.column("lang").dictionary_encode()
        code = lang.indices.to_numpy()[row]
        for k, name in enumerate(lang.dictionary.to_pylist()):
            totals.setdefault(name, np.zeros(BUCKETS, np.int64))
            totals[name] += np.bincount(bucket[code == k], minlength=BUCKETS)
    for name, counts in totals.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(counts[used])], ["lang", "bucket", "n"])


class Model:
    """Trigram distributions: ``table[i]`` is that of ``langs[i]``."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + SMOOTHING
        self.table = (smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)


def train(docs: DataFrame) -> Model:
    """Counts over all rows of ``docs(text, lang)`` whose text and lang are not null; none of them may be held out.

    The driver receives at most ``BUCKETS`` sums a language, whatever the size of the corpus.
    """
    rows = _prepared(docs.where("text IS NOT NULL AND lang IS NOT NULL"), "lang")
    sums = rows.mapInArrow(_counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS))
    counts[[langs.index(x) for x in sums["lang"]], sums["bucket"]] = sums["n"]
    return Model(langs, counts)


def _fit(c: np.ndarray, first: np.ndarray, p: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (document, language) among the allowed languages, and the log likelihood of each document.

    ``c`` are trigram counts with the documents' ranges in ``first``, ``p`` their
    probabilities by language.
    """
    sizes = np.diff(first)
    total = np.add.reduceat(c, first[:-1])
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        weight = c / np.einsum("el,el->e", np.repeat(share, sizes, axis=0), p)
        share = share * np.add.reduceat(weight[:, None] * p, first[:-1], axis=0) / total[:, None]
    fit = np.log(np.einsum("el,el->e", np.repeat(share, sizes, axis=0), p))
    return share, np.add.reduceat(c * fit, first[:-1])


def mixtures(bucket: np.ndarray, row: np.ndarray, rows: int, table: np.ndarray) -> np.ndarray:
    """Selected proportions (row, language); rows without trigrams have zeros.

    If even all languages together gain less than one more language costs, the
    best single language is the selected set. Else the sets are grown in the order
    of the proportions in the full mixture.
    """
    out = np.zeros((rows, len(table)))
    key, c = np.unique(row * BUCKETS + bucket, return_counts=True)
    if not len(key) or not len(table):
        return out
    owner = key // BUCKETS
    docs, first = np.unique(owner, return_index=True)
    first = np.append(first, len(key))
    p, c = table[:, key % BUCKETS].T.astype(np.float32), c.astype(np.float32)
    cost = PENALTY * np.log(np.maximum(np.add.reduceat(c, first[:-1]), 2))

    alone = np.add.reduceat(c[:, None] * np.log(p), first[:-1], axis=0)
    best = alone.max(axis=1)
    chosen = np.zeros_like(alone)
    chosen[np.arange(len(docs)), alone.argmax(axis=1)] = 1
    if len(table) > 1:
        full, gain = _fit(c, first, p, np.ones_like(alone))
        mixed = np.flatnonzero(gain - best > cost)
        if len(mixed):
            sizes = np.diff(first)[mixed]
            at = np.repeat(first[mixed] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            c, p, first = c[at], p[at], np.append(0, np.cumsum(sizes))
            order = np.argsort(-full[mixed], axis=1, kind="stable")
            allowed, value = np.zeros_like(full[mixed]), best[mixed]
            for k in range(len(table)):
                allowed[np.arange(len(mixed)), order[:, k]] = 1
                share, fit = _fit(c, first, p, allowed)
                fit = fit - k * cost[mixed]
                better = fit > value
                chosen[mixed[better]], value = share[better], np.where(better, fit, value)
    out[docs] = chosen
    return out


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = model.value
        for part in slices(batches, "text"):
            share = mixtures(*_trigrams(part.column("text")), part.num_rows, table)
            known = part.column("lettered").to_numpy(zero_copy_only=False) & (share.sum(axis=1) > 0 if len(langs) else False)
            best = share.argmax(axis=1) if len(langs) else np.zeros(part.num_rows, int)
            found = [[{"lang": langs[k], "share": float(s[k])} for k in np.argsort(-s, kind="stable") if s[k] > 0] if ok else [] for s, ok in zip(share, known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("held_out"),
                    pa.array([langs[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)], pa.string()),
                    pa.array([min(1.0, float(s[b])) if ok else 0.0 for s, b, ok in zip(share, best, known, strict=True)]),
                    pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "mixture"],
            )

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, mixture)`` for every row of ``docs(doc_id, text)``.

    ``lang_pred`` has the largest share of the selected set and ``score`` is that
    share. A text that is null or has no letter is ``und`` with score 0 and an empty
    mixture, and so is every text if the model knows no language. Ties go to the
    language that sorts first. Repeated rows and null ids are judged row by row;
    further columns, lang and source among them, are never read; an empty table
    gives an empty result.
    """
    lettered = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("lettered")
    rows = _prepared(docs.select("doc_id", "text", lettered, held_out(F.col("doc_id")).alias("held_out")), "doc_id", "held_out", "lettered")
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.table))  # plain values, which need no package to be read
    schema = "doc_id long, held_out boolean, lang_pred string, score double, mixture array<struct<lang: string, share: double>>"
    return rows.mapInArrow(_predicted(shared), schema)
