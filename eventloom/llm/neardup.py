"""Near-duplicate documents from SetSketch registers, confirmed on the full shingle sets.

1. One Arrow pass turns each text into its set size, a 128-bit fingerprint of
   the set and 128 two-byte registers. Documents with equal sets become one node.
2. Bands of four registers put nodes into buckets. With 32 bands a pair at the
   threshold shares a bucket but for some five cases in 10^8.
3. Each bucket is a star: its members are compared with one centre, first the
   smallest node, then the largest. Members that are in one component by then
   need no further comparison.
4. Where a bucket still holds several components, every member outside its
   largest one is compared with all members of the other components whose set
   sizes allow the threshold. Blocks of members with the parities of their sets
   meet in numpy. Parities differ at no more places than the two sets differ in
   elements, so no link is lost there, and hardly a pair leaves that is none.
5. Pairs that may reach the threshold, in step 3 by the joint likelihood of their
   registers, are confirmed on the full sets of the two whole texts.

No step emits all pairs of a group, and no bucket has a cap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.links import LABELS, components
from eventloom.llm.sketches import REGISTERS, WIDTH, differing, parities, plausible, sketch
from eventloom.llm.texts import distinct_texts
from eventloom.llm.words import GOLDEN, LOWER_VALUES, mix, shingles, signed, slices, word_hashes, words_of
from eventloom.session import broadcast_if_small, durable, gathered, parts_for, stored_bytes

BAND = 4
#: A pair at the threshold is lost to the likelihood test only beyond five standard deviations.
MARGIN = 12.5
#: Members of a bucket that meet as one block, on average.
BLOCK = 64
#: Bytes of left texts whose pairs are confirmed together, and pairs from which they are split.
BLOCK_BYTES = 4 << 20
PAIRS_IN_PART = 8_000
#: Comparisons made in one go.
PAIRS_AT_ONCE = 1 << 14
#: The largest key of a bucket in 32 bits.
LAST = np.iinfo(np.int32).max


def _described(width: int, carried: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = words_of(part.column("text"))
            elements, first = shingles(words, word_hashes(words, LOWER_VALUES), width)
            sums = np.zeros((2, len(elements) + 1), np.uint64)
            np.cumsum(mix(elements ^ GOLDEN), out=sums[0, 1:])
            np.cumsum(mix(elements + GOLDEN), out=sums[1, 1:])
            registers = sketch(elements, first).tobytes()
            rows = part.num_rows
            at = pa.py_buffer(np.arange(rows + 1, dtype=np.int32) * REGISTERS * WIDTH)
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(name) for name in carried),
                    pa.array(np.diff(first)),
                    *(signed(s[first[1:]] - s[first[:-1]]) for s in sums),
                    pa.Array.from_buffers(pa.binary(), rows, [None, at, pa.py_buffer(registers)]),
                ],
                [*carried, "n_shingles", "set_a", "set_b", "registers"],
            )

    return run


def _parities(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = words_of(part.column("text"))
            rows = parities(*shingles(words, word_hashes(words, LOWER_VALUES), width))
            yield part.select(["node"]).append_column("parities", pa.array(rows, pa.binary()))

    return run


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _kept(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _registers(batch.column("registers_a")), _registers(batch.column("registers_b"))
            sizes = [batch.column(c).to_numpy() for c in ("size_a", "size_b")]
            yield batch.select(["a", "b"]).filter(pa.array(plausible(a, b, *sizes, similarity, MARGIN)))

    return run


def _confirmed(width: int, percent: int):
    """Pairs with 100 * intersection >= percent * union.

    Rows come by block and part: first the texts of the left nodes, whose sets are kept until the
    next part, then each right text with the left nodes it is compared with.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, left = None, {}
        for part in slices(batches, "text"):
            words = words_of(part.column("text"))
            elements, first = shingles(words, word_hashes(words, LOWER_VALUES), width)
            found = []
            columns = [part.column(c).to_pylist() for c in ("block", "part", "node", "partners")]
            for i, (block, number, node, partners) in enumerate(zip(*columns, strict=True)):
                if (block, number) != place:
                    place, left = (block, number), {}
                own = elements[first[i] : first[i + 1]]
                if partners is None:
                    left[node] = own.copy()
                    continue
                for other in partners:
                    its = left[other]
                    at = np.searchsorted(its, own)
                    common = int((its[np.minimum(at, len(its) - 1)] == own).sum()) if len(its) else 0
                    if common > 0 and 100 * common >= percent * (len(its) + len(own) - common):
                        found.append((other, node))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return run


def _within_blocks(percent: int):
    """Pairs of a left and a right member with different labels whose parities allow a link, for each row's two blocks.

    100 * intersection >= percent * union says that at most (100 - percent) / (100 + percent) of the
    elements of both sets, each set's counted, are in one of them alone.
    A pair that shares several buckets leaves from the one with the smallest key, by
    the keys' low 32 bits.
    """

    def columns(batch: pa.RecordBatch, side: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        lists = batch.column(side)
        members = lists.flatten()
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        return first, {k: members.field(k).to_numpy() for k in ("n_shingles", "label", "node")} | {
            "parities": members.field("parities").to_pylist(),
            "bands": members.field("bands").flatten().to_numpy().reshape(-1, REGISTERS // BAND),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part.slice(i, 64) for part in batches for i in range(0, part.num_rows, 64)):
            (first_l, left), (first_r, right) = columns(batch, "left"), columns(batch, "right")
            # One entry for each left member, which meets the whole right block of its row.
            row = np.repeat(np.arange(batch.num_rows), np.diff(first_l))
            meets = np.diff(first_r)[row]
            bucket = batch.column("bucket").to_numpy().astype(np.int32)
            ends = np.cumsum(meets)
            for lo, hi in _runs(ends, PAIRS_AT_ONCE):
                i = np.repeat(np.arange(lo, hi), meets[lo:hi])
                begin = ends[lo:hi] - meets[lo:hi] - (ends[lo - 1] if lo else 0)
                j = np.arange(len(i)) - np.repeat(begin - first_r[row[lo:hi]], meets[lo:hi])
                size_l, size_r = left["n_shingles"][i], right["n_shingles"][j]
                pick = (left["label"][i] != right["label"][j]) & (100 * size_r >= percent * size_l) & (100 * size_l >= percent * size_r)
                at = bucket[np.repeat(row[lo:hi], meets[lo:hi])[pick]]
                i, j, both = i[pick], j[pick], (size_l + size_r)[pick]
                pick = (100 + percent) * differing(left["parities"], right["parities"], i, j) <= (100 - percent) * both
                i, j, at = i[pick], j[pick], at[pick]
                own = left["bands"][i]
                smallest = np.where(own == right["bands"][j], own, LAST).min(axis=1, initial=LAST)
                pick = smallest == at
                a, b = left["node"][i[pick]], right["node"][j[pick]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _runs(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Stretches of entries that end at most ``limit`` beyond where they began, at least one entry each."""
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield at, stop
        at = stop


class _Comparison:
    """Nodes with their registers and texts, and what it takes to confirm pairs of them."""

    def __init__(self, nodes: DataFrame, texts: DataFrame, width: int, percent: int):
        self.nodes, self.texts, self.width, self.percent = nodes, texts, width, percent
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
        self.blocks = max(1, math.ceil(size / BLOCK_BYTES))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` that the registers allow and the full sets confirm."""
        for side in "ab":
            more = self.nodes.select(F.col("node").alias(side), F.col("n_shingles").alias(f"size_{side}"), F.col("registers").alias(f"registers_{side}"))
            pairs = pairs.join(more, side)
        return self.confirmed(pairs.mapInArrow(_kept(self.percent / 100), "a long, b long"))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs that the full sets confirm.

        Left nodes are dealt into blocks of some ``BLOCK_BYTES`` of text, and a block with many pairs
        into parts by its right nodes. A left text moves once a part, a right text once for each part
        that it has partners in, however many pairs they make.
        """
        pairs = durable(pairs.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(self.blocks))))
        few = parts_for(stored_bytes(pairs))
        pairs = pairs.coalesce(few)
        # One row a block, so some hundred for a GB of texts.
        parts = pairs.groupBy("block").agg(F.ceil(F.count("*") / PAIRS_IN_PART).alias("parts")).coalesce(few)
        part = F.pmod(F.xxhash64(F.lit(1), "b"), F.col("parts")).alias("part")
        pairs = pairs.join(F.broadcast(parts), "block").select("a", "b", "block", part)
        left = pairs.select("block", "part", F.col("a").alias("node")).distinct().withColumn("partners", F.lit(None).cast("array<long>"))
        right = pairs.groupBy("block", "part", F.col("b").alias("node")).agg(F.collect_list("a").alias("partners"))
        rows = left.coalesce(few).unionByName(right.coalesce(few)).join(self.texts, "node").repartition("block", "part")
        rows = rows.sortWithinPartitions("block", "part", F.col("partners").isNotNull())
        return durable(rows.mapInArrow(_confirmed(self.width, self.percent), "a long, b long")).coalesce(few)


def _relabelled(labels: DataFrame, links: DataFrame, size: int) -> DataFrame:
    """Join components that a link connects; ``labels`` has every node of the links and takes ``size`` bytes."""
    of = {side: broadcast_if_small(labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}")), LABELS, size) for side in "ab"}
    between = links.join(of["a"], "a").join(of["b"], "b").where("label_a <> label_b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    merged = components(between).select(F.col("node").alias("label"), F.col("label").alias("root"))
    merged = broadcast_if_small(merged, LABELS, size)
    return durable(labels.join(merged, "label", "left").select("node", F.coalesce("root", "label").alias("label")).coalesce(parts_for(size)))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs(doc_id, text)``.

    A document's set holds its distinct ``width``-word shingles with A-Z
    lower-cased. Two documents are linked if 100 * intersection >= percent *
    union; ``component_id`` is the smallest doc_id that links reach.

    Null and blank texts have no shingles and are linked with nothing. Rows with
    the same doc_id stay separate rows; those with equal sets share a component.
    Rows whose doc_id is null take part and get the smallest non-null doc_id of
    their component, else null. Equal rows are compared once. Further columns of ``docs`` are ignored. An empty
    table gives an empty result.
    """
    described, nodes, labels = _components(distinct_texts(docs), width, percent, "text_no int", "copies long")
    smallest = nodes.join(labels, "node").groupBy("label").agg(F.min("smallest").alias("component_id"))
    found = labels.join(smallest, "label").select("node", "component_id")
    of_set = nodes.join(found, "node", "left").select("set_a", "set_b", F.coalesce("component_id", "smallest").alias("component_id"))
    out = described.join(of_set, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def surplus(docs: DataFrame, key: str, width: int = 5, percent: int = 80) -> DataFrame:
    """The ``key`` of every row of ``docs(doc_id, text, key)`` but for one of each component of ``near_duplicates``.

    ``key`` is a string that no two rows share. The row with the smallest doc_id
    stays, null last; among equal ids the one with the smallest hash of its text, then
    the smallest key. Null and blank texts are linked with nothing and all stay.
    """
    keyed = docs.select("doc_id", "text", key, F.xxhash64("text").alias("text_hash"))
    described, nodes, labels = _components(keyed, width, percent, f"{key} string", "text_hash long")
    of_set = nodes.join(labels, "node", "left").select("set_a", "set_b", F.coalesce("label", "node").alias("component"))
    rows = described.where("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", key)
    first = rows.join(of_set, ["set_a", "set_b"]).groupBy("component").agg(F.min(order).alias("first"))
    return rows.select(key).join(first.select(f"first.{key}"), key, "left_anti")


def _components(docs: DataFrame, width: int, percent: int, *keys: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row with its set but without its text, a node for every set that is not empty, and ``_labels`` of the nodes.

    ``keys`` are further columns of ``docs`` with their types, of which the first one tells rows
    with equal doc_ids apart.
    """
    names = [key.split()[0] for key in keys]
    docs = docs.select("doc_id", *names, "text")
    schema = f"doc_id long, {', '.join(keys)}, n_shingles long, set_a long, set_b long, registers binary"
    described = durable(docs.mapInArrow(_described(width, ("doc_id", *names)), schema))
    sets = described.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles")
    sets = sets.agg(
        F.min("doc_id").alias("smallest"),
        F.min(F.struct("doc_id", F.col(names[0]).alias("key"))).alias("copy"),
        F.any_value("registers").alias("registers"),
    )
    # The ids have to be read as they are made, so they are stored at once.
    nodes = gathered(durable(sets.withColumn("node", F.monotonically_increasing_id())))
    docs = docs.withColumn("key", F.col(names[0]))
    return described, nodes, _labels(nodes, docs, width, percent)


def _bands() -> Column:
    """One key for each band of ``registers``."""
    size = BAND * WIDTH
    return F.expr(f"transform(sequence(0, {REGISTERS // BAND - 1}), i -> xxhash64(i, substring(registers, {size} * i + 1, {size})))")


def _labels(nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``(node, label)`` of every node that shares a bucket with another one, to be broadcast if they are few."""
    bands = nodes.select("node", F.explode(_bands()).alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high")).where("size > 1")
    members = gathered(durable(bands.join(shared, "bucket")))

    labels = durable(members.select("node", F.col("node").alias("label")).distinct())
    size = stored_bytes(labels)
    labels = labels.coalesce(parts_for(size))
    near = gathered(durable(nodes.join(broadcast_if_small(labels, LABELS, size), "node")))
    # One row of ``docs`` for each node, however many copies it has.
    ids = durable(near.select("node", "copy.doc_id", "copy.key"))
    same = docs["doc_id"].eqNullSafe(ids["doc_id"]) & (docs["key"] == ids["key"])
    texts = durable(docs.join(broadcast_if_small(ids), same).select("node", "text"))
    compare = _Comparison(near, texts, width, percent)

    for centre in ("low", "high"):
        of = {side: broadcast_if_small(labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}")), LABELS, size) for side in ("node", centre)}
        pairs = members.select("node", centre).where(f"node <> {centre}").distinct().join(of["node"], "node").join(of[centre], centre)
        pairs = pairs.where(f"label_node <> label_{centre}").select(F.col(centre).alias("a"), F.col("node").alias("b"))
        labels = _relabelled(labels, compare.links(pairs), size)

    odd = texts.mapInArrow(_parities(width), "node long, parities binary")
    known = members.select("bucket", "node").join(broadcast_if_small(labels, LABELS, size), "node")
    pairs = _apart(known, near, odd, percent)
    return broadcast_if_small(_relabelled(labels, compare.confirmed(pairs), size), LABELS, size)


def _apart(members: DataFrame, nodes: DataFrame, odd: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components within a bucket whose parities allow a link, each once.

    Sizes are put into classes one threshold wide, so sets that may be linked are in the same
    class or in neighbouring ones; only blocks of such classes meet.
    """
    members = members.join(_labelled(members), "bucket").join(nodes.select("node", "n_shingles"), "node")
    members = gathered(durable(members.withColumn("class", F.floor(F.log(F.col("n_shingles").cast("double")) / -math.log(percent / 100)).cast("int"))))
    sizes = members.groupBy("bucket", "class").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK))
    members = gathered(durable(members.join(sizes, ["bucket", "class"]).select("bucket", "class", "node", "label", "main", block.alias("block"))))

    short = F.transform(_bands(), lambda key: F.shiftright(F.shiftleft(key, 32), 32).cast("int"))
    content = F.collect_list(F.struct("node", "label", "n_shingles", "parities", "bands"))
    full = members.join(odd.join(nodes.select("node", "n_shingles", short.alias("bands")), "node"), "node")
    right = full.groupBy("bucket", "class", "block").agg(content.alias("right")).drop("block")
    left = full.where("label <> main").groupBy("bucket", "class", "block").agg(content.alias("left")).drop("block")
    left = left.withColumn("class", F.explode(F.array(*[F.col("class") + step for step in (-1, 0, 1)])))
    pairs = left.join(right, ["bucket", "class"]).select("bucket", "left", "right")
    return pairs.mapInArrow(_within_blocks(percent), "a long, b long").distinct()


def _labelled(members: DataFrame) -> DataFrame:
    """Buckets that hold several components, with the largest one."""
    by_label = members.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    of = by_label.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels"))
    return of.where("labels > 1").select("bucket", F.col("top.label").alias("main"))
