"""Conversation repair by weighted interval parsing.

The roles of a repaired conversation read ``(s?(ua)+)?`` in initials. The repair
grammar in Chomsky normal form has a nonterminal for each pair of states of that
language, ``X[p,q] -> X[p,r] X[r,q]``, which derives all edits of a span of turns
that lead from state p to state q. A cell holds the smallest (cost, audit) of each
nonterminal over a span; ``INSERTED`` is the closure of insertions, the cells of the
empty span.

Cells are combined bottom-up by span length. As the nonterminals cover every state
between two parts of a span, the smallest derivation is found at any of its split
points: a span needs one split instead of all of them, and a conversation of n turns
n - 1 combinations instead of a triangle of n^2 / 2 cells. The smallest audits of two
parts make the smallest audit of both: of two audits of one span with equal costs,
neither begins with the other, since they have a letter for every turn and their
further letters, insertions, cost something.

A conversation may hold any share of all rows. Turns are numbered by range
partitions, repeated ones are found by a grouped minimum, cells are made for blocks
of ``BLOCK`` turns and combined ``FAN`` at a time in rounds. Texts move once, at the
end, where the turns of a conversation pass by in order and none is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.ordering import numbered
from eventloom.session import durable

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
BLOCK, FAN = 256, 64
#: What each initial does in each state: nothing yet, after s, after u, after a.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, FINAL = range(4), (0, 3)
PAIRS = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
RULES = [(PAIRS.index((p, q)), PAIRS.index((p, r)), PAIRS.index((r, q))) for p, q in PAIRS for r in STATES if (p, r) in PAIRS and (r, q) in PAIRS]

#: ``(cost, audit)`` of each pair, or None.
Cell = tuple


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of a span from those of its two parts."""
    out: list = [None] * len(PAIRS)
    for whole, a, b in RULES:
        x, y = left[a], right[b]
        if x is not None and y is not None:
            cost = x[0] + y[0]
            if out[whole] is None or cost <= out[whole][0]:
                both = (cost, x[1] + y[1])
                if out[whole] is None or both < out[whole]:
                    out[whole] = both
    return tuple(out)


def _inserted() -> Cell:
    once = tuple((INSERT, "I") if q in (STEPS.get((p, "u")), STEPS.get((p, "a"))) else None for p, q in PAIRS)
    cell: Cell = tuple((0, "") if p == q else None for p, q in PAIRS)
    while True:
        longer = combined(cell, once)
        lower = tuple(min((c for c in pair if c is not None), default=None) for pair in zip(cell, longer, strict=True))
        if lower == cell:
            return cell
        cell = lower


INSERTED = _inserted()


@lru_cache(maxsize=None)
def turn_cell(kind: str) -> Cell:
    """The cell of one turn: ``x`` must go; else its role's initial (``o``: any other), a capital if it is cut off."""
    more = TRUNCATED if kind.isupper() else 0
    out: list = []
    for p, q in PAIRS:
        edits = [(DELETE, "D")] if p == q else []
        if kind != "x":
            edits += [(more, "K")] if STEPS.get((p, kind.lower())) == q else []
            edits += [(REROLE + more, "R")] if q in (STEPS.get((p, "u")), STEPS.get((p, "a"))) else []
        out.append(min(edits, default=None))
    return combined(combined(INSERTED, tuple(out)), INSERTED)


def _fold(cells: list[Cell]) -> Cell:
    while len(cells) > 1:
        pairs = [combined(cells[i], cells[i + 1]) for i in range(0, len(cells) - 1, 2)]
        cells = pairs + cells[len(pairs) * 2 :]
    return cells[0] if cells else INSERTED


@lru_cache(maxsize=1 << 14)
def _short(kinds: str) -> Cell:
    return _fold([turn_cell(k) for k in kinds])


def cell_of(kinds: str) -> Cell:
    """The cell of a span of turns; spans of eight turns and fewer recur and are kept."""
    return _fold([_short(kinds[i : i + 8]) for i in range(0, len(kinds), 8)])


CELL = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.large_string())]))
CELL_DDL = "array<struct<cost: long, audit: string>>"


def _plain(cell: Cell) -> list:
    return [c and {"cost": c[0], "audit": c[1]} for c in cell]


def _block_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = [_plain(cell_of(k)) for k in batch.column("kinds").to_pylist()]
        yield batch.drop_columns(["kinds"]).append_column("cell", pa.array(cells, CELL))


def _joined_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = [
            _plain(_fold([tuple(c and (c["cost"], c["audit"]) for c in cell) for cell in cells])) for cells in batch.column("cells").to_pylist()
        ]
        yield batch.drop_columns(["cells"]).append_column("cell", pa.array(cells, CELL))


BLANKS = r"\x20\x09-\x0D"


def _described(turns: DataFrame) -> DataFrame:
    """Every turn without its text, with what the parser needs of it."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return turns.select(
        "conv_id",
        "turn",
        role.alias("role"),
        F.sha2(text, 256).alias("text_key"),
        (~F.rlike(text, F.lit(f"[^{BLANKS}]"))).alias("blank"),
        (~F.rlike(text, F.lit(rf"[.!?][{BLANKS}]*\z"))).alias("cut_off"),
    )


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text_key")]


def repairs(turns: DataFrame) -> DataFrame:
    """The cheapest repair of every conversation of ``turns(conv_id, turn, role, text)``.

    Gives conv_id, gaps, blank, duplicate, truncated, illegal, cost (all long) and audit. A turn is blank,
    else a duplicate of an earlier turn with its role and text, else truncated if its last letter is
    none of ``.!?``. Keeping a turn costs nothing, another role (user or assistant) 1, deleting 2,
    inserting an empty user or assistant turn 5; a truncated turn that stays costs 5 more. Blank and
    duplicate turns have to go. ``audit`` has the initials of the edits in order, the least string
    among the cheapest ones.

    Turns are ordered by turn (nulls first), then role, then the SHA-256 of the text; a null role or
    text counts as one space. Rows with a null conv_id are one conversation. Repeated rows are
    duplicates of each other. Further columns are ignored; an empty table gives an empty result.
    """
    numbered_turns = durable(numbered(_described(turns), ["conv_id"], _order()))
    key = ["conv_id", "role", "text_key"]
    # Stored, so that the join can split a text that most turns have.
    again = durable(numbered_turns.groupBy(*key).agg(F.count("*").alias("n"), F.min("row_no").alias("first_no")).where("n > 1").drop("n"))
    again = again.select(*[F.col(k).alias(f"_{k}") for k in key], "first_no")
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    seen = F.coalesce(F.col("row_no") > F.col("first_no"), F.lit(False))
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("blank"), "b").when(seen, "d").when(F.col("cut_off"), "t").otherwise("")
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    kind = F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper(kind)).otherwise(kind)
    marked = numbered_turns.join(again, same, "left").withColumn("fault", fault).withColumn("kind", kind).withColumn("initial", initial)

    block = F.floor((F.col("row_no") - 1) / BLOCK)
    ordered = F.sort_array(F.collect_list(F.struct("row_no", "kind", "initial")))
    pair = "substring(initials, {0}, 2)"
    counts = [F.count_if(F.col("fault") == f).alias(name) for f, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))]
    ends = [F.min_by("initial", "row_no").alias("left_end"), F.max_by("initial", "row_no").alias("right_end")]
    blocks = marked.groupBy("conv_id", block.alias("block")).agg(ordered.alias("rows"), *counts, *ends)
    legal = F.expr("array('su', 'ua', 'au')")
    initials = F.transform("rows", lambda r: F.rpad(r["initial"], 1, " "))
    inside = F.size(F.filter(F.sequence(F.lit(1), F.size("rows")), lambda i: (i > 1) & ~F.array_contains(legal, F.concat(F.element_at("initials", F.greatest(i - 1, F.lit(1))), F.element_at("initials", i)))))
    blocks = blocks.withColumn("initials", initials).select(
        "conv_id",
        "block",
        "blank",
        "duplicate",
        "truncated",
        inside.cast("long").alias("illegal"),
        "left_end",
        "right_end",
        F.array_join(F.transform("rows", lambda r: r["kind"]), "").alias("kinds"),
    )
    plain = "conv_id long, block long, blank long, duplicate long, truncated long, illegal long, left_end string, right_end string"
    cells = durable(blocks.mapInArrow(_block_cells, f"{plain}, cell {CELL_DDL}"))
    while cells.agg(F.max("block")).first()[0]:
        parts = F.sort_array(F.collect_list(F.struct("block", "left_end", "right_end", "cell")))
        up = cells.groupBy("conv_id", F.floor(F.col("block") / FAN).alias("block")).agg(
            *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
            F.min_by("left_end", "block").alias("left_end"),
            F.max_by("right_end", "block").alias("right_end"),
            parts.alias("parts"),
        )
        seams = F.size(
            F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: (i > 1) & ~F.array_contains(legal, F.concat(F.element_at("parts", F.greatest(i - 1, F.lit(1)))["right_end"], F.element_at("parts", i)["left_end"])))
        )
        up = up.select(
            "conv_id", "block", "blank", "duplicate", "truncated", (F.col("illegal") + seams).alias("illegal"), "left_end", "right_end", F.transform("parts", lambda p: p["cell"]).alias("cells")
        )
        cells = durable(up.mapInArrow(_joined_cells, f"{plain}, cell {CELL_DDL}"))

    best = F.array_min(F.array(*[F.element_at("cell", PAIRS.index((0, q)) + 1) for q in FINAL]))
    turns_of = numbered_turns.groupBy("conv_id").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.count_distinct("turn").alias("n"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n"), F.lit(0)).alias("gaps")
    gaps = turns_of.select(F.col("conv_id").alias("_conv"), gaps)
    both = cells.join(gaps, F.col("conv_id").eqNullSafe(F.col("_conv")))
    out = both.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", best.alias("best"))
    return durable(out.select("*", "best.cost", "best.audit").drop("best"))


REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.large_string()), ("text", pa.large_string())])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns after edits. An audit comes before the turns of its conversation."""
    audit, at, place, expects = "", 0, 0, "u"

    def inserts(conv_id, rows):
        nonlocal at, place, expects
        while at < len(audit) and audit[at] == "I":
            rows.append((conv_id, place, "user" if expects == "u" else "assistant", ""))
            expects, place, at = ("a" if expects == "u" else "u"), place + 1, at + 1

    for batch in batches:
        rows: list = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "audit")]
        for conv_id, role, text, begun in zip(*columns, strict=True):
            if begun is not None:
                audit, at, place, expects = begun, 0, 0, "u"
                inserts(conv_id, rows)
                continue
            edit = audit[at]
            at += 1
            if edit != "D":
                if edit == "R":
                    role = "user" if expects == "u" else "assistant"
                rows.append((conv_id, place, role, text))
                expects = "a" if role[:1] == "u" else "u"
                place += 1
            inserts(conv_id, rows)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), REPAIRED, strict=True)], schema=REPAIRED)


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The turns ``(conv_id, place, role, text)`` that the edits ``found`` by ``repairs`` leave of ``turns``.

    The rows of a conversation lie together in a partition, in order. A conversation without
    remaining turns has no rows.
    """
    text = F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.sha2(text, 256).alias("text_key"))
    rows = rows.withColumn("audit", F.lit(None).cast("string"))
    heads = found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("text_key"), "audit")
    both = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_order())
    return both.select("conv_id", "role", "text", "audit").mapInArrow(_edited, "conv_id long, place long, role string, text string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, own = None, None
    names = ["conv_id", "repaired_sha256"]
    for batch in batches:
        out = []
        for conv_id, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place == 0:
                if state is not None:
                    out.append((own, state.hexdigest()))
                state, own = hashlib.sha256(), conv_id
            state.update(f"{'' if place == 0 else chr(10)}{role}:{text}".encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string()), strict=True)], names)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([state.hexdigest()])], names)


def digests(rows: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of the rows of ``repaired``: the hash of ``role:text``, joined by newlines."""
    return rows.mapInArrow(_hashed, "conv_id long, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults planted by ``crc32('conv_id:turn') % 20``, where a null is one space.

    0 drops the turn, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 gives it to the user.
    """
    turns = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    turns = turns.withColumn("fault", F.crc32(F.concat_ws(":", *parts).cast("binary")) % 20).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("_")).drop("_")
