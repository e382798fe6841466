"""Secrets in texts, kept in an incremental ledger of content-addressed blobs.

Every version of every document is a path to a blob, addressed by the SHA-256 of
its text. A ledger holds which pairs of blob and rule version were scanned and
what was found. A run scans only pairs the ledger lacks, each distinct blob once,
and joins the findings back to all paths. All of it is Spark SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.session import broadcast_if_small, durable
from eventloom.sources.manifest import Folders


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds, in the order that breaks ties.
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # A run of hex digits is maximal, so the length can be part of the pattern.
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: A line break, also one written out in a string, and what may stand around the lines of a key in code.
_BREAK = r"(?:[\r\n]|\\[nr])"
_AROUND = r"(?:\\[nrt]|[\s\"'+,;#>*|\\])"
#: The line has ended, but for closing quotes and the like.
_ENDS = rf"(?=[\x20\t\"'+,;]*+(?:{_BREAK}|\\?\z))"
#: All up to the END line of the same kind, if neither another key nor prose comes first ...
_CLOSED = r"(?:[^-\x20]|-(?!----(?:BEGIN|END)\x20)|\x20(?!(?:[A-Za-z]{1,15}[,.;:]?\x20){4}))*+-----END \1PRIVATE KEY\2-----"
#: ... or else the header fields and lines of base64, the last of which may be short, and an END line right after them.
_OPEN = (
    rf"(?:{_AROUND}*+[A-Z][A-Za-z-]*+:\x20[^\r\n\\]*+(?={_BREAK}))*+"
    rf"(?:(?:(?:(?!{_BREAK}){_AROUND})*+{_BREAK}{_AROUND}*+[A-Za-z0-9+/=]{{16,}}+{_ENDS}|[\x20\t]++[A-Za-z0-9+/=]{{40,}}+)++"
    rf"(?:{_AROUND}++[A-Za-z0-9+/=]{{1,15}}+{_ENDS})*+)?+"
    rf"(?:{_AROUND}*+-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----)?+"
)
RULES = (
    *BASE,
    Rule("private_key", rf"-----BEGIN ([A-Z ]*)PRIVATE KEY((?: BLOCK)?+)-----(?:{_CLOSED}|{_OPEN})"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
#: Raised with every change of the rules, so that ledgers scan all blobs again.
RULE_VERSION = "1.1"
FINDING = "blob string, rule_version string, kind string, kind_no int, start int, stop int"


def address(text: Column) -> Column:
    """A null text is an empty one."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _found(rule: Rule) -> Column:
    text, pattern = F.col("text"), F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("secret"),
    )
    return F.when(text.rlike(rule.pattern), parts)


def scan(blobs: DataFrame, rules: Sequence[Rule] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """All findings in ``blobs(blob, text)``; positions count code points, ``stop`` is exclusive.

    What lies between matches comes from splitting at the pattern. The running sum of
    gaps and matches gives the positions, in time proportional to their number. A
    blob that comes twice has its findings once.
    """
    tried = F.array(*[F.struct(F.lit(i).alias("kind_no"), _found(r).alias("parts")) for i, r in enumerate(rules)])
    hits = blobs.select("blob", F.explode(tried).alias("rule")).where("rule.parts is not null")
    parts = hits.select("blob", "rule.kind_no", F.posexplode("rule.parts").alias("no", "part")).where("part.match is not null")
    match_length = F.length("part.match")
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("kind_no") + 1)
    lengths = parts.select("blob", "kind_no", "no", (F.length("part.gap") + match_length).alias("step"), match_length.alias("size"), (F.length("part.secret") >= least).alias("passes")).distinct()
    so_far = Window.partitionBy("blob", "kind_no").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    placed = lengths.withColumn("stop", F.sum("step").over(so_far).cast("int")).where("passes")
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind_no") + 1)
    return placed.select("blob", F.lit(version).alias("rule_version"), kind.alias("kind"), "kind_no", (F.col("stop") - F.col("size")).alias("start"), "stop")


@dataclass
class Ledger:
    """Scanned pairs ``(blob, rule_version)`` and their findings."""

    scanned: DataFrame
    findings: DataFrame

    @classmethod
    def empty(cls, spark) -> Ledger:
        return cls(spark.createDataFrame([], "blob string, rule_version string"), spark.createDataFrame([], FINDING))


def advance(docs: DataFrame, ledger: Ledger | None = None, rules: Sequence[Rule] = RULES, version: str = RULE_VERSION) -> Ledger:
    """The ledger's new rows: blobs of ``docs(doc_id, text)`` not yet scanned under this version.

    Each blob is read from one of its paths. Nothing is scanned twice, so running
    the same increment again adds no rows.
    """
    versions = docs.select("doc_id", address(F.col("text")).alias("blob"))
    fresh = versions.groupBy("blob").agg(F.min("doc_id").alias("path"))
    if ledger is not None:
        fresh = fresh.join(ledger.scanned.where(F.col("rule_version") == version), "blob", "left_anti")
    fresh = durable(fresh)
    texts = docs.select("doc_id", "text", address(F.col("text")).alias("address")).where("text is not null")
    one = (texts["address"] == fresh["blob"]) & texts["doc_id"].eqNullSafe(fresh["path"])
    blobs = texts.join(broadcast_if_small(fresh), one, "left_semi").select(F.col("address").alias("blob"), "text")
    return Ledger(fresh.select("blob", F.lit(version).alias("rule_version")), durable(scan(blobs, rules, version)))


class StoredLedger:
    """A ledger kept below a folder that all executors share, one increment after the other.

    An increment counts once the manifest names it, so one that was lost half-way is scanned
    again and one that is repeated finds nothing left to scan. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._folders = Folders(spark, path)

    def ledger(self) -> Ledger:
        parts = self._folders.read().get("increments", [])
        if not parts:
            return Ledger.empty(self.spark)
        read = lambda name, schema: self.spark.read.schema(schema).parquet(*[f"{self.path}/{part}/{name}" for part in parts])
        return Ledger(read("scanned", "blob string, rule_version string"), read("findings", FINDING))

    def advance(self, docs: DataFrame, rules: Sequence[Rule] = RULES, version: str = RULE_VERSION) -> Ledger:
        """Scan what ``docs`` holds and the ledger does not know under this version; store and return the new rows."""
        new = advance(docs, self.ledger(), rules, version)
        parts = self._folders.read().get("increments", [])
        part = f"increment-{uuid.uuid4().hex}"
        new.scanned.write.parquet(f"{self.path}/{part}/scanned")
        new.findings.write.parquet(f"{self.path}/{part}/findings")
        self._folders.commit({"increments": [*parts, part]})
        return new


def _listed(found: Column) -> Column:
    """``kind:start:stop`` of all entries, by start and then kind."""
    entry = F.transform(F.array_sort(found), lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"]))
    return F.array_join(entry, ",")


def report(docs: DataFrame, findings: DataFrame, base: Sequence[Rule] = BASE) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` with the findings of its blob.

    Gives doc_id, blob, ``n_<kind>`` and base_sha256 for the base kinds, and spans
    and n_spans for all kinds. Null texts count as empty and have no findings; rows
    that repeat each get the findings; further columns of ``docs`` are ignored; an
    empty table gives an empty result.
    """
    placed = F.struct("start", "kind_no", "stop", "kind")
    is_base = F.col("kind").isin([r.kind for r in base])
    found = findings.groupBy("blob").agg(
        *[F.count_if(F.col("kind") == r.kind).alias(f"n_{r.kind}") for r in base],
        F.collect_list(F.when(is_base, placed)).alias("base"),
        F.collect_list(placed).alias("all"),
    )
    found = found.select("blob", *[f"n_{r.kind}" for r in base], _listed(F.col("base")).alias("base"), _listed(F.col("all")).alias("spans"), F.size("all").alias("n_spans"))
    paths = docs.select("doc_id", address(F.col("text")).alias("blob")).join(found, "blob", "left")
    return paths.select(
        "doc_id",
        *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("bigint").alias(f"n_{r.kind}") for r in base],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
        "blob",
    )


def redacted(docs: DataFrame, findings: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with the union of all spans found in a text replaced by ``mark``; other texts stay as they are.

    Touching and overlapping spans become one mark. ``n_chars`` follows the text.
    Expects the columns of ``docs`` to include text and n_chars.
    """
    found = findings.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("found"))
    # Each span in order starts where all earlier ones have ended, if it is not covered by them.
    cut = """
        aggregate(found, struct(0 AS at, cast(array() AS array<string>) AS parts),
            (s, x) -> CASE
                WHEN x.stop <= s.at THEN s
                WHEN x.start <= s.at AND s.at > 0 THEN struct(x.stop AS at, s.parts AS parts)
                ELSE struct(x.stop AS at, array_append(s.parts, substring(text, s.at + 1, x.start - s.at)) AS parts) END,
            s -> concat(array_join(s.parts, '{mark}'), '{mark}', substring(text, s.at + 1)))
    """.format(mark=mark.replace("'", "\\'"))
    rows = docs.select(F.struct("*").alias("row"), F.col("text"), address(F.col("text")).alias("blob"))
    both = rows.join(found, "blob", "left").select("row", "found", F.when(F.col("found").isNotNull(), F.expr(cut)).alias("clean"))
    changed = {"text": F.col("clean"), "n_chars": F.length("clean").cast("bigint")}
    kept = [F.when(F.col("found").isNotNull(), changed[c]).otherwise(F.col("row")[c]).alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns]
    return both.select(*kept)
