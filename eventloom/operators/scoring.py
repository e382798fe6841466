"""Relevance scoring in batches: candidates, requests, answers and write-back.

``per`` names the columns a batch must not mix, e.g. ``["user_id"]`` when each
user has a profile of their own. Without it all events share one profile.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.ordering import numbered
from eventloom.functions.text import clip, nullif_empty, one_line, strip
from eventloom.functions.times import ntz
from eventloom.operators.inference import Completer
from eventloom.sources.answers import AnswerStore

BATCH_SIZE = 40


def score_candidates(catalog: DataFrame, *, as_of: datetime | str, rescore_all: bool = False) -> DataFrame:
    """Events from now on that have no score yet, or all of them."""
    future = catalog.where(F.col("date") >= ntz(as_of))
    return future if rescore_all else future.where(F.col("score").isNull())


def batch_members(candidates: DataFrame, *, per: Sequence[str] = (), size: int = BATCH_SIZE) -> DataFrame:
    """The batch number of each candidate, in id order."""
    order = numbered(candidates.select(*per, "id"), per, [F.col("id")])
    return order.withColumn("batch_no", F.floor((F.col("row_no") - 1) / size).cast("bigint"))


def score_batches(candidates: DataFrame, *, per: Sequence[str] = (), size: int = BATCH_SIZE) -> DataFrame:
    """Batches of ``size`` events as JSON array text, one event per line."""
    members = batch_members(candidates, per=per, size=size)

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")).alias(name)

    entry = F.to_json(
        F.struct(
            "id",
            text("title"),
            one_line(clip(F.coalesce("description", F.lit("")), 150)).alias("desc"),
            text("venue"),
            text("category"),
        )
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "entry"))), lambda e: e["entry"])
    return (
        candidates.select(*per, "id", entry.alias("entry"))
        .join(members, [*per, "id"])
        .groupBy(*per, "batch_no")
        .agg(F.count("id").alias("events"), lines.alias("lines"))
        .select(
            *per,
            "batch_no",
            "events",
            F.concat(F.lit("[\n"), F.array_join("lines", ",\n"), F.lit("\n]")).alias("events_json"),
        )
    )


SCORE_TASK = """\
Judge for each event in the list how well it suits the person described above, as a number between 0.0 and 1.0.
  0.8 to 1.0  what they ask for
  0.5 to 0.7  close to it
  0.2 to 0.4  far from it
  0.0 to 0.1  foreign to them, or something they reject
Reply with JSON alone: an array with one {"id": ..., "score": ...} for every id in the list.
"""


def _profile_text(taste: Column, summary: Column) -> Column:
    sections = [
        F.concat(F.lit("USER INTERESTS:\n"), nullif_empty(strip(taste)), F.lit("\n\n")),
        F.concat(F.lit("LEARNED PREFERENCES:\n"), nullif_empty(strip(summary)), F.lit("\n\n")),
    ]
    return F.concat_ws("", *sections)


def score_prompt(batches: DataFrame, profiles: DataFrame, *, per: Sequence[str] = ("user_id",)) -> DataFrame:
    """The request of each batch. Users whose profile is empty get none."""
    known = profiles.select(
        *per, _profile_text(F.col("taste_prompt"), F.col("preference_summary")).alias("_profile")
    ).where(F.col("_profile") != "")
    prompt = F.concat("_profile", F.lit(SCORE_TASK), F.lit("\nEVENTS:\n"), "events_json")
    return batches.join(known, list(per)).select(*per, "batch_no", "events", prompt.alias("prompt"))


#: What a score request is known by when each user has a profile.
BATCH_KEYS = "user_id BIGINT, batch_no BIGINT"


def score_infer(prompts: DataFrame, store: AnswerStore, completer: Completer, *, partitions: int | None = None) -> DataFrame:
    """One answer per batch; a failed batch is recorded and leaves the others alone.

    ``store`` is keyed by the batch (``BATCH_KEYS``), so batches it can answer are not sent again.
    """
    return store.complete(prompts, completer, partitions=partitions).withColumnRenamed("content", "reply")


def _unfenced(reply: Column) -> Column:
    """The answer without a Markdown code fence around it."""
    raw = strip(reply)
    inner = F.split_part(raw, F.lit("```"), F.lit(2))
    inner = F.when(inner.startswith("json"), F.substring(inner, F.lit(5), F.length(inner))).otherwise(inner)
    return F.when(raw.startswith("```"), strip(inner)).otherwise(raw)


def _number(value: Column) -> Column:
    """A VARIANT number or truth value as DOUBLE; texts and nulls give null."""
    kind = F.schema_of_variant(value)
    truth = F.try_variant_get(value, "$", "boolean").cast("int").cast("double")
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(value, "$", "double")).when(
        kind == "BOOLEAN", truth
    )


def _whole(value: Column) -> Column:
    """A VARIANT number without a fraction as BIGINT; whole numbers never pass through DOUBLE."""
    number = _number(value)
    exact = F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))
    return F.coalesce(exact, F.when(number == F.floor(number), number.cast("bigint")))


def parse_scores(replies: DataFrame, members: DataFrame, *, per: Sequence[str] = ()) -> DataFrame:
    """Valid scores of each batch, clamped to 0..1.

    An answer counts only if it is a JSON array of objects. Ids outside the batch
    and non-numeric scores are ignored; the last entry of a repeated id wins.
    """
    keys = [*per, "batch_no"]
    items = F.try_variant_get(F.try_parse_json(_unfenced(F.col("reply"))), "$", "array<variant>")
    objects = F.forall("items", lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))
    # No filter may reach the reply text, or Spark parses it once more in there: hence
    # when() and the outer explode.
    entries = replies.select(*keys, items.alias("items")).withColumn("items", F.when(objects, F.col("items")))
    item = entries.select(*keys, F.posexplode_outer("items").alias("pos", "item"))
    scored = item.where(F.col("pos").isNotNull()).select(
        *keys,
        "pos",
        _whole(F.try_variant_get("item", "$.id", "variant")).alias("id"),
        _number(F.try_variant_get("item", "$.score", "variant")).alias("score"),
    ).where(F.col("id").isNotNull() & F.col("score").isNotNull())
    return (
        scored.groupBy(*keys, "id")
        .agg(F.max_by("score", "pos").alias("score"))
        .join(members.select(*keys, "id"), [*keys, "id"], "left_semi")
        .withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))
    )


def score_coverage(scores: DataFrame, members: DataFrame, *, per: Sequence[str] = ()) -> DataFrame:
    """How many of a batch's events were scored, and which ids are missing."""
    keys = [*per, "batch_no"]
    expected = members.groupBy(*keys).agg(F.collect_set("id").alias("_expected"))
    got = scores.groupBy(*keys).agg(F.collect_set("id").alias("_got"))
    none = F.array().cast("array<bigint>")
    return (
        expected.join(got, keys, "left")
        .withColumn("_got", F.coalesce("_got", none))
        .select(
            *keys,
            F.size("_got").alias("scored"),
            F.size("_expected").alias("expected"),
            F.array_sort(F.array_except("_expected", "_got")).alias("missing_ids"),
        )
    )


def score_writeback(catalog: DataFrame, scores: DataFrame, *, per: Sequence[str] = ()) -> DataFrame:
    """The catalog with new scores where there are any and the old ones elsewhere.

    With ``per`` the catalog has a row for each event and, say, user, and so have the
    scores. Several scores for one key would multiply rows; the highest counts.
    """
    keys = [*per, "id"]
    return (
        catalog.join(scores.groupBy(*keys).agg(F.max("score").alias("_new")), keys, "left")
        .withColumn("score", F.coalesce("_new", "score"))
        .drop("_new")
    )
