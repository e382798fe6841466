"""Feedback clicks and the per-user taste profile built from them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.ordering import numbered
from eventloom.functions.text import clip, nullif_empty, one_line, strip
from eventloom.functions.times import ntz
from eventloom.operators.inference import Completer
from eventloom.session import durable
from eventloom.sources.answers import AnswerStore

SUMMARY_THRESHOLD = 10
SUMMARY_MAX_CHARS = 10_000
#: Clicks in one summary request of ``fold_summaries``; more of them take more requests in a row.
LINES_PER_REQUEST = 200
#: What a summary request is known by.
SUMMARY_KEYS = "user_id BIGINT, part_no BIGINT"


def _problem(clicks: DataFrame) -> Column:
    """Why a click is not acceptable as it stands; null when it is."""
    types = dict(clicks.dtypes)
    whole = F.lit(True) if types["event_id"] != "string" else F.col("event_id").rlike(r"^-?\d+$")
    truth = F.lit(True) if types["interested"] != "string" else F.lower("interested").isin("true", "false")
    return (
        F.when(F.col("event_id").isNull(), "event_id is required")
        .when(~whole, "event_id must be an integer")
        .when(F.col("interested").isNull(), "interested is required")
        .when(~truth, "interested must be a boolean")
    )


def accepted(clicks: DataFrame, *more: str) -> DataFrame:
    """Well-formed clicks with typed columns."""
    return clicks.where(_problem(clicks).isNull()).select(
        "click_id",
        "user_id",
        F.col("event_id").cast("bigint").alias("event_id"),
        F.col("interested").cast("boolean").alias("interested"),
        "created_at",
        *more,
    )


def rejected(clicks: DataFrame) -> DataFrame:
    """Malformed clicks, with the reason."""
    problem = _problem(clicks)
    return clicks.where(problem.isNotNull()).withColumn("reason", problem)


def feedback_snapshot(clicks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Clicks with the event's content at click time, so they outlive the event."""
    events = catalog.select(
        F.col("id").alias("event_id"),
        F.col("title").alias("event_title"),
        F.col("description").alias("event_description"),
        F.col("source").alias("event_source"),
        F.col("category").alias("event_category"),
        F.col("venue").alias("event_venue"),
    )
    more = [c for c in ("new_no", "rank") if c in clicks.columns]
    return (
        accepted(clicks, *more)
        .join(events, "event_id")
        .select(
            "click_id",
            "user_id",
            "event_id",
            "event_title",
            "event_description",
            "event_source",
            "event_category",
            "event_venue",
            "interested",
            "created_at",
            *more,
        )
    )


def feedback_rejects(clicks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Clicks that were not recorded, with the reason."""
    malformed = rejected(clicks).select("click_id", "user_id", "reason")
    ids = catalog.select(F.col("id").alias("event_id"))
    orphans = accepted(clicks).join(ids, "event_id", "left_anti")
    return malformed.unionByName(orphans.select("click_id", "user_id", F.lit("Event not found").alias("reason")))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """Clicks per user: all, liked and disliked."""
    return feedback.groupBy("user_id").agg(
        F.count("*").alias("total"),
        F.count_if("interested").alias("liked"),
        F.count_if(~F.col("interested")).alias("disliked"),
    )


def recent_feedback(feedback: DataFrame, *, n: int = 10) -> DataFrame:
    """Each user's newest clicks. Map tasks send at most ``n`` rows per user.

    Hand in ``recorded_clicks`` and attach the content last, so that no text moves with the clicks.
    """
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("click_id"))
    return feedback.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n)


def recent_history(history: DataFrame, *, n: int = 10) -> DataFrame:
    """Each user's newest archived summaries."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("feedback_count"))
    return history.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n)


def recorded_clicks(clicks: DataFrame, catalog: DataFrame) -> DataFrame:
    """The clicks that ``feedback_snapshot`` keeps, still without content."""
    return accepted(clicks).join(catalog.select(F.col("id").alias("event_id")), "event_id", "left_semi")


def recent_feedback_n(feedback: DataFrame, profile: DataFrame) -> DataFrame:
    """Each user's clicks since the last summary, numbered from the oldest one (``new_no``).

    These are the newest ``total - counted`` ones, which is all but the oldest
    ``counted``, so numbering from the oldest is enough. ``feedback`` is read once; hand in
    ``recorded_clicks`` and attach the content last to keep the numbered rows narrow.
    """
    order = numbered(feedback, ["user_id"], [F.col("created_at"), F.col("click_id")])
    counted = profile.select(
        "user_id", F.coalesce("feedback_count_at_last_summary", F.lit(0)).alias("_counted")
    )
    fresh = order.join(counted, "user_id").where(F.col("row_no") > F.col("_counted"))
    return fresh.select(*feedback.columns, (F.col("row_no") - F.col("_counted")).alias("new_no"))


def summary_due(feedback: DataFrame, profile: DataFrame, *, threshold: int = SUMMARY_THRESHOLD) -> DataFrame:
    """Users with enough clicks since their last summary."""
    return (
        feedback.groupBy("user_id")
        .agg(F.count("*").alias("total"))
        .join(profile.select("user_id", "feedback_count_at_last_summary"), "user_id")
        .withColumn("new_feedback", F.col("total") - F.coalesce("feedback_count_at_last_summary", F.lit(0)))
        .where(F.col("new_feedback") >= threshold)
        .select("user_id", "total", "new_feedback")
    )


def feedback_lists(new_feedback: DataFrame, *, lines_per_part: int | None = None, newest_first: bool = False) -> DataFrame:
    """Liked and disliked events as bullet text, newest first.

    ``new_feedback`` is numbered as by ``recent_feedback_n``. One row per user with all of them, or
    with ``lines_per_part`` one per user and part of so many clicks, the oldest ones in part 0, or
    with ``newest_first`` the newest ones.
    """
    about = one_line(clip(F.coalesce("event_description", F.lit("")), 100))
    line = F.concat(
        F.lit('- "'), F.coalesce("event_title", F.lit("None")), F.lit('" ('), F.coalesce("event_source", F.lit("None")),
        F.lit(") -- "), about,
    )
    place = F.col("new_no")
    if newest_first:
        new_feedback = new_feedback.join(new_feedback.groupBy("user_id").agg(F.max("new_no").alias("_last")), "user_id")
        place = F.col("_last") - place + 1
    part = F.floor((place - 1) / lines_per_part) if lines_per_part else F.lit(0)
    rows = new_feedback.select(
        "user_id", "interested", (-F.col("new_no")).alias("age"), line.alias("line"), part.cast("bigint").alias("part_no")
    )

    def bullets(wanted: Column) -> Column:
        picked = F.array_sort(F.collect_list(F.when(wanted, F.struct("age", "line"))))
        return F.coalesce(
            nullif_empty(F.array_join(F.transform(picked, lambda r: r["line"]), "\n")), F.lit("(none)")
        )

    return rows.groupBy("user_id", "part_no").agg(
        bullets(F.col("interested")).alias("liked"), bullets(~F.col("interested")).alias("disliked")
    )


SUMMARY_RULES = """\
Two headings, Likes and Dislikes; under each at most five points of a few words.
A point is about a kind of event. Leave out what a single event, place or organiser is called.
Nothing before or after the two lists.
"""
SUMMARY_UPDATE = """\
Revise the current profile in the light of the new reactions: what they repeat weighs more, what they deny weighs less or goes.
"""
SUMMARY_FIRST = """\
Describe this person's taste from the reactions above.
"""


def summary_prompt(lists: DataFrame, due: DataFrame, profile: DataFrame, *, continued: bool = False) -> DataFrame:
    """The summary request of each due user: an update if a summary exists, else a first one.

    Each part of the lists is a request of its own; with ``continued`` part 0 alone is one, and
    the further parts follow it as continuations.
    """
    existing = nullif_empty(F.coalesce("preference_summary", F.lit("")))
    clicks = F.concat(
        F.lit("EVENTS THE USER LIKED:\n"), "liked", F.lit("\n\nEVENTS THE USER DISLIKED:\n"), "disliked", F.lit("\n\n")
    )
    update = F.concat(
        F.lit("CURRENT PROFILE:\n"), existing, F.lit("\n\nNEW "), clicks, F.lit(SUMMARY_UPDATE), F.lit(SUMMARY_RULES)
    )
    first = F.concat(clicks, F.lit(SUMMARY_FIRST), F.lit(SUMMARY_RULES))
    prompt = F.coalesce(update, first)
    if continued:
        prompt = F.when(F.col("part_no") > 0, F.concat(F.lit("CONTINUED "), clicks)).otherwise(prompt)
    return (
        lists.join(due.select("user_id"), "user_id", "left_semi")
        .join(profile.select("user_id", "preference_summary"), "user_id")
        .select("user_id", "part_no", prompt.alias("prompt"))
    )


def fold_summaries(
    fresh: DataFrame, due: DataFrame, profile: DataFrame, store: AnswerStore, completer: Completer, *, lines_per_request: int = LINES_PER_REQUEST
) -> DataFrame:
    """One new summary (user_id, new_summary, total) of each due user, from all of the ``fresh`` clicks.

    A user's clicks go out from the oldest on, ``lines_per_request`` at a time, and each
    request starts from the summary that the last one gave. A round handles the next request of all
    users who still have clicks, so there are as many rounds as the busiest user needs requests. A
    user with a failed or empty answer gets no summary this time; the answers that ``store``
    (``SUMMARY_KEYS``) has by then are used when the fold runs again.
    """
    due = durable(due)
    lists = durable(feedback_lists(fresh.join(due.select("user_id"), "user_id", "left_semi"), lines_per_part=lines_per_request))
    current = durable(profile.join(due.select("user_id", "total"), "user_id").select("user_id", "preference_summary", "total", F.lit(-1).cast("bigint").alias("last_part")))
    last = lists.agg(F.coalesce(F.max("part_no"), F.lit(-1))).first()[0]
    for part in range(last + 1):
        # Users whose last answer failed stopped at an earlier part.
        going = current.where(F.col("last_part") == part - 1)
        answers = store.complete(summary_prompt(lists.where(F.col("part_no") == part), going, going), completer)
        text = F.when(F.col("error").isNull(), nullif_empty(strip(F.coalesce("content", F.lit("")))))
        good = answers.select("user_id", text.alias("_new")).where(F.col("_new").isNotNull())
        step = F.when(F.col("_new").isNotNull(), F.lit(part).cast("bigint")).otherwise(F.col("last_part"))
        current = durable(
            current.join(good, "user_id", "left").select(
                "user_id", F.coalesce("_new", "preference_summary").alias("preference_summary"), "total", step.alias("last_part")
            )
        )
    ends = lists.groupBy("user_id").agg(F.max("part_no").alias("last_part"))
    return current.join(ends, ["user_id", "last_part"]).select("user_id", F.col("preference_summary").alias("new_summary"), "total")


def summary_apply(profile: DataFrame, summaries: DataFrame, *, as_of: datetime | str) -> tuple[DataFrame, DataFrame]:
    """Store new summaries (user_id, new_summary, total): the next profile and the rows to archive.

    Empty summaries change nothing; an old summary is archived only if there was one. Of
    several summaries for a user the one that covers most clicks counts.
    """
    best = F.max(F.struct("total", "new_summary")).alias("best")
    fresh = summaries.where(F.col("new_summary") != "").groupBy("user_id").agg(best).select("user_id", "best.new_summary", "best.total")
    both = profile.join(fresh, "user_id", "left")
    replaced = F.col("new_summary").isNotNull()
    snapshot = both.select(
        "user_id",
        "taste_prompt",
        F.coalesce("new_summary", "preference_summary").alias("preference_summary"),
        F.when(replaced, F.col("total")).otherwise(F.col("feedback_count_at_last_summary")).alias(
            "feedback_count_at_last_summary"
        ),
        F.when(replaced, ntz(as_of)).otherwise(
            F.col("last_summarized_at") if "last_summarized_at" in profile.columns else F.lit(None)
        ).alias("last_summarized_at"),
    )
    archived = both.where(replaced & (F.coalesce("preference_summary", F.lit("")) != "")).select(
        "user_id",
        "taste_prompt",
        "preference_summary",
        F.col("feedback_count_at_last_summary").alias("feedback_count"),
        ntz(as_of).alias("created_at"),
    )
    return snapshot, archived


def profile_upsert(profile: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply each user's latest taste text and latest hand-written summary.

    A summary over the length limit is rejected, so an earlier valid one stands.
    """
    text = strip(F.coalesce("content", F.lit("")))
    valid = edits.withColumn("text", text).where(
        (F.col("field") == "taste") | (F.length("text") <= SUMMARY_MAX_CHARS)
    )

    def latest(field: str) -> Column:
        mine = F.col("field") == field
        return F.max_by(F.when(mine, F.col("text")), F.when(mine, F.struct("edited_at", "edit_id")))

    newest = valid.groupBy("user_id").agg(latest("taste").alias("_taste"), latest("summary").alias("_summary"))
    return profile.join(newest, "user_id", "full").select(
        "user_id",
        F.coalesce("_taste", "taste_prompt", F.lit("")).alias("taste_prompt"),
        F.coalesce("_summary", "preference_summary", F.lit("")).alias("preference_summary"),
        F.coalesce("feedback_count_at_last_summary", F.lit(0)).alias("feedback_count_at_last_summary"),
    )


def pin_state(toggles: DataFrame, catalog: DataFrame) -> DataFrame:
    """Whether each toggled event is pinned now: the initial state, flipped once per toggle."""
    flips = toggles.groupBy("user_id", "event_id").agg((F.count("*") % 2 == 1).alias("odd"))
    return flips.join(catalog.select(F.col("id").alias("event_id"), F.col("pinned").alias("_was")), "event_id").select(
        "user_id", "event_id", (F.col("odd") != F.col("_was")).alias("pinned")
    )
