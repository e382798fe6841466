import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventloom.operators import inference, limits, profile, scoring, usage
from eventloom.plans import all_jobs
from eventloom.sources import tables
from eventloom.sources.answers import AnswerStore

PAIR = ("k", "m")


def test_retry_wordings(spark):
    cases = [
        ("Please try again in 2h15m30.5s", 8131),
        ("Please try again in 2h15m", 8101),
        ("Please try again in 2h", 7260),
        ("Please try again in 45.2s", 46),
        ("Please try again in 2m30.5s", 151),
        ("Please try again in 2m", 121),
        ("try again in 450ms", 27001),  # read as minutes, as documented
        ("no hint", 60),
        (None, 60),
        ("busy 'Retry-After': '77'", 77),
        ("try again in 5m, 'retry-after': '12'", 301),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id INT, error_text STRING")
    got = {r.id: r.retry_after for r in limits.limit_parse(df).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_interval_sums_at_the_edges(spark):
    t = datetime(2024, 1, 10, 12)
    offsets = {1: timedelta(hours=24), 2: timedelta(hours=24, microseconds=1), 3: timedelta(seconds=60), 4: timedelta(seconds=61), 5: timedelta(0), 6: -timedelta(microseconds=1)}
    calls = spark.createDataFrame([(i, t - d, *PAIR, 10**i, 0) for i, d in offsets.items()] + [(7, t, "k", "other", 5, 5), (8, t, *PAIR, None, 5)], "id BIGINT, timestamp TIMESTAMP_NTZ, api_key_label STRING, model STRING, prompt_tokens BIGINT, completion_tokens BIGINT")
    errors = spark.createDataFrame([(1, t, *PAIR, ""), (2, t, "k", "silent", "")], "id BIGINT, timestamp TIMESTAMP_NTZ, api_key_label STRING, model STRING, error_text STRING")
    got = {r.id: (r.tokens_60s, r.tokens_24h) for r in limits.limit_usage_join(errors, calls).collect()}
    assert got == {1: (10**3 + 10**5, 10 + 10**3 + 10**4 + 10**5), 2: (0, 0)}


def test_free_at_against_a_plain_loop(spark):
    rng = random.Random(5)
    as_of = datetime(2024, 1, 10)
    rows = []
    for i in range(600):
        # Bursts: many calls in one minute, several at the very same moment.
        at = as_of - timedelta(hours=rng.choice([1, 2, 20]), microseconds=rng.choice([0, 1, 999, 10**6, 61 * 10**6]))
        rows.append((i, at, "p", rng.choice("ab"), 1.0, rng.choice(["k0", "k1", None]), rng.randrange(50), rng.choice([None, 3])))
    calls = spark.createDataFrame(rows, "id BIGINT, timestamp TIMESTAMP_NTZ, provider STRING, model STRING, duration_seconds DOUBLE, api_key_label STRING, prompt_tokens BIGINT, completion_tokens BIGINT")
    limit = {"a": 400, "b": 10**6}
    table = spark.createDataFrame(list(limit.items()), "model STRING, tpd BIGINT")
    want = {}
    for key in ("k0", "k1", None):
        for model in "ab":
            mine = sorted((r[1], (r[6] + r[7]) if r[7] is not None else 0) for r in rows if r[5] == key and r[3] == model)
            left = sum(t for _, t in mine)
            if left >= limit[model]:
                for at, t in mine:
                    left -= t
                    if left < limit[model]:
                        want[key, model] = at + timedelta(hours=24)
                        break
    got = {(r.api_key_label, r.model): r.free_at for r in usage.budget_free_at(calls, table, as_of=as_of).collect()}
    assert got == want and (None, "a") in want
    cards = usage.usage_budget(calls, table, as_of=as_of, provider="p").where("free_at IS NOT NULL").collect()
    assert {(r.api_key_label, r.model): r.free_at for r in cards} == want


def feedback(spark, n):
    rows = [(i, i % 2, i, f"E{i}", f"line\n{i}", "s", "c", "v", i % 3 > 0, datetime(2024, 1, 1) + timedelta(minutes=i // 2)) for i in range(n)]
    return spark.createDataFrame(rows, "click_id BIGINT, user_id BIGINT, event_id BIGINT, event_title STRING, event_description STRING, event_source STRING, event_category STRING, event_venue STRING, interested BOOLEAN, created_at TIMESTAMP_NTZ")


PEOPLE = "user_id BIGINT, taste_prompt STRING, preference_summary STRING, feedback_count_at_last_summary BIGINT"


def test_feedback_lists_are_whole_and_in_parts(spark):
    clicks = feedback(spark, 46)
    people = spark.createDataFrame([(0, "t", "", 3), (1, "t", "old", 20)], PEOPLE)
    fresh = profile.recent_feedback_n(clicks, people)
    ids = sorted(r.click_id for r in fresh.collect())
    assert ids == sorted([i for i in range(0, 46, 2)][3:] + [i for i in range(1, 46, 2)][20:])
    whole = profile.feedback_lists(fresh).where("user_id = 0").collect()
    assert len(whole) == 1 and whole[0].liked.startswith('- "E44" (s) -- line 44\n')  # newest first
    lists = profile.feedback_lists(fresh, lines_per_part=8)
    mine = sorted((r.part_no, r.liked, r.disliked) for r in lists.where("user_id = 0").collect())
    assert len(mine) == 3 and '"E6"' in mine[0][1] + mine[0][2]  # oldest part first
    bullets = [b for _, liked, disliked in mine for b in (liked + "\n" + disliked).split("\n") if b != "(none)"]
    assert sorted(bullets) == sorted(f'- "E{i}" (s) -- line {i}' for i in range(6, 46, 2))
    due = profile.summary_due(clicks, people)
    assert [(r.user_id, r.new_feedback) for r in due.collect()] == [(0, 20)]


@pytest.mark.parametrize("n", [501, 5000])
def test_many_clicks_end_in_one_summary(spark, tmp_path, n):
    rows = [(i, 1, i, f"E{i}", "d", "s", "c", "v", True, datetime(2024, 1, 1) + timedelta(minutes=i)) for i in range(n)]
    rows += [(10_000 + i, 2, i, "bad", "d", "s", "c", "v", i > 30, datetime(2024, 1, 1) + timedelta(minutes=i)) for i in range(60)]
    clicks = spark.createDataFrame(rows, "click_id BIGINT, user_id BIGINT, event_id BIGINT, event_title STRING, event_description STRING, event_source STRING, event_category STRING, event_venue STRING, interested BOOLEAN, created_at TIMESTAMP_NTZ")
    people = spark.createDataFrame([(1, "t", "Seen 0 up to none", 0), (2, "t", "old", 5), (3, "t", "quiet", 0)], PEOPLE)

    def answer(prompt):
        """Carries on from the profile in the request; fails on the second request of user 2."""
        before = int(re.search(r"CURRENT PROFILE:\nSeen (\d+)", prompt)[1]) if "Seen" in prompt else 0
        titles = re.findall(r'- "(\w+)"', prompt)
        if before and titles[0] == "bad":
            raise RuntimeError("503")
        return inference.Completion(f"Seen {before + len(titles)} up to {titles[0]}")

    fresh, due = profile.recent_feedback_n(clicks, people), profile.summary_due(clicks, people)
    store = AnswerStore(spark, str(tmp_path), profile.SUMMARY_KEYS)
    found = profile.fold_summaries(fresh, due, people, store, answer, lines_per_request=200 if n < 1000 else 1000)
    assert [tuple(r) for r in found.where("user_id = 1").collect()] == [(1, f"Seen {n} up to E{n - 1}", n)]
    assert found.where("user_id = 2").count() == (0 if n < 1000 else 1) or n < 1000
    twice = found.unionByName(found.withColumn("total", F.col("total") - 1))
    after, archived = profile.summary_apply(people, twice, as_of="2024-02-01 00:00:00")
    assert sorted(r.user_id for r in after.collect()) == [1, 2, 3]
    assert after.where("user_id = 1").first().feedback_count_at_last_summary == n
    assert [r.preference_summary for r in archived.where("user_id = 1").collect()] == ["Seen 0 up to none"]


def test_a_failed_round_gives_no_summary_until_it_is_made_good(spark, tmp_path):
    clicks = feedback(spark, 60).where("user_id = 0")
    people = spark.createDataFrame([(0, "t", "", 0)], PEOPLE)
    fresh, due = profile.recent_feedback_n(clicks, people), profile.summary_due(clicks, people)
    store = AnswerStore(spark, str(tmp_path), profile.SUMMARY_KEYS)
    flaky = lambda prompt: inference.Completion("" if "CURRENT" in prompt else "one")
    assert profile.fold_summaries(fresh, due, people, store, flaky, lines_per_request=10).collect() == []
    assert store.answers().count() == 2

    def down(prompt):
        raise RuntimeError("503")

    assert profile.fold_summaries(fresh, due, people, store, down, lines_per_request=10).collect() == []


def test_limit_usage_reads_the_days_and_keys_of_the_errors(spark, tmp_path):
    path = str(tmp_path / "calls")
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i), "p", f"m{i % 3}", "t", 5, 5, 1.0, "k") for i in range(24 * 20)]
    spark.createDataFrame(rows, tables.TABLES["llm_calls"]).withColumn("day", F.to_date("timestamp")).write.partitionBy("day").parquet(path)
    errors = spark.createDataFrame([(1, datetime(2024, 1, 15, 12), "k", "m0", "")], "id BIGINT, timestamp TIMESTAMP_NTZ, api_key_label STRING, model STRING, error_text STRING")
    out = limits.limit_usage_join(errors, tables.scan_table(spark, "llm_calls", path))
    assert (out.first().tokens_60s, out.first().tokens_24h) == (10 if (14 * 24 + 12) % 3 == 0 else 0, 90)


def test_profile_edits(spark):
    people = spark.createDataFrame([(1, "old taste", "old", 4)], "user_id BIGINT, taste_prompt STRING, preference_summary STRING, feedback_count_at_last_summary BIGINT")
    edits = spark.createDataFrame(
        [
            (1, 1, "summary", " fine ", datetime(2024, 1, 1)),
            (2, 1, "summary", "x" * 10_001, datetime(2024, 1, 2)),
            (3, 2, "taste", "jazz", datetime(2024, 1, 1)),
            (4, 2, "taste", "rock", datetime(2024, 1, 1)),
        ],
        "edit_id BIGINT, user_id BIGINT, field STRING, content STRING, edited_at TIMESTAMP_NTZ",
    )
    got = {r.user_id: (r.taste_prompt, r.preference_summary) for r in profile.profile_upsert(people, edits).collect()}
    assert got == {1: ("old taste", "fine"), 2: ("rock", "")}


def test_parse_scores(spark):
    replies = [
        (1, '[{"id": 1, "score": 2}, {"id": 2, "score": -1}, {"id": 3, "score": "0.5"}, {"id": 9, "score": 0.5}]'),
        (2, '```json\n[{"id": 1, "score": 0.5}]\n```'),
        (3, '[{"id": 1.0, "score": true}, {"id": 2.5, "score": 1}]'),
        (4, '[{"id": 1, "score": 0.5}, 7]'),
        (5, '{"id": 1, "score": 0.5}'),
        (6, "no"),
        (7, '[{"id": 1, "score": 0.1}, {"id": 1, "score": 0.9}, {"id": 1, "score": null}]'),
        (8, None),
        (9, "[]"),
    ]
    df = spark.createDataFrame(replies, "batch_no BIGINT, reply STRING")
    members = spark.createDataFrame([(b, i) for b, _ in replies for i in (1, 2, 3)], "batch_no BIGINT, id BIGINT")
    scores = scoring.parse_scores(df, members)
    got = {(r.batch_no, r.id): r.score for r in scores.collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.0, (2, 1): 0.5, (3, 1): 1.0, (7, 1): 0.9}
    coverage = {r.batch_no: (r.scored, r.missing_ids) for r in scoring.score_coverage(scores, members).collect()}
    assert coverage[1] == (2, [3]) and coverage[6] == (0, [1, 2, 3])


def test_every_scored_request_is_answered(spark):
    asked, answered = (all_jobs.QUERIES[name](spark, "/root/testdata/sf0.001").select("user_id").distinct().collect() for name in ("score_prompt", "score_infer"))
    assert sorted(asked) == sorted(answered) and any(r.user_id % 7 == 3 for r in asked)


def test_long_lists_come_in_parts(spark):
    clicks = feedback(spark, 46)
    people = spark.createDataFrame([(0, "t", "old", 3), (1, "t", "", 20)], PEOPLE)
    fresh, due = profile.recent_feedback_n(clicks, people), profile.summary_due(clicks, people)
    lists = profile.feedback_lists(fresh, lines_per_part=8, newest_first=True)
    titles = lambda text: re.findall(r'"E(\d+)"', text)
    parts = {r.part_no: sorted(map(int, titles(r.liked + r.disliked))) for r in lists.where("user_id = 0").collect()}
    assert parts == {0: list(range(30, 46, 2)), 1: list(range(14, 30, 2)), 2: list(range(6, 14, 2))}
    asked = {r.part_no: r.prompt for r in profile.summary_prompt(lists, due, people, continued=True).collect()}
    assert sorted(asked) == [0, 1, 2] and asked[0].startswith("CURRENT PROFILE:\nold") and profile.SUMMARY_RULES in asked[0]
    assert all(asked[i].startswith("CONTINUED EVENTS") and profile.SUMMARY_RULES not in asked[i] for i in (1, 2))


@pytest.mark.parametrize("name", ["feedback_lists", "summary_prompt"])
def test_lists_and_requests_have_their_further_parts(spark, name):
    assert all_jobs.QUERIES[name](spark, "/root/testdata/sf0.001").where("part_no > 0").count() > 0


def test_newest_clicks_are_ranked_without_their_texts(spark):
    plan = all_jobs.QUERIES["recent_feedback"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(plan) if re.match(r"[ :+-]*Window \[", line))
    end = next((i for i in range(at + 1, len(plan)) if depth(plan[i]) <= depth(plan[at])), len(plan))
    below = [line for line in plan[at:end] if "Relation [" not in line]
    assert len(below) > 2 and not any("text#" in line or "event_description" in line for line in below)
