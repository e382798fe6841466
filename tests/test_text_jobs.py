import random
import uuid

import completers
import pytest
from completers import offline_completer
from pyspark import cloudpickle
from pyspark.sql import functions as F

from eventloom.operators import extraction, inference, pagetext
from eventloom.sources import answers
from eventloom.sources.answers import AnswerStore
from eventloom.sources.tables import scan_pages, scan_registry

cloudpickle.register_pickle_by_value(completers)
REGISTRY = "site_key STRING, head STRING, tail STRING, display_name STRING"


def test_trim(spark):
    registry = spark.createDataFrame(
        [("both", "HEAD", "TAIL", None), ("head", "HEAD", None, None), ("none", None, None, None)], REGISTRY
    )
    cases = [
        ("both", "xHEADyTAILz", "y"),
        ("both", "TAILxHEADyTAILz", "y"),  # a tail before the head does not count
        ("both", "xyTAILz", "xy"),  # tail applies without a head
        ("both", "xHEADyHEADz", "yHEADz"),
        ("head", "xHEADyTAILz", "yTAILz"),
        ("none", "xHEADyTAILz", "xHEADyTAILz"),
        ("unknown", "xHEADy", "xHEADy"),
        ("both", "HEADTAIL", ""),
    ]
    df = spark.createDataFrame([(i, s, t) for i, (s, t, _) in enumerate(cases)], "page_id INT, site_key STRING, text STRING")
    got = {r.page_id: r.text for r in pagetext.trim_boilerplate(df, registry).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, _, want in cases]


def chunks_by_hand(text, size, overlap):
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while True:
        out.append(text[start : start + size])
        if start + size >= len(text):
            return out
        start += size - overlap


def test_chunks_cover_the_text(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcé\n🎉 ") for _ in range(n)) for n in (0, 1, 19, 20, 21, 35, 36, 100, 333)]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id INT, text STRING")
    rows = pagetext.chunk_text(df, size=20, overlap=5).collect()
    for i, text in enumerate(texts):
        mine = sorted((r.chunk_no, r.text, r.is_last) for r in rows if r.page_id == i)
        assert [t for _, t, _ in mine] == chunks_by_hand(text, 20, 5)
        assert [last for *_, last in mine] == [False] * (len(mine) - 1) + [True]
        assert mine[0][1] + "".join(t[5:] for _, t, _ in mine[1:]) == text


def test_inject_dates(spark):
    df = spark.createDataFrame([(1, 2023, 2, "1\n28\n29\n05\n 7\nx 3\n31"), (2, 2024, 3, "31\n5")], "page_id INT, year INT, month INT, text STRING")
    got = {r.page_id: r.text for r in pagetext.inject_dates(df).collect()}
    assert got[1] == "February 1, 2023:\nFebruary 28, 2023:\n29\n05\n 7\nx 3\n31"
    assert got[2] == "March 31, 2024:\nMarch 5, 2024:"


def test_tidy_drops_export_links(spark):
    text = "a\n\n\n\nGoogle Calendar [http://www.google.com/calendar/event?x=1]\nICS [/e/1?format=ical]\n b \t c"
    got = spark.createDataFrame([(text,)], "t STRING").select(pagetext.tidy(F.col("t"))).first()[0]
    assert got == "a\n\n b c"


def test_flags(spark):
    long = "word " * 40
    df = spark.createDataFrame(
        [(1, "s", ""), (2, "s", " \n "), (3, "s", "Please wait"), (4, "s", long), (5, "s", long + "LOADING..."), (6, "s", None)],
        "page_id INT, site_key STRING, text STRING",
    )
    got = {r.page_id: r.flags for r in pagetext.placeholder_flags(df).collect()}
    assert got == {1: ["empty"], 2: ["empty"], 3: ["very short", "please wait"], 4: [], 5: ["loading..."], 6: ["empty"]}
    pages = spark.createDataFrame(
        [(1, "s", "<TITLE>403 Forbidden</TITLE> Access Denied captcha"), (2, "s", "x" * 3000 + "captcha"), (3, "s", "Just a moment" + "x" * 3000)],
        "page_id INT, site_key STRING, html STRING",
    )
    got = {r.page_id: r.flags for r in pagetext.bot_block_flags(pages).collect()}
    assert got == {1: ["access denied", "captcha", "title 403", "very short"], 2: [], 3: ["just a moment"]}


def test_clean_pages_end_to_end(spark, tmp_path):
    folder = tmp_path / "site_a"
    folder.mkdir()
    (folder / "p1.html").write_text("<body><main>Hello   <a href='/e'>there</a>\n</main>out</body>")
    pages = scan_pages(spark, str(tmp_path), layout="html")
    row = pagetext.clean_pages(pages).first()
    assert (row.site_key, row.text) == ("site_a", "Hello\nthere [/e]")


RESPONSES = [
    (1, 1, True, '{"events":[{"title":"A","url":null,"extra":1}],"next_page_url":null}', "ok", 1),
    (2, 1, True, '{"events":[{"title":"A"},{"title":"B"},{"title":"C', "salvaged", 2),
    (3, 1, True, '{"events":[{"title":"A"', "failed", 0),
    (4, 1, True, "", "failed", 0),
    (5, 1, True, None, "failed", 0),
    (6, 1, True, "[1, 2]", "failed", 0),
    (7, 1, True, '{"next_page_url":"https://x"}', "ok", 0),
    (8, 1, True, '{"a":{"b":1},"c', "failed", 0),  # repaired text parses nowhere
    (9, 1, True, ' {"events":[]}', "ok", 0),
]


def test_parse_responses(spark):
    df = spark.createDataFrame([r[:4] for r in RESPONSES], "page_id INT, chunk_no INT, is_last BOOLEAN, content STRING")
    got = {r.page_id: (r.status, len(r.events or [])) for r in extraction.parse_responses(df).collect()}
    assert got == {r[0]: r[4:] for r in RESPONSES}


def test_dedup_keeps_single_chunk_pages(spark):
    rows = [(1, 1, True, 0, "A"), (1, 1, True, 1, "a"), (1, 1, True, 2, ""), (2, 1, False, 0, "X"), (2, 2, True, 0, " x "), (2, 2, True, 1, " "), (2, 2, True, 2, "Y")]
    df = spark.createDataFrame(rows, "page_id INT, chunk_no INT, is_last BOOLEAN, pos INT, title STRING")
    got = sorted((r.page_id, r.chunk_no, r.pos) for r in extraction.dedup_in_page(df).collect())
    assert got == [(1, 1, 0), (1, 1, 1), (1, 1, 2), (2, 1, 0), (2, 2, 2)]


KEYS = "page_id INT, chunk_no INT"


def requests_of(spark, prompts):
    return spark.createDataFrame([(i, 1, p) for i, p in enumerate(prompts)], f"{KEYS}, prompt STRING")


def counted(path, bad="bad"):
    """A completer that leaves a file for every call."""

    def answer(prompt):
        with open(f"{path}/{uuid.uuid4().hex}", "w") as f:
            f.write(prompt)
        if bad in prompt:
            raise RuntimeError("503 from server")
        return inference.Completion(prompt.upper(), 3, None)

    return answer


def calls(path):
    return sorted(p.read_text() for p in path.iterdir())


def test_a_failed_call_is_recorded_and_sent_again(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    store = AnswerStore(spark, str(tmp_path / "answers"), KEYS)
    df = requests_of(spark, ["good", "bad"])
    got = {r.page_id: (r.content, r.prompt_tokens, r.completion_tokens, r.error) for r in inference.infer_chunks(df, store, counted(log)).collect()}
    assert got == {0: ("GOOD", 3, None, None), 1: (None, None, None, "503 from server")}
    got = {r.page_id: (r.content, r.error) for r in store.complete(df, counted(log, bad="never")).collect()}
    assert got == {0: ("GOOD", None), 1: ("BAD", None)}
    assert calls(log) == ["bad", "bad", "good"]
    # A changed text is a new request; the answer to the old one is not given for it.
    changed = requests_of(spark, ["better", "bad"])
    assert {r.content for r in store.complete(changed, counted(log, bad="never")).collect()} == {"BETTER", "BAD"}
    assert calls(log) == ["bad", "bad", "better", "good"]
    times = [r.asked_at for r in store.answers().collect()]
    assert len(times) == 3 and len(set(times)) == 3


def test_no_second_call_after_a_crash(spark, tmp_path, monkeypatch):
    log = tmp_path / "log"
    log.mkdir()
    store = AnswerStore(spark, str(tmp_path / "answers"), KEYS)
    df = requests_of(spark, [f"p{i}" for i in range(40)])
    commit, seen = store.commit, []

    def crashing(answers, name=None):
        if len(seen) == 2:
            raise RuntimeError("driver lost")
        seen.append(1)
        commit(answers, name)

    with monkeypatch.context() as broken:
        broken.setattr(store, "commit", crashing)
        with pytest.raises(RuntimeError):
            store.complete(df, counted(log), batch=10)
    done = store.answers().count()
    assert 0 < done < 40 and len(calls(log)) == done
    again = AnswerStore(spark, str(tmp_path / "answers"), KEYS)
    assert sorted(r.content for r in again.complete(df, counted(log), batch=10).collect()) == sorted(f"P{i}" for i in range(40))
    assert calls(log) == sorted(f"p{i}" for i in range(40))
    assert again.complete(df, counted(log)).count() == 40 and len(calls(log)) == 40


def test_parts_of_answers_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(answers, "PARTS", 3)
    store = AnswerStore(spark, str(tmp_path), KEYS)
    for i in range(9):
        store.commit(spark.sql(f"SELECT {i} AS page_id, 1 AS chunk_no, 'h' AS prompt_hash, '{i}' AS content, 1L AS prompt_tokens, 1L AS completion_tokens, 0D AS duration_seconds, CAST(NULL AS STRING) AS error, TIMESTAMP_NTZ'2024-01-01' AS asked_at"), str(i))
        store.commit(spark.sql("SELECT 1"), str(i))  # known: not even read
    assert sorted(r.content for r in store.answers().collect()) == [str(i) for i in range(9)]
    assert len(list(tmp_path.glob("part-*"))) <= 7


def test_extraction_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "s", 1, True, "Big Show 2024-05-01\nnothing here", "u")], "page_id BIGINT, site_key STRING, chunk_no BIGINT, is_last BOOLEAN, text STRING, url STRING")
    registry = spark.createDataFrame([("s", "Site S")], "site_key STRING, display_name STRING")
    store = AnswerStore(spark, str(tmp_path), inference.CHUNK_KEYS)
    found = inference.infer_chunks(pagetext.build_prompts(chunks, registry), store, offline_completer)
    event = extraction.explode_events(extraction.parse_responses(found)).first()
    assert (event.title, event.date, event.site_key) == ("Big Show", "2024-05-01", "s")
    log = inference.call_log(found, ["page_id"], provider="p", model="m", call_type="scraping", api_key_label="k")
    assert log.first().timestamp == found.first().asked_at


def test_dedup_reads_its_rows_once(spark):
    df = spark.createDataFrame([(1, 1, False, 0, "A", "x" * 50)], "page_id INT, chunk_no INT, is_last BOOLEAN, pos INT, title STRING, description STRING")
    plan = extraction.dedup_in_page(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "SortAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_registry_defaults(spark):
    df = spark.read.schema("site_key STRING, display_name STRING, url STRING, use_browser BOOLEAN, wait_secs INT, max_pages INT, note STRING, pagination STRUCT<type: STRING, months: INT, url_template: STRING, param_name: STRING, start_index: INT, param_pattern: STRING, inject_dates: BOOLEAN>, head STRING, tail STRING").json(
        spark.createDataFrame([('{"site_key":"a","url":"https://a/{today}/{x}","max_pages":2}',)], "value STRING").rdd.map(lambda r: r[0])
    )
    row = scan_registry(df).first()
    assert (row.start_url, row.pagination_type, row.months, row.start_index) == ("https://a/", "llm", 3, 1)
