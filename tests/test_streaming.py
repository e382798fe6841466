"""Streams that see their rows in several batches end where the batch jobs end."""

import os
import time
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from eventloom.operators.catalog import catalog_rows, merge_catalog, prepare_events
from eventloom.plans import all_jobs, fixtures
from eventloom.streaming import catalog, feedback, usage

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
AS_OF = fixtures.CATALOG_AS_OF


def in_files(spark, df, path, order, parts=3):
    """Write ``df`` as a few files, one after the other, since a stream takes the oldest file first."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], df.schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_catalog_in_batches(spark, tmp_path):
    events = fixtures.view(spark, SF_DIR, "fx_extracted")
    old = fixtures.view(spark, SF_DIR, "fx_catalog")
    registry = fixtures.registry(spark, SF_DIR)
    stream = in_files(spark, events, str(tmp_path / "in"), "row_id")
    out = str(tmp_path / "out")
    catalog.stream_catalog(stream, old, registry, out, str(tmp_path / "cp"), as_of=AS_OF).awaitTermination()
    got = catalog.stored_catalog(spark, out)
    want = merge_catalog(old, catalog_rows(prepare_events(events, old, as_of=AS_OF), registry))
    key = ["title", "date", "source", "url"]
    assert sorted(map(str, got.select(key).collect())) == sorted(map(str, want.select(key).collect()))
    assert got.select("id").distinct().count() == got.count()

    # A batch that was committed is not added again; one that was written but not committed is.
    last = spark.createDataFrame(events.orderBy("row_id").collect()[-333:], events.schema)
    before = sorted(map(str, got.select("id", *key).collect()))
    merge = catalog.merge_batch(registry, out, AS_OF)
    merge(last, 2)
    assert before == sorted(map(str, catalog.stored_catalog(spark, out).select("id", *key).collect()))
    later = last.withColumn("title", F.concat("title", F.lit(" II")))
    last.limit(5).write.parquet(f"{out}/part-3")  # left behind by a crash
    merge(later, 3)
    again = catalog.stored_catalog(spark, out)
    assert again.count() > len(before) and again.select("id").distinct().count() == again.count()


def test_a_batch_reads_its_months_alone(spark, tmp_path):
    out = str(tmp_path)
    rows = [(i, f"T{i}", datetime(2024, 1 + i % 6, 1)) for i in range(60)] + [(60, "none", None)]
    frame = spark.createDataFrame(rows, "id BIGINT, title STRING, date TIMESTAMP_NTZ")
    store = catalog.CatalogStore(spark, out)
    store.start(frame.where("id < 30"))
    store.start(frame)  # has begun
    store.append(frame.where("id >= 30"), 0)
    some = store.read(["2024-02", "2024-05", "2030-01"])
    assert sorted({r.date.month for r in some.collect()}) == [2, 5] and some.count() == 20
    assert {part.split("month=")[1].split("/")[0] for part in some.inputFiles()} == {"2024-02", "2024-05"}
    assert store.highest() == 60 and store.read().count() == 61
    assert store.read([]).count() == 0


def test_parts_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "PARTS", 3)
    store = catalog.CatalogStore(spark, str(tmp_path))
    frame = spark.createDataFrame([(i, f"T{i}", datetime(2024, 1 + i % 6, 1)) for i in range(60)], "id BIGINT, title STRING, date TIMESTAMP_NTZ")
    store.start(frame.where("id < 30"))
    for i in range(10):
        held = store.read()
        store.append(frame.where(F.col("id").between(30 + 3 * i, 32 + 3 * i)), i)
        assert held.count() == 30 + 3 * i  # a plan made before the merge still works
    assert sorted(r.id for r in store.read().collect()) == list(range(60))
    assert len(list(tmp_path.glob("part-*"))) <= 8


def test_usage_in_batches(spark, tmp_path):
    calls = fixtures.view(spark, SF_DIR, "fx_llm_calls")
    whole = in_files(spark, calls, str(tmp_path / "one"), "timestamp", parts=1)
    split = in_files(spark, calls, str(tmp_path / "many"), "timestamp")
    results = []
    for name, stream in (("one", whole), ("many", split)):
        windows = usage.stream_usage(stream)
        out = str(tmp_path / f"{name}-out")
        usage.write_closed(windows, out, str(tmp_path / f"{name}-cp")).awaitTermination()
        results.append(sorted(map(str, spark.read.parquet(out).select(windows.columns).collect())))
    assert results[0] == results[1] and len(results[0]) > 100


def test_late_calls_are_counted(spark, tmp_path):
    start = datetime(2024, 1, 1)
    calls = [(i, start + timedelta(minutes=10 * i), "m", "k", 1, 1) for i in range(60)]
    late = [(100 + i, start + timedelta(minutes=i), "m", "k", 1, 1) for i in range(7)]
    schema = "id BIGINT, timestamp TIMESTAMP_NTZ, model STRING, api_key_label STRING, prompt_tokens BIGINT, completion_tokens BIGINT"
    batches = [calls[:30], calls[30:50], calls[50:55] + late[:3], calls[55:] + late[3:]]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    listener = usage.LateRows(spark, str(tmp_path / "late"))
    spark.streams.addListener(listener)
    try:
        usage.write_closed(usage.stream_usage(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        deadline = time.time() + 20
        while time.time() < deadline and len(list((tmp_path / "late").glob("*.json"))) < 2:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    # Plainly: calls whose hour had closed an hour before the newest call of two batches ago and more. Calls of
    # one hour, model and key in a file are summed up before they are dropped.
    newest = [max(r[1] for batch in batches[: n + 1] for r in batch) for n in range(len(batches))]
    want = 0
    for n in range(2, len(batches)):
        gone = [r for r in batches[n] if r[1].replace(minute=0) + timedelta(hours=1) <= newest[n - 2] - timedelta(hours=1)]
        want += len({(r[1].replace(minute=0), r[2], r[3]) for r in gone})
    assert want and usage.late_rows(spark, str(tmp_path / "late")).agg(F.sum("dropped")).first()[0] == want


CLICKS = "click_id BIGINT, user_id BIGINT, event_id BIGINT, interested BOOLEAN, created_at TIMESTAMP_NTZ, arrived_at TIMESTAMP"
EVENTS = "id BIGINT, title STRING, description STRING, source STRING, category STRING, venue STRING, arrived_at TIMESTAMP"


def test_feedback_waits_for_its_event(spark, tmp_path):
    """Clicks and events in several batches: each is kept once with its content, or leaves as a reject."""
    start = datetime(2024, 1, 1)
    click = lambda i, event, minute, user=1: (i, user, event, i % 2 == 0, start + timedelta(minutes=minute), start + timedelta(minutes=minute))
    event = lambda i, minute: (i, f"E{i}", "d", "s", "c", None, start + timedelta(minutes=minute))
    clicks = [
        [click(i, 1, 1) for i in range(9)] + [click(50, 2, 2), click(51, 99, 2), (60, 1, None, True, start, start)],
        [click(9, 1, 30)],
        [click(10, 1, 100, user=2), click(52, 98, 100)],
        [click(i, 2, 3000) for i in range(20, 32)],
    ]
    events = [[event(1, 0)], [event(2, 40)], [event(3, 100)], [event(4, 3000)]]
    sources = {"clicks": (clicks, CLICKS), "events": (events, EVENTS)}
    for name in sources:
        (tmp_path / name).mkdir()
    streams = {n: spark.readStream.schema(schema).parquet(str(tmp_path / n)) for n, (_, schema) in sources.items()}
    out, due_out = str(tmp_path / "feedback"), str(tmp_path / "due")
    people = spark.createDataFrame([(1, 0), (2, 5)], "user_id BIGINT, feedback_count_at_last_summary BIGINT")
    reported = []
    for number in range(4):
        for name, (batches, schema) in sources.items():
            spark.createDataFrame(batches[number], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        rows = feedback.stream_feedback(streams["clicks"], streams["events"], wait=timedelta(hours=24))
        feedback.write_stream(rows, out, str(tmp_path / "cp"), by="status").awaitTermination()
        kept = spark.readStream.schema(feedback.FEEDBACK).parquet(out).where("status = 'kept'")
        feedback.write_stream(feedback.stream_due(kept, people), due_out, str(tmp_path / "due-cp")).awaitTermination()
        reported.append(sorted((r.user_id, r.total) for r in spark.read.parquet(due_out).collect()))
    stored = spark.read.schema(feedback.FEEDBACK).parquet(out).collect()
    assert len({r.click_id for r in stored}) == len(stored)
    kept = {r.click_id: (r.event_title, r.event_venue) for r in stored if r.status == "kept"}
    assert kept == {**{i: ("E1", None) for i in range(11)}, 50: ("E2", None), **{i: ("E2", None) for i in range(20, 32)}}
    # Both clicks on unknown events have left: their time was up when the last batch came.
    assert {r.click_id: r.reason for r in stored if r.status == "rejected"} == {
        51: "Event not found", 52: "Event not found", 60: "event_id is required",
    }
    # User 1 has clicks 0-9 and 50 after two batches, 20-31 in the end: once per ten.
    assert reported == [[], [(1, 10)], [(1, 10)], [(1, 10), (1, 20)]]


def test_clicks_wait_in_groups(spark, tmp_path, monkeypatch):
    """Events are stored once, ids stay exact, and clicks of one group leave each at its own time."""
    monkeypatch.setattr(feedback, "GROUPS", 1, raising=False)
    start, large = datetime(2024, 1, 1), 2**60 + 1
    click = lambda i, event, minute, user=1: (i, user, event, i % 2 == 0, start + timedelta(minutes=minute), start + timedelta(minutes=minute))
    event = lambda i, minute, title=None: (i, title or f"E{i}", "d", "s", "c", None, start + timedelta(minutes=minute))
    clicks = [
        [*[click(i, 1, 1) for i in range(5)], click(51, 99, 2), click(large, 2, 5, user=None), click(52, 98, 10), click(53, 98, 10, user=large)],
        [click(6, 1, 65)],
        [click(7, 2, 66)],
        [],
    ]
    events = [[event(1, 0)] + [event(i, 0) for i in range(1000, 1200)], [event(2, 65), event(1, 65, "new"), event(1, 64, "old")], [], [event(3, 200)]]
    sources = {"clicks": (clicks, CLICKS), "events": (events, EVENTS)}
    for name in sources:
        (tmp_path / name).mkdir()
    streams = {n: spark.readStream.schema(schema).parquet(str(tmp_path / n)) for n, (_, schema) in sources.items()}
    out, gone = str(tmp_path / "feedback"), []
    for number in range(4):
        for name, (batches, schema) in sources.items():
            if batches[number]:
                spark.createDataFrame(batches[number], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        rows = feedback.stream_feedback(streams["clicks"], streams["events"], wait=timedelta(hours=1))
        query = feedback.write_stream(rows, out, str(tmp_path / "cp"))
        query.awaitTermination()
        if number == 0:
            assert 201 <= query.lastProgress["stateOperators"][0]["numRowsTotal"] < 300
        stored = spark.read.schema(feedback.FEEDBACK).parquet(out).collect()
        gone.append(sorted(r.click_id for r in stored if r.status == "rejected"))
    kept = {r.click_id: (r.event_id, r.event_title, r.user_id, r.interested, r.created_at) for r in stored if r.status == "kept"}
    at = lambda minute: start + timedelta(minutes=minute)
    assert kept == {
        **{i: (1, "E1", 1, i % 2 == 0, at(1)) for i in range(5)}, large: (2, "E2", None, False, at(5)),
        6: (1, "new", 1, True, at(65)), 7: (2, "E2", 1, False, at(66)),
    }
    assert gone == [[], [51], [51], [51, 52, 53]] and len(stored) == 11
    assert {r.click_id: (r.event_id, r.user_id, r.reason) for r in stored if r.status == "rejected"} == {
        51: (99, 1, "Event not found"), 52: (98, 1, "Event not found"), 53: (98, large, "Event not found"),
    }


def test_users_are_counted_in_groups():
    """One call counts many users, those of the profile and others."""
    state = {}
    counts = SimpleNamespace(getValue=lambda key: state.get(key), updateValue=state.__setitem__)
    due = feedback._Due(10)
    due.init(SimpleNamespace(getMapState=lambda *schema: counts))
    due.handleInitialState((0,), pd.DataFrame({"user_id": [1, 2], "counted": [0, 5]}), None)
    batches = [[[(1, 4), (2, 14)], [(1, 6), (3, 25)]], [[(2, 1), (3, 4)]], [[(1, 1), (3, 1)]]]
    found = []
    for parts in batches:
        rows = (pd.DataFrame(part, columns=["user_id", "clicks"]) for part in parts)
        found.append(sorted(row for out in due.handleInputRows((0,), rows, None) for row in out.itertuples(index=False, name=None)))
    assert found == [[(1, 10, 10), (3, 10, 10), (3, 20, 10)], [(2, 15, 10)], [(3, 30, 10)]]
    assert state == {(1,): (11, 10), (2,): (15, 15), (3,): (30, 30)}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The given tables as folders of several files, beside a table whose name begins like another's."""
    base = tmp_path_factory.mktemp("folders")
    for name in ("pages", "documents", "labels", "events"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").repartition(3).write.parquet(f"{base}/{name}.parquet")
    spark.read.parquet(f"{SF_DIR}/pages.parquet").write.parquet(f"{base}/pages_old.parquet")
    return str(base)


@pytest.mark.parametrize("name", ["stream_pages", "stream_snapshots", "stream_feedback", "stream_usage"])
def test_streams_read_tables_of_several_files(spark, folders, name):
    assert difference(all_jobs.QUERIES[name](spark, folders), connect(SF_DIR), all_jobs.CHECKS[name]) is None
