from datetime import datetime

import pytest
from pyspark.sql import functions as F

from eventloom.operators import catalog, crawlplan, export, health, listing
from eventloom.sources import sinks, tables

AS_OF = "2024-02-15 00:00:00"
EVENT = "row_id BIGINT, source STRING, title STRING, date STRING, end_date STRING, time STRING, url STRING, venue STRING, description STRING"
STORED = "id BIGINT, title STRING, description STRING, venue STRING, source STRING, category STRING, date TIMESTAMP_NTZ, url STRING, score DOUBLE, pinned BOOLEAN"


def events(spark):
    rows = [
        (1, "s", " A ", "2024-03-01", None, "8:00 PM", "/e/1", "V", "d"),
        (2, "t", "A", "2024-03-01", None, "8:00 PM", "x", "V", "d"),  # same title and moment, other source
        (3, "s", "A", "2024-03-02", None, "8:00 PM", None, "", None),
        (4, "s", " ", "2024-03-01", None, None, None, None, None),
        (5, "s", "Old", "2024-01-01", None, None, None, None, None),
        (6, "s", "Runs", "2024-01-01", "2024-03-01", None, " http://x/y ", None, None),
        (7, "s", "Stored", "2024-03-03", None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, EVENT)


def stored(spark):
    return spark.createDataFrame([(41, "Stored", "", "", "s", "general", datetime(2024, 3, 3, 12, 34), "", None, False)], STORED)


def test_outcomes_and_merge(spark):
    old = stored(spark)
    classed = catalog.prepare_events(events(spark), old, as_of=AS_OF)
    outcome = {r.row_id: r.outcome for r in classed.collect()}
    assert outcome == {1: "added", 2: "duplicate", 3: "added", 4: "no_title", 5: "past", 6: "added", 7: "duplicate"}

    registry = spark.createDataFrame([("s", "https://h.org/list")], "site_key STRING, url STRING")
    rows = catalog.catalog_rows(classed, registry)
    merged = catalog.merge_catalog(old, rows)
    got = {r.id: (r.title, r.url) for r in merged.collect()}
    assert got == {41: ("Stored", ""), 42: ("A", "https://h.org/e/1"), 43: ("A", ""), 44: ("Runs", "http://x/y")}
    assert catalog.merge_catalog(merged, rows).count() == merged.count()  # a second merge adds nothing

    summary = catalog.run_summary(classed, spark.createDataFrame([("s", "abc")], "site_key STRING, text STRING"), as_of=AS_OF)
    s = {r.source: r for r in summary.collect()}["s"]
    assert s.events_found == s.events_added + s.skipped_past + s.skipped_duplicate + s.skipped_no_title == 6
    # Old, Stored and the second A have no link; the untitled one is not counted.
    assert (s.missing_url, s.missing_time, s.missing_venue) == (3, 3, 4)
    assert s.month_distribution == '{"2024-02":1,"2024-03":3}'


def test_crawl_plan(spark):
    sites = spark.createDataFrame(
        [
            ("m", "", "multi_month", 3, "u/{month_name}/{month:02d}/{month}-{year}/{other}", "page", 1, None, 5),
            ("p0", "https://x/l", "url_param", 3, None, "page", 0, None, 2),
            ("p1", "https://x/l?page=1&a=2", "url_param", 3, None, "page", 1, None, 2),
            ("p2", "https://x/l?a=2", "url_param", 3, None, "p", 1, None, 2),
            ("p3", "https://x/(pageindex=1)", "url_param", 3, None, "pageindex", 2, None, 1),
        ],
        "site_key STRING, url STRING, pagination_type STRING, months INT, url_template STRING, param_name STRING, start_index INT, param_pattern STRING, max_pages INT",
    ).withColumn("inject_dates", F.lit(False))
    months = [r.url for r in crawlplan.expand_month_urls(sites, as_of="2024-01-31").orderBy("page_no").collect()]
    # 30-day steps from Jan 31 give Mar 1 and Mar 31: February is skipped, March repeated.
    assert months == ["u/january/01/1-2024/{other}", "u/march/03/3-2024/{other}", "u/march/03/3-2024/{other}"]
    params = {(r.site_key, r.page_no): r.url for r in crawlplan.expand_param_urls(sites).collect()}
    assert params == {
        ("p0", 0): "https://x/l?page=0",
        ("p0", 1): "https://x/l?page=1",
        ("p1", 0): "https://x/l?page=1&a=2",
        ("p1", 1): "https://x/l?page=2&a=2",
        ("p2", 0): "https://x/l?a=2",
        ("p2", 1): "https://x/l?a=2&p=2",
        ("p3", 0): "https://x/(pageindex=2)",
    }


def test_follow_links_stops_at_loops_and_limits(spark):
    registry = spark.createDataFrame([("a", 3), ("b", 9)], "site_key STRING, max_pages INT")
    starts = spark.createDataFrame([("a", "http://a/1"), ("b", "http://b/1")], "site_key STRING, url STRING")
    links = spark.createDataFrame(
        [("a", f"http://a/{i}", f"http://a/{i + 1}") for i in range(1, 9)] + [("b", "http://b/1", "http://b/2"), ("b", "http://b/2", "http://b/1")],
        "site_key STRING, url STRING, next_page_url STRING",
    )
    got = sorted((r.url, r.page_no) for r in crawlplan.follow_links(starts, links, registry).collect())
    assert got == [("http://a/1", 1), ("http://a/2", 2), ("http://a/3", 3), ("http://b/1", 1), ("http://b/2", 2)]


def fold_by_hand(line):
    parts, rest = [line[:75]], line[75:]
    while rest:
        parts.append(" " + rest[:74])
        rest = rest[74:]
    return "\r\n".join(parts)


def test_ics_text(spark):
    lines = ["", "x" * 75, "x" * 76, "y" * 149, "y" * 150, "é🎉" * 200]
    df = spark.createDataFrame([(t,) for t in lines], "t STRING").select("t", export.ics_fold(F.col("t")).alias("f"))
    assert all(r.f == fold_by_hand(r.t) for r in df.collect())
    got = spark.createDataFrame([("a\\b;c,d\r\ne\nf\rg",)], "t STRING").select(export.ics_escape(F.col("t"))).first()[0]
    assert got == "a\\\\b\\;c\\,d\\ne\\nf\\ng"


def test_large_calendars_are_one_document(spark, tmp_path):
    rows = [(i, f"T{i}", "", "", "s" if i < 1501 else None, "general", datetime(2024, 3, 1 + i % 5, 12, 34), "", None, True) for i in range(1510)]
    lines = export.export_ics(spark.createDataFrame(rows, STORED), F.col("source"), as_of=AS_OF)
    sinks.sink_ics(lines, str(tmp_path / "out"))
    want = {"s": rows[:1501], None: rows[1501:]}
    for calendar, own in want.items():
        texts = [r.text for r in sorted((r for r in lines.collect() if r.calendar == calendar), key=lambda r: r.seq)]
        document = "".join(t + "\r\n" for t in texts)
        order = [line[8:] for line in document.split("\r\n") if line.startswith("SUMMARY:")]
        assert order == [r[1] for r in sorted(own, key=lambda r: (r[6], r[0]))]
        assert document.startswith("BEGIN:VCALENDAR\r\n") and document.endswith("END:VCALENDAR\r\n")
        folder = tmp_path / "out" / f"calendar={calendar or '__HIVE_DEFAULT_PARTITION__'}"
        assert "".join(p.read_bytes().decode() for p in sorted(folder.glob("*.txt"))) == document


def test_month_bounds():
    assert listing.month_bounds(2024, 0) == (datetime(2023, 12, 1), datetime(2023, 12, 31, 23, 59, 59))
    assert listing.month_bounds(2024, 13) == (datetime(2025, 1, 1), datetime(2025, 1, 31, 23, 59, 59))
    assert listing.month_bounds(2024, 2)[1] == datetime(2024, 2, 29, 23, 59, 59)


def test_a_run_is_evaluated_once(spark):
    """Rows and summary read what was stored; the extraction's own plan is in neither."""
    ran = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            ran.add(batch.num_rows)
            yield batch

    old = spark.createDataFrame([], STORED)
    extracted = events(spark)
    once = extracted.mapInArrow(counting, extracted.schema)
    registry = spark.createDataFrame([("s", "https://s.org/x")], "site_key STRING, url STRING")
    pages = spark.createDataFrame([("s", "text")], "site_key STRING, text STRING")
    classed = catalog.clamp_ongoing(catalog.normalize_dates(once, as_of=AS_OF), as_of=AS_OF)
    classed = catalog.classify_save(classed, old, as_of=AS_OF)
    before = ran.value
    rows, summary, totals = catalog.save_run(classed, registry, pages, as_of=AS_OF)
    stored_by = ran.value
    assert rows.count() == totals["added"] and summary.agg(F.sum("events_found")).first()[0] == totals["found"] == extracted.count()
    assert ran.value == stored_by > before


def test_sketched_months_are_close(spark):
    rows = [(i, f"s{i % 3}", datetime(2020 + i % 60, 1 + i % 12, 1 + i % 28)) for i in range(6000)]
    frame = spark.createDataFrame(rows, "id BIGINT, source STRING, date TIMESTAMP_NTZ")
    exact = {r.source: r.months for r in health.month_spread(frame, as_of=AS_OF).collect()}
    parts = [health.spread_sketches(frame.where(F.col("id") % 2 == k)) for k in (0, 1)]  # stored at two times
    got = {r.source: r.months for r in health.month_spread_estimate(parts[0].unionByName(parts[1]), as_of="2024-02-15 00:00:00").collect()}
    assert set(got) == set(exact) and all(abs(got[s] - exact[s]) <= 0.05 * exact[s] + 1 for s in exact)


STAGE = "site_key STRING, page_id INT"


def staged(spark, path):
    return sorted((r.site_key, r.page_id) for r in sinks.read_stage(spark, path).collect())


def test_stage_sink_goes_by_the_runs_sites(spark, tmp_path):
    path = str(tmp_path / "stage")
    sinks.sink_stage(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], STAGE), path, sites=["a", "b", "c"], run="1")
    # The new run covers a and c, and finds nothing on c. Rows of other sites are not its own.
    again = spark.createDataFrame([("a", 9), ("b", 7)], STAGE)
    sinks.sink_stage(again, path, sites=["a", "c"], run="2")
    assert staged(spark, path) == [("a", 9), ("b", 3)]
    sinks.sink_stage(again, path, sites=["a", "c"], run="2")
    assert staged(spark, path) == [("a", 9), ("b", 3)]
    only_b = sinks.read_stage(spark, path).where("site_key = 'b'")
    assert only_b.count() == 1


def test_a_crash_while_staging_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "stage")
    sinks.sink_stage(spark.createDataFrame([("a", 1)], STAGE), path, sites=["a"], run="1")

    def crash(self, state):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(sinks.Folders, "commit", crash)
        with pytest.raises(RuntimeError):
            sinks.sink_stage(spark.createDataFrame([("a", 2)], STAGE), path, sites=["a"], run="2")
    assert staged(spark, path) == [("a", 1)]
    sinks.sink_stage(spark.createDataFrame([("a", 2)], STAGE), path, sites=["a"], run="2")
    assert staged(spark, path) == [("a", 2)]


def test_run_log_has_failed_sources_and_survives_replays(spark, tmp_path):
    path = str(tmp_path / "runs")
    sites = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "site_key STRING")
    summary = spark.createDataFrame([("a", 5, 2), ("b", 4, 4)], "source STRING, events_found BIGINT, events_added BIGINT")
    outcomes = spark.createDataFrame(
        [("a", True, None, 1.5), ("b", False, "timeout", 30.0), ("c", True, None, 2.0)], "source STRING, success BOOLEAN, error_message STRING, duration_seconds DOUBLE"
    )
    rows = catalog.run_log(sites, summary, outcomes, as_of=AS_OF)
    for run in ("1", "2", "2", "1"):
        sinks.sink_run_log(rows, path, run=run)
    stored = tables.scan_table(spark, "source_runs", path)
    got = sorted(tuple(r) for r in stored.select("source", "events_found", "events_added", "success", "error_message", "duration_seconds").distinct().collect())
    assert got == [("a", 5, 2, True, None, 1.5), ("b", 0, 0, False, "timeout", 30.0), ("c", 0, 0, True, None, 2.0), ("d", 0, 0, False, "not run", None)]
    assert stored.count() == 8 and stored.select("id").distinct().count() == 8
    stats = {r.source: (r.total_runs, r.successful_runs, r.success_rate) for r in health.run_stats(stored).collect()}
    assert stats == {"a": (2, 2, 100.0), "b": (2, 0, 0.0), "c": (2, 2, 100.0), "d": (2, 0, 0.0)}
    no_ids = stored.withColumn("id", F.lit(None).cast("bigint"))
    assert {r.source: r.total_runs for r in health.run_stats(no_ids).collect()} == dict.fromkeys("abcd", 2)


def test_day_layout_is_pruned(spark, tmp_path):
    from eventloom.operators.usage import usage_24h

    path = str(tmp_path / "calls")
    rows = [(i, datetime(2024, 1, 1 + i, 12), "p", "m", "t", 1, 1, 1.0, "k") for i in range(20)]
    sinks.append_log(spark.createDataFrame(rows, tables.TABLES["llm_calls"]), path, "timestamp", run="r", key=["timestamp"])
    used = usage_24h(tables.scan_table(spark, "llm_calls", path), as_of="2024-01-20 12:00:00")
    assert used.first().calls == 2
    assert "day" in used._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]
