"""Streams give what batches give."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from threadlens.operators import reconstruct
from threadlens.streaming import events, pages

SF = "/root/testdata/sf0.001"


def test_wanted_edits(spark):
    def event(**change):
        return json.dumps({"wiki": "enwiki", "bot": False, "namespace": 1, "title": "Talk:A", "revision": {"old": 1, "new": 2}} | change)

    lines = [event(), event(wiki="dewiki"), event(bot=True), event(revision={"new": 2}), "{broken", event(namespace=0)]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [r.title for r in events.wanted_edits(df, "enwiki", [1, 3]).collect()] == ["Talk:A"]


def test_windows_agree_with_batch(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    counts = events.windowed_counts(stream, "ts", "1 hour", by=["event_type"])
    q = counts.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = source.groupBy(F.window("ts", "1 hour"), "event_type").count()
    assert sorted((r.start, r.event_type, r.n) for r in spark.table("hours").collect()) == sorted((r.window.start, r.event_type, r["count"]) for r in batch.collect())


def put(spark, folder, rows, schema, expr=None):
    """Write rows as the next file that a stream of the folder reads."""
    df = spark.createDataFrame(rows, schema)
    (df.selectExpr(*expr) if expr else df).coalesce(1).write.mode("append").parquet(str(folder))
    files = sorted(folder.glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    for n, f in enumerate(files):
        os.utime(f, (1_600_000_000 + n, 1_600_000_000 + n))


LIVE = "rev_id int, page_id string, sha1 string, ts timestamp"


def live(spark, path):
    return events.LiveRevisions(spark, str(path), LIVE, ["rev_id", "sha1"], ["rev_id"], buckets=8)


def revision_rows(spark, rows):
    return spark.createDataFrame(rows, "rev_id int, page_id string, sha1 string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_micro_batches_append_once_and_flag(spark, tmp_path):
    at = "2001-01-01 00:0{}:00".format
    first = revision_rows(spark, [(1, "p", "a", at(0)), (2, "p", "b", at(1)), (3, "p", "a", at(2)), (3, "p", "a", at(2)), (4, "p", "", at(3)), (5, None, "a", at(3))])
    first.write.parquet(str(tmp_path / "in"))
    events.run_available(spark.readStream.schema(first.schema).parquet(str(tmp_path / "in")), live(spark, tmp_path / "live").step, str(tmp_path / "check")).awaitTermination(120)
    table = live(spark, tmp_path / "live")
    ids = lambda df: sorted(r.rev_id for r in df.collect())
    assert ids(table.revisions()) == [1, 2, 3] and ids(table.reverted()) == [1, 2]
    # a batch that touches other pages only leaves the flags as they are
    table.step(revision_rows(spark, [(10, "q", "x", at(0)), (11, "q", "y", at(1))]), 1)
    assert ids(table.revisions()) == [1, 2, 3, 10, 11] and ids(table.reverted()) == [1, 2]
    # a page is flagged anew with all its rows; a batch given again changes nothing
    again = revision_rows(spark, [(12, "q", "x", at(2)), (2, "p", "b", at(1)), (6, "p", "b", at(4))])
    for _ in range(2):
        table.step(again, 2)
        assert ids(table.revisions()) == [1, 2, 3, 6, 10, 11, 12] and ids(table.reverted()) == [1, 2, 3, 10, 11]
    table.step(first.limit(0), 3)
    assert ids(table.reverted()) == [1, 2, 3, 10, 11]


def test_batches_that_die_around_their_commit(spark, tmp_path):
    """Rows and flags appear together: nothing of a batch that died before its commit, everything once after it."""
    from threadlens.sources import ledger

    at = "2001-01-01 00:0{}:00".format
    batch = revision_rows(spark, [(1, "p", "a", at(0)), (2, "p", "b", at(1)), (3, "p", "a", at(2))])
    table = live(spark, tmp_path / "live")

    class Dying(ledger._BatchWriter):
        def commit(self, messages):
            raise OSError("lost")

        def abort(self, messages):
            pass

    class DyingSource(ledger.LedgerSource):
        def writer(self, schema, overwrite):
            return Dying(self.options["path"], int(self.options["batch"]))

    spark.dataSource.register(DyingSource)
    with pytest.raises(Exception, match="lost"):
        table.step(batch, 0)
    table = live(spark, tmp_path / "live")
    assert table.revisions().count() == 0 and table.reverted().count() == 0 and not table.ledger.has(0)
    table.step(batch, 0)
    files = table.ledger.files().count()
    # after the commit, but before the stream knows: the same number again
    ledger._BatchWriter(str(tmp_path / "live"), 0).commit([])
    table.step(batch, 0)
    assert sorted(r.rev_id for r in table.revisions().collect()) == [1, 2, 3] and table.reverted().count() == 2 and table.ledger.files().count() == files
    assert table.ledger.vacuum() > 0 and table.ledger.vacuum() == 0 and table.revisions().count() == 3


def test_a_stream_into_a_ledger(spark, tmp_path):
    from threadlens.sources.ledger import Ledger

    for k in range(3):
        put(spark, tmp_path / "in", [(10 * k + i, f"p{i % 3}") for i in range(10)], "id long, page_id string")
    ledger = Ledger(spark, str(tmp_path / "ledger"), buckets=4)
    stream = spark.readStream.schema("id long, page_id string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ledger.stream(stream, "events", str(tmp_path / "check"), key="page_id").awaitTermination(120)
    assert sorted(r.id for r in ledger.read("events", "id long, page_id string").collect()) == list(range(30))
    assert ledger.files().select("batch").distinct().count() == 3
    one = spark.createDataFrame([("p1",)], "page_id string").select(ledger.bucket("page_id")).first()[0]
    got = {r.page_id for r in ledger.read("events", "id long, page_id string", [one]).collect()}
    assert "p1" in got
    assert ledger.read("none", "id long").count() == 0


REVISION = "rev_id long, timestamp string, text string, user_id string, user_text string, page_id string, page_title string"


def growing(page, n, minute=0):
    return [{"rev_id": 100 * minute + i, "timestamp": f"2001-01-01T00:{minute:02d}:{i:02d}Z", "text": "".join(f":line {k} of a page\n" for k in range(i + 1)), "user_id": None, "user_text": "u", "page_id": page, "page_title": "T"} for i in range(n)]


def run_pages(spark, tmp_path, late="1 hour", fold=None):
    stream = spark.readStream.schema(REVISION).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    writer = pages.reconstruct_stream(stream, late, fold).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
    with pages.state_on_disk(spark):
        q = writer.partitionBy("tag").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.read.schema(pages.PAGE_ROWS).parquet(str(tmp_path / "out"))


def test_pages_whose_revisions_come_in_any_order(spark, tmp_path):
    """Out of order over three batches, with a restart between them, the actions are the batch run's; late revisions go to their own output."""
    rows = growing("1", 6) + growing("2", 5, 1)
    for part in (rows[5::-3], rows[6:9][::-1] + [rows[1], rows[4]]):
        put(spark, tmp_path / "in", part, REVISION)
    run_pages(spark, tmp_path)  # stops in the middle
    put(spark, tmp_path / "in", [r for r in rows if r not in rows[5::-3] and r not in rows[6:9] and r not in (rows[1], rows[4])], REVISION)
    put(spark, tmp_path / "in", [rows[0] | {"page_id": "end", "timestamp": "2002-01-01T00:00:00Z"}], REVISION)
    out = run_pages(spark, tmp_path)
    batch, _, _ = reconstruct.reconstruct(spark.createDataFrame(rows, REVISION))
    names = list(pages.ACTION_COLUMNS)
    want = sorted(map(tuple, batch.select("page_id", *names).collect()), key=str)
    assert sorted(map(tuple, out.where("tag = 'action'").select("page_id", *names).collect()), key=str) == want
    assert out.where("tag <> 'action'").count() == 0
    put(spark, tmp_path / "in", [rows[2] | {"rev_id": 999}], REVISION)
    out = run_pages(spark, tmp_path)
    assert [(r.page_id, r.rev_id, r.content) for r in out.where("tag = 'late'").collect()] == [("1", 999, rows[2]["text"])]
    assert out.where("tag = 'action'").count() == len(want)


def test_a_broken_revision_stops_its_page_for_good(spark, tmp_path):
    from threadlens.operators.reconstruct import PageFold

    class Breaking(PageFold):
        def __init__(self, page):
            super().__init__(page)
            plain = self.fold.apply

            def apply(rev):
                if rev["rev_id"] == 2:
                    raise AssertionError("broken")
                return plain(rev)

            self.fold.apply = apply

    rows = growing("1", 6) + growing("2", 3, 1)
    put(spark, tmp_path / "in", rows[:3], REVISION)
    put(spark, tmp_path / "in", [rows[0] | {"page_id": "end", "timestamp": "2001-01-01T05:00:00Z"}], REVISION)
    out = run_pages(spark, tmp_path, "0 seconds", Breaking)
    assert [(r.page_id, r.rev_id) for r in out.where("tag = 'error'").collect()] == [("1", 2)]
    later = [r | {"timestamp": r["timestamp"].replace("T00", "T06")} for r in rows[3:]]
    put(spark, tmp_path / "in", later, REVISION)
    put(spark, tmp_path / "in", [rows[0] | {"page_id": "end", "timestamp": "2002-01-01T00:00:00Z"}], REVISION)
    out = run_pages(spark, tmp_path, "0 seconds", Breaking)
    batch, _, _ = reconstruct.reconstruct(spark.createDataFrame(rows[:3] + later, REVISION), errors=spark.createDataFrame([("1", 2)], "page_id string, rev_id long"))
    of_end = "page_id <> 'end' AND tag = 'action'"
    assert sorted(r.id for r in out.where(of_end).collect()) == sorted(r.id for r in batch.collect())
    assert out.where("tag = 'error'").count() == 1


def test_rows_in_time_order(spark, tmp_path):
    """Rows of each key go out by time over all batches once the watermark has passed; late ones have their own tag."""
    for rows in ([("p", 3), ("p", 1), ("q", 2), ("p", None), (None, 1)], [("p", 200), ("p", 100), ("p", 2)], [("q", 5), ("p", 400)], [("q", 399), ("end", 9000)], [("q", 8)]):
        put(spark, tmp_path / "in", rows, "page_id string, m long", ["page_id", "timestamp_seconds(60 * m) AS ts", "m"])
    seen, late = [], []

    def step(batch, n):
        got = batch.collect()
        seen.extend((r.page_id, r.m) for r in got if r.tag == "row")
        late.extend((r.page_id, r.m) for r in got if r.tag == "late")

    stream = spark.readStream.schema("page_id string, ts timestamp, m long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with pages.state_on_disk(spark):
        q = events.run_available(pages.in_time_order(stream, "page_id", "ts", "m", "30 minutes"), step, str(tmp_path / "check"))
    q.awaitTermination(300)
    assert q.exception() is None
    assert [m for p, m in seen if p == "p"] == [1, 2, 3, 100, 200, 400] and [m for p, m in seen if p == "q"] == [2, 399]
    assert late == [("q", 5), ("q", 8)]


def test_a_feed_that_is_stopped_and_started_again(spark, tmp_path):
    """Windows are asked for once each: nothing is lost or repeated over a restart, malformed lines are kept apart, a busy service is asked again."""
    from threadlens.sources import feed

    folder, clock = tmp_path / "asked", tmp_path / "now"
    folder.mkdir()

    def fetch(start, end):
        from pathlib import Path

        mark = Path(folder, f"{start}-{end}")
        if start == 7200 and not mark.exists():
            mark.touch()
            raise feed.Busy(0.01)
        with mark.open("a") as f:
            f.write("x")
        return ["{broken", ""] * (start == 3600) + [json.dumps({"wiki": "w", "bot": False, "title": f"{t}"}) for t in range(start, end, 600)]

    def run(now):
        clock.write_text(str(now))
        lines = feed.read_feed(spark, fetch, 3600, clock=lambda: float(clock.read_text()), wait=0.01)
        parsed = feed.parsed_events(lines).select("event.title", "malformed", "window_start")
        q = parsed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return spark.read.parquet(str(tmp_path / "out")).collect()

    assert run(5000) == []  # the first hour isn't over for an hour
    got = run(4 * 3600 + 1234)  # in the midst of the fifth hour: hours two and three
    assert sorted(int(r.title) for r in got if r.title) == list(range(3600, 10800, 600)) and [r.malformed for r in got if r.malformed] == ["{broken"]
    got = run(7 * 3600)
    assert sorted(int(r.title) for r in got if r.title) == list(range(3600, 6 * 3600, 600))
    assert all(p.read_text() == "x" for p in folder.iterdir())
    with pytest.raises(feed.Busy):
        feed.patiently(lambda a, b: (_ for _ in ()).throw(feed.Busy()), 0, 1, 2, 0.0)


def test_redelivered_and_late_events(spark, tmp_path):
    rows = [(1, 0), (1, 0), (2, 5), (3, 200), (4, 1)]
    spark.createDataFrame(rows, "id long, m long").selectExpr("id", "timestamp_seconds(60 * m + 86400) AS ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = events.once_each(stream, ["id"], "ts").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.id for r in spark.table("once").collect()) == [1, 2, 3, 4]


def test_waiting_rows_share_groups_and_blocks():
    """Rows of thousands of keys wait as a few blocks of their group's state, each row was an element of its key's before; those due go out by time within their key."""
    import pandas as pd

    class Held(list):
        put = lambda self, rows: self.__setitem__(slice(None), rows)
        appendList, get = list.extend, list.copy

    class Times:
        mark = 0
        timers: set = set()
        registerTimer, listTimers = timers.add, timers.copy
        getCurrentWatermarkInMs = classmethod(lambda cls: cls.mark)

    made = pages.InTimeOrder()
    made.handle, made.waiting = Times, Held()
    rows = [(f"k{n % 3000}", 1 + (n * 7919) % 10_007, n, str(n)) for n in range(12_000)]
    for at in (0, 6000):
        assert not list(made.handleInputRows(("g",), iter([pd.DataFrame(rows[at : at + 6000], columns=["key", "due", "place", "row"])]), Times))
    assert len(made.waiting) == 12
    seen = []
    for Times.mark in (4000, 4001, 20_000):
        assert any(t <= Times.mark for t in Times.timers)
        out = [r for f in made.handleExpiredTimer(("g",), Times, None) for r in f["row"]]
        assert {int(r) for r in out} == {n for _, due, n, _ in rows if due <= Times.mark} - set(map(int, seen))
        Times.timers.difference_update([t for t in Times.timers if t <= Times.mark])
        seen += out
    for k in ("k0", "k2999"):
        assert [r for r in seen if rows[int(r)][0] == k] == [r[3] for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3])]
    assert made.waiting == []


def test_pages_of_a_group_keep_parts_of_their_own():
    """Two pages fold in one call; each page's state is read and written by a few values, however many comments it has."""

    class Parts(dict):
        getValue, removeKey, calls = dict.get, dict.pop, 0

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

    made = pages.Pages()
    made.parts = Parts()
    rows = [r | {"timestamp": f"2001-01-01T00:{n // 60:02d}:{n % 60:02d}Z"} for n, r in enumerate(growing("1", 3) + growing("2", 200, 1))]
    waiting = [(n, r["page_id"], r["rev_id"], json.dumps(r)) for n, r in enumerate(rows)]
    out = [r for cut in (waiting[:2] + waiting[3:100], waiting[2:3] + waiting[100:]) for f in made.take(cut) for r in f.to_dict("records")]
    want = [(p, a["id"]) for p in ("1", "2") for tag, a in reconstruct.fold_page(reconstruct.Page(p), [r for r in rows if r["page_id"] == p]) if tag == "action"]
    assert sorted((r["page_id"], r["id"]) for r in out) == sorted(want)
    assert len([k for k in made.parts if k[0] == "1"]) == 2 and made.parts.calls < 16
    before, page, stopped = made._load("2")
    assert stopped is None and len(page.comments) == len(page.conversations) == 200 and len(before) == len([k for k in made.parts if k[0] == "2"]) == 5
