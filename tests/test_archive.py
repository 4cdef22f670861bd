"""The archive behind its commit log: replaced days, runs that die, merges, pages over cold and hot days, release of raw days."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sessionmill.operators import archive, listing, rollups, search, turns, windowed
from sessionmill.operators import sessions as ses
from sessionmill.sources import daylog
from sessionmill.sources import fixtures as fx

SF, UTC = "/root/testdata/sf0.001", dt.timezone.utc
AS_OF = dt.datetime(2024, 1, 31, tzinfo=UTC)


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "log")
    fx.content_events(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def full(spark, log, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("turns") / "turns")
    turns.full(log, fx.rates(spark)).write.parquet(path)
    return spark.read.parquet(path)


def rows(frame):
    return sorted(map(str, frame.select(sorted(frame.columns)).collect()))


def days_frame(spark, *days):
    return spark.createDataFrame([(dt.date(2024, 1, d),) for d in days], "day date")


def same_as(spark, path, t):
    """Every table is what its definition makes of t."""
    kept = archive.read_table(spark, path, "turns")
    assert rows(kept.select(t.columns)) == rows(t)
    for name, frame in rollups.rollups(t).items():
        assert rows(archive.read_table(spark, path, name)) == rows(frame), name


def jobs(spark, run):
    """How many jobs a call starts."""
    spark.sparkContext.setJobGroup(group := f"g{id(run)}", "count")
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_day_written_again_is_replaced_in_every_table(spark, full, tmp_path):
    path = str(tmp_path)
    archive.write_days(full, path)
    same_as(spark, path, full)
    none = full.withColumn("calls", F.array().cast(full.schema["calls"].dataType))
    archive.write_days(none, path)
    assert archive.read_table(spark, path, "by_tool").count() == 0
    same_as(spark, path, none)
    # days that have become empty, for one tenant and for all
    archive.write_days(full.where("day = '2024-01-05' and tenant_id = 'acme'"), path, days_frame(spark, 5, 6))
    want = none.where("day not in ('2024-01-05', '2024-01-06')").unionByName(full.where("day = '2024-01-05' and tenant_id = 'acme'"))
    same_as(spark, path, want)
    done = {r["day"].day: r["turns"] for r in archive.done_days(spark, path).where("month(day) = 1").collect()}
    assert done[6] == 0 and done[5] == full.where("day = '2024-01-05' and tenant_id = 'acme'").count()
    archive.consolidate(spark, path, whole=True)
    same_as(spark, path, want)


def test_a_run_that_dies_before_its_record_changes_nothing(spark, full, tmp_path, monkeypatch):
    path = str(tmp_path)
    archive.write_days(full.where("day <= '2024-01-10'"), path)
    before = {n: rows(archive.read_table(spark, path, n)) for n in ("turns", *archive.ROLLUPS)}
    # killed after each of its writes in turn, and in the commit itself
    write, at = archive._write, 0

    def dying(*args, n):
        nonlocal at
        at += 1
        if at > n:
            raise KeyboardInterrupt
        return write(*args)

    for n in (0, 1, 4, 7):
        at = 0
        monkeypatch.setattr(archive, "_write", lambda *a, n=n: dying(*a, n=n))
        with pytest.raises(KeyboardInterrupt):
            archive.write_days(full.where("day between '2024-01-08' and '2024-01-12'").limit(50), path)
    monkeypatch.setattr(archive, "_write", write)
    (tmp_path / "log" / f"{daylog.state(spark, path).number + 1:012d}.json").write_text('{"version": "torn')
    assert {n: rows(archive.read_table(spark, path, n)) for n in before} == before
    # the torn number stays unused; the next commit goes on, and what the dead runs left can go
    archive.write_days(full.where("day = '2024-01-11'"), path)
    same_as(spark, path, full.where("day <= '2024-01-11'"))
    assert archive.vacuum(spark, path) and archive.vacuum(spark, path) == []
    same_as(spark, path, full.where("day <= '2024-01-11'"))


def test_two_writers_take_two_numbers(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    record = lambda v, d: {"version": v, "days": {d: {"turns": 1, "refs": 0, "seq": 1}}, "holds": [[d, v]], "schemas": {}}
    old = daylog.state(spark, path)
    assert daylog.commit(spark, path, record("a", "2024-01-01")) == 1
    real, stale = daylog.state, [old]
    monkeypatch.setattr(daylog, "state", lambda s, p: stale.pop() if stale else real(s, p))  # read before the other committed
    assert daylog.commit(spark, path, record("b", "2024-01-01")) == 2
    assert real(spark, path).live() == {("2024-01-01", "b")}
    # of two merges of the same runs the later is refused
    daylog.commit(spark, path, {"version": "m", "replaces": ["a", "b"], "holds": [["2024-01-01", "b"]]})
    with pytest.raises(daylog.Conflict):
        daylog.commit(spark, path, {"version": "n", "replaces": ["a", "b"], "holds": [["2024-01-01", "b"]]})
    assert set(real(spark, path).runs) == {"m"}


def test_state_is_read_from_the_last_snapshot(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    for i in range(2 * daylog.SNAPSHOT + 3):
        day = f"2024-{1 + i % 5:02d}-01"
        daylog.commit(spark, path, {"version": f"v{i}", "days": {day: {"turns": i, "refs": 0, "seq": i}}, "holds": [[day, f"v{i}"]], "schemas": {}})
    opened, read = [], daylog._record
    monkeypatch.setattr(daylog, "_record", lambda s, p, n: opened.append(n) or read(s, p, n))
    found = daylog.state(spark, path)
    assert min(opened) == 2 * daylog.SNAPSHOT and len(found.days) == 5 and found.days["2024-05-01"]["turns"] == 34
    assert set(found.versions) == {c["version"] for c in found.days.values()}
    # all records read from the first give the same
    for f in (tmp_path / "log").glob("*.json"):
        whole = json.loads(f.read_text())
        whole.pop("state", None)
        f.write_text(json.dumps(whole))
        (tmp_path / "log" / f".{f.name}.crc").unlink(missing_ok=True)
    again = daylog.state(spark, path)
    assert (again.days, again.runs, again.versions) == (found.days, found.runs, found.versions)


def test_merging_costs_a_day_no_history(spark, full, tmp_path, monkeypatch):
    """Days are added one by one. Each is merged as often as runs have grown by FAN, and is in every answer at once."""
    monkeypatch.setattr(archive, "FAN", 2)
    monkeypatch.setattr(archive, "ROLLUPS", ("day", "by_session"))
    path, merged = str(tmp_path), []
    for d in range(1, 9):
        archive.write_days(full.where(F.col("day") == F.lit(dt.date(2024, 1, d))), path)
        merged.append(sum(len(daylog.state(spark, path).runs[r]) for r in daylog.state(spark, path).runs))
        before = daylog.state(spark, path).runs
        gone = archive.consolidate(spark, path)
        assert sum(len(before[g]) for g in gone) <= d
        want = full.where(F.col("day") <= F.lit(dt.date(2024, 1, d)))
        assert rows(archive.read_table(spark, path, "day")) == rows(rollups.rollup_day(want))
    assert merged == list(range(1, 9)) and len(daylog.state(spark, path).runs) <= 4
    assert archive.consolidate(spark, path, whole=True) and archive.consolidate(spark, path, whole=True) == []


def test_reads_ask_no_file(spark, full, tmp_path):
    path = str(tmp_path)
    for d in (5, 6, 7):
        archive.write_days(full.where(F.col("day") == F.lit(dt.date(2024, 1, d))), path)
    assert jobs(spark, lambda: [archive.read_table(spark, path, n) for n in ("turns", *archive.ROLLUPS)] + [archive.done_days(spark, path)]) == 0
    some = archive.read_table(spark, path, "turns", dt.date(2024, 1, 6), dt.date(2024, 1, 6))
    assert len(some.inputFiles()) == 1 and {r["day"].day for r in some.select("day").distinct().collect()} == {6}
    assert archive.read_table(spark, path, "turns", dt.date(2025, 1, 1)).count() == 0
    # a column that later versions have is null in earlier ones
    later = full.where("day = '2024-01-08'").withColumn("extra", F.lit(7))
    archive.write_days(later, path)
    seen = archive.read_table(spark, path, "turns").groupBy("day").agg(F.sum("extra").alias("n"), F.count("*").alias("c")).collect()
    assert {r["day"].day: r["n"] for r in seen} == {5: None, 6: None, 7: None, 8: 7 * later.count()}
    with pytest.raises(ValueError):
        archive.read_table(spark, path, "nothing")


def test_compaction_builds_turns_once_and_of_its_days_alone(spark, log, full, tmp_path):
    path, rates = str(tmp_path), fx.rates(spark)
    first = archive.compact(log, rates, path, dt.datetime(2024, 1, 10, tzinfo=UTC))
    assert first.count() == 9 and archive.compact(log, rates, path, dt.datetime(2024, 1, 10, tzinfo=UTC)).count() == 0
    version = daylog.state(spark, path).days["2024-01-03"]["version"]
    assert archive.compact(log, rates, path, AS_OF).agg(F.min("day")).first()[0] == dt.date(2024, 1, 10)
    assert daylog.state(spark, path).days["2024-01-03"]["version"] == version
    same_as(spark, path, full.where("day < '2024-01-31'"))
    again = archive.compact(log, rates, path, AS_OF, again=True)
    assert again.count() == 30 and daylog.state(spark, path).days["2024-01-03"]["version"] != version
    same_as(spark, path, full.where("day < '2024-01-31'"))
    both = archive.hot_and_cold(spark, path, log, rates)
    assert rows(both.select("tenant_id", "day", "turn_key", "cost_units")) == rows(full.select("tenant_id", "day", "turn_key", "cost_units"))


def test_release_refuses_days_that_disagree(spark, log, full, tmp_path):
    raw, path, rates = str(tmp_path / "raw"), str(tmp_path / "archive"), fx.rates(spark)
    log.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(raw)
    archive.compact(log, rates, path, dt.datetime(2024, 1, 20, tzinfo=UTC))
    # a day of fewer turns, and one of as many turns and fewer refs
    archive.write_days(full.where("day = '2024-01-03' and first_seq % 4 <> 0"), path, days_frame(spark, 3))
    archive.write_days(full.where("day = '2024-01-04'").withColumn("content_blobs", F.slice("content_blobs", 1, 1)), path, days_frame(spark, 4))
    verdict = {r["day"].day: r["releasable"] for r in archive.release(spark, path, raw, rates, dt.datetime(2024, 1, 18, tzinfo=UTC)).collect()}
    assert verdict == {d: d not in (3, 4) for d in range(1, 18)}
    left = [int(f[-2:]) for f in daylog.folders(spark, raw)]
    assert left == [3, 4, *range(18, 31)]
    assert archive.release(spark, path, raw, rates, dt.datetime(2024, 1, 3, tzinfo=UTC)).count() == 0
    # what was released is still there to read
    cut = archive.hot_and_cold(spark, path, spark.read.parquet(raw).drop("day"), rates)
    assert cut.where("day = '2024-01-02'").count() == full.where("day = '2024-01-02'").count()


# --- pages over cold and hot days ----------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def cold(spark, full, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cold"))
    archive.write_days(full.where("day <= '2024-01-10'"), path)
    archive.write_days(full.where("day between '2024-01-11' and '2024-01-20'"), path)
    return path


KEYS = ["tenant_id", "session_id", "ended_ms", "turns", "cost_units"]


EDGES = (dt.datetime(2024, 1, 5, 6, 30, tzinfo=UTC), dt.datetime(2024, 1, 23, 9, tzinfo=UTC))
ONE_DAY = (dt.datetime(2024, 1, 12, 3, tzinfo=UTC), dt.datetime(2024, 1, 12, 20, tzinfo=UTC))


@pytest.mark.parametrize("text,window", [("", None), ("branch:feature tool:bash", None), ("grep bash s1", None), ("has:errors", None), ("cost:>9999", None), ("no such word", None), ("", EDGES), ("proj3", EDGES), ("model:mini turns:>1", EDGES), ("", ONE_DAY), ("id:s2 proj", ONE_DAY)])
def test_page_equals_the_filtered_list(spark, full, cold, text, window):
    since, to = window or (None, None)
    t = full if window is None else windowed.in_window(full, since, to)
    whole = ses.sessions(t).where(search.search(text)).withColumn("ended_ms", F.unix_millis("ended_at")).orderBy(*[F.desc(c) for c in listing.CURSOR])
    want = [tuple(r) for r in whole.select(KEYS).collect()]
    got, after, hot = [], None, full.where("day > '2024-01-20'")
    size = max(3, len(want) // 2)
    while True:
        page = listing.page(spark, cold, size, after, text, since, to, hot)
        got += [tuple(r) for r in page.sessions.select(KEYS).collect()]
        if not page.more:
            break
        after = page.after
    assert got == want


def test_page_reads_only_the_days_it_needs(spark, cold, full, tmp_path):
    every = {r["day"] for r in full.where("day <= '2024-01-20'").select("day").distinct().collect()}
    path = str(tmp_path)
    # a session a day, and one that comes back after a pause
    one_a_day = full.where("day <= '2024-01-20'").withColumn("session_id", F.concat(F.lit("d"), F.dayofmonth("day")))
    paused = one_a_day.withColumn("session_id", F.when(F.dayofmonth("day").isin(4, 20), "paused").otherwise(F.col("session_id")))
    archive.write_days(paused.withColumn("project", F.when(F.dayofmonth("day") == 2, "rarity").otherwise(F.col("project"))), path)
    page = listing.page(spark, path, 2)
    assert page.more and {r["session_id"] for r in page.sessions.collect()} <= {"paused", "d19", "d18"}
    assert {d.day for d in page.days} <= {4, 16, 17, 18, 19, 20} and len(page.days) < len(every)
    ended = {(r["tenant_id"], r["session_id"]): r["turns"] for r in page.sessions.collect()}
    for (tenant, session), n in ended.items():  # none is shown in part
        assert n == paused.where((F.col("tenant_id") == tenant) & (F.col("session_id") == session)).count()
    rare = listing.page(spark, path, 50, text="rarity")
    assert [d.day for d in rare.days] == [2] and rare.sessions.count() == ses.sessions(archive.read_table(spark, path, "turns")).where(search.search("rarity")).count() > 0


@pytest.mark.parametrize("text", ["tool:grep model:mini", "bash grep read", "s1", "has:tools", "zz-none"])
def test_find_equals_search(spark, cold, full, text):
    want = ses.sessions(full.where("day <= '2024-01-20'")).where(search.search(text))
    assert rows(listing.find(spark, cold, text).select("tenant_id", "session_id", "turns")) == rows(want.select("tenant_id", "session_id", "turns"))


def test_page_before_the_first_compaction(spark, full, tmp_path):
    hot = full.where("day > '2024-01-28'").unionByName(full.limit(1).withColumn("day", F.lit(None).cast("date")))
    want = listing.recent(ses.sessions(hot.where("day is not null")).where(search.search("proj3")), 4)
    page = listing.page(spark, str(tmp_path / "none"), 4, text="proj3", hot=hot.where("day is not null"))
    assert [r["session_id"] for r in page.sessions.collect()] == [r["session_id"] for r in want.collect()] and page.days == []
    with pytest.raises(ValueError):
        listing.page(spark, str(tmp_path / "none"), 4)
    archive.write_days(hot, str(tmp_path / "a"))  # a turn without a day is left out
    assert archive.read_table(spark, str(tmp_path / "a"), "turns").where("day is null").count() == 0


def test_needles():
    assert search.needles('proj "two words" tool:Bash cost:>1 has:errors projectid:ab turns:lots x:y branch:') == ["proj", "two words", "bash", "turns:lots", "x:y", "branch:"]
    assert search.posted_days(None, []) is None and search.posted_days(None, ["ab", "long"]) is None


def test_payload_store_reads_the_folders_it_needs(spark, tmp_path):
    path = str(tmp_path / "blobs")
    rows = [("acme", f"text {i}") for i in range(300)] + [("acme", "text 1"), ("globex", "text 1"), ("acme", None), (None, "nobody's")]
    frame = spark.createDataFrame(rows, "tenant_id string, payload string")
    assert archive.store_blobs(frame.where("payload is null or payload < 'text 2'"), path) + archive.store_blobs(frame, path) in (302, 303)
    ref = frame.where("payload = 'text 1' and tenant_id = 'acme'").select(F.sha2("payload", 256)).first()[0]
    for folder in (tmp_path / "blobs").glob("bucket=*"):  # others may be unreadable
        if folder.name != f"bucket={ref[:1]}":
            for f in folder.glob("*.parquet"):
                f.write_bytes(b"broken")
                (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    wanted = spark.createDataFrame([(1, "acme", ref), (2, "globex", ref), (3, "other", ref), (4, "acme", "../x"), (5, "acme", None), (6, "acme", ref)], "n long, tenant_id string, ref string")
    assert sorted((r["n"], r["payload"]) for r in archive.find_blobs(spark, path, wanted).collect()) == [(1, "text 1"), (2, "text 1"), (6, "text 1")]
