"""No task takes a share of the log that grows with it, and days that are not over."""

import datetime as dt
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sessionmill.functions import pricing
from sessionmill.operators import archive, listing, rollups, sessions, turns
from sessionmill.plans import registry
from sessionmill.schemas import EVENT, conform
from sessionmill.sources import fixtures as fx
from sessionmill.streaming import stream

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plain(spark):
    """Plans as for tables too large to be broadcast, without what is mended at run time."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def dealt(monkeypatch):
    """The given tables in eight parts."""
    read = fx.read
    monkeypatch.setattr(fx, "read", lambda *args: read(*args).repartition(8))


def test_events_without_a_directory_stay_apart(spark, plain, dealt):
    parts = fx.events(spark, SF).select("seq", "project").groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.count("project")).collect()  # without project there is no join
    assert max(r["count"] for r in parts) < 0.3 * sum(r["count"] for r in parts)


def test_priced_turns_are_not_dealt_by_model(spark, plain, dealt):
    t = turns.full(fx.content_events(spark, SF), fx.rates(spark))
    parts = t.groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.sum("cost_units")).collect()  # without a price there is no join
    assert max(r["count"] for r in parts) < 0.3 * sum(r["count"] for r in parts)


def test_pages_of_the_archive_do_not_shuffle_turns_by_day(spark, plain):
    t = pricing.with_cost(turns.build_turns(fx.events(spark, SF), calls=True), fx.rates(spark))
    stored = spark.createDataFrame(t.limit(0).collect(), t.schema)
    plan = listing.recent_archived(rollups.rollup_session_day(stored), stored, 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in plan


def test_a_session_s_turns_are_not_shuffled_by_day(spark, plain):
    t = pricing.with_cost(turns.build_turns(fx.events(spark, SF), calls=True), fx.rates(spark))
    stored = spark.createDataFrame(t.limit(0).collect(), t.schema)
    plan = sessions.detail(stored, rollups.rollup_session_day(stored), "s7")._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and not re.search(r"SortMergeJoin \[tenant_id#\d+, day#\d+\]", plan)


def test_a_search_does_not_shuffle_words_by_day(spark, plain, tmp_path):
    archive.write_days(turns.full(fx.content_events(spark, SF), fx.rates(spark)), str(tmp_path))
    found = listing.find(spark, str(tmp_path), registry.FIND_TEXT)
    assert found.count() and not re.search(r"SortMergeJoin \[tenant_id#\d+, day#\d+\]", found._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("calls", [False, True])
def test_turns_are_sorted_behind_the_shuffle_alone(spark, plain, calls):
    log = spark.createDataFrame([(None,) * len(EVENT)], EVENT)
    plan = turns.build_turns(log, calls)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" in plan.split("Exchange")[0] and "Aggregate" not in plan.split("Exchange")[1]


def test_days_that_are_not_over_have_no_verdict(spark, monkeypatch):
    """An event in the last second of 30 January, whose response comes on the 31st."""
    late = spark.createDataFrame([(1_004, dt.datetime(2024, 1, 30, 23, 59, 58), 7, "view", 1.0, "{}")], fx.read(spark, SF, "events").schema)
    read = fx.read
    monkeypatch.setattr(fx, "read", lambda *args: read(*args).unionByName(late))
    got = registry.QUERIES["released_days"](spark, SF)
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    con.sql(f"create view events as select * from '{SF}/events.parquet' union all select 1004, timestamp '2024-01-30 23:59:58', 7, 'view', 1.0, '{{}}'")
    want = con.sql(registry.ORACLE_SQL["released_days"])
    columns = list(want.columns)
    assert con.sql("select 1 from (" + registry.ORACLE_SQL["event_days"] + ") where day = '2024-01-31'").fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name, starts", [("stream_turns", "keep_days"), ("stateful_turns", "stateful_turns")])
def test_streamed_log_is_written_by_many_tasks(spark, dealt, monkeypatch, tmp_path, name, starts):
    monkeypatch.setattr(registry, "work_dir", lambda _: str(tmp_path))

    class Stop(Exception):
        pass

    def stop(*_):
        raise Stop

    monkeypatch.setattr(stream, starts, stop)
    with pytest.raises(Stop):
        registry.QUERIES[name](spark, SF)
    whole = (fx.content_events if name == "stream_turns" else fx.events)(spark, SF).count()
    written = spark.read.parquet(str(next(tmp_path.glob("*/in"))))
    assert written.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < whole / 6


@pytest.mark.parametrize("name", ["prune_verdict", "committed_days", "hot_cold_turns", "replaced_days", "compacted_days", "sessions_page_window"])
def test_log_of_an_archive_query_is_written_by_many_tasks(spark, plain, dealt, monkeypatch, tmp_path, name):
    """Dealt by directory, most of the log would come to one task."""
    monkeypatch.setattr(registry, "work_dir", lambda _: str(tmp_path))

    class Stop(Exception):
        pass

    def stop(*_):
        raise Stop

    monkeypatch.setattr(turns, "full", stop)
    with pytest.raises(Stop):
        registry.QUERIES[name](spark, SF)
    written = spark.read.parquet(str(next(tmp_path.glob("log-*"))))
    assert written.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < written.count() / 6


def test_state_of_turns_is_spark_s_own_and_equals_the_processor_s(spark, tmp_path):
    """Repeats, an order that is none, and an event whose day the watermark has left behind."""
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    assert "TransformWithState" not in stream.observed(source)._jdf.queryExecution().analyzed().toString()
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    parts = [
        [(2, "response", "t1", at(5, 3)), (2, "response", "t1", at(5, 3)), (9, "request", "t3", at(5, 23))],
        [(1, "request", "t1", at(5, 2)), (2, "response", "t1", at(5, 3)), (9, "request", "t3", at(5, 23)), (12, "response", "t3", at(6, 0)), (20, "request", "t4", at(20, 0))],
        [(3, "error", "t1", at(5, 4)), (21, "response", "t4", at(20, 1))],  # Spark drops what was late before the last batch
        [(4, "error", "t1", at(5, 5)), (20, "request", "t4", at(20, 0))],
    ]
    sent = {"observed": [], "observed_by_processor": []}
    for part in parts:
        rows = spark.createDataFrame(part, "seq long, type string, turn_id string, ts timestamp")
        conform(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        before = {k: spark.conf.get(k, None) for k in stream.STATE}
        for k, v in stream.STATE.items():
            spark.conf.set(k, v)
        for how, batches in sent.items():
            keep = lambda batch, _, to=batches: to.append(sorted((r["turn_id"], r["seq"]) for r in batch.collect()))
            getattr(stream, how)(source, "1 day").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / how)).trigger(availableNow=True).start().awaitTermination()
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sent["observed"] == [[("t1", 2), ("t3", 9)], [("t1", 1), ("t1", 2), ("t3", 12), ("t4", 20)], [("t1", 1), ("t1", 2), ("t1", 3), ("t4", 20), ("t4", 21)], []]
    assert sent["observed_by_processor"] == sent["observed"]
