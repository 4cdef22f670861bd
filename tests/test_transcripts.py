"""Transcript parsing, drift counters, captured bodies, growing files, registry."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from sessionmill.operators import capture, coverage, normalize
from sessionmill.plans import registry
from sessionmill.sources.transcripts import TranscriptSource, scan
from sessionmill.streaming import stream


def record(**more):
    base = {"type": "assistant", "timestamp": "2024-03-01T10:00:00.5Z", "sessionId": "s", "uuid": "u", "message": {"id": "m1", "model": "m", "usage": {"input_tokens": 1, "output_tokens": 2}, "content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"a": 1}}, {"type": "text", "text": ""}, {"type": "novel"}]}}
    return json.dumps(base | more)


def frame(spark, *lines):
    return spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "n long, line string").withColumn("mtime", F.lit("2024-01-01").cast("timestamp"))


def test_absent_is_not_zero(spark):
    zero = {"input_tokens": 1, "output_tokens": 2, "output_tokens_details": {"thinking_tokens": 0}}
    lines = frame(spark, record(), record(message={"id": "m2", "model": "m", "usage": zero, "content": "bare"}), record(message={"id": "m3", "model": "<synthetic>", "usage": zero}), record(message={"id": "m4", "model": "m"}), "{bad", record(sessionId="", timestamp="nonsense"))
    got = {r["n"]: r for r in normalize.response_events(lines).collect()}
    assert set(got) == {0, 1, 5}
    assert got[0]["reasoning_tokens"] is None and got[1]["reasoning_tokens"] == 0
    assert got[0]["cache_write_5m"] is None and [tuple(c) for c in got[0]["tool_calls"]] == [("t1", "Bash")] and got[1]["tool_calls"] == []
    assert got[5]["session_id"] == "unknown" and got[5]["ts"].year == 2024 and got[5]["ts"].month == 1


def test_failures_blocks_and_results(spark):
    failed = record(isApiErrorMessage=True, apiErrorStatus="529", error="overloaded")
    vague = record(isApiErrorMessage=True, apiErrorStatus="soon")
    answer = json.dumps({"type": "user", "message": {"id": "x", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "done"}, {"type": "tool_result", "content": "lost"}]}})
    typed = json.dumps({"type": "user", "message": {"content": "typed prompt"}})
    lines = frame(spark, failed, vague, record(), answer, typed)
    assert [(r["status_code"], r["error"]) for r in normalize.error_events(lines).orderBy("n").collect()] == [(529, "overloaded"), (None, "api error")]
    blocks = normalize.content_blocks(frame(spark, record())).collect()
    assert [(r["kind"], r["text"]) for r in blocks] == [("text", "hi"), ("tool_use", '{"a":1}'), ("unknown", None)]
    assert [(r["tool_use_id"], r["text"]) for r in normalize.tool_results(lines).collect()] == [("t1", "done")]


def test_coverage(spark):
    lines = frame(spark, record(version="2.0", novel=1), record(), "{bad", json.dumps({"type": "summary"}))
    got = {(r["metric"], r["key"]): r["n"] for r in coverage.coverage(lines).collect()}
    assert got == {("records", ""): 4, ("parsed", ""): 2, ("unreadable", ""): 1, ("skipped", ""): 1, ("version", "2.0"): 1, ("version", "unknown"): 1, ("missing", "output_tokens_details"): 2, ("missing", "cache_creation"): 2, ("unknown", "novel"): 1}
    twice = {(r["metric"], r["key"]): r["n"] for r in coverage.merge(coverage.coverage(lines), coverage.coverage(lines)).collect()}
    assert twice == {k: 2 * n for k, n in got.items()}


def test_bodies(spark):
    request = json.dumps({"model": "m", "stream": True, "max_tokens": 5, "system": [{"type": "text"}, {"type": "text"}], "messages": [{"role": "user", "content": "x"}], "tools": [{"name": "Bash"}]})
    got = capture.request_summary(spark.createDataFrame([(1, request), (2, "{bad"), (3, '{"system":"be kind"}')], "exchange_id long, request_body string")).orderBy("exchange_id").collect()
    assert [(r["model"], r["stream"], r["message_count"], r["system_blocks"], r["tools"]) for r in got] == [("m", True, 1, 2, ["Bash"]), (None, False, 0, 0, []), (None, False, 0, 1, [])]
    sse = "\n".join(["event: x", 'data: {"type":"message_start","message":{"model":"m","usage":{"input_tokens":7,"output_tokens":1}}}', "data: {oops", 'data: {"type":"message_delta","delta":{"stop_reason":"end"},"usage":{"output_tokens":9,"input_tokens":0}}', "data: [DONE]"])
    r = capture.sse_fold(spark.createDataFrame([(1, sse)], "exchange_id long, sse string")).first()
    assert (r["model"], r["input_tokens"], r["output_tokens"], r["stop_reason"], r["tool_calls"]) == ("m", 7, 9, "end", [])


def test_growing_files(spark, tmp_path):
    """Appended lines arrive once, a partial last line waits, a file that shrinks is read anew; the batch scan sees the same lines."""
    spark.dataSource.register(TranscriptSource)
    logs, at = tmp_path / "logs" / "deep", str(tmp_path / "at")
    logs.mkdir(parents=True)
    log = logs / "a.jsonl"

    def drained(name):
        s = spark.readStream.format("transcripts").option("path", str(tmp_path / "logs")).load()
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", at).trigger(once=True).start()
        q.awaitTermination()
        return sorted(r["line"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    log.write_text("one\ntwo\nthr")
    assert drained("a") == ["one", "two"]
    with log.open("a") as f:
        f.write("ee\nfour\n")
    assert drained("b") == ["four", "one", "three", "two"]
    log.write_text("new\n")
    assert drained("c") == ["four", "new", "one", "three", "two"]
    assert [r["line"] for r in scan(spark, str(tmp_path / "logs"), oldest_first=True).collect()] == ["new"]
    assert scan(spark, str(tmp_path / "nowhere")).count() == 0


def test_pieces_of_a_file_hold_each_line_once(tmp_path, monkeypatch):
    from sessionmill.sources import transcripts

    lines = [f"{i}:" + "x" * (i * 7 % 40) for i in range(60)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\nrest")
    for size in (1, 5, 33, 64, 10**6):
        monkeypatch.setattr(transcripts, "PIECE", size)
        reader = transcripts._Reader(str(tmp_path), ".jsonl")
        pieces = reader.partitions({}, reader.latestOffset())
        assert [t[0] for p in pieces for t in reader.read(p)] == lines


def bounded(folder, most):
    from sessionmill.sources import transcripts

    return transcripts._Bounded(str(folder / "logs"), ".jsonl", str(folder / "offsets"), most)


def test_bounded_source_holds_its_limit(tmp_path):
    """Every line once and in order, whatever the limit, also across restarts; a record is over it by one long line at most."""
    import random

    random.seed(3)
    logs = tmp_path / "logs"
    logs.mkdir()
    texts = {f"{i}.jsonl": [f"{i}/{j}" + "x" * random.randrange(60) for j in range(40)] for i in range(5)}
    for name, lines in texts.items():
        (logs / name).write_text("\n".join(lines) + "\npart")
    reader, at, read, sizes = bounded(tmp_path, 300), {"record": 0}, [], []
    reader.initialOffset()
    while (end := reader.latestOffset()) != at:
        pieces = reader.partitions(at, end)
        sizes.append(sum(p.end - p.start for p in pieces))
        read += [t[:2] for p in pieces for t in reader.read(p)]
        at = end
        if end["record"] % 7 == 3:
            reader = bounded(tmp_path, 300)  # killed and started again
    assert max(sizes) <= 300 and len(sizes) > 20
    for name, lines in texts.items():
        assert [t for t, path in read if path.endswith(f"/{name}")] == lines
    # a batch that runs again reads the same; a new query goes through the records one by one
    again = bounded(tmp_path, 300)
    assert sum(p.end - p.start for p in again.partitions({"record": 4}, {"record": 5})) == sizes[4]
    assert again.initialOffset() == {"record": 0} and [again.latestOffset()["record"] for _ in range(2)] == [1, 2]
    # a line longer than the limit goes whole, the part line waits for its end, a file that shrinks is read anew
    with (logs / "0.jsonl").open("a") as f:
        f.write("y" * 1000 + "\nz\n")
    (logs / "1.jsonl").write_text("new\n")
    reader, got = bounded(tmp_path, 50), []
    while (end := reader.latestOffset()) != at:
        got += [t[0] for p in reader.partitions(at, end) for t in reader.read(p)]
        at = end
    assert sorted(got) == sorted(["part" + "y" * 1000, "z", "new"])


def test_poll_opens_no_unchanged_file(tmp_path, monkeypatch):
    from sessionmill.sources import transcripts

    logs = tmp_path / "logs"
    logs.mkdir()
    for i in range(10_000):
        (logs / f"{i}.jsonl").write_text(f"{i}\n")
    reader = bounded(tmp_path, 1 << 20)
    reader.initialOffset()
    assert reader.latestOffset() == {"record": 1} and len(reader.partitions({"record": 0}, {"record": 1})) == 10_000
    opened, end_of = [], transcripts._last_line_end
    monkeypatch.setattr(transcripts, "_last_line_end", lambda files, path, size: opened.append(path) or end_of(files, path, size))
    assert reader.latestOffset() == {"record": 1} and opened == []
    assert bounded(tmp_path, 1 << 20).latestOffset() == {"record": 1} and opened == []  # nor after a restart
    with (logs / "77.jsonl").open("a") as f:
        f.write("more")
    assert reader.latestOffset() == {"record": 2} and len(opened) == 1 and reader.partitions({"record": 1}, {"record": 2}) == []
    assert reader.latestOffset() == {"record": 2} and len(opened) == 1  # a part line is looked at once


def test_offsets_are_snapshot(tmp_path, monkeypatch):
    from sessionmill.sources import transcripts

    monkeypatch.setattr(transcripts._Bounded, "SNAPSHOT", 4)
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.jsonl").write_text("".join(f"{i:03d}\n" for i in range(40)))
    reader = bounded(tmp_path, 8)
    reader.initialOffset()
    while (n := reader.latestOffset()["record"]) < 10:
        pass
    opened, read = [], transcripts._Bounded._open
    monkeypatch.setattr(transcripts._Bounded, "_open", lambda self, name: opened.append(name) or read(self, name))
    again = bounded(tmp_path, 8)
    assert (again.number, again.seen) == (reader.number, reader.seen) and n == 10
    assert sorted(opened) == ["000000000009.json", "000000000010.json", "all-000000000008.json"]


def test_following_in_bounded_batches(spark, tmp_path):
    spark.dataSource.register(TranscriptSource)
    (tmp_path / "logs").mkdir()
    lines = [record(uuid=f"u{i}") for i in range(12)]
    (tmp_path / "logs" / "a.jsonl").write_text("\n".join(lines) + "\n")
    source = lambda: spark.readStream.format("transcripts").option("path", str(tmp_path / "logs")).option("offsets", str(tmp_path / "offsets")).option("maxBytes", 4 * len(lines[0]) + 8).load()
    assert stream.catch_up(source, str(tmp_path / "out"), str(tmp_path / "at")) == 3
    assert sorted(r["line"] for r in spark.read.parquet(str(tmp_path / "out/lines")).collect()) == sorted(lines)
    assert stream.catch_up(source, str(tmp_path / "out"), str(tmp_path / "at")) == 0


def test_shipping_stream_drops_repeats(spark, tmp_path):
    rows = [("response", "t1", "m1", "2024-03-01 10:00:00"), ("response", "t1", "m1", "2024-03-01 10:00:00"), ("content", "t1", "m1", "2024-03-01 10:00:00"), ("request", "t1", None, "2024-03-01 10:00:00")]
    spark.createDataFrame(rows, "type string, turn_id string, message_id string, at string").select("type", "turn_id", "message_id", F.col("at").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("type string, turn_id string, message_id string, ts timestamp").parquet(str(tmp_path / "in"))
    assert stream.drain(stream.shippable(s), str(tmp_path)).count() == 2


def test_streamed_archive_equals_compaction(spark, tmp_path):
    """Late events of a day that is archived: every table comes out as one compaction of all events writes it."""
    from sessionmill.operators import archive, turns
    from sessionmill.sources import fixtures as fx

    fx.content_events(spark, SF).where("seq % 1000000000000 < 1500").write.parquet(str(tmp_path / "log"))
    log, rates = spark.read.parquet(str(tmp_path / "log")), fx.rates(spark)
    arrived = []
    read_day = lambda days: log.where(" or ".join(arrived)).join(days, F.to_date("ts") == days["day"], "left_semi")
    for part in ("seq % 3 = 0", "seq % 3 > 0"):
        arrived.append(part)
        log.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
        stream.keep_days(s, read_day, str(tmp_path / "streamed"), str(tmp_path / "at"), rates).awaitTermination()
    archive.write_days(turns.full(log, rates), str(tmp_path / "batch"))
    for name in ("turns", *archive.ROLLUPS):
        a, b = (archive.read_table(spark, str(tmp_path / run), name) for run in ("streamed", "batch"))
        a = a.select(b.columns)
        assert b.count() > 0 and sorted(map(str, a.collect())) == sorted(map(str, b.collect())), name


def test_stateful_turns_equal_batch_turns(spark, tmp_path):
    """In any order of arrival, with repeats, over a restart; a turn is sent out again only if something new is seen of it."""
    from sessionmill.functions.pricing import with_cost
    from sessionmill.operators import turns
    from sessionmill.sources import fixtures as fx

    fx.content_events(spark, SF).where("seq % 1000000000000 < 3000").write.parquet(str(tmp_path / "log"))
    log, rates = spark.read.parquet(str(tmp_path / "log")), fx.rates(spark)
    own = log.where("type <> 'content'")
    want = with_cost(turns.with_tool_calls(turns.build_turns(own), own), rates, own)
    run, out = str(tmp_path / "a"), str(tmp_path / "a" / "out")
    at = F.pmod(F.xxhash64("seq"), F.lit(3))
    for parts in ([0, 1], [1, 2], [0]):  # repeats, then nothing but repeats
        log.where(at.isin(parts)).coalesce(1).orderBy(F.desc("seq")).write.mode("append").parquet(f"{run}/in")
        source = spark.readStream.schema(log.schema).parquet(f"{run}/in")
        stream.stateful_turns(source, out, f"{run}/at", rates, "60 days").awaitTermination()
    got = stream.current_turns(spark, out)
    key = lambda f: sorted(map(str, f.select(sorted(want.columns)).collect()))
    assert key(got) == key(want) and want.count() > 100
    sent = {r["batch"]: r["count"] for r in spark.read.parquet(out).groupBy("batch").count().collect()}
    assert len(sent) == 2 and sent[max(sent)] < want.count()  # the third run, of repeats alone, sends nothing


def test_state_of_a_turn_is_dropped_behind_the_watermark():
    import pandas as pd

    class Cell:
        def __init__(self):
            self.held = []

        exists = lambda self: bool(self.held)
        get = lambda self: iter(self.held)
        appendList = lambda self, rows: self.held.extend(rows)  # noqa: E731, N815
        update = lambda self, row: self.held.append(row)
        clear = lambda self: self.held.clear()

    class Handle:
        timers: list = []
        getListState = getValueState = lambda self, *_: Cell()  # noqa: E731, N815
        registerTimer = lambda self, at: self.timers.append(at)  # noqa: E731, N815

    turn, handle = stream.Observations(1_000), Handle()
    turn.init(handle)
    rows = lambda *events: iter([pd.DataFrame({"event": list(events), "day_ms": 5_000})])
    sent = lambda *events: [e for f in turn.handleInputRows("k", rows(*events), None) for e in f["event"]]
    assert sent("a", "b", "a") == ["a", "b"] and sent("b") == [] and sent("c", "a") == ["a", "b", "c"]
    assert handle.timers == [5_000 + 86_400_000 + 1_000]
    assert list(turn.handleExpiredTimer("k", None, None)) == [] and sent("a") == ["a"]


SF = "/root/testdata/sf0.001"


def test_registry_is_complete():
    assert len(registry.QUERIES) == 118 and set(registry.QUERIES) == set(registry.ORACLE_SQL)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("events", "conversations", "documents"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


#: Queries that write an archive or run streams take a while; one of each kind here, all in the driver's comparison.
LONG = {"archive_columns", "additive_schema", "consolidated_rollups", "session_detail", "follow_coverage", "stream_turns", "sessions_page_search", "released_days", "stateful_turns"}


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in LONG])
def test_against_duckdb(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    place = [list(want.columns).index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=repr)
