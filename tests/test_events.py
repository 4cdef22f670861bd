"""Turn merge, prices, sessions: hand cases."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sessionmill.functions import columns as fn
from sessionmill.functions import pricing
from sessionmill.operators import archive, listing, normalize, projects, rollups, search, turns, windowed
from sessionmill.operators import sessions as ses
from sessionmill.sources import fixtures as fx
from sessionmill.schemas import EVENT, RATE, conform

UTC = dt.timezone.utc
T0 = dt.datetime(2024, 3, 1, 3, tzinfo=UTC)


def log(spark, rows):
    """Events from dictionaries; seq is the place in the list unless given."""
    full = []
    for i, r in enumerate(rows):
        r = {"seq": i, "tenant_id": "acme", "session_id": "s1"} | r
        full.append(tuple(r.get(f.name) for f in EVENT.fields))
    return conform(spark.createDataFrame(full, EVENT), EVENT)


def usage(i=0, o=0, w=0, r=0, **more):
    return {"input_tokens": i, "output_tokens": o, "cache_write": w, "cache_read": r} | more


def rates(spark):
    return spark.createDataFrame([("m", Decimal(5), Decimal(25)), ("m-mini", Decimal(1), Decimal(5))], RATE)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_pair_in_any_order(spark):
    pair = [
        {"type": "request", "ts": T0, "turn_id": "t1", "message_id": "x", "model": "m", "message_count": 3},
        {"type": "response", "ts": T0 + dt.timedelta(seconds=2), "turn_id": "t1", "message_id": "x", "model": "m-2", "status_code": 200, "duration_ms": 1500, "tool_calls": [("a", "Bash"), ("b", "Read")], **usage(1, 2, 2000, 4, cache_write_5m=1500, cache_write_1h=500)},
    ]
    for rows in (pair, pair[::-1]):
        t = one(turns.build_turns(log(spark, rows)))
        assert (t["model"], t["started_at"], t["status_code"], t["duration_ms"], t["pending"], t["message_count"]) == ("m-2", T0.replace(tzinfo=None), 200, 1500, False, 3)
        assert (t["cache_write_5m"], t["cache_write_1h"]) == (1500, 500)


def test_repeated_records_are_not_summed(spark):
    rows = [{"type": "response", "ts": T0, "turn_id": "t", "message_id": "x", "model": "m", **usage(2, 277, 1968, 30173)}] * 3
    t = one(turns.build_turns(log(spark, rows)))
    assert (t["input_tokens"], t["output_tokens"], t["cache_write"], t["cache_read"]) == (2, 277, 1968, 30173)


def test_two_sources_make_one_turn(spark):
    rows = [
        {"type": "request", "ts": T0, "turn_id": "w", "message_id": "x", "source": "wire", "model": "m"},
        {"type": "response", "ts": T0, "turn_id": "w", "message_id": "x", "source": "wire", "duration_ms": 900, **usage(100, 50, 0, 900)},
        {"type": "response", "ts": T0, "turn_id": "l", "message_id": "x", "source": "log", "project": "alpha", "git_branch": "main", **usage(100, 50, 0, 900)},
    ]
    t = one(turns.build_turns(log(spark, rows)))
    assert (t["project"], t["git_branch"], t["duration_ms"], t["source"], t["turn_id"]) == ("alpha", "main", 900, "wire", "w")


def test_usage_is_taken_whole_and_errors_set_duration(spark):
    rows = [
        {"type": "response", "ts": T0, "turn_id": "t", "duration_ms": 700, **usage(1, 2, 3, 4, reasoning_tokens=5)},
        {"type": "response", "ts": T0, "turn_id": "t", "duration_ms": 0, **usage(9, 0, 0, 0)},
        {"type": "error", "ts": T0, "turn_id": "t", "error": "overloaded", "status_code": 529, "model": "m"},
    ]
    t = one(turns.build_turns(log(spark, rows)))
    assert (t["input_tokens"], t["reasoning_tokens"], t["duration_ms"], t["error"]) == (9, None, 0, "overloaded")
    assert t["status_code"] is None and t["model"] is None  # an error event's own status and model are not read


def test_pending_midnight_and_late_request(spark):
    rows = [
        {"type": "request", "ts": dt.datetime(2024, 3, 1, 23, 59, 59, tzinfo=UTC), "turn_id": "t", "model": "m"},
        {"type": "response", "ts": dt.datetime(2024, 3, 2, 0, 0, 1, tzinfo=UTC), "turn_id": "t", "model": "m", **usage(1)},
    ]
    found = {r["day"].day: r["pending"] for r in turns.build_turns(log(spark, rows)).collect()}
    assert found == {1: True, 2: False}
    rows = [{"type": "response", "ts": T0, "turn_id": "t", "model": "r", **usage(1)}, {"type": "request", "ts": T0 + dt.timedelta(seconds=9), "turn_id": "t", "model": "q"}]
    t = one(turns.build_turns(log(spark, rows)))
    assert t["model"] == "r" and t["started_at"].second == 9


def test_tool_calls_merge_and_results(spark):
    rows = [
        {"type": "response", "ts": T0, "turn_id": "t", "tool_calls": [("a", ""), ("", "Blank")], **usage(1)},
        {"type": "response", "ts": T0, "turn_id": "t", "tool_calls": [("b", "Read"), ("a", "Bash"), ("", "Blank")], **usage(1)},
    ]
    events = log(spark, rows)
    t = turns.with_tool_calls(turns.build_turns(events), events)
    assert [tuple(c) for c in one(t)["calls"]] == [("a", "Bash"), (None, "Blank"), ("b", "Read"), (None, "Blank")]
    results = spark.createDataFrame([("acme", T0.date(), "a", "r1"), ("acme", T0.date(), "zz", "r2"), ("other", T0.date(), "a", "r3")], "tenant_id string, day date, tool_use_id string, ref string")
    assert one(turns.attach_tool_results(t, results))["ref"] == "r1"


def test_partitioning_does_not_matter(spark):
    rows = [{"type": k, "ts": T0 + dt.timedelta(seconds=i), "turn_id": f"t{i % 7}", "model": f"m{i}", "error": "e" if k == "error" else None, **(usage(i) if k == "response" else {})} for i, k in enumerate(["request", "response", "error", "response"] * 20)]
    events = log(spark, rows)
    want = sorted(map(str, turns.build_turns(events).collect()))
    for n in (1, 3, 11):
        assert sorted(map(str, turns.build_turns(events.repartition(n, F.rand(n))).collect())) == want


M = 1_000_000


@pytest.mark.parametrize(
    "tokens,model,cost,priced",
    [
        (usage(M, M), "m", 30.0, True),
        (usage(r=M), "m", 0.5, True),
        (usage(w=M, cache_write_5m=M, cache_write_1h=0), "m", 6.25, True),
        (usage(w=M, cache_write_5m=0, cache_write_1h=M), "m", 10.0, True),
        (usage(w=M), "m", 6.25, True),
        (usage(M, M), "unknown", 0.0, False),
        (usage(M), "m-mini-20250101", 1.0, True),
        (usage(M), "m-20250101", 5.0, True),
    ],
)
def test_prices(spark, tokens, model, cost, priced):
    events = log(spark, [{"type": "response", "ts": T0, "turn_id": "t", "model": model, **tokens}])
    t = one(pricing.with_cost(turns.build_turns(events), rates(spark)).select("priced", pricing.dollars(F.col("cost_units")).alias("usd"), pricing.dollars(F.col("saved_units")).alias("saved")))
    assert (t["usd"], t["priced"]) == (cost, priced)
    assert t["saved"] == (4.5 if tokens["cache_read"] else 0.0)


def day_log(spark, days=3, sessions=2, per=3):
    rows = []
    for d in range(days):
        for s in range(sessions):
            for k in range(per):
                at = dt.datetime(2024, 3, 1 + d, 1 + s, k, tzinfo=UTC)
                rows.append({"type": "response", "ts": at, "turn_id": f"{d}-{s}-{k}", "session_id": f"s{s}", "model": "m" if k else "other", "project": "alpha" if s else None, "project_id": "a1" if s else None, "duration_ms": 1000, "status_code": 429 if k == 2 else 200, "tool_calls": [(f"{d}{s}{k}", "Bash")], **usage(100, 30, 10, 500)})
    events = log(spark, rows)
    return pricing.with_cost(turns.with_tool_calls(turns.build_turns(events), events), rates(spark))


def test_session_rollup(spark):
    s = {r["session_id"]: r for r in ses.sessions(day_log(spark)).collect()}
    assert s["s0"]["turns"] == 9 and s["s0"]["errors"] == 3 and s["s0"]["unpriced"] == 3 and s["s0"]["tool_calls"] == 9
    assert s["s0"]["hit_rate"] == 500 / 610 and s["s0"]["models"] == ["m", "other"] and s["s0"]["tool_names"] == ["Bash"]
    assert s["s1"]["project"] == "alpha" and s["s0"]["project"] is None
    assert s["s0"]["duration_ms"] == (2 * 86400 + 2 * 60) * 1000 + 1000


def test_rollups_equal_turns(spark):
    t = day_log(spark)
    d = rollups.rollup_day(t)
    assert sorted((r["sessions"], r["turns"], r["errors"], r["input_tokens"]) for r in d.collect()) == [(2, 6, 2, 600)] * 3
    for since, to in ((dt.datetime(2024, 3, 1, tzinfo=UTC), dt.datetime(2024, 3, 4, tzinfo=UTC)), (dt.datetime(2024, 3, 1, 1, 1, tzinfo=UTC), dt.datetime(2024, 3, 3, 2, 0, tzinfo=UTC))):
        plain = windowed.in_window(t, since, to)
        got = one(windowed.totals(t, d, since, to))
        assert (got["turns"], got["cost_units"]) == (plain.count(), plain.agg(F.sum("cost_units")).first()[0])
        models = {r["model"]: r["turns"] for r in windowed.by_model(t, rollups.rollup_model(t), since, to).collect()}
        assert models == {r["model"]: r["count"] for r in plain.groupBy("model").count().collect()}


def test_archive_round_trip(spark, tmp_path):
    t = day_log(spark)
    archive.write_days(t, str(tmp_path))
    archive.write_days(t.where("day = '2024-03-02'"), str(tmp_path))  # a day again: replaced, the others stay
    back = archive.read_table(spark, str(tmp_path), "turns")
    assert back.count() == t.count() == 18
    assert archive.read_table(spark, str(tmp_path), "by_session").count() == 6
    assert "PushedFilters: [IsNotNull(day)" in back.where("day = '2024-03-02'")._jdf.queryExecution().toString()
    by_session = rollups.rollup_session_day(t)
    assert archive.complete_session_days(by_session.where("day > '2024-03-01'"), t).count() == by_session.count()
    verdict = archive.prune_verdict(t.where("turn_key <> 'turn:0-0-0'").withColumn("refs", F.lit(1)), t.withColumn("refs", F.lit(1)))
    assert sorted(r["releasable"] for r in verdict.collect()) == [False, True, True]


def test_pages_equal_the_whole_list(spark):
    s = ses.sessions(day_log(spark, 2, 9, 2))
    whole = [r["session_id"] for r in listing.recent(s, 500).collect()]
    seen, after = [], None
    while page := listing.recent(s, 2, after).collect():
        seen += [r["session_id"] for r in page]
        after = tuple(page[-1][c] for c in listing.CURSOR)
    assert seen == whole and len(whole) == 9
    # two tenants with sessions of equal ids and ends
    tied = s.unionByName(s.withColumn("tenant_id", F.lit("other")))
    seen, after = [], None
    while page := listing.recent(tied, 5, after).collect():
        seen += [(r["tenant_id"], r["session_id"]) for r in page]
        after = tuple(page[-1][c] for c in listing.CURSOR)
    assert len(seen) == len(set(seen)) == 18
    assert [r["turns"] for r in listing.ranked(s, "turns", 3).collect()] == [4, 4, 4]
    assert [r["session_id"] for r in listing.ranked(s, "nonsense", 3).collect()] == whole[:3]
    assert listing.page_size(0) == 50 and listing.page_size(9999) == 500


SESSION = {"session_id": "Abc-123", "project": "My Web App", "project_id": "00ff00ff00ff", "git_branch": "feature/Login", "model": "m-large", "models": ["m-large", "m-mini"], "tool_names": ["Bash", "Read"], "errors": 2, "unpriced": 0, "cost_usd": 1.5, "turns": 12}


@pytest.mark.parametrize(
    "text,found",
    [
        ("", True), ("web", True), ("WEB", True), ("login", True), ("abc", True), ("mini", True), ("bash", True), ("nothing", False),
        ("project:web", True), ("project:nope", False), ("branch:feature", True), ("id:123", True), ("projectid:00FF00FF00FF", True), ("projectid:00ff", False),
        ("model:large", True), ("tool:read", True), ("tool:grep", False), ("has:errors", True), ("has:failed", True), ("has:unpriced", False), ("has:wings", False),
        ("cost:>1", True), ("cost:<1", False), ("cost:1.5", True), ("turns:>=12", False), ("turns:>11", True), ("turns:lots", False),
        ("project:", False), ('"web app"', True), ('project:"my web"', True), ("web bash turns:>5", True), ("web grep", False),
    ],
)
def test_search(spark, text, found):
    row = spark.createDataFrame([tuple(SESSION.values())], "session_id string, project string, project_id string, git_branch string, model string, models array<string>, tool_names array<string>, errors long, unpriced long, cost_usd double, turns long")
    assert (row.where(search.search(text)).count() == 1) is found


def test_windows():
    now = dt.datetime(2024, 1, 31, tzinfo=UTC)
    assert windowed.window(now) == (now - dt.timedelta(days=7), now)
    assert windowed.window(now, days=30)[0] == now - dt.timedelta(days=30)
    assert windowed.window(now, days=200000)[0] == now - dt.timedelta(days=3650)
    assert windowed.window(now, "garbage", "also") == (now - dt.timedelta(days=7), now)
    a, b = windowed.window(now, "2024-01-20", "2024-01-10T00:00:00Z")
    assert a == dt.datetime(2024, 1, 10, tzinfo=UTC) and b == dt.datetime(2024, 1, 20, tzinfo=UTC)


def test_columns(spark):
    df = spark.createDataFrame([("/a/b/", "héé"), ("C:\\x\\Proj", "ab"), ("C:\\", ""), ("/", "日本")], "p string, s string")
    assert [r[0] for r in df.select(fn.project_name(F.col("p"))).collect()] == ["b", "Proj", None, None]
    got = df.select(*fn.truncate_utf8(F.col("s"), 4)).collect()
    assert [tuple(r) for r in got] == [("hé", True, 5), ("ab", False, 2), ("", False, 0), ("日", True, 6)]
    raw = spark.createDataFrame([('"plain"',), ('[{"type":"text","text":"a"},{"type":"text","text":""},{"type":"text","text":"b"}]',), ('{"k":1}',), ("[]",)], "r string")
    assert [r[0] for r in raw.select(fn.result_text(F.col("r"))).collect()] == ["plain", "a\nb", '{"k":1}', "[]"]


def test_repository_roots(spark):
    dirs = spark.createDataFrame([("/src/app/web",), ("/src/application",), ("D:\\Work\\Lib\\x",), (None,)], "cwd string")
    roots = spark.createDataFrame([("/src/app",), ("/src",), ("d:/work/lib",)], "root string")
    got = {r["cwd"]: (r["root"], r["in_repo"]) for r in projects.attribute(dirs, roots).collect()}
    assert got == {"/src/app/web": ("/src/app", True), "/src/application": ("/src", True), "D:\\Work\\Lib\\x": ("d:/work/lib", True)}


def test_plausible_and_identity(spark):
    now = dt.datetime(2024, 1, 31, tzinfo=UTC)
    e = log(spark, [{"ts": now}, {"ts": dt.datetime(1900, 1, 1, tzinfo=UTC)}, {"ts": now + dt.timedelta(days=9)}, {}])
    assert e.where(normalize.plausible(e, now)).count() == 1
    assert {r["tenant_id"] for r in normalize.fill_identity(e, {"tenant_id": "x"}).collect()} == {"acme"}
    assert {r["tenant_id"] for r in normalize.overwrite_identity(e, {"tenant_id": "x"}).collect()} == {"x"}


def test_calls_in_the_turn_aggregate_equal_those_apart(spark):
    odd = [
        {"type": "response", "ts": T0, "turn_id": "t", "tool_calls": [("a", ""), (None, "X"), ("b", "B"), ("a", "A")], **usage(1)},
        {"type": "response", "ts": T0, "turn_id": "t", "tool_calls": [("", "Y"), ("b", "late"), ("c", None)], **usage(1)},
        {"type": "response", "ts": T0, "turn_id": "u", "tool_calls": [], **usage(1)},
        {"type": "request", "ts": T0, "turn_id": "t", "tool_calls": [("z", "never")]},
        {"type": "error", "ts": T0, "turn_id": "v"},
    ]
    for events in (log(spark, odd), fx.events(spark, "/root/testdata/sf0.001")):
        apart = turns.with_tool_calls(turns.build_turns(events), events)
        together = turns.build_turns(events, calls=True).select(apart.columns)
        assert sorted(map(str, together.collect())) == sorted(map(str, apart.collect()))
    got = {r["turn_key"]: [tuple(c) for c in r["calls"]] for r in turns.build_turns(log(spark, odd), calls=True).collect()}
    assert got == {"turn:t": [("a", "A"), (None, "X"), ("b", "B"), (None, "Y"), ("c", None)], "turn:u": [], "turn:v": []}


def test_content_refs(spark):
    """Own content in order of arrival, repeats kept; results behind it; a result of another day or of no call is dropped."""
    later = T0 + dt.timedelta(days=1)
    rows = [
        {"type": "content", "ts": T0, "turn_id": "t", "content_ref": "b"},
        {"type": "content", "ts": T0, "turn_id": "x", "tool_use_id": "a", "content_ref": "r"},
        {"type": "response", "ts": T0, "turn_id": "t", "tool_calls": [("a", "Bash")], **usage(1)},
        {"type": "content", "ts": T0, "turn_id": "t", "content_ref": "a"},
        {"type": "content", "ts": T0, "turn_id": "t", "content_ref": "a"},
        {"type": "content", "ts": later, "turn_id": "y", "tool_use_id": "a", "content_ref": "late"},
        {"type": "content", "ts": T0, "turn_id": "z", "tool_use_id": "nobody", "content_ref": "lost"},
    ]
    events = log(spark, rows)
    t = one(turns.full(events, rates(spark)))
    assert t["content_blobs"] == ["b", "a", "a", "r"] and not t["pending"]
    back = one(archive.from_rows(archive.to_rows(turns.full(events, rates(spark)))))
    assert [tuple(c) for c in back["calls"]] == [(None, "Bash")] and back["content_blobs"] == t["content_blobs"] and back["cost_units"] == t["cost_units"]


def test_capture(spark):
    df = spark.createDataFrame([("héllo", None), ("ab", '{"long":"input"}'), ("ab", "{}"), (None, None)], "t string, i string")
    got = df.select(*[c.alias(n) for c, n in zip(fn.captured(F.col("t"), F.col("i"), 3), ("text", "input", "cut", "bytes"), strict=True)]).collect()
    assert [tuple(r) for r in got] == [("hé", None, True, 6), ('{"l', None, True, 16), ("ab", "{}", False, 2), (None, None, False, 0)]


def test_scope_and_first_page(spark):
    for bad in ("", "A", "a/b", "_a", "a__b", "x" * 65):
        with pytest.raises(ValueError):
            archive.scope(spark.range(1), bad)
    t = day_log(spark, 3, 7, 2)
    page = lambda f: [(r["session_id"], r["turns"], r["cost_units"]) for r in f.collect()]
    by_session = rollups.rollup_session_day(t)
    first = listing.recent(ses.sessions(t), 3)
    assert page(listing.recent_archived(by_session, t, 3)) == page(first)
    after = tuple(first.collect()[-1][c] for c in listing.CURSOR)
    assert page(listing.recent_archived(by_session, t, 3, after)) == page(listing.recent(ses.sessions(t), 3, after))


@pytest.mark.parametrize("few", [True, False])
def test_append_adds_what_is_new(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(turns, "BROADCAST_KEYS", 1000 if few else 0)
    path = str(tmp_path / "log")
    day = lambda d, n, **more: {"ts": T0 + dt.timedelta(days=d, microseconds=n), "turn_id": f"t{n % 7}", **more}
    first = [day(0, i) for i in range(20)] + [day(1, i) for i in range(20)] + [{"turn_id": "no instant"}]
    assert turns.append_events(log(spark, first + first), path) == 41
    assert turns.append_events(log(spark, first), path) == 0
    # other days' files aren't opened: they may be unreadable
    for f in (tmp_path / "log" / "day=2024-03-01").glob("*.parquet") if T0.date() == dt.date(2024, 3, 1) else (tmp_path / "log" / f"day={T0.date()}").glob("*.parquet"):
        (tmp_path / f"kept-{f.name}").write_bytes(f.read_bytes())
        f.write_bytes(b"broken")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert turns.append_events(log(spark, [day(1, 5), day(1, 500), day(2, 1), {"turn_id": "no instant"}, day(1, 6, tenant_id="other")]), path) == 3
    with pytest.raises(Exception):
        turns.append_events(log(spark, [day(0, 5)]), path)


def test_median(spark):
    import statistics

    for costs in ([3.0], [1.0, 2.0], [5.0] * 4000 + [1.0] * 3000, [float(i % 997) for i in range(5001)], [float(i) for i in range(4000)], [i * 0.37 % 91 for i in range(20_001)] + [7.5] * 9_000, [i / 7 for i in range(10_000)]):
        assert one(projects.median_cost(spark.createDataFrame([(c,) for c in costs], "cost_usd double")))["median_cost"] == statistics.median(costs)
    assert one(projects.median_cost(spark.createDataFrame([], "cost_usd double")))["median_cost"] == 0.0


def test_event_dedupe(spark):
    e = log(spark, [{"ts": T0, "turn_id": "a"}, {"ts": T0, "turn_id": "a"}, {"ts": T0, "turn_id": "b"}])
    kept = turns.dedupe_events(e)
    assert kept.count() == 2
    stored = spark.createDataFrame([(r["tenant_id"], r["event_hash"]) for r in kept.where("turn_id = 'a'").collect()], "tenant_id string, event_hash string")
    assert turns.dedupe_events(e, stored).count() == 1
