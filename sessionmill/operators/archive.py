"""Compaction of finished days behind a commit log, consolidated rollups, release of raw days, the payload store, audits."""

from __future__ import annotations

import datetime as dt
import math
import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionmill.operators import rollups
from sessionmill.operators import turns as build
from sessionmill.schemas import conform
from sessionmill.sources import daylog


def eligible_days(events: DataFrame, done: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Days with events that are over and not compacted yet."""
    days = events.select(F.to_date("ts").alias("day")).where("day is not null").distinct()
    return days.where(F.col("day") < F.lit(as_of.date())).join(done, "day", "left_anti")


#: Rollups that a version holds: the five by day, and what search prunes by.
ROLLUPS = ("day", "by_model", "by_tool", "by_project", "by_session", "words", "grams")
#: Runs of about one size are merged once there are so many.
FAN = 8
_ORDER = {"grams": ("gram", "day"), "by_session": ("day", "tenant_id", "session_id"), "words": ("day", "tenant_id", "session_id")}


def _write(frame: DataFrame, path: str, order: tuple[str, ...]) -> None:
    """Writes a new folder, dealt by day and sorted inside: AQE puts small days together and splits a large one over several files
    (which then hold that day alone), so nothing is counted beforehand and no file is small for holding one day."""
    dealt = frame.hint("rebalance", "day").sortWithinPartitions(*order)
    dealt.write.mode("error").option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").parquet(path)


def _write_all(spark: SparkSession, writes: dict[str, tuple[DataFrame, tuple[str, ...]]]) -> None:
    """Writes several small tables at once: each alone would leave most of a cluster idle."""
    one = inheritable_thread_target(spark)(lambda path, frame, order: _write(frame, path, order))
    with ThreadPoolExecutor(len(writes)) as pool:
        for done in [pool.submit(one, path, frame, order) for path, (frame, order) in writes.items()]:
            done.result()


def write_days(turns: DataFrame, path: str, days: DataFrame | None = None) -> int:
    """Writes turns and rollups of the given days (day), by default those that turns hold, as a new version, and commits it.

    A day that is written again is replaced whole, in every table, also if it has become empty. Turns are built once, by the write;
    rollups and counts are made of the turns as written. Turns without a day belong to none and are left out. Returns the number of the
    commit.
    """
    spark = turns.sparkSession
    chosen = None if days is None else [r["day"] for r in days.select("day").distinct().collect()]  # one value a day
    turns = turns.where("day is not null") if chosen is None else turns.where(F.col("day").isin(chosen))
    version = uuid.uuid4().hex
    _write(turns, f"{path}/turns/version={version}", ("day", "tenant_id", "session_id", "started_at", "first_seq"))
    written = spark.read.schema(turns.schema).parquet(f"{path}/turns/version={version}").withColumn("version", F.lit(version))
    made = rollups.rollups(written.drop("version"))
    _write_all(spark, {f"{path}/rollup/{n}/{version}": (f.withColumn("version", F.lit(version)), _ORDER.get(n, ("day", "tenant_id"))) for n, f in made.items()})
    refs = F.sum(F.size("content_blobs")) if "content_blobs" in turns.columns else F.lit(None).cast("long")
    counts = written.groupBy("day").agg(F.count("*").alias("turns"), refs.alias("refs"), F.max("first_seq").alias("seq")).collect()  # one row a day
    held = {daylog.as_text(d): {"turns": 0, "refs": 0, "seq": None} for d in chosen or []}
    held |= {daylog.as_text(r["day"]): {"turns": r["turns"], "refs": r["refs"], "seq": r["seq"]} for r in counts}
    version_field = T.StructField("version", T.StringType())
    schemas = {"turns": turns.schema} | {name: frame.schema for name, frame in made.items()}
    return daylog.commit(spark, path, {"version": version, "days": held, "holds": [[d, version] for d in held], "schemas": {n: T.StructType([*s.fields, version_field]).jsonValue() for n, s in schemas.items()}})


def _only(frame: DataFrame, pairs: set[tuple[str, str]], live: set[tuple[str, str]]) -> DataFrame:
    """frame without the days that later versions have replaced."""
    dead: dict[str, list[dt.date]] = {}
    for d, version in sorted(pairs - live):
        dead.setdefault(version, []).append(dt.date.fromisoformat(d))
    for version, gone in dead.items():
        frame = frame.where(~((F.col("version") == version) & F.col("day").isin(gone)))
    return frame.drop("version")


def read_table(spark: SparkSession, path: str, name: str, since: dt.date | None = None, to: dt.date | None = None) -> DataFrame:
    """A table of the archive as committed: turns, or a rollup, over all days or those from since to to. The log tells the schema and
    the folders that hold such days, so no file is asked; inside a folder, rows are sorted by day and skipped by their statistics."""
    state = daylog.state(spark, path)
    if name not in state.schemas:
        raise ValueError(f"no table {name!r} in {path}")
    inside = lambda d: (since is None or d >= since.isoformat()) and (to is None or d <= to.isoformat())
    schema, live = state.schema(name), state.live()
    wanted = {(d, v) for d, v in live if inside(d)}
    if name == "turns":
        held = {v: {(d, v) for d in state.versions[v]} for v in {v for d, v in wanted if state.days[d]["turns"]}}
        paths = [f"{path}/turns/version={v}" for v in sorted(held)]
    else:
        held = {run: {(d, v) for d, v in pairs} for run, pairs in state.runs.items() if any((d, v) in wanted for d, v in pairs)}
        paths = [f"{path}/rollup/{name}/{run}" for run in sorted(held)]
    if not paths:
        return spark.createDataFrame([], schema).drop("version")
    reader = spark.read.schema(schema)
    found = (reader.option("basePath", f"{path}/turns") if name == "turns" else reader).parquet(*paths)
    for low, bound in ((True, since), (False, to)):
        if bound is not None:
            found = found.where(F.col("day") >= F.lit(bound) if low else F.col("day") <= F.lit(bound))
    return _only(found, set().union(*held.values()), live)


def done_days(spark: SparkSession, path: str) -> DataFrame:
    """(day, turns, refs, compacted_seq) of the committed days, by the log alone."""
    rows = [(dt.date.fromisoformat(d), c["turns"], c["refs"], c["seq"]) for d, c in sorted(daylog.state(spark, path).days.items())]
    return spark.createDataFrame(rows, "day date, turns long, refs long, compacted_seq long")


def consolidate(spark: SparkSession, path: str, whole: bool = False) -> list[str]:
    """Merges rollups of many versions into one folder a table, so that a question over years opens few files.

    Runs are told by the power of FAN in their number of days; FAN runs of one power are merged into one of the next. So a day is
    rewritten a few times at most, however long the history, and a version that is written later is simply a run of its own.
    Readers see it at once. ``whole`` merges all. Returns the runs that were merged (none if there was nothing to do).
    """
    state = daylog.state(spark, path)
    live, tiers = state.live(), {}
    for run, held in state.runs.items():
        tiers.setdefault(0 if whole else int(math.log(max(1, len(held)), FAN)), []).append(run)
    merged = next((runs for _, runs in sorted(tiers.items()) if len(runs) >= (2 if whole else FAN)), None)
    if merged is None:
        return []
    new, pairs = uuid.uuid4().hex, {(d, v) for run in merged for d, v in state.runs[run]}
    writes = {}
    for name in ROLLUPS:
        read = spark.read.schema(state.schema(name)).parquet(*[f"{path}/rollup/{name}/{run}" for run in merged])
        kept = _only(read.withColumn("kept", F.col("version")), pairs, live).withColumnRenamed("kept", "version")
        writes[f"{path}/rollup/{name}/{new}"] = (kept, _ORDER.get(name, ("day", "tenant_id")))
    _write_all(spark, writes)
    daylog.commit(spark, path, {"version": new, "replaces": merged, "holds": [list(p) for p in sorted(pairs & live)]})
    return merged


def compact(events: DataFrame, rates: DataFrame, path: str, as_of: dt.datetime, again: bool = False) -> DataFrame:
    """Compacts every day of events (EVENT columns) that is over and not in the archive; with ``again`` also those that are.

    The days come from a scan of one column, and only their events are built into turns. Returns the days.
    """
    spark = events.sparkSession
    done = done_days(spark, path).select("day")
    days = [r["day"] for r in eligible_days(events, done.limit(0) if again else done, as_of).collect()]  # one value a day
    out = spark.createDataFrame([(d,) for d in days], "day date")
    if days:
        write_days(build.full(events.where(F.to_date("ts").isin(days)), rates), path, out)
        consolidate(spark, path)
    return out


def hot_and_cold(spark: SparkSession, path: str, events: DataFrame, rates: DataFrame) -> DataFrame:
    """Turns of committed days from the archive, and those of all other days built from events."""
    done = [r["day"] for r in done_days(spark, path).select("day").collect()]  # one value a day
    hot = build.full(events.where(~F.coalesce(F.to_date("ts").isin(done), F.lit(False))), rates)
    return read_table(spark, path, "turns").unionByName(hot, allowMissingColumns=True) if done else hot


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes folders that no reader of the present state reads: replaced runs, versions without a live day, and what runs that died
    have left. Not while a compaction runs or a reader of an earlier state is at work. Returns the folders."""
    state = daylog.state(spark, path)
    versions = {f"version={v}" for _, v in state.live()}
    gone = [f"{path}/turns/{f}" for f in daylog.folders(spark, f"{path}/turns") if f not in versions]
    gone += [f"{path}/rollup/{n}/{f}" for n in daylog.folders(spark, f"{path}/rollup") for f in daylog.folders(spark, f"{path}/rollup/{n}") if f not in state.runs]
    for folder in gone:
        daylog.delete(spark, folder)
    return gone


def release(spark: SparkSession, path: str, raw: str, rates: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Drops finished days of a raw log from its folder (partitioned by day), each only if the archive holds it in full.

    Turns are rebuilt from the raw events of the candidate days and compared with the archive's as read back from its files: the
    number of turns and of content refs must agree by day. Returns the verdict by day with what was released; days that disagree,
    are not committed or are not over keep their events.
    """
    there = sorted(f.removeprefix("day=") for f in daylog.folders(spark, raw) if f.startswith("day="))
    done = daylog.state(spark, path).days
    days = [dt.date.fromisoformat(d) for d in there if d in done and d < as_of.date().isoformat()]
    schema = "day date, archived_turns long, archived_refs long, rebuilt_turns long, rebuilt_refs long, releasable boolean"
    if not days:
        return spark.createDataFrame([], schema)
    chosen = F.col("day").isin(days)
    refs = F.size("content_blobs").alias("refs")
    rebuilt = build.full(conform(spark.read.parquet(raw).where(chosen).drop("day")), rates).where(chosen).select("day", refs)
    archived = read_table(spark, path, "turns").where(chosen).select("day", refs)
    rows = prune_verdict(archived, rebuilt).collect()  # one row a day
    for r in rows:
        if r["releasable"]:
            daylog.delete(spark, f"{raw}/day={r['day'].isoformat()}")
    return spark.createDataFrame(rows, schema)


def complete_session_days(session_days: DataFrame, turns: DataFrame) -> DataFrame:
    """The session-day rollup, derived from turns for days that were written before it existed."""
    older = turns.join(session_days.select("tenant_id", "day").distinct(), ["tenant_id", "day"], "left_anti")
    return session_days.unionByName(rollups.rollup_session_day(older))


#: Columns of an archive row; flags of a turn that only live events need are not among them.
ROW = ("tenant_id", "day", "turn_key", "session_id", "turn_id", "message_id", "user_id", "machine_id", "source", "model", "stream", "project", "project_id", "git_branch", "status_code", "stop_reason", "duration_ms", "ttfb_ms", "message_count", "system_blocks")
ROW_USAGE = ("input_tokens", "output_tokens", "cache_read")
ROW_REST = ("tools_offered", "request_blob", "response_blob", "content_blobs", "error", "pending", "first_seq", "cost_units", "priced")


def to_rows(turns: DataFrame) -> DataFrame:
    """Flat archive rows of priced turns: instants in ms, both cache-write tiers, names of the calls; call ids don't survive."""
    names = F.filter(F.transform("calls", lambda c: c["name"]), lambda n: n.isNotNull() & (n != "")).alias("tool_calls")
    return turns.select(F.unix_millis("started_at").alias("ts"), *ROW, *ROW_USAGE, F.col("w5m").alias("cache_write_5m"), F.col("w1h").alias("cache_write_1h"), names, *ROW_REST)


def from_rows(rows: DataFrame) -> DataFrame:
    """Turns of archive rows, with what the rows keep; calls have names and no ids."""
    calls = F.transform("tool_calls", lambda n: F.struct(F.lit(None).cast("string").alias("id"), n.alias("name"))).alias("calls")
    tiers = [F.col("cache_write_5m").alias("w5m"), F.col("cache_write_1h").alias("w1h"), (F.col("cache_write_5m") + F.col("cache_write_1h")).alias("cache_write")]
    return rows.select(F.timestamp_millis("ts").alias("started_at"), *ROW, *ROW_USAGE, *tiers, calls, *ROW_REST)


def blobs(payloads: DataFrame) -> DataFrame:
    """(tenant_id, ref, payload): each payload once a tenant, by its content hash."""
    return payloads.where("payload is not null").select("tenant_id", F.sha2("payload", 256).alias("ref"), "payload").dropDuplicates(["tenant_id", "ref"])


def lookup(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """Payloads of (tenant_id, ref); a ref that is no hash finds nothing."""
    return wanted.where(F.col("ref").rlike("^[0-9a-f]{64}$")).join(store, ["tenant_id", "ref"])


#: Up to this many wanted refs are broadcast to the store; more are joined by shuffle.
BROADCAST_REFS = 1_000_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_REFS else df


def _buckets(refs: DataFrame) -> list[str]:
    return [r["bucket"] for r in refs.select(F.substring("ref", 1, 1).alias("bucket")).distinct().collect()]  # 16 at most


def store_blobs(payloads: DataFrame, path: str) -> int:
    """Adds payloads (tenant_id, payload) to a store that is laid out by the first digit of their ref, sorted by ref and with Bloom filters of it, each once a tenant; returns
    how many were new. Of what is stored only refs of the same digits are read. Run again, it adds nothing; two writers at once may
    store a payload twice, which a look-up shows once."""
    spark = payloads.sparkSession
    batch = blobs(payloads).withColumn("bucket", F.substring("ref", 1, 1)).persist()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fresh = batch
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        keys = ["tenant_id", "ref"]
        known = spark.read.schema(batch.schema).parquet(path).where(F.col("bucket").isin(_buckets(batch))).select(keys)
        fresh = batch.join(_few(known.join(_few(batch.select(keys)), keys, "left_semi").distinct()), keys, "left_anti")
    fresh = fresh.persist()
    n = fresh.count()
    out = fresh.hint("rebalance", "bucket").sortWithinPartitions("bucket", "ref", "tenant_id").write.mode("append")
    out.option("compression", "zstd").option("parquet.bloom.filter.enabled#ref", "true").partitionBy("bucket").parquet(path)
    fresh.unpersist()
    batch.unpersist()
    return n


def find_blobs(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``lookup`` in a store as ``store_blobs`` lays it out: only folders of the wanted refs' first digits are read, and the refs go to
    the payloads and not the payloads to the refs. wanted: (tenant_id, ref) and other columns."""
    asked = wanted.where(F.col("ref").rlike("^[0-9a-f]{64}$"))
    found = spark.read.schema("tenant_id string, ref string, payload string, bucket string").parquet(path).where(F.col("bucket").isin(_buckets(asked)))
    met = found.join(_few(asked.select("tenant_id", "ref").distinct()), ["tenant_id", "ref"], "left_semi").dropDuplicates(["tenant_id", "ref"])
    return asked.join(met.drop("bucket"), ["tenant_id", "ref"])


def summary(turns: DataFrame) -> DataFrame:
    days = turns.groupBy("day").agg(F.count("*").alias("turns"))
    return days.agg(F.count("*").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("turns").alias("turns"), F.max("turns").alias("most_turns"))


def days_of(*frames: DataFrame) -> DataFrame:
    """Distinct days of several tables, in order."""
    out = frames[0].select("day")
    for f in frames[1:]:
        out = out.union(f.select("day"))
    return out.distinct().orderBy("day")


def prune_verdict(archived: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """By day: turns and content refs in the archive and rebuilt from raw events, and whether the raw rows may go."""
    count = lambda f, name: f.groupBy("day").agg(F.count("*").alias(f"{name}_turns"), F.sum("refs").alias(f"{name}_refs"))
    both = count(archived, "archived").join(count(rebuilt, "rebuilt"), "day", "full")
    same = F.col("archived_turns").eqNullSafe(F.col("rebuilt_turns")) & F.col("archived_refs").eqNullSafe(F.col("rebuilt_refs"))
    return both.withColumn("releasable", same)


def partition_audit(frame: DataFrame, partition: str, inside: str) -> DataFrame:
    """Rows of each partition whose own column disagrees with it."""
    return frame.groupBy(F.col(partition).alias("partition")).agg(F.count("*").alias("n_rows"), F.count_if(~F.col(partition).eqNullSafe(F.col(inside))).alias("mismatched"))


#: Lower-case letters and digits, with at most one underscore, inside.
TENANT_ID, TENANT_MOST = r"^[a-z0-9]+(_[a-z0-9]+)?$", 64


def scope(frame: DataFrame, tenant_id: str) -> DataFrame:
    """One tenant's rows; an id outside the alphabet is refused, before any path or predicate is made of it."""
    if len(tenant_id) > TENANT_MOST or not re.fullmatch(TENANT_ID, tenant_id):
        raise ValueError(f"no tenant id: {tenant_id!r}")
    return frame.where(F.col("tenant_id") == tenant_id)


def pending(events: DataFrame, shipped: DataFrame) -> DataFrame:
    """Events not shipped yet, by (type, turn_id, message_id, ts); content events are never shipped."""
    keys = ["type", "turn_id", "message_id", "ts"]
    on = [events[k].eqNullSafe(shipped[k]) for k in keys]
    return events.where("type <> 'content'").join(shipped.select(*keys), on, "left_anti")


def late_days(events: DataFrame, done: DataFrame) -> DataFrame:
    """Compacted days (day, compacted_seq) that later events touched, to be compacted again."""
    e = events.withColumn("day", F.to_date("ts"))
    return e.join(done, "day").where("seq > compacted_seq").groupBy("day").agg(F.count("*").alias("late_events"))
