"""Structured Streaming: day counts, shipping without repeats, turns kept up to date by micro-batch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sessionmill.functions.pricing import with_cost
from sessionmill.operators import archive, coverage, turns
from sessionmill.schemas import EVENT, conform


def tumbling_days(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by UTC day and type; a day is final once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "type").agg(F.count("*").alias("events")).select(F.to_date("w.start").alias("day"), "type", "events")


def shippable(events: DataFrame, overlap: str = "1 hour") -> DataFrame:
    """Events once each within the overlap, without content events."""
    keys = ["type", "turn_id", "message_id", "ts"]
    return events.where("type <> 'content'").withWatermark("ts", overlap).dropDuplicatesWithinWatermark(keys)


def keep_days(events: DataFrame, read_day: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, rates: DataFrame) -> StreamingQuery:
    """Recompacts the days that each micro-batch touches, turns and rollups as batch compaction writes them, priced and with their
    calls and content, and merges rollups as they add up. read_day: all events of the given days, the batch's among them. No state is
    kept between batches."""

    def upsert(batch: DataFrame, _: int) -> None:
        days = batch.select(F.to_date("ts").alias("day")).where("day is not null").distinct()
        merged = read_day(days)
        archive.write_days(turns.full(merged, rates), path, days)
        archive.consolidate(batch.sparkSession, path)

    return events.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Observations(StatefulProcessor):
    """State of one turn: what has been observed of it, each observation once. New observations send out all that are known; a timer
    drops the state when the watermark has left the turn's day behind."""

    def __init__(self, late_ms: int):
        self.late_ms = late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getListState("known", "event string")
        self.until = handle.getValueState("until", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803 - Spark gives them by name
        before = [e for (e,) in self.known.get()] if self.known.exists() else []
        held, new, last = set(before), [], 0
        for part in rows:
            last = max(last, int(part["day_ms"].max()))
            for event in part["event"]:
                if event not in held:
                    held.add(event)
                    new.append(event)
        if not new:
            return
        self.known.appendList([(e,) for e in new])
        if not self.until.exists():
            at = last + 86_400_000 + self.late_ms
            self.until.update((at,))
            self.handle.registerTimer(at)
        yield pd.DataFrame({"event": before + new})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        self.known.clear()
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: State on disk, of which a batch keeps what it changed; what the watermark has left behind goes with the next batch that brings events.
#: Buffers and caches of all stores of an executor share one bound, since there are as many stores as partitions of the state.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "500",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Of a run that ends with what is there: a store is closed when its task ends, as the next run opens stores of its own.
ONCE = {"spark.sql.streaming.stateStore.unloadOnCommit": "true"}


def _observations(events: DataFrame, late: str) -> tuple[DataFrame, int]:
    """(tenant_key, day, turn_key, ts, starts, event as JSON) of the events that make turns, and ``late`` in ms."""
    late_ms = int(events.sparkSession.sql(f"select cast(interval {late} as interval day to second)").first()[0].total_seconds() * 1000)
    keyed = turns.keyed(conform(events)).where("type <> 'content' and ts is not null and turn_key is not null")
    return keyed.select(F.coalesce("tenant_id", F.lit("")).alias("tenant_key"), "day", "turn_key", "ts", F.col("day").cast("timestamp").alias("starts"), F.to_json(F.struct(*EVENT.names), _JSON).alias("event")), late_ms


def observed(events: DataFrame, late: str = "7 days") -> DataFrame:
    """For each turn that a micro-batch brings something new of, all of its observations so far (EVENT columns).

    Turns are keyed as build_turns keys them, so one key's state is one turn of one day. Observations repeat, come in any order and
    up to ``late`` behind the newest; content events are left out. Repeats are dropped by a hash of the whole event, and what is new
    joins the turn's list; both are Spark's own state, so no key costs a call to Python, and both go once the watermark has left the
    day behind. That runs on the days' starts, a day behind ``late``: no event within ``late`` starts a day before it. Needs the
    RocksDB state store (``stateful_turns`` sets it).
    """
    rows, late_ms = _observations(events, late)
    new = rows.withColumn("digest", F.unhex(F.sha2("event", 256))).withWatermark("starts", f"{late_ms + 86_400_000} milliseconds").dropDuplicates(["starts", "digest"])
    known = new.groupBy("tenant_key", "starts", "turn_key").agg(F.collect_list("event").alias("events"))
    return known.select(F.explode("events").alias("event")).select(F.from_json("event", EVENT, _JSON).alias("e")).select("e.*")


def observed_by_processor(events: DataFrame, late: str = "7 days") -> DataFrame:
    """``observed`` with each observation kept once, by a processor with a timer a turn: less state, but some calls to Python for each
    turn of a batch, so it is for streams of small batches."""
    rows, late_ms = _observations(events, late)
    timed = rows.withWatermark("ts", late).withColumn("day_ms", F.unix_millis("starts")).drop("starts")
    made = timed.groupBy("tenant_key", "day", "turn_key").transformWithStateInPandas(Observations(late_ms), "event string", outputMode="Update", timeMode="EventTime")
    return made.select(F.from_json("event", EVENT, _JSON).alias("e")).select("e.*")


def stateful_turns(events: DataFrame, out: str, checkpoint: str, rates: DataFrame, late: str = "7 days", once: bool = True) -> StreamingQuery:
    """Keeps out/batch=N: the turns that each micro-batch brought something new of, merged over all their observations, with calls
    and prices. A batch that runs again replaces itself; ``current_turns`` reads the newest of each turn. No day is read again."""

    def upsert(batch: DataFrame, number: int) -> None:
        seen = batch.persist(StorageLevel.DISK_ONLY)
        merged = with_cost(turns.build_turns(seen, calls=True), rates, seen)
        merged.write.mode("overwrite").parquet(f"{out}/batch={number}")
        seen.unpersist()

    spark = events.sparkSession
    asked = STATE | (ONCE if once else {})
    before = {name: spark.conf.get(name, None) for name in asked}
    for name, value in asked.items():
        spark.conf.set(name, value)
    try:
        writer = observed(events, late).writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def current_turns(spark: SparkSession, out: str) -> DataFrame:
    """The newest row of each turn."""
    newest = F.row_number().over(W.partitionBy(*turns.KEY).orderBy(F.desc("batch")))
    return spark.read.parquet(out).withColumn("newest", newest).where("newest = 1").drop("newest", "batch")


def destination_checkpoint(root: str, destination: str) -> str:
    """Where the progress of shipping to a destination is kept: a new destination starts from the beginning."""
    return f"{root.rstrip('/')}/{hashlib.sha256(destination.encode()).hexdigest()[:16]}"


def ship(events: DataFrame, destination: str, checkpoints: str, overlap: str = "1 hour") -> StreamingQuery:
    """Appends events to the destination (a Parquet folder), each once within the overlap; goes on where it stopped."""
    out = shippable(events, overlap).writeStream.format("parquet").option("path", destination)
    return out.option("checkpointLocation", destination_checkpoint(checkpoints, destination)).trigger(availableNow=True).start()


def follow(lines: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Transcript lines into out/lines and their coverage counters into out/coverage, a folder a batch, so that a batch that is
    run again replaces itself. Without ``once`` it polls every two seconds. A new checkpoint and out reads all from the start."""

    def upsert(batch: DataFrame, number: int) -> None:
        kept = f"{out}/lines/batch={number}"
        batch.write.mode("overwrite").parquet(kept)
        written = batch.sparkSession.read.schema(batch.schema).parquet(kept)
        coverage.coverage(written).write.mode("overwrite").parquet(f"{out}/coverage/batch={number}")

    writer = lines.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(once=True) if once else writer.trigger(processingTime="2 seconds")).start()


def catch_up(lines: Callable[[], DataFrame], out: str, checkpoint: str) -> int:
    """Follows a bounded source batch by batch until a run finds nothing new. Returns the number of batches."""
    n = 0
    while True:
        query = follow(lines(), out, checkpoint)
        query.awaitTermination()
        if not any(p["numInputRows"] for p in query.recentProgress):
            return n
        n += 1


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """All that a stream has so far, as a batch table in path; ``complete`` results replace each other."""

    def upsert(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/{'all' if mode == 'complete' else f'batch={number}'}")

    stream.writeStream.foreachBatch(upsert).outputMode(mode).option("checkpointLocation", f"{path}/at").trigger(availableNow=True).start().awaitTermination()
    spark: SparkSession = stream.sparkSession
    return spark.read.option("recursiveFileLookup", "true").schema(stream.schema).parquet(f"{path}/out")
