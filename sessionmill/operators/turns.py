"""Turns: all observations of one exchange merged, each field by its own rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.pricing import with_cost
from sessionmill.functions.columns import attributed, failed, first_of, last_of, present

KEY = ["tenant_id", "day", "turn_key"]
USAGE = ("input_tokens", "output_tokens", "cache_write", "cache_read", "cache_write_5m", "cache_write_1h", "reasoning_tokens")


def keyed(events: DataFrame) -> DataFrame:
    """events with day (UTC) and turn_key: by message id, else by turn id."""
    key = F.coalesce(F.concat(F.lit("msg:"), "message_id"), F.concat(F.lit("turn:"), "turn_id"))
    return events.withColumns({"day": F.to_date("ts"), "turn_key": key})


def build_turns(events: DataFrame, calls: bool = False) -> DataFrame:
    """One row for each exchange and UTC day, whatever order its observations came in. Tool results make no turn of their own.

    events: the columns of EVENT; ``seq`` is the order of arrival. One grouped aggregate, with partial aggregation on
    the map side. ``calls`` adds the turn's calls (as ``tool_calls`` makes them) in the same aggregate, without a shuffle of their own.
    """
    e = keyed(events.where("not (type = 'content' and tool_use_id is not null)"))
    o, t = F.col("seq"), F.col("type")
    request, response, error = t == "request", t == "response", t == "error"
    c = F.col
    nonzero = lambda name: F.when(c(name) != 0, c(name))
    timed = error | (response & nonzero("duration_ms").isNotNull())
    has_usage = response & c("input_tokens").isNotNull()
    usage = F.max_by(F.struct(*USAGE), F.when(has_usage, o))
    first = ("source", "message_id", "turn_id", "user_id", "machine_id", "project", "project_id", "git_branch", "effort")
    seen = F.transform("tool_calls", lambda x, i: F.struct(o.alias("seq"), i.alias("pos"), x["id"].alias("id"), x["name"].alias("name")))
    listed = [F.flatten(F.collect_list(F.when(response & (F.size("tool_calls") > 0), seen))).alias("seen")] if calls else []
    out = e.repartition(*KEY).groupBy(*KEY).agg(
        last_of(c("session_id"), o).alias("session_id"),
        *[first_of(c(n), o).alias(n) for n in first],
        *[F.coalesce(F.bool_or(n), F.lit(False)).alias(n) for n in ("in_repo", "subagent", "stream")],
        F.coalesce(last_of(c("model"), o, response), first_of(c("model"), o, request)).alias("model"),
        F.coalesce(last_of(c("ts"), o, request), first_of(c("ts"), o, response | error)).alias("started_at"),
        last_of(nonzero("message_count"), o, request).alias("message_count"),
        last_of(nonzero("system_blocks"), o, request).alias("system_blocks"),
        last_of(F.when(F.size("tools_offered") > 0, c("tools_offered")), o, request).alias("tools_offered"),
        last_of(nonzero("status_code"), o, response).alias("status_code"),
        last_of(nonzero("ttfb_ms"), o, response).alias("ttfb_ms"),
        F.max_by(F.coalesce("duration_ms", F.lit(0)), F.when(timed, o)).alias("duration_ms"),
        first_of(c("stop_reason"), o, response).alias("stop_reason"),
        first_of(c("request_blob"), o, request).alias("request_blob"),
        first_of(c("response_blob"), o, response).alias("response_blob"),
        last_of(c("error"), o, error).alias("error"),
        (~F.coalesce(F.bool_or(response | error), F.lit(False))).alias("pending"),
        F.min(o).alias("first_seq"),
        usage.alias("usage"),
        *listed,
    )
    kept = [n for n in out.columns if n not in ("usage", "seen")]
    return out.select(*kept, "usage.*", *([_distinct_calls(F.sort_array("seen")).alias("calls")] if calls else []))


def _distinct_calls(seen: Column) -> Column:
    """Calls of one turn from all that was seen of them, in order: distinct by id; a later name fills a blank; those without an id all stay."""
    has_id = lambda x: F.coalesce(x["id"] != "", F.lit(False))
    ids = F.array_distinct(F.transform(F.filter(seen, has_id), lambda x: x["id"]))

    def one(i: Column) -> Column:
        own = F.filter(seen, lambda x: x["id"] == i)
        name = F.try_element_at(F.filter(own, lambda x: F.coalesce(x["name"] != "", F.lit(False))), F.lit(1))["name"]
        return F.struct(own[0]["seq"].alias("seq"), own[0]["pos"].alias("pos"), i.alias("id"), name.alias("name"))

    blank = F.transform(F.filter(seen, lambda x: ~has_id(x)), lambda x: F.struct(x["seq"].alias("seq"), x["pos"].alias("pos"), F.lit(None).cast("string").alias("id"), x["name"].alias("name")))
    both = F.sort_array(F.concat(F.transform(ids, one), blank))
    return F.transform(both, lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name")))


def tool_calls(events: DataFrame) -> DataFrame:
    """(key, calls): each turn's calls, distinct by id, in the order first seen; a later name fills a blank; calls without an id all stay."""
    e = keyed(events).where("type = 'response'").select(*KEY, "seq", F.posexplode("tool_calls").alias("pos", "call"))
    at = F.struct("seq", "pos")
    named = e.where("call.id is not null and call.id <> ''").groupBy(*KEY, F.col("call.id").alias("id")).agg(F.min(at).alias("at"), first_of(present(F.col("call.name")), at).alias("name"))
    blank = e.where("call.id is null or call.id = ''").select(*KEY, F.lit(None).cast("string").alias("id"), at.alias("at"), F.col("call.name").alias("name"))
    return named.unionByName(blank).groupBy(*KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "id", "name"))), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"))).alias("calls"))


def with_tool_calls(turns: DataFrame, events: DataFrame) -> DataFrame:
    """turns with calls (empty list if none)."""
    calls = tool_calls(events)
    return turns.join(calls, KEY, "left").withColumn("calls", F.coalesce("calls", F.array().cast("array<struct<id:string,name:string>>")))


def content_refs(events: DataFrame) -> DataFrame:
    """(key, content_blobs): refs of each turn's captured content in order of arrival, without dedupe; behind them those of the
    results of its calls. A call id that several turns of a day hold is the turn's that showed it first; a result whose call no turn of
    the day made is dropped."""
    e = keyed(events).where("type = 'content' and content_ref is not null")
    ref = [F.col("seq"), F.col("content_ref")]
    own = e.where("tool_use_id is null").select(*KEY, F.lit(0).alias("behind"), *ref)
    calls = keyed(events).where("type = 'response'").select(*KEY, "seq", F.explode("tool_calls.id").alias("tool_use_id")).where("tool_use_id <> ''")
    owners = calls.groupBy("tenant_id", "day", "tool_use_id").agg(F.min_by("turn_key", F.struct("seq", "turn_key")).alias("turn_key"))
    results = owners.join(e.where("tool_use_id is not null").select("tenant_id", "day", "tool_use_id", *ref), ["tenant_id", "day", "tool_use_id"])
    both = own.unionByName(results.select(*KEY, F.lit(1).alias("behind"), *ref))
    listed = F.sort_array(F.collect_list(F.struct("behind", *ref)))
    return both.groupBy(*KEY).agg(F.transform(listed, lambda x: x["content_ref"]).alias("content_blobs"))


def with_content(turns: DataFrame, events: DataFrame) -> DataFrame:
    """turns with content_blobs (empty list if none)."""
    return turns.join(content_refs(events), KEY, "left").withColumn("content_blobs", F.coalesce("content_blobs", F.array().cast("array<string>")))


def full(events: DataFrame, rates: DataFrame) -> DataFrame:
    """Turns as the archive keeps them: with calls, content refs and prices."""
    return with_cost(with_content(build_turns(events, calls=True), events), rates, events)


def failures(turns: DataFrame) -> DataFrame:
    """Turns with an error text or a status of 400 or more."""
    return turns.where(failed(F.col("error"), F.col("status_code")))


def unattributed(turns: DataFrame) -> DataFrame:
    """Turns without a tenant or a user."""
    return turns.where(~attributed(F.col("tenant_id"), F.col("user_id")))


def attach_tool_results(turns: DataFrame, results: DataFrame) -> DataFrame:
    """(turn key, tool_use_id, content ref) of results (tenant_id, day, tool_use_id, ref) whose call a turn of that day made; others are dropped."""
    owned = turns.select(*KEY, F.explode("calls").alias("call")).where("call.id is not null").select(*KEY, F.col("call.id").alias("tool_use_id")).distinct()
    return owned.join(results, ["tenant_id", "day", "tool_use_id"])


def dedupe_events(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """events with event_hash, once for each tenant and content; those that ``existing`` (tenant_id, event_hash) holds are left out."""
    content = [n for n in events.columns if n not in ("seq", "event_hash")]
    out = events.withColumn("event_hash", F.sha2(F.to_json(F.struct(*content), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}), 256)).dropDuplicates(["tenant_id", "event_hash"])
    return out if existing is None else out.join(existing, ["tenant_id", "event_hash"], "left_anti")


#: Up to this many keys of a batch are broadcast to the stored log; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def append_events(events: DataFrame, path: str) -> int:
    """Appends events to a stored log (partitioned by day), each once a tenant and content. Returns how many were new.

    An event's content holds its instant, so an equal one can only be stored under the same day: only the days of the batch are looked
    at, and of these two columns. The batch's keys go to the stored log and not the log to the batch, so the log is not shuffled. A
    run that is repeated, also after it died, adds nothing twice; two writers at once may.
    """
    spark, keys = events.sparkSession, ["tenant_id", "day", "event_hash"]
    batch = dedupe_events(events).withColumn("day", F.to_date("ts")).persist()
    days = [r["day"] for r in batch.select("day").distinct().collect()]  # one value a day
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        few = batch.count() <= BROADCAST_KEYS
        asked = batch.select(keys)
        known = spark.read.schema(batch.schema).parquet(path).where(F.col("day").isin([d for d in days if d]) | (F.col("day").isNull() if None in days else F.lit(False))).select(keys)
        asked = F.broadcast(asked) if few else asked
        met = known.join(asked, [known[k].eqNullSafe(asked[k]) for k in keys], "left_semi").distinct()
        met = F.broadcast(met) if few else met  # no more than the batch has
        fresh = batch.join(met, [batch[k].eqNullSafe(met[k]) for k in keys], "left_anti")
    else:
        fresh = batch
    fresh = fresh.persist()
    n = fresh.count()
    fresh.write.mode("append").partitionBy("day").parquet(path)
    fresh.unpersist()
    batch.unpersist()
    return n
