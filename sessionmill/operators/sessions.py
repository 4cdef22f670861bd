"""Sessions: turns rolled up, and views of one session's turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionmill.functions.columns import failed, first_of, hit_rate, last_of
from sessionmill.functions.pricing import dollars

#: Turn order: by start, then arrival.
ORDER = ("started_at", "first_seq")


def ended_at() -> Column:
    return F.timestamp_add("MILLISECOND", F.coalesce("duration_ms", F.lit(0)), F.col("started_at"))


def sessions(turns: DataFrame) -> DataFrame:
    """One row a session from priced turns with calls; every aggregate is partial, so a long session is no hot task."""
    o = F.struct(*ORDER)
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    named = F.col("project").isNotNull()
    names = F.filter(F.transform("calls", lambda x: x["name"]), lambda x: x.isNotNull() & (x != ""))
    out = turns.where("session_id is not null").groupBy("tenant_id", "session_id").agg(
        F.min("started_at").alias("started_at"),
        F.max(ended_at()).alias("ended_at"),
        F.count("*").alias("turns"),
        *[n(c) for c in ("input_tokens", "output_tokens", "cache_write", "cache_read", "w5m", "w1h")],
        F.sum("cost_units").alias("cost_units"),
        F.count_if(~F.col("priced") & F.col("model").isNotNull()).alias("unpriced"),
        F.count_if(failed(F.col("error"), F.col("status_code"))).alias("errors"),
        F.sum(F.size("calls")).alias("tool_calls"),
        last_of(F.col("model"), o).alias("model"),
        F.min_by(F.struct("project", "project_id"), F.when(named, o)).alias("p"),
        first_of(F.col("git_branch"), o).alias("git_branch"),
        F.sort_array(F.collect_set("model")).alias("models"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(names)))).alias("tool_names"),
    )
    out = out.withColumns({"project": F.col("p.project"), "project_id": F.col("p.project_id"), "cost_usd": dollars(F.col("cost_units"))}).drop("p")
    duration = F.unix_millis("ended_at") - F.unix_millis("started_at")
    return out.withColumns({"duration_ms": duration, "hit_rate": hit_rate(F.col("input_tokens"), F.col("cache_write"), F.col("cache_read"))})


def turn_sequence(turns: DataFrame) -> DataFrame:
    """turns with their place (1, 2, ...) in their session.

    Turns are ranked within a session's minute, behind the counts of its earlier minutes, so a long session is many small
    windows; only its counts by minute meet.
    """
    t = turns.withColumn("minute", F.date_trunc("minute", "started_at"))
    key = ["tenant_id", "session_id", "minute"]
    counts = t.groupBy(*key).agg(F.count("*").alias("n"))
    before = W.partitionBy("tenant_id", "session_id").orderBy("minute").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"c_{c}") for c in key], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    t = t.withColumn("within", F.row_number().over(W.partitionBy(*key).orderBy(*ORDER)))
    same = [t[c].eqNullSafe(counts[f"c_{c}"]) for c in key]
    return t.join(counts, on=same).withColumn("place", (F.col("earlier") + F.col("within")).cast("int")).select(*turns.columns, "place")


def day_segments(turns: DataFrame, zone: str = "UTC") -> DataFrame:
    """Runs of a session's turns on one local day: segment, local_day, turns, first and last start, gap since the segment before.

    In order of start local days only rise, so a run is a day; windows hold a session's days and no turns.
    """
    local = F.to_date(F.from_utc_timestamp("started_at", zone)).alias("local_day")
    s = turns.where("started_at is not null").groupBy("tenant_id", "session_id", local).agg(F.count("*").alias("turns"), F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at"))
    own = W.partitionBy("tenant_id", "session_id").orderBy("local_day")
    return s.withColumns({"segment": F.row_number().over(own) - 1, "gap_ms": F.unix_millis("first_at") - F.unix_millis(F.lag("last_at").over(own))})


def detail(turns: DataFrame, session_days: DataFrame, session_id: str, tenant_id: str | None = None) -> DataFrame:
    """One session's turns in order; the session-day rollup tells the days, and only those are read."""
    mine = F.col("session_id") == session_id
    mine = mine if tenant_id is None else mine & (F.col("tenant_id") == tenant_id)
    days = session_days.where(mine).select("tenant_id", "day").distinct()
    # a row a day, sent to the turns: a shuffle by day would bring a long session's day together in one task
    return turn_sequence(turns.where(mine).join(F.broadcast(days), ["tenant_id", "day"], "left_semi"))


def session_span(session_days: DataFrame) -> DataFrame:
    """Oldest and newest day of each session, from the session-day rollup."""
    return session_days.groupBy("tenant_id", "session_id").agg(F.min("day").alias("oldest_day"), F.max("day").alias("newest_day"), F.count("*").alias("days"))


def timeline_buckets(turns: DataFrame, most: int = 240, buckets: int = 120) -> DataFrame:
    """A session's turns as bars: one each up to ``most``, else ``buckets`` of equal width in time, summed."""
    key = ["tenant_id", "session_id"]
    t = turns.where("started_at is not null").withColumn("ms", F.unix_millis("started_at"))
    spans = t.groupBy(*key).agg(F.count("*").alias("n"), F.min("ms").alias("low"), F.max("ms").alias("high"))
    t = t.join(spans, key)
    width = F.greatest((F.col("high") - F.col("low")) / F.lit(buckets), F.lit(1.0))
    wide = t.where(F.col("n") > most).withColumn("bucket", F.least(F.lit(buckets - 1), F.floor((F.col("ms") - F.col("low")) / width)).cast("int"))
    # windows only over sessions of at most ``most`` turns
    each = t.where(F.col("n") <= most).withColumn("bucket", F.row_number().over(W.partitionBy(*key).orderBy(*ORDER)) - 1)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return each.unionByName(wide).groupBy(*key, "bucket").agg(F.min("ms").alias("start_ms"), F.count("*").alias("turns"), *[total(c) for c in ("input_tokens", "output_tokens", "cache_write", "cache_read")], F.sum("cost_units").alias("cost_units"))
