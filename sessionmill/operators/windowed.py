"""Questions over a time window: which days a rollup answers, totals, series."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.columns import hit_rate
from sessionmill.functions.pricing import dollars
from sessionmill.operators import rollups

DEFAULT_DAYS, MOST_DAYS = 7, 3650
UTC = dt.timezone.utc


def _instant(text: str | None, end: bool = False) -> dt.datetime | None:
    if not text:
        return None
    try:
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
            day = dt.datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=UTC)
            return day + dt.timedelta(days=1, milliseconds=-1) if end else day
        found = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
        return found.astimezone(UTC) if found.tzinfo else None
    except ValueError:
        return None


def window(as_of: dt.datetime, start: str | None = None, end: str | None = None, days: int | None = None) -> tuple[dt.datetime, dt.datetime]:
    """The inclusive window asked for: seven days by default; days overrides start; reversed bounds are swapped; at most ten years."""
    to = _instant(end, True) or as_of
    since = _instant(start) or to - dt.timedelta(days=DEFAULT_DAYS)
    if days and days > 0:
        since = to - dt.timedelta(days=min(days, MOST_DAYS))
    since, to = min(since, to), max(since, to)
    return max(since, to - dt.timedelta(days=MOST_DAYS)), to


def in_window(frame: DataFrame, since: dt.datetime, to: dt.datetime, ts: str = "started_at") -> DataFrame:
    """Rows whose instant is in the window; the day predicate prunes partitions."""
    return frame.where(F.col("day").between(F.lit(since.date()), F.lit(to.date())) & F.col(ts).between(F.lit(since), F.lit(to)))


def whole_days(since: dt.datetime, to: dt.datetime) -> Column:
    """Predicate on day: days that lie fully in the window (the last day never counts as whole)."""
    first = since.date() if since.time() == dt.time(0) else since.date() + dt.timedelta(days=1)
    return F.col("day").between(F.lit(first), F.lit(to.date() - dt.timedelta(days=1)))


def edge_turns(turns: DataFrame, since: dt.datetime, to: dt.datetime) -> DataFrame:
    return in_window(turns, since, to).where(~whole_days(since, to))


def totals(turns: DataFrame, by_day: DataFrame, since: dt.datetime, to: dt.datetime) -> DataFrame:
    """One row: rollup rows answer whole days, turns the edges. Sessions are counted a day, so exact only if one day is asked."""
    parts = by_day.where(whole_days(since, to)).unionByName(rollups.rollup_day(edge_turns(turns, since, to)), allowMissingColumns=True)
    counts = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sessions", "turns", "errors", "unpriced")]
    out = parts.agg(*counts, *rollups.sums(), (F.count_distinct("day") <= 1).alias("sessions_exact"))
    return out.select("*", dollars(F.col("cost_units")).alias("cost_usd"), dollars(F.col("saved_units")).alias("saved_usd"))


def exact_sessions(session_days: DataFrame, since: dt.datetime, to: dt.datetime) -> DataFrame:
    """Distinct sessions of the window's days."""
    return session_days.where(F.col("day").between(F.lit(since.date()), F.lit(to.date()))).agg(F.count_distinct("tenant_id", "session_id").alias("sessions"))


def _by(turns: DataFrame, rolled: DataFrame, roll, key: list[str], since: dt.datetime, to: dt.datetime, counts: tuple[str, ...], sums: bool = True, names: tuple[str, ...] = ()) -> DataFrame:
    parts = rolled.where(whole_days(since, to)).unionByName(roll(edge_turns(turns, since, to)), allowMissingColumns=True)
    first = [F.min_by(n, "day").alias(n) for n in names]
    out = parts.groupBy(*key).agg(*first, *[F.sum(c).alias(c) for c in counts], *(rollups.sums() if sums else []))
    return out.withColumn("cost_usd", dollars(F.col("cost_units"))) if sums else out


def by_model(turns, rolled, since, to) -> DataFrame:
    return _by(turns, rolled, rollups.rollup_model, ["model"], since, to, ("turns",))


def by_tool(turns, rolled, since, to) -> DataFrame:
    return _by(turns, rolled, rollups.rollup_tool, ["tool"], since, to, ("calls",), False)


def by_project(turns, rolled, since, to) -> DataFrame:
    """By project id; sessions are counted a day on every path."""
    return _by(turns, rolled, rollups.rollup_project, ["project_id"], since, to, ("sessions", "turns", "errors"), True, ("project",))


def daily_series(turns: DataFrame, by_day: DataFrame, since: dt.datetime, to: dt.datetime) -> DataFrame:
    """A row for each day that has turns."""
    parts = by_day.where(whole_days(since, to)).unionByName(rollups.rollup_day(edge_turns(turns, since, to)), allowMissingColumns=True)
    out = parts.groupBy("day").agg(*[F.sum(c).alias(c) for c in ("sessions", "turns", "errors")], *rollups.sums())
    return out.withColumns({"cost_usd": dollars(F.col("cost_units")), "hit_rate": hit_rate(F.col("input_tokens"), F.col("cache_write"), F.col("cache_read"))}).orderBy("day")


def project_daily(turns: DataFrame, by_project_day: DataFrame, project_id: str, since: dt.datetime, to: dt.datetime) -> DataFrame:
    """One project's days."""
    mine = turns.where(F.col("project_id") == project_id)
    parts = by_project_day.where((F.col("project_id") == project_id) & whole_days(since, to)).unionByName(rollups.rollup_project(edge_turns(mine, since, to)), allowMissingColumns=True)
    out = parts.groupBy("day").agg(*[F.sum(c).alias(c) for c in ("sessions", "turns", "errors")], *rollups.sums())
    return out.withColumn("cost_usd", dollars(F.col("cost_units"))).orderBy("day")


def dashboard(turns: DataFrame, rolled: DataFrame, since: dt.datetime, to: dt.datetime) -> DataFrame:
    """Projects of the window by cost, with hit rates."""
    out = by_project(turns, rolled, since, to)
    return out.withColumn("hit_rate", hit_rate(F.col("input_tokens"), F.col("cache_write"), F.col("cache_read"))).orderBy(F.desc("cost_units"), "project_id")


def cold_over_hot(cold: DataFrame, hot: DataFrame, done: DataFrame) -> DataFrame:
    """Compacted days from the archive, all other days from raw events."""
    keys = ["tenant_id", "day"] if "tenant_id" in done.columns else ["day"]
    return cold.join(done, keys, "left_semi").unionByName(hot.join(done, keys, "left_anti"))
