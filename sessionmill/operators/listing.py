"""Pages of sessions: by recency with a keyset cursor, or ranked with an offset."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.operators import archive, rollups, search, windowed
from sessionmill.operators.sessions import sessions as rollup
from sessionmill.sources import daylog

DEFAULT_LIMIT, MOST_LIMIT = 50, 500
RANKS = {"cost": "cost_units", "turns": "turns", "errors": "errors"}


def page_size(limit: int | None) -> int:
    return min(limit, MOST_LIMIT) if limit and limit > 0 else DEFAULT_LIMIT


#: Newest end first; a session is known by its id within its tenant, so the tenant breaks ties.
CURSOR = ("ended_ms", "session_id", "tenant_id")


def _behind(after: tuple[int, str, str]) -> Column:
    values = [F.lit(after[0]).cast("long"), F.lit(after[1]), F.lit(after[2])]
    return F.struct(*CURSOR) < F.struct(*[v.alias(c) for v, c in zip(values, CURSOR, strict=True)])


def recent(sessions: DataFrame, limit: int | None = None, after: tuple[int, str, str] | None = None) -> DataFrame:
    """The next page, newest end first; after: (ended_at in ms, session id, tenant) of the last row seen."""
    s = sessions.withColumn("ended_ms", F.unix_millis("ended_at"))
    if after:
        s = s.where(_behind(after))
    return s.orderBy(*[F.desc(c) for c in CURSOR]).limit(page_size(limit))


def recent_archived(session_days: DataFrame, turns: DataFrame, limit: int | None = None, after: tuple[int, str, str] | None = None) -> DataFrame:
    """The same page from the archive: the session-day rollup tells the page's sessions and their days, and only those days' turns
    are read and rolled up. A session's end is the latest of its days', so no session outside the page can belong to it."""
    size = page_size(limit)
    spans = session_days.groupBy("tenant_id", "session_id").agg(F.unix_millis(F.max("last_at")).alias("ended_ms"))
    spans = spans.where(_behind(after)) if after else spans
    page = spans.orderBy(*[F.desc(c) for c in CURSOR]).limit(size).select("tenant_id", "session_id")
    keys = F.broadcast(page)  # MOST_LIMIT rows at most
    days = session_days.join(keys, ["tenant_id", "session_id"], "left_semi").select("tenant_id", "day").distinct()
    # both go to the turns: a shuffle by day would bring a day's turns together in one task
    found = turns.join(keys, ["tenant_id", "session_id"], "left_semi").join(F.broadcast(days), ["tenant_id", "day"], "left_semi")
    return recent(rollup(found), size)


@dataclass
class Page:
    """A page of sessions, whether more follow, the cursor for them, and the days whose turns were read."""

    sessions: DataFrame
    more: bool
    after: tuple[int, str, str] | None
    days: list[dt.date]


def _ends(days: list[dt.date]) -> tuple[dt.date, dt.date]:
    """First and last of sorted days; without any, bounds that hold no day."""
    return (days[0], days[-1]) if days else (dt.date.max, dt.date.min)


#: Sessions that a round looks at, in pages; after the last all that are left.
ROUNDS = (2, 16, 128)


def page(
    spark: SparkSession, path: str, limit: int | None = None, after: tuple[int, str, str] | None = None, text: str = "", since: dt.datetime | None = None, to: dt.datetime | None = None, hot: DataFrame | None = None
) -> Page:
    """A page of the sessions of a window that a search finds, over the archive and hot turns (of days that it doesn't hold yet).

    Equal to filtering the list of all sessions made of the window's turns. The session-day rollup (and turns of the window's edge
    days and the hot days) tells when each session ends and which days it touches, so sessions are walked backwards by their end,
    and of a round's sessions only their days are read: no session is shown before its oldest day is in, and the walk stops with
    the page full. The posting table and the words of the days that it names leave sessions out that can't match.
    """
    size = page_size(limit)
    begun = bool(daylog.state(spark, path).schemas) or hot is None

    def read(name: str, *days: dt.date | None) -> DataFrame:
        """A table of the archive; before the first compaction an empty one."""
        made = {"turns": lambda t: t, "by_session": rollups.rollup_session_day, "words": rollups.rollup_words, "grams": rollups.rollup_grams}
        return archive.read_table(spark, path, name, *days) if begun else made[name](hot).limit(0)

    first, last = (None if x is None else x.date() for x in (since, to))
    trim = lambda f: f if since is None else windowed.in_window(f, since, to)
    warm = None if hot is None else trim(hot)
    cold_days = read("by_session", first, last)
    if since is not None:
        whole = windowed.whole_days(since, to)
        edges = reduce(DataFrame.unionByName, [read("turns", d, d) for d in sorted({first, last})])
        cold_days = cold_days.where(whole).unionByName(rollups.rollup_session_day(trim(edges).where(~whole)))
    spans = cold_days if warm is None else cold_days.unionByName(rollups.rollup_session_day(warm))
    asked = search.needles(text)
    if asked:
        words = search.in_posted(read("words", first, last), search.posted_days(read("grams", first, last), asked))
        words = words if warm is None else words.unionByName(rollups.rollup_words(warm))
        spans = spans.join(search.candidates(words, asked), ["tenant_id", "session_id"], "left_semi")
    spans = spans.select("tenant_id", "session_id", "day", "last_at").persist()
    ends = spans.groupBy("tenant_id", "session_id").agg(F.unix_millis(F.max("last_at")).alias("ended_ms"))
    hot_days = [] if warm is None else [r["day"] for r in warm.select("day").distinct().collect()]  # one value a day
    found, walked, at, schema = [], set(), after, None
    for pages in (*ROUNDS, None):
        keys = ends if at is None else ends.where(_behind(at))
        if pages is not None:
            keys = keys.orderBy(*[F.desc(c) for c in CURSOR]).limit(pages * size)
        keys = keys.persist()
        reach = keys.agg(F.count("*").alias("n"), F.min(F.struct(*CURSOR)).alias("last")).first()
        days = sorted(r["day"] for r in spans.join(keys, ["tenant_id", "session_id"], "left_semi").select("day").distinct().collect())  # one value a day
        cold = trim(read("turns", *_ends(days)).where(F.col("day").isin(days)))
        turns = cold if warm is None else cold.unionByName(warm, allowMissingColumns=True)
        made = rollup(turns.join(keys.select("tenant_id", "session_id"), ["tenant_id", "session_id"], "left_semi")).where(search.search(text))
        made = made.withColumn("ended_ms", F.unix_millis("ended_at")).orderBy(*[F.desc(c) for c in CURSOR]).limit(size + 1)
        schema = made.schema
        if reach["n"]:
            found += made.collect()  # a page and one row at most
            walked |= set(days) - set(hot_days)
        keys.unpersist()
        if len(found) > size or pages is None or reach["n"] < pages * size:
            break
        at = tuple(reach["last"])
    spans.unpersist()
    rows = found[:size]
    return Page(spark.createDataFrame(rows, schema), len(found) > size, tuple(rows[-1][c] for c in CURSOR) if rows else None, sorted(walked))


def find(spark: SparkSession, path: str, text: str) -> DataFrame:
    """All sessions of the archive that a search finds: the posting table and words name the candidates, only the days that these
    touch are read, and the exact predicate decides."""
    asked, turns = search.needles(text), archive.read_table(spark, path, "turns")
    if asked:
        words = search.in_posted(archive.read_table(spark, path, "words"), search.posted_days(archive.read_table(spark, path, "grams"), asked))
        keys = search.candidates(words, asked)
        touched = archive.read_table(spark, path, "by_session").join(keys, ["tenant_id", "session_id"], "left_semi")
        days = sorted(r["day"] for r in touched.select("day").distinct().collect())  # one value a day
        turns = archive.read_table(spark, path, "turns", *_ends(days)).where(F.col("day").isin(days)).join(keys, ["tenant_id", "session_id"], "left_semi")
    return rollup(turns).where(search.search(text))


def ranked(sessions: DataFrame, sort: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page by cost, turns or errors; an unknown sort is by recency."""
    if sort not in RANKS:
        return recent(sessions, limit)
    s = sessions.withColumn("ended_ms", F.unix_millis("ended_at"))
    return s.orderBy(F.desc(RANKS[sort]), *[F.desc(c) for c in CURSOR]).offset(offset).limit(page_size(limit))
