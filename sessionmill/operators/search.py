"""Session search: a query text becomes one predicate that Catalyst plans, and needles that a posting table of days is asked for."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.operators import rollups

_PIECE = re.compile(r'(?:[^\s"]|"[^"]*(?:"|$))+')
_NUMBER = {"cost": lambda: F.col("cost_usd"), "turns": lambda: F.col("turns")}
_HAS = {
    "errors": lambda: F.col("errors") > 0,
    "tools": lambda: F.size("tool_names") > 0,
    "unpriced": lambda: F.col("unpriced") > 0,
}
_HAS |= {"error": _HAS["errors"], "failed": _HAS["errors"]}


def _holds(c: Column, needle: str) -> Column:
    return F.coalesce(F.contains(F.lower(c), F.lit(needle)), F.lit(False)) if needle else F.lit(False)


def _any(array: str, needle: str) -> Column:
    return F.exists(array, lambda x: F.contains(F.lower(x), F.lit(needle))) if needle else F.lit(False)


def _model(needle: str) -> Column:
    return _any("models", needle) | _holds(F.col("model"), needle)


def _word(needle: str) -> Column:
    return _holds(F.col("project"), needle) | _holds(F.col("git_branch"), needle) | _holds(F.col("session_id"), needle) | _model(needle) | _any("tool_names", needle)


_FIELDS = {
    "project": lambda v: _holds(F.col("project"), v),
    "branch": lambda v: _holds(F.col("git_branch"), v),
    "id": lambda v: _holds(F.col("session_id"), v),
    "projectid": lambda v: F.coalesce(F.lower("project_id") == v, F.lit(False)),
    "model": _model,
    "tool": lambda v: _any("tool_names", v),
    "has": lambda v: _HAS.get(v, lambda: F.lit(False))(),
}


def term(piece: str) -> Column:
    """One term: ``field:value``, a comparison, or a bare word that any of the text columns may hold."""
    name, colon, value = piece.partition(":")
    if colon and value:
        if name in _FIELDS:
            return _FIELDS[name](value)
        if name in _NUMBER:
            sign, number = (value[0], value[1:].lstrip("=")) if value[0] in "<>" else ("=", value.lstrip("="))
            try:
                limit = F.lit(float(number))
            except ValueError:
                return _word(piece)
            column = _NUMBER[name]()
            return column > limit if sign == ">" else column < limit if sign == "<" else column == limit
    return _word(piece)


def pieces(query: str) -> list[str]:
    """The terms of a query: case doesn't matter; quoted runs keep their spaces."""
    return [p for p in (p.replace('"', "").strip().lower() for p in _PIECE.findall(query)) if p]


def search(query: str) -> Column:
    """All terms must hold; an empty query finds everything."""
    return reduce(and_, [term(p) for p in pieces(query)], F.lit(True))


#: Fields whose value is part of a name that a turn of the session carries.
_NAMED = ("project", "branch", "id", "model", "tool")


def needles(query: str) -> list[str]:
    """What a session that the query finds must have in its id or in a project, branch, model or tool name of its turns, each
    perhaps on another day. Terms about numbers, flags and project ids ask for nothing here."""
    out = []
    for piece in pieces(query):
        name, colon, value = piece.partition(":")
        if colon and value and name in _NAMED:
            out.append(value)
        elif not (colon and value and name in (*_FIELDS, *_NUMBER)):
            out.append(piece)
        elif name in _NUMBER:
            try:
                float(value.lstrip("<>="))
            except ValueError:
                out.append(piece)  # no number, so the whole is a word
    return out


def posted_days(grams: DataFrame, asked: list[str]) -> DataFrame | None:
    """(tenant_id, day) of the posting table that hold all letter runs of at least one needle; None if a needle is too short to tell."""
    if not asked or any(len(n) < rollups.GRAM for n in asked):
        return None
    runs = {n: sorted({n[i : i + rollups.GRAM] for i in range(len(n) - rollups.GRAM + 1)}) for n in asked}
    found = grams.where(F.col("gram").isin(sorted({g for r in runs.values() for g in r}))).groupBy("tenant_id", "day").agg(F.collect_set("gram").alias("found"))
    return found.where(reduce(or_, [F.size(F.array_intersect("found", F.array(*[F.lit(g) for g in r]))) == len(r) for r in runs.values()])).select("tenant_id", "day")


def in_posted(words: DataFrame, posted: DataFrame | None) -> DataFrame:
    """words of the posted days (all, if None). A row a tenant and day is sent to the words: a shuffle by day would bring a day's words
    together in one task."""
    return words if posted is None else words.join(F.broadcast(posted), ["tenant_id", "day"], "left_semi")


def candidates(words: DataFrame, asked: list[str]) -> DataFrame:
    """(tenant_id, session_id) of the sessions whose words (a row a session and day) hold every needle, on whatever days."""
    held = [_any("words", n) | _holds(F.col("session_id"), n) for n in asked]
    flags = [F.bool_or(h).alias(f"f{i}") for i, h in enumerate(held)]
    found = words.where(reduce(or_, held)).groupBy("tenant_id", "session_id").agg(*flags)
    return found.where(reduce(and_, [F.col(f"f{i}") for i in range(len(asked))])).select("tenant_id", "session_id")
