"""Per-day rollups of priced turns: day, model, tool, project, session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.columns import failed, first_of
from sessionmill.operators.sessions import ended_at

TOKENS = ("input_tokens", "output_tokens", "cache_write", "cache_read", "w5m", "w1h")
SUMS = (*TOKENS, "cost_units", "saved_units")


def sums(columns: tuple[str, ...] = SUMS) -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns]


def unpriced() -> Column:
    return ~F.col("priced") & F.col("model").isNotNull()


def rollup_day(turns: DataFrame) -> DataFrame:
    return turns.groupBy("tenant_id", "day").agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("turns"), F.count_if(failed(F.col("error"), F.col("status_code"))).alias("errors"), F.count_if(unpriced()).alias("unpriced"), *sums())


def rollup_model(turns: DataFrame) -> DataFrame:
    """By model and day; turns of no model are left out."""
    return turns.where("model is not null").groupBy("tenant_id", "day", "model").agg(F.count("*").alias("turns"), *sums())


def rollup_tool(turns: DataFrame) -> DataFrame:
    calls = turns.select("tenant_id", "day", F.explode("calls").alias("call")).select("tenant_id", "day", F.col("call.name").alias("tool"))
    return calls.where("tool is not null and tool <> ''").groupBy("tenant_id", "day", "tool").agg(F.count("*").alias("calls"))


def rollup_project(turns: DataFrame) -> DataFrame:
    """By project id and day; turns of no project name are left out, the name is that of the first turn."""
    o = F.struct("started_at", "first_seq")
    return turns.where("project is not null").groupBy("tenant_id", "day", "project_id").agg(
        first_of(F.col("project"), o).alias("project"), F.min_by("in_repo", o).alias("in_repo"), F.count_distinct("session_id").alias("sessions"), F.count("*").alias("turns"), F.count_if(failed(F.col("error"), F.col("status_code"))).alias("errors"), *sums()
    )


def rollup_session_day(turns: DataFrame) -> DataFrame:
    return turns.where("session_id is not null").groupBy("tenant_id", "day", "session_id").agg(F.count("*").alias("turns"), F.min("started_at").alias("first_at"), F.max(ended_at()).alias("last_at"))


#: Letters that a posting is made of.
GRAM = 3


def rollup_words(turns: DataFrame) -> DataFrame:
    """What search can find a session by, a session and day: the distinct lower-case project, branch, model and tool names."""
    names = F.array("project", "git_branch", "model")
    both = F.concat(names, F.transform("calls", lambda c: c["name"])) if "calls" in turns.columns else names
    words = turns.where("session_id is not null").select("tenant_id", "day", "session_id", F.explode(F.filter(F.transform(both, F.lower), lambda w: w != "")).alias("word"))
    return words.groupBy("tenant_id", "day", "session_id").agg(F.sort_array(F.collect_set("word")).alias("words"))


def grams(text: Column) -> Column:
    """The runs of GRAM letters of a text."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda i: F.substring(text, i, F.lit(GRAM)))


def rollup_grams(turns: DataFrame) -> DataFrame:
    """The posting table of search: letter runs of session ids and of the words above, with the days that hold them."""
    ids = turns.where("session_id is not null").select("tenant_id", "day", F.lower("session_id").alias("word"))
    words = rollup_words(turns).select("tenant_id", "day", F.explode("words").alias("word"))
    each = words.union(ids).distinct().where(F.length("word") >= GRAM)
    return each.select("tenant_id", "day", F.explode(grams(F.col("word"))).alias("gram")).distinct()


def rollups(turns: DataFrame) -> dict[str, DataFrame]:
    """All of a version, by table name."""
    named = {"words": rollup_words(turns), "grams": rollup_grams(turns)}
    return {"day": rollup_day(turns), "by_model": rollup_model(turns), "by_tool": rollup_tool(turns), "by_project": rollup_project(turns), "by_session": rollup_session_day(turns)} | named
