"""Transcript lines to events, content blocks and tool results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.columns import captured, present, result_text
from sessionmill.schemas import BLOCKS, TRANSCRIPT

SYNTHETIC = "<synthetic>"


def parsed(lines: DataFrame) -> DataFrame:
    """lines (line, ...) with r (the record; its fields NULL where absent) and bad (not a JSON object).

    A generator holds the parse, so that filters on r stay above it and a line is parsed once, not once a filter term.
    """
    bad = F.json_object_keys("line").isNull() & F.col("line").isNotNull()
    made = F.array(F.struct(F.from_json("line", TRANSCRIPT).alias("r"), bad.alias("bad")))
    return lines.select("*", F.inline(made))


def _when(lines: DataFrame):
    at = F.try_to_timestamp(F.col("r.timestamp"))
    return F.coalesce(at, F.col("mtime")) if "mtime" in lines.columns else at


def response_events(lines: DataFrame) -> DataFrame:
    """Assistant records with usage and a real model as response events."""
    p = parsed(lines)
    u = F.col("r.message.usage")
    kept = p.where((F.col("r.type") == "assistant") & u.isNotNull() & (F.coalesce("r.message.model", F.lit("")) != SYNTHETIC) & ~F.coalesce("r.isApiErrorMessage", F.lit(False)))
    extra = [c for c in lines.columns if c not in ("line", "mtime")]
    calls = F.transform(F.filter(F.from_json("r.message.content", BLOCKS), lambda b: b["type"] == "tool_use"), lambda b: F.struct(b["id"].alias("id"), b["name"].alias("name")))
    return kept.select(
        *extra,
        F.lit("response").alias("type"),
        _when(lines).alias("ts"),
        F.coalesce(present(F.col("r.sessionId")), F.lit("unknown")).alias("session_id"),
        F.coalesce(present(F.col("r.message.id")), F.col("r.uuid")).alias("turn_id"),
        present(F.col("r.message.id")).alias("message_id"),
        present(F.col("r.requestId")).alias("request_id"),
        present(F.col("r.message.model")).alias("model"),
        present(F.col("r.cwd")).alias("cwd"),
        present(F.col("r.gitBranch")).alias("git_branch"),
        present(F.col("r.effort")).alias("effort"),
        present(F.col("r.version")).alias("producer_version"),
        F.coalesce("r.isSidechain", F.lit(False)).alias("subagent"),
        F.lit(200).cast("long").alias("status_code"),
        present(F.col("r.message.stop_reason")).alias("stop_reason"),
        *[F.coalesce(u[c], F.lit(0)).alias(n) for c, n in (("input_tokens", "input_tokens"), ("output_tokens", "output_tokens"), ("cache_creation_input_tokens", "cache_write"), ("cache_read_input_tokens", "cache_read"))],
        u["cache_creation"]["ephemeral_5m_input_tokens"].alias("cache_write_5m"),
        u["cache_creation"]["ephemeral_1h_input_tokens"].alias("cache_write_1h"),
        u["output_tokens_details"]["thinking_tokens"].alias("reasoning_tokens"),
        present(u["service_tier"]).alias("service_tier"),
        present(u["speed"]).alias("speed"),
        F.when(F.coalesce("r.isAbortedMidStream", F.lit(False)), "aborted mid-stream").alias("error"),
        F.coalesce(calls, F.array().cast("array<struct<id:string,name:string>>")).alias("tool_calls"),
    )


def error_events(lines: DataFrame) -> DataFrame:
    """Records of API failures as error events."""
    extra = [c for c in lines.columns if c not in ("line", "mtime")]
    return parsed(lines).where("r.isApiErrorMessage").select(
        *extra,
        F.lit("error").alias("type"),
        _when(lines).alias("ts"),
        F.coalesce(present(F.col("r.sessionId")), F.lit("unknown")).alias("session_id"),
        F.coalesce(present(F.col("r.message.id")), F.col("r.uuid")).alias("turn_id"),
        present(F.col("r.message.model")).alias("model"),
        F.expr("try_cast(r.apiErrorStatus AS BIGINT)").alias("status_code"),
        F.coalesce(present(F.col("r.error")), F.lit("api error")).alias("error"),
    )


def _blocks(lines: DataFrame, role: str) -> DataFrame:
    """One row a content block; a bare string has none."""
    extra = [c for c in lines.columns if c not in ("line", "mtime")]
    return parsed(lines).where(F.col("r.type") == role).select(*extra, F.col("r.message.id").alias("message_id"), F.posexplode(F.from_json("r.message.content", BLOCKS)).alias("pos", "b"))


def content_blocks(lines: DataFrame) -> DataFrame:
    """Text, thinking and tool_use blocks of assistants; empty texts are skipped, other kinds kept as ``unknown`` to be counted."""
    b = _blocks(lines, "assistant")
    kind = F.when(F.col("b.type").isin("text", "thinking", "tool_use"), F.col("b.type")).otherwise("unknown")
    text = F.when(kind == "text", F.col("b.text")).when(kind == "thinking", F.col("b.thinking")).when(kind == "tool_use", F.col("b.input"))
    made = b.select(*[c for c in b.columns if c != "b"], kind.alias("kind"), F.col("b.id").alias("tool_use_id"), F.col("b.name").alias("tool_name"), text.alias("text"))
    return made.where((F.col("kind") == "tool_use") | (F.col("kind") == "unknown") | present(F.col("text")).isNotNull())


def captured_blocks(lines: DataFrame, limit: int = 128 << 10) -> DataFrame:
    """content_blocks as they are stored: text, input, truncated, bytes, each bounded to limit bytes."""
    b = content_blocks(lines)
    call = F.col("kind") == "tool_use"
    text, given, cut, size = captured(F.when(~call, F.col("text")), F.when(call, F.col("text")), limit)
    return b.select(*[c for c in b.columns if c != "text"], text.alias("text"), given.alias("input"), cut.alias("truncated"), size.alias("bytes"))


def tool_results(lines: DataFrame) -> DataFrame:
    """Results in users' records that name their call, with their text."""
    b = _blocks(lines, "user").where("b.type = 'tool_result' and b.tool_use_id <> ''")
    return b.select(*[c for c in b.columns if c != "b"], F.col("b.tool_use_id").alias("tool_use_id"), result_text(F.col("b.content")).alias("text"), F.coalesce("b.is_error", F.lit(False)).alias("is_error"))


def fill_identity(events: DataFrame, identity: dict[str, str]) -> DataFrame:
    """Identity columns where the event has none of its own."""
    return events.withColumns({k: F.coalesce(present(F.col(k)), F.lit(v)) for k, v in identity.items()})


def overwrite_identity(events: DataFrame, identity: dict[str, str]) -> DataFrame:
    """The credential's identity wins over the event's."""
    return events.withColumns({k: F.lit(v) for k, v in identity.items()})


def plausible(events: DataFrame, as_of, past_days: int = 5 * 365, ahead_hours: int = 24):
    """Predicate: a timestamp that is there, at most five years old and at most a day ahead."""
    import datetime as dt

    return F.coalesce(F.col("ts").between(F.lit(as_of - dt.timedelta(days=past_days)), F.lit(as_of + dt.timedelta(hours=ahead_hours))), F.lit(False))
