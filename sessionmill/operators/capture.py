"""Captured request and response bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.columns import first_of, last_of, present

USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>"


def request_summary(bodies: DataFrame) -> DataFrame:
    """exchange_id, model, stream, max_tokens, message_count, system_blocks, tools of request bodies; bad JSON leaves them empty."""
    r = F.from_json("request_body", "model string, stream boolean, max_tokens bigint, system string, messages array<string>, tools array<struct<name:string>>")
    system = F.col("r.system")
    blocks = F.when(system.startswith("["), F.json_array_length(system)).when(present(system).isNotNull(), 1).otherwise(0)
    return bodies.withColumn("r", r).select(
        "exchange_id",
        present(F.col("r.model")).alias("model"),
        F.coalesce("r.stream", F.lit(False)).alias("stream"),
        F.col("r.max_tokens"),
        F.coalesce(F.size("r.messages"), F.lit(0)).cast("long").alias("message_count"),
        blocks.cast("long").alias("system_blocks"),
        F.coalesce(F.transform("r.tools", lambda t: t["name"]), F.array().cast("array<string>")).alias("tools"),
    )


def response_summary(bodies: DataFrame) -> DataFrame:
    """exchange_id, model, stop_reason, usage and tool calls of buffered response bodies."""
    r = F.from_json("response_body", f"model string, stop_reason string, content array<struct<type:string,id:string,name:string>>, usage {USAGE}")
    calls = F.transform(F.filter("r.content", lambda b: b["type"] == "tool_use"), lambda b: F.struct(b["id"].alias("id"), b["name"].alias("name")))
    return bodies.withColumn("r", r).select("exchange_id", present(F.col("r.model")).alias("model"), present(F.col("r.stop_reason")).alias("stop_reason"), "r.usage.*", calls.alias("tool_calls"))


def sse_fold(streams: DataFrame) -> DataFrame:
    """Streamed responses (exchange_id, sse) folded to one row each; broken frames and the end mark are skipped."""
    frames = streams.select("exchange_id", F.posexplode(F.split("sse", "\n")).alias("pos", "line")).where(F.col("line").startswith("data:"))
    kind = f"type string, message struct<model:string,usage:{USAGE}>, content_block struct<type:string,id:string,name:string>, delta struct<stop_reason:string>, usage {USAGE}"
    f = frames.select("exchange_id", "pos", F.from_json(F.trim(F.substring("line", 6, 1 << 30)), kind).alias("f")).where("f.type is not null")
    pos, t = F.col("pos"), F.col("f.type")
    start, delta, block = t == "message_start", t == "message_delta", (t == "content_block_start") & (F.col("f.content_block.type") == "tool_use")
    said = F.col("f.usage.input_tokens")
    calls = F.transform(F.sort_array(F.collect_list(F.when(block, F.struct("pos", "f.content_block")))), lambda x: F.struct(x["content_block"]["id"].alias("id"), x["content_block"]["name"].alias("name")))
    begun = lambda c: first_of(F.col(f"f.message.usage.{c}"), pos, start)
    return f.groupBy("exchange_id").agg(
        first_of(present(F.col("f.message.model")), pos, start).alias("model"),
        F.coalesce(last_of(said, pos, delta & (said > 0)), begun("input_tokens")).alias("input_tokens"),
        F.coalesce(last_of(F.col("f.usage.output_tokens"), pos, delta), begun("output_tokens")).alias("output_tokens"),
        begun("cache_creation_input_tokens").alias("cache_write"),
        begun("cache_read_input_tokens").alias("cache_read"),
        last_of(present(F.col("f.delta.stop_reason")), pos, delta).alias("stop_reason"),
        calls.alias("tool_calls"),
    )
