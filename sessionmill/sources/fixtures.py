"""Event logs, transcripts and captured bodies made from the given tables, by SQL that DuckDB runs unchanged where an oracle needs it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.functions.columns import project_id, project_name
from sessionmill.operators import projects
from sessionmill.schemas import EVENT, RATE, conform

AS_OF = "2024-01-31T00:00:00"

#: The event log; {events} is the given table.
FX_EVENTS = """
SELECT e.event_id * 10 + k.k AS seq,
       CASE k.k WHEN 0 THEN 'request' WHEN 5 THEN 'error' ELSE 'response' END AS type,
       CASE WHEN k.k = 0 THEN e.ts ELSE e.ts + interval '1' second * (1 + e.event_id % 5) END AS ts,
       concat('s', e.user_id) AS session_id,
       concat('t', e.event_id) AS turn_id,
       CASE WHEN e.event_id % 6 = 1 THEN NULL ELSE concat('msg_', e.event_id) END AS message_id,
       CASE WHEN e.user_id % 2 = 0 THEN 'acme' ELSE 'globex' END AS tenant_id,
       CASE WHEN k.k = 4 THEN 'log' ELSE 'wire' END AS source,
       CASE e.event_id % 5 WHEN 0 THEN 'model-a' WHEN 1 THEN 'model-a-20251001' WHEN 2 THEN 'model-a-mini'
                           WHEN 3 THEN 'model-b' ELSE 'other-llm' END AS model,
       CASE WHEN k.k = 4 THEN concat('/home/dev/src/proj', e.user_id % 8, CASE WHEN e.event_id % 3 = 0 THEN '/web/app' ELSE '' END) END AS cwd,
       CASE WHEN k.k = 4 THEN CASE e.user_id % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'feature/x' ELSE 'HEAD' END END AS git_branch,
       CASE WHEN k.k IN (1, 2, 3, 4) THEN CASE WHEN e.event_id % 41 = 0 THEN 429 ELSE 200 END END AS status_code,
       CASE WHEN k.k IN (1, 5) THEN 500 + e.event_id % 4500 END AS duration_ms,
       CASE WHEN k.k IN (1, 2, 3, 4) THEN e.event_id % 7 END AS input_tokens,
       CASE WHEN k.k IN (1, 2, 3, 4) THEN (e.event_id * 37) % 2000 END AS output_tokens,
       CASE WHEN k.k IN (1, 2, 3, 4) THEN (e.event_id * 13) % 3000 END AS cache_write,
       CASE WHEN k.k IN (1, 2, 3, 4) AND e.event_id % 11 = 0 THEN 0 END AS cache_write_5m,
       CASE WHEN k.k IN (1, 2, 3, 4) AND e.event_id % 11 = 0 THEN (e.event_id * 13) % 3000 END AS cache_write_1h,
       CASE WHEN k.k IN (1, 2, 3, 4) THEN (e.event_id * 101) % 50000 END AS cache_read,
       CASE WHEN k.k IN (1, 2, 3, 4) AND e.event_id % 4 <> 3 THEN concat('tu_', e.event_id, '_', k.k % 2) END AS tool_id,
       CASE WHEN k.k IN (1, 2, 3, 4) AND e.event_id % 4 <> 3 THEN CASE (e.event_id + k.k) % 4 WHEN 0 THEN 'Bash' WHEN 1 THEN 'Read' WHEN 2 THEN 'Edit' ELSE 'Grep' END END AS tool_name,
       CASE WHEN k.k = 5 THEN 'rate_limited' END AS error
FROM {events} e
CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) k
WHERE (k.k = 0 AND e.event_id % 3 <> 0)
   OR (k.k = 1 AND e.event_type <> 'error' AND e.event_id % 97 <> 0)
   OR (k.k IN (2, 3) AND e.event_type <> 'error' AND e.event_id % 10 = 0)
   OR (k.k = 4 AND e.event_type <> 'error' AND e.event_id % 4 = 0)
   OR (k.k = 5 AND e.event_type = 'error')
"""

RATES = [("model-a", "5", "25"), ("model-a-mini", "1", "5"), ("model-b", "2", "10")]
ROOTS = [f"/home/dev/src/proj{i}" for i in range(6)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rates(spark: SparkSession) -> DataFrame:
    from decimal import Decimal

    return spark.createDataFrame([(p, Decimal(i), Decimal(o)) for p, i, o in RATES], RATE)


def roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r,) for r in ROOTS], "root string")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as made, before projects are attributed."""
    made = spark.sql(FX_EVENTS, events=read(spark, sf_dir, "events"))
    calls = F.when(F.col("tool_id").isNotNull(), F.array(F.struct(F.col("tool_id").alias("id"), F.col("tool_name").alias("name"))))
    return conform(made.withColumns({"ts": F.col("ts").cast("timestamp"), "tool_calls": calls}), EVENT)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with project, project_id and in_repo of each working directory.

    The log names 16 directories, however long it is, and most of its events have none: they are sent to the events, since a shuffle by
    directory would bring the events without one together in one task.
    """
    made = raw_events(spark, sf_dir)
    found = projects.attribute(made, roots(spark)).select("cwd", project_name(F.col("root")).alias("name"), project_id(F.col("root")).alias("pid"), F.col("in_repo").alias("repo"))
    out = made.join(F.broadcast(found), "cwd", "left").withColumns({"project": F.col("name"), "project_id": F.col("pid"), "in_repo": F.col("repo")})
    return out.select(EVENT.fieldNames())


def content_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with content: a text of each response, and the results of calls, some of which name a call that nobody made."""
    e = events(spark, sf_dir)
    said = e.where("type = 'response'")
    text = said.withColumns({"type": F.lit("content"), "seq": F.col("seq") + 1_000_000_000_000, "content_ref": F.sha2(F.concat_ws("/", "turn_id", F.col("seq") % 10), 256)})
    results = said.where("tool_calls is not null").withColumn("call", F.when(F.col("seq") % 70 == 0, "nobody").otherwise(F.col("tool_calls")[0]["id"]))
    results = results.withColumns({"type": F.lit("content"), "seq": F.col("seq") + 2_000_000_000_000, "tool_use_id": F.col("call"), "content_ref": F.sha2(F.concat(F.col("call"), F.lit("r")), 256)})
    return e.unionByName(text.select(e.columns)).unionByName(results.select(e.columns))


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, path, mtime, event_id): transcript lines of the log's responses, repeated ones too, and errors, some odd by event_id % 50."""
    e = raw_events(spark, sf_dir).where("type in ('response', 'error')").withColumn("event_id", F.floor(F.col("seq") / 10))
    odd = F.col("event_id") % 50
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    usage = F.when(
        F.col("type") == "response",
        F.struct(
            "input_tokens",
            "output_tokens",
            F.col("cache_write").alias("cache_creation_input_tokens"),
            F.col("cache_read").alias("cache_read_input_tokens"),
            F.when(F.col("cache_write_1h").isNotNull(), F.struct(F.col("cache_write_5m").alias("ephemeral_5m_input_tokens"), F.col("cache_write_1h").alias("ephemeral_1h_input_tokens"))).alias("cache_creation"),
            F.when(odd != 11, F.struct((F.col("event_id") % 13).alias("thinking_tokens"))).alias("output_tokens_details"),
        ),
    )
    model = F.when(odd == 9, "<synthetic>").otherwise(F.col("model"))
    call = F.col("tool_calls")[0]
    blocks = F.array_compact(
        F.array(
            F.struct(F.lit("text").alias("type"), F.concat(F.lit("note "), "event_id").alias("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name")),
            F.when(call.isNotNull(), F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), call["id"].alias("id"), call["name"].alias("name"))),
        )
    )
    failed = F.col("type") == "error"
    top = [
        F.lit("assistant").alias("type"),
        stamp.alias("timestamp"),
        F.col("session_id").alias("sessionId"),
        F.col("turn_id").alias("uuid"),
        "cwd",
        F.col("git_branch").alias("gitBranch"),
        F.concat(F.lit("2."), F.col("event_id") % 3).alias("version"),
        F.when(failed, F.lit(True)).alias("isApiErrorMessage"),
        F.col("error"),
        F.when(failed, F.lit("529")).alias("apiErrorStatus"),
        F.when(odd == 10, F.lit(1)).alias("surprise"),
    ]
    head = [F.col("message_id").alias("id"), model.alias("model")]
    bare = F.to_json(F.struct(*top, F.struct(*head, F.lit("just text").alias("content"), usage.alias("usage")).alias("message")))
    full = F.to_json(F.struct(*top, F.struct(*head, blocks.alias("content"), usage.alias("usage")).alias("message")))
    line = F.when(odd == 7, F.lit("{broken")).when(odd == 8, bare).otherwise(full)
    return e.select(F.explode(F.array(line)).alias("line"), F.concat(F.lit("/logs/"), "session_id", F.lit(".jsonl")).alias("path"), F.col("ts").alias("mtime"), "event_id", "seq")


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, line): transcript lines of conversations; an assistant's text and call, and the result in the user's next turn."""
    c = read(spark, sf_dir, "conversations").where("role in ('assistant', 'user')")
    cid, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    call = F.struct(F.lit("tool_use").alias("type"), F.concat_ws("_", F.lit("tu"), cid, turn).alias("id"), F.lit("Bash").alias("name"), F.struct(turn.alias("n")).alias("input"))
    said = F.struct(F.lit("text").alias("type"), text)
    answer = F.concat_ws("_", F.lit("tu"), cid, F.when(turn % 7 == 0, F.lit("none")).otherwise((turn - 1).cast("string")))
    result = F.struct(F.lit("tool_result").alias("type"), answer.alias("tool_use_id"), F.array(F.struct(F.lit("text").alias("type"), text)).alias("content"))
    top = [F.concat(F.lit("c"), cid).alias("sessionId"), F.concat_ws("-", cid, turn).alias("uuid"), F.lit("2024-01-02T00:00:00Z").alias("timestamp")]
    message = lambda role, *blocks: F.to_json(F.struct(F.lit(role).alias("type"), *top, F.struct(F.concat_ws("_", F.lit("m"), cid, turn).alias("id"), F.concat(F.lit("["), F.concat_ws(",", *[F.to_json(b) for b in blocks]), F.lit("]")).alias("content")).alias("message")))
    # content is a list, not a string: the quoted text that to_json made is put back as it is
    return c.select("conv_id", "turn", F.when(F.col("role") == "assistant", message("assistant", said, call)).otherwise(message("user", result)).alias("quoted")).select("conv_id", "turn", unquote("quoted").alias("line"))


def unquote(column: str):
    """The line with its content string put back as JSON."""
    got = F.get_json_object(column, "$.message.content")
    start = F.instr(column, '"content":"') + F.length(F.lit('"content":'))
    return F.concat(F.substring(F.col(column), F.lit(1), start - 1), got, F.lit("}}"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(exchange_id, request_body, response_body, sse): captured bodies of conversations."""
    c = read(spark, sf_dir, "conversations")
    said = F.sort_array(F.collect_list(F.when(F.col("role") != "system", F.struct("turn", "role", F.col("text").alias("content")))))
    g = c.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "system", F.col("text"))).alias("system"), said.alias("m"), F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.coalesce(F.max_by("text", "turn"), F.lit("")).alias("said"))
    body = F.struct(F.lit("model-a").alias("model"), (F.col("n") % 2 == 0).alias("stream"), (F.col("n") * 100).alias("max_tokens"), "system", F.transform("m", lambda x: F.struct(x["role"], x["content"])).alias("messages"), F.array(F.struct(F.lit("Bash").alias("name")), F.struct(F.lit("Read").alias("name"))).alias("tools"))
    request = F.when(F.col("conv_id") % 10 == 3, F.lit("{broken")).otherwise(F.to_json(body))
    usage = F.struct(F.col("chars").alias("input_tokens"), (F.col("n") * 2).alias("output_tokens"), (F.col("n") * 3).alias("cache_read_input_tokens"))
    reply = F.to_json(F.struct(F.lit("model-a-20251001").alias("model"), F.lit("end_turn").alias("stop_reason"), F.array(F.struct(F.lit("text").alias("type"), F.col("said").alias("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name")), F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("tu"), "conv_id").alias("id"), F.lit("Bash").alias("name"))).alias("content"), usage.alias("usage")))
    frame = lambda j: F.concat(F.lit("data: "), j)
    sse = F.concat_ws(
        "\n",
        F.lit("event: message_start"),
        frame(F.to_json(F.struct(F.lit("message_start").alias("type"), F.struct(F.lit("model-a").alias("model"), usage.alias("usage")).alias("message")))),
        frame(F.lit('{"type":"ping"}')),
        frame(F.to_json(F.struct(F.lit("content_block_start").alias("type"), F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("tu"), "conv_id").alias("id"), F.lit("Read").alias("name")).alias("content_block")))),
        frame(F.lit("{malformed")),
        frame(F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(F.lit("text_delta").alias("type"), F.col("said").alias("text")).alias("delta")))),
        frame(F.to_json(F.struct(F.lit("message_delta").alias("type"), F.struct(F.lit("tool_use").alias("stop_reason")).alias("delta"), F.struct((F.col("n") * 5).alias("output_tokens")).alias("usage")))),
        frame(F.to_json(F.struct(F.lit("message_delta").alias("type"), F.struct(F.lit("end_turn").alias("stop_reason")).alias("delta"), F.struct((F.col("n") * 7).alias("output_tokens"), F.when(F.col("n") % 2 == 0, F.col("chars") + 1).alias("input_tokens")).alias("usage")))),
        frame(F.lit("[DONE]")),
    )
    return g.select(F.col("conv_id").alias("exchange_id"), "n", request.alias("request_body"), reply.alias("response_body"), sse.alias("sse"))


def bench_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event log of the size of lineitem over 365 days: a response a line, some orders together a session of about a dozen turns."""
    li = read(spark, sf_dir, "lineitem").withColumn("cust", F.floor(F.col("l_orderkey") / 12))
    models = F.array(*[F.lit(m) for m in ("model-a", "model-a-20251001", "model-a-mini", "model-b", "other-llm")])
    tools = F.array(*[F.lit(t) for t in ("Bash", "Read", "Edit", "Grep", "Write")])
    quantity = F.col("l_quantity").cast("long")
    made = li.select(
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1024 + F.pmod(F.xxhash64("l_partkey", "l_suppkey"), F.lit(1024))).alias("seq"),
        F.lit("response").alias("type"),
        (F.lit("2023-01-01").cast("timestamp") + F.make_dt_interval(days=F.pmod(F.xxhash64("cust"), F.lit(365)).cast("int"), hours=F.lit(9), mins=F.pmod(F.col("l_orderkey"), F.lit(12)).cast("int") * 8 + F.col("l_linenumber"))).alias("ts"),
        F.concat(F.lit("s"), "cust").alias("session_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("turn_id"),
        F.when(F.col("cust") % 2 == 0, "acme").otherwise("globex").alias("tenant_id"),
        models[(F.col("l_partkey") % 5).cast("int")].alias("model"),
        F.concat(F.lit("proj"), F.col("cust") % 40).alias("project"),
        F.concat(F.lit("id"), F.col("cust") % 40).alias("project_id"),
        F.lit(200).alias("status_code"),
        (quantity * 100).alias("duration_ms"),
        (quantity * 24).alias("input_tokens"),
        (quantity * 8).alias("output_tokens"),
        (quantity * 40).alias("cache_write"),
        F.col("l_extendedprice").cast("long").alias("cache_read"),
        F.array(F.struct(F.concat_ws("-", F.lit("tu"), "l_orderkey", "l_linenumber").alias("id"), tools[(F.col("l_suppkey") % 5).cast("int")].alias("name"))).alias("tool_calls"),
    )
    return conform(made, EVENT)
