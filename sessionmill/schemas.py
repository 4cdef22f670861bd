"""Fixed schemas. Columns are added, never reused; a column that an old file lacks reads as NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One observation of one model exchange. '' is normalised to NULL on read.
EVENT = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        *[T.StructField(c, T.StringType()) for c in ("session_id", "turn_id", "message_id", "tenant_id", "user_id", "machine_id", "source", "model", "cwd", "project", "project_id", "git_branch", "effort")],
        *[T.StructField(c, T.BooleanType()) for c in ("in_repo", "subagent", "stream")],
        *[T.StructField(c, T.LongType()) for c in ("message_count", "system_blocks", "status_code", "ttfb_ms", "duration_ms")],
        T.StructField("tools_offered", T.ArrayType(T.StringType())),
        *[T.StructField(c, T.StringType()) for c in ("stop_reason", "request_blob", "response_blob", "error")],
        *[T.StructField(c, T.LongType()) for c in ("input_tokens", "output_tokens", "cache_write", "cache_read", "cache_write_5m", "cache_write_1h", "reasoning_tokens")],
        T.StructField("tool_calls", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType())]))),
        *[T.StructField(c, T.StringType()) for c in ("content_ref", "tool_use_id")],
    ]
)

RATE = T.StructType([T.StructField("model_prefix", T.StringType()), T.StructField("input", T.DecimalType(10, 4)), T.StructField("output", T.DecimalType(10, 4))])

_USAGE = (
    "struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint,"
    "cache_creation:struct<ephemeral_5m_input_tokens:bigint,ephemeral_1h_input_tokens:bigint>,output_tokens_details:struct<thinking_tokens:bigint>,service_tier:string,speed:string>"
)
#: A transcript line. message.content stays raw, since it is a list or a bare string.
TRANSCRIPT = (
    "type string, timestamp string, sessionId string, requestId string, uuid string, cwd string, gitBranch string, effort string, version string, isSidechain boolean, isAbortedMidStream boolean, "
    f"isApiErrorMessage boolean, error string, apiErrorStatus string, message struct<id:string,model:string,stop_reason:string,content:string,usage:{_USAGE}>"
)
BLOCKS = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"


def conform(df: DataFrame, schema: T.StructType = EVENT) -> DataFrame:
    """df with exactly the schema's columns: missing ones are NULL, blank strings become NULL."""
    out = []
    for field in schema.fields:
        if field.name not in df.columns:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif isinstance(field.dataType, T.StringType):
            text = F.col(field.name).cast("string")
            out.append(F.when(text != "", text).alias(field.name))
        else:
            out.append(F.col(field.name).cast(field.dataType).alias(field.name))
    return df.select(*out)
