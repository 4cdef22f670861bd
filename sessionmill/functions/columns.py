"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(c: Column) -> Column:
    """c, or NULL where it is blank."""
    return F.when(c != "", c)


def first_of(value: Column, order: Column, when: Column | None = None) -> Column:
    """Aggregate: the first non-null value in the given order (among rows where ``when`` holds)."""
    ok = value.isNotNull() if when is None else value.isNotNull() & when
    return F.min_by(value, F.when(ok, order))


def last_of(value: Column, order: Column, when: Column | None = None) -> Column:
    """Aggregate: the last non-null value in the given order (among rows where ``when`` holds)."""
    ok = value.isNotNull() if when is None else value.isNotNull() & when
    return F.max_by(value, F.when(ok, order))


def hit_rate(input_tokens: Column, cache_write: Column, cache_read: Column) -> Column:
    """Share of the prompt that was read from cache; output is no part of it; 0 without a prompt."""
    prompt = input_tokens + cache_write + cache_read
    return F.when(prompt > 0, cache_read / prompt).otherwise(F.lit(0.0))


def failed(error: Column, status: Column) -> Column:
    """An error text or a status of 400 or more."""
    return error.isNotNull() | F.coalesce(status >= 400, F.lit(False))


def joined(array: Column) -> Column:
    """A string list as one string, for outputs."""
    return F.array_join(array, ",")


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def project_name(directory: Column) -> Column:
    """Last segment of a path with either separator; NULL for a drive or root."""
    bare = F.regexp_replace(F.trim(directory), r"[\\/]+$", "")
    last = F.regexp_extract(bare, r"([^\\/]*)$", 1)
    return F.when(last.rlike(r"^[A-Za-z]:$"), None).otherwise(present(last))


def project_id(directory: Column) -> Column:
    """Stable id of a path: case and separators don't matter."""
    return F.substring(F.sha2(F.lower(F.replace(directory, F.lit("\\"), F.lit("/"))), 256), 1, 12)


def truncate_utf8(text: Column, limit: int) -> tuple[Column, Column, Column]:
    """(text cut to at most limit bytes on a character boundary, whether it was cut, bytes before)."""
    data = F.encode(text, "UTF-8")
    size = F.octet_length(text)
    keep = F.lit(limit)
    for _ in range(3):  # a character has at most three continuation bytes
        byte = F.conv(F.hex(F.substring(data, keep + 1, F.lit(1))), 16, 10).cast("int")
        keep = F.when((keep > 0) & byte.between(0x80, 0xBF), keep - 1).otherwise(keep)
    cut = size > limit
    return F.when(cut, F.decode(F.substring(data, F.lit(1), keep), "UTF-8")).otherwise(text), cut, size


def result_text(raw: Column) -> Column:
    """Text of a tool result: a JSON string, or its blocks' texts by line, else the raw JSON."""
    texts = F.transform(F.from_json(raw, "array<struct<type:string,text:string>>"), lambda b: b["text"])
    kept = F.array_join(F.filter(texts, lambda t: t.isNotNull() & (t != "")), "\n")
    plain = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
    return F.when(raw.startswith('"'), plain).when(raw.startswith("[") & (kept != ""), kept).otherwise(raw)


def conversation_key(body: Column) -> Column:
    """Id of a conversation from a request body: hash of its system part and first user message; ``unknown`` for bad JSON."""
    parsed = F.from_json(body, "system string, messages array<struct<role:string,content:string>>")
    first = F.get(F.filter(parsed["messages"], lambda m: m["role"] == "user"), F.lit(0))["content"]
    ok = parsed.isNotNull() & (parsed["system"].isNotNull() | parsed["messages"].isNotNull())
    return F.when(ok, F.substring(F.sha2(F.concat(F.coalesce(parsed["system"], F.lit("")), F.coalesce(first, F.lit(""))), 256), 1, 16)).otherwise("unknown")


def token_total(input_tokens: Column, output_tokens: Column, cache_write: Column, cache_read: Column) -> Column:
    """All tokens of a turn; absent counts are 0."""
    n = lambda c: F.coalesce(c, F.lit(0))
    return n(input_tokens) + n(output_tokens) + n(cache_write) + n(cache_read)


def captured(text: Column, tool_input: Column, limit: int = 128 << 10) -> tuple[Column, Column, Column, Column]:
    """(text, input, truncated, bytes) of a content block bounded to limit bytes: a long text is cut; tool input that is too long is
    no longer JSON once cut, so it moves to the text. bytes is the size before the cut."""
    kept, cut, size = truncate_utf8(text, limit)
    moved, over, input_size = truncate_utf8(tool_input, limit)
    over = F.coalesce(over, F.lit(False))
    return (
        F.when(over, moved).otherwise(kept),
        F.when(~over, tool_input),
        over | F.coalesce(cut, F.lit(False)),
        F.when(over, input_size).otherwise(F.coalesce(size, F.lit(0))).cast("long"),
    )


def attributed(tenant_id: Column, user_id: Column) -> Column:
    return present(tenant_id).isNotNull() & present(user_id).isNotNull()
