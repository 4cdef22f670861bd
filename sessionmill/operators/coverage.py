"""How much of a transcript was understood: counters in long form, (metric, key, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.columns import present
from sessionmill.operators.normalize import SYNTHETIC, parsed

KNOWN_KEYS = ("type", "timestamp", "sessionId", "requestId", "uuid", "cwd", "gitBranch", "effort", "version", "isSidechain", "isAbortedMidStream", "isApiErrorMessage", "error", "apiErrorStatus", "message")


def _classified(lines: DataFrame) -> DataFrame:
    failure = F.coalesce("r.isApiErrorMessage", F.lit(False))
    good = (F.col("r.type") == "assistant") & F.col("r.message.usage").isNotNull() & (F.coalesce("r.message.model", F.lit("")) != SYNTHETIC)
    state = F.when(F.col("bad"), "unreadable").when(failure | F.coalesce(good, F.lit(False)), "parsed").otherwise("skipped")
    return parsed(lines).withColumn("state", state)


def counts(lines: DataFrame) -> DataFrame:
    """Records, and those parsed, skipped and unreadable."""
    c = _classified(lines)
    return c.select(F.explode(F.array(F.lit("records"), "state")).alias("metric")).groupBy("metric").agg(F.count("*").alias("n")).select("metric", F.lit("").alias("key"), "n")


def by_version(lines: DataFrame) -> DataFrame:
    return _classified(lines).where("state = 'parsed'").groupBy(F.coalesce(present(F.col("r.version")), F.lit("unknown")).alias("key")).agg(F.count("*").alias("n")).select(F.lit("version").alias("metric"), "key", "n")


def missing(lines: DataFrame) -> DataFrame:
    """Parsed records that lack a field which newer producers report."""
    u = F.col("r.message.usage")
    absent = F.array_compact(F.array(F.when(u["output_tokens_details"].isNull(), F.lit("output_tokens_details")), F.when(u["cache_creation"].isNull(), F.lit("cache_creation"))))
    c = _classified(lines).where("state = 'parsed'").where(u.isNotNull())
    return c.select(F.explode(absent).alias("key")).groupBy("key").agg(F.count("*").alias("n")).select(F.lit("missing").alias("metric"), "key", "n")


def unknown(lines: DataFrame) -> DataFrame:
    """Top-level keys that the schema does not have."""
    keys = lines.select(F.explode(F.json_object_keys("line")).alias("key")).where(~F.col("key").isin(*KNOWN_KEYS))
    return keys.groupBy("key").agg(F.count("*").alias("n")).select(F.lit("unknown").alias("metric"), "key", "n")


def coverage(lines: DataFrame) -> DataFrame:
    return counts(lines).unionByName(by_version(lines)).unionByName(missing(lines)).unionByName(unknown(lines))


def merge(*runs: DataFrame) -> DataFrame:
    """Key-wise sum over runs."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.groupBy("metric", "key").agg(F.sum("n").alias("n"))
