"""Repository attribution and the project page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.columns import hit_rate
from sessionmill.functions.pricing import dollars


def normal(path: Column) -> Column:
    """Path for comparison: lower case, forward slashes, none at the end."""
    return F.regexp_replace(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/+$", "")


def attribute(dirs: DataFrame, roots: DataFrame) -> DataFrame:
    """(cwd, root, in_repo) of distinct directories: the longest known root that is it or above it, else itself.

    A directory's ancestors are listed and joined by equality, so there is no prefix join.
    """
    parts = F.split(F.col("path"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    listed = dirs.select("cwd").where("cwd is not null").distinct().withColumn("path", normal(F.col("cwd")))
    up = listed.select("cwd", F.explode(above).alias("path"))
    known = roots.select(F.col("root"), normal(F.col("root")).alias("path")).where("path <> ''")
    best = up.join(known, "path").groupBy("cwd").agg(F.max_by("root", F.struct(F.length("path"), "root")).alias("found"))
    return listed.select("cwd").join(best, "cwd", "left").select("cwd", F.coalesce("found", "cwd").alias("root"), F.col("found").isNotNull().alias("in_repo"))


def counts(turns: DataFrame, project_id: str, column: str) -> DataFrame:
    """How often each value occurs in a project's turns, most frequent first."""
    return turns.where((F.col("project_id") == project_id) & F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def tool_counts(turns: DataFrame, project_id: str) -> DataFrame:
    calls = turns.where(F.col("project_id") == project_id).select(F.explode("calls").alias("call")).select(F.col("call.name").alias("tool"))
    return calls.where("tool is not null and tool <> ''").groupBy("tool").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tool")


def branches(sessions: DataFrame) -> DataFrame:
    """A project's branches by cost; no branch and a detached HEAD are one. Hit rates come from summed tokens."""
    name = F.when(F.col("git_branch").isNull() | F.col("git_branch").isin("", "HEAD"), F.lit("(no branch)")).otherwise(F.col("git_branch"))
    total = [F.sum(c).alias(c) for c in ("turns", "errors", "input_tokens", "cache_write", "cache_read", "cost_units")]
    out = sessions.groupBy(name.alias("branch")).agg(F.count("*").alias("sessions"), *total, F.max("ended_at").alias("last_active"))
    rate = hit_rate(F.col("input_tokens"), F.col("cache_write"), F.col("cache_read"))
    return out.withColumns({"cost_usd": dollars(F.col("cost_units")), "hit_rate": rate}).orderBy(F.desc("cost_units"), "branch")


#: Distinct costs that are ranked at last; cuts of a round of counting.
LEAST, CUTS = 4096, 64


def median_cost(sessions: DataFrame) -> DataFrame:
    """Exact median session cost; 0 without sessions.

    Sessions are counted by cost once, so a cost that many share is one row. Rounds of counting between approximate percentiles then
    narrow the costs down to those around the middle, to a thirtieth or so a round, until few are left to rank. No task orders more
    than it has read, and how good the percentiles are decides how many rounds there are and nothing else.
    """
    spark, c = sessions.sparkSession, F.col("cost_usd")
    counted = sessions.groupBy(c).agg(F.count("*").alias("times")).persist()
    whole = counted.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("sessions"), F.coalesce(F.sum(F.when(c.isNotNull(), F.col("times"))), F.lit(0)).alias("n")).first()
    ranks = ((whole["n"] + 1) // 2, whole["n"] // 2 + 1)
    inside, below, median = counted.where(c.isNotNull()), 0, 0.0
    while whole["n"]:
        ends = inside.agg(F.count("*").alias("rows"), F.percentile_approx(c, [i / CUTS for i in range(1, CUTS)], 1000).alias("cuts")).first()
        if ends["rows"] <= LEAST:
            found, upto = [], below
            for r in sorted(inside.collect(), key=lambda r: r["cost_usd"]):  # LEAST rows at most
                upto += r["times"]
                found += [r["cost_usd"]] * sum(upto - r["times"] < k <= upto for k in set(ranks))
            median = (found[0] + found[-1]) / 2
            break
        cut = F.lit(0)
        for x in sorted(set(ends["cuts"])):
            cut += (c > x).cast("int")
        bins = sorted(inside.groupBy(cut.alias("bin")).agg(F.sum("times").alias("times"), F.min(c).alias("low"), F.max(c).alias("high")).collect(), key=lambda r: r["bin"])  # CUTS rows
        upto, low, high, skipped = below, None, None, below
        for r in bins:
            if any(upto < k <= upto + r["times"] for k in ranks):
                low, skipped, high = (r["low"], upto, r["high"]) if low is None else (low, skipped, r["high"])
            upto += r["times"]
        inside, below = inside.where(c.between(low, high)), skipped
    counted.unpersist()
    return spark.createDataFrame([(float(median), whole["sessions"])], "median_cost double, sessions long")


def extremes(sessions: DataFrame) -> DataFrame:
    """The costliest and the longest session; ties go to the most recent."""
    late = ("ended_at", "session_id")
    return sessions.agg(F.max_by("session_id", F.struct("cost_units", *late)).alias("costliest"), F.max("cost_usd").alias("cost_usd"), F.max_by("session_id", F.struct("duration_ms", *late)).alias("longest"), F.max("duration_ms").alias("duration_ms"))
