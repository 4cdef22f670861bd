"""Activity views: dense days, weeks, levels, shares, labels, rankings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dense_daily(series: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Every day of the window, zero where the series (day, turns, cost_units) has none."""
    spark = series.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    return days.join(series, "day", "left").select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in series.columns if c != "day"])


def weekly(daily: DataFrame, first: dt.date) -> DataFrame:
    """Days folded into weeks that start on Sunday; the first may be short."""
    start = F.greatest(F.next_day(F.date_sub("day", 7), "SU"), F.lit(first))
    return daily.groupBy(start.alias("week")).agg(*[F.sum(c).alias(c) for c in daily.columns if c != "day"])


def summary(daily: DataFrame) -> DataFrame:
    """Active days, span, totals and the busiest day (the first on ties)."""
    busiest = F.max_by("day", F.struct("turns", -F.unix_date("day")))
    return daily.where("turns > 0").agg(F.count("*").alias("active_days"), (F.datediff(F.max("day"), F.min("day")) + 1).cast("long").alias("span_days"), F.sum("turns").alias("turns"), F.sum("cost_units").alias("cost_units"), busiest.alias("busiest_day"))


def levels(daily: DataFrame, archive_start: dt.date) -> DataFrame:
    """Level 0 to 4 of each day on a square-root scale; -1 before the archive starts. One row a day, so the whole-frame window is small."""
    top = F.max("turns").over(W.partitionBy())
    scaled = F.least(F.lit(4), F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("turns") / top) * 4))).cast("int")
    return daily.select("day", "turns", F.when(F.col("day") < F.lit(archive_start), -1).when(F.col("turns") == 0, 0).otherwise(scaled).alias("level"))


def shares(daily: DataFrame) -> DataFrame:
    """Each day's share of the window's turns."""
    return daily.select("day", "turns", (F.col("turns") / F.sum("turns").over(W.partitionBy())).alias("share"))


def project_labels(projects: DataFrame) -> DataFrame:
    """Display names: a name that several projects have gets the first four characters of the id."""
    shared = F.count("*").over(W.partitionBy("project")) > 1
    return projects.select("project_id", "project", F.when(shared, F.concat("project", F.lit(" · "), F.substring("project_id", 1, 4))).otherwise(F.col("project")).alias("label"))


def ranked(frame: DataFrame, name: str, metric: str, n: int) -> DataFrame:
    """The n largest of a small grouped frame with their share of the largest, and one row for the rest."""
    order = W.partitionBy().orderBy(F.desc(metric), name)
    r = frame.select(name, metric, F.row_number().over(order).alias("place"))
    top = F.max(metric).over(W.partitionBy())
    return r.select(F.when(F.col("place") <= n, F.col(name)).otherwise("(other)").alias(name), F.least("place", F.lit(n + 1)).alias("place"), metric, top.alias("top")).groupBy("place", name).agg(F.sum(metric).alias(metric), (F.sum(metric) / F.max("top")).alias("scale"))
