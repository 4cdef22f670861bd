"""Prices. Money is exact decimal inside (``COST_UNIT`` a dollar) and becomes DOUBLE once, at the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of token kinds against a rate, times 20 to be whole numbers: 1, 1.25, 2 and 0.1 of the input rate; the output rate.
INPUT_20, WRITE_5M_20, WRITE_1H_20, READ_20, OUTPUT_20, SAVED_20 = 20, 25, 40, 2, 20, 18
#: Rates are a million tokens; costs are kept in units of a twentieth of a millionth.
COST_UNIT = 20e6
MONEY = "decimal(30,4)"


def cache_write_split() -> tuple[Column, Column]:
    """(5-minute, 1-hour) cache writes; without a reported split all is 5-minute."""
    known = F.col("cache_write_5m").isNotNull() | F.col("cache_write_1h").isNotNull()
    return F.when(known, F.coalesce("cache_write_5m", F.lit(0))).otherwise(F.coalesce("cache_write", F.lit(0))), F.when(known, F.coalesce("cache_write_1h", F.lit(0))).otherwise(F.lit(0))


def rate_of(models: DataFrame, rates: DataFrame) -> DataFrame:
    """(model, rate_input, rate_output) of the distinct models: an exact prefix, else the longest; a model without one is absent.

    Every beginning of a model is joined by equality, so no cross product is planned; there are few distinct models.
    """
    known = rates.select("model_prefix", F.col("input").alias("rate_input"), F.col("output").alias("rate_output"))
    cut = models.select("model").where("model <> ''").distinct().select("model", F.explode(F.sequence(F.lit(1), F.length("model"))).alias("size"))
    cut = cut.withColumn("model_prefix", F.substring(F.col("model"), F.lit(1), F.col("size")))
    best = F.max_by(F.struct("rate_input", "rate_output", "model_prefix"), "size").alias("rate")
    return cut.join(known, "model_prefix").groupBy("model").agg(best).select("model", "rate.rate_input", "rate.rate_output", F.col("rate.model_prefix").alias("matched_prefix"))


def priced_models(rates: DataFrame) -> DataFrame:
    """The models (prefixes) that have a rate, in order."""
    return rates.select("model_prefix").distinct().orderBy("model_prefix")


def with_cost(turns: DataFrame, rates: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """turns with priced, cost_units, saved_units, and the two cache-write tiers (w5m, w1h).

    models: where the models are read from (by default turns); give the events that turns are built of, and only their model
    column is scanned in place of building all turns twice.

    A row a model is sent to the turns: a shuffle by model would bring all turns together in as many tasks as there are models.
    """
    w5m, w1h = cache_write_split()
    found = F.broadcast(rate_of(turns if models is None else models, rates).drop("matched_prefix"))
    out = turns.join(found, "model", "left").withColumns({"w5m": w5m, "w1h": w1h, "priced": F.col("rate_input").isNotNull()})
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(19,0)")
    prompt = (n("input_tokens") * INPUT_20 + n("w5m") * WRITE_5M_20 + n("w1h") * WRITE_1H_20 + n("cache_read") * READ_20).cast("decimal(20,0)")
    cost = (prompt * F.col("rate_input")).cast(MONEY) + ((n("output_tokens") * OUTPUT_20).cast("decimal(20,0)") * F.col("rate_output")).cast(MONEY)
    saved = (n("cache_read") * SAVED_20).cast("decimal(20,0)") * F.col("rate_input")
    zero = F.lit(0).cast(MONEY)
    return out.withColumns({"cost_units": F.coalesce(cost.cast(MONEY), zero), "saved_units": F.coalesce(saved.cast(MONEY), zero)}).drop("rate_input", "rate_output")


def dollars(units: Column) -> Column:
    return F.coalesce(units.cast("double") / COST_UNIT, F.lit(0.0))
