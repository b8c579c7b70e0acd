"""Checks of temperatures against references and neighbouring readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import neighbours
from ..schema import NEIGHBOUR_TOLERANCE


def city_benchmark(daily: DataFrame) -> DataFrame:
    """Lowest low and highest high of each city, with their first dates."""
    return daily.groupBy("city").agg(
        F.min("t_min").alias("low"), F.min(F.struct("t_min", "obs_date"))["obs_date"].alias("low_date"),
        F.max("t_max").alias("high"), F.min(F.struct((-F.col("t_max")).alias("x"), "obs_date"))["obs_date"].alias("high_date"),
    )


def month_envelope(daily: DataFrame) -> DataFrame:
    return daily.groupBy("city", F.month("obs_date").cast("bigint").alias("month")).agg(F.min("t_min").alias("low"), F.max("t_max").alias("high"))


def benchmark_check(layer: DataFrame, daily: DataFrame) -> DataFrame:
    """Status of each temperature against its city's range."""
    t = F.col("temperature_c")
    status = F.when(F.col("known").isNull(), "unknown_city").when(t.isNull(), "missing").when(t < F.col("low"), "below").when(t > F.col("high"), "above").otherwise("within")
    bench = city_benchmark(daily).select("city", "low", "high", F.lit(True).alias("known"))
    return layer.join(bench, "city", "left").select("record_id", "city", "temperature_c", "low", "high", status.alias("status"))


def decision(plausible: Column, near: Column) -> Column:
    """Only three cells of the grid are decided."""
    return (
        F.when((plausible == "plausible") & (near == "consistent"), "retain_unchanged")
        .when((plausible == "plausible") & (near == "inconsistent"), "flag_for_review")
        .when((plausible == "implausible") & (near == "inconsistent"), "probable_error")
        .otherwise("not_assessed")
    )


def neighbour_validation(layer: DataFrame, daily: DataFrame, tolerance: float = NEIGHBOUR_TOLERANCE) -> DataFrame:
    """Month plausibility, neighbour status and decision for every row.

    Neighbours are the readings before and after of the same city that have a
    temperature, in order of (ts, record_id).
    """
    known = layer.filter("temperature_c IS NOT NULL").select("record_id", "city", "month", "ts", "temperature_c")
    near = neighbours(known, "city", ["ts", "record_id"], ["temperature_c"])
    near = near.select("record_id", "city", "month", "temperature_c", F.col("prev.temperature_c").alias("prev_c"), F.col("next.temperature_c").alias("next_c"))
    none = F.lit(None).cast(layer.schema["temperature_c"].dataType)
    rest = layer.filter("temperature_c IS NULL").select("record_id", "city", "month", "temperature_c", none.alias("prev_c"), none.alias("next_c"))
    t = F.col("temperature_c")
    # a row for each city and month
    rows = near.unionByName(rest).join(F.broadcast(month_envelope(daily)), ["city", "month"], "left")
    plausible = F.when(t.isNull() | F.col("low").isNull(), "unknown").when(t.between(F.col("low"), F.col("high")), "plausible").otherwise("implausible")
    spread = F.greatest("prev_c", t, "next_c") - F.least("prev_c", t, "next_c")
    status = F.when(t.isNull(), "unknown").when(F.col("prev_c").isNull() | F.col("next_c").isNull(), "insufficient").when(spread <= tolerance, "consistent").otherwise("inconsistent")
    rows = rows.withColumn("plausibility", plausible).withColumn("neighbour_status", status)
    return rows.select("record_id", "city", "temperature_c", "prev_c", "next_c", "plausibility", "neighbour_status", decision(F.col("plausibility"), F.col("neighbour_status")).alias("decision"))


def with_probable_errors(layer: DataFrame, validation: DataFrame) -> DataFrame:
    """layer with `probable_error`, whether the neighbour rule rejects it."""
    bad = validation.filter("decision = 'probable_error'").select("record_id", F.lit(True).alias("probable_error"))
    return layer.join(bad, "record_id", "left").withColumn("probable_error", F.coalesce("probable_error", F.lit(False)))


def append_flags(flags: DataFrame, new: DataFrame) -> DataFrame:
    """flags and those of new (record_id, field_name, flag_type, effect) that
    aren't there yet: appending twice changes nothing."""
    keys = ["record_id", "field_name", "flag_type", "effect"]
    return flags.select(*keys).unionByName(new.select(*keys).distinct().join(flags.select(*keys), keys, "left_anti"))
