"""Value-treatment scenarios and imputation layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import masked
from ..schema import ALPHA, METRICS
from .stats import gram, gram_correlation, holm, with_inference

SCENARIOS = ("primary_observed", "flagged_values_included", "city_month_median_imputed")
#: The fields that imputation fills and the gate on skewness.
IMPUTED = ("traffic_volume", "avg_speed_kmph", "temperature_c")
SKEW_GATE = 0.5


def scenario_values(layer: DataFrame) -> DataFrame:
    """layer once per scenario: valid values; all values; or valid values with
    gaps filled by the median of their city and month, else of all."""
    medians = layer.groupBy("city", "month").agg(*(F.median(masked(m)).alias(f"cm_{m}") for m in METRICS))
    overall = layer.agg(*(F.median(masked(m)).alias(f"all_{m}") for m in METRICS))
    joined = layer.join(medians, ["city", "month"], "left").crossJoin(F.broadcast(overall))  # one row
    s = F.col("scenario")
    values = [F.when(s == SCENARIOS[1], F.col(m).cast("double")).when(s == SCENARIOS[0], masked(m)).otherwise(F.coalesce(masked(m), f"cm_{m}", f"all_{m}")).alias(m) for m in METRICS]
    each = joined.withColumn("scenario", F.explode(F.array(*map(F.lit, SCENARIOS))))
    return each.select("scenario", "record_id", "city", "zone", "ts", "observation_date", "hour", "weekday", "month", *values)


def _plain(values: DataFrame) -> DataFrame:
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))
    return values.select("scenario", F.explode(each).alias("x")).select("scenario", "x.metric", "x.value").filter("value IS NOT NULL")


def scenario_summary(values: DataFrame) -> DataFrame:
    """n, mean, median and sd: 27 rows."""
    return _plain(values).groupBy("scenario", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_samp("value").alias("sd"))


def scenario_correlations(values: DataFrame) -> DataFrame:
    """Pearson r of 36 pairs in each scenario, by the scenario's own values."""
    return gram(values, ["scenario"]).select("scenario", "x", "y", "n", gram_correlation().alias("r"))


def scenario_inference(values: DataFrame) -> DataFrame:
    """The same with the 99 per cent interval, p and Holm's p within a scenario."""
    return holm(with_inference(scenario_correlations(values)), ["scenario"], ["x", "y"]).withColumn("significant", F.col("p_holm") < ALPHA)


def imputation_methods(layer: DataFrame) -> DataFrame:
    """How each field would be filled: the mean where its adjusted skewness is
    within SKEW_GATE, else the median; the most frequent zone, ties to the
    first label.  Estimates use screened values; layer has probable_error."""
    aggregates, parts = [], []
    for m in IMPUTED:
        v = masked(m, F.col("probable_error"))
        n = F.count(v)
        skew = F.when((n > 2) & (F.var_pop(v) > 0), F.skewness(v) * F.sqrt(n * (n - 1.0)) / (n - 2.0)).otherwise(F.lit(0.0))
        aggregates.append(F.struct(F.lit(m).alias("field"), n.alias("observed"), F.count_if(F.col(m).isNull()).alias("missing"), F.avg(v).alias("mean"), F.median(v).alias("median"), skew.alias("skewness"), F.lit(None).cast("string").alias("label")).alias(m))
    counts = layer.filter("zone IS NOT NULL").groupBy("zone").agg(F.count("*").alias("n"))
    zone = counts.agg(F.sum("n").alias("observed"), F.min(F.struct((-F.col("n")).alias("x"), "zone"))["zone"].alias("label")).crossJoin(layer.agg(F.count_if(F.col("zone").isNull()).alias("missing")))
    null = F.lit(None).cast("double")
    numeric = layer.agg(*aggregates).select(F.explode(F.array(*IMPUTED)).alias("p")).select("p.*")
    both = numeric.unionByName(zone.select(F.lit("zone").alias("field"), "observed", "missing", null.alias("mean"), null.alias("median"), null.alias("skewness"), "label"))
    method = F.when(F.col("field") == "zone", "mode").when(F.abs("skewness") <= SKEW_GATE, "mean").otherwise("median")
    estimate = F.when(method == "mean", F.col("mean")).when(method == "median", F.col("median"))
    return both.select("field", "observed", "missing", "mean", "median", "skewness", method.alias("method"), estimate.alias("estimate"), "label")


def imputed_layer(layer: DataFrame, methods: DataFrame) -> DataFrame:
    """layer with nulls of four fields filled, and how many were.  Values out
    of their domain stay as they are."""
    one = methods.agg(*(F.max(F.when(F.col("field") == m, F.col("estimate"))).alias(f"est_{m}") for m in IMPUTED), F.max(F.when(F.col("field") == "zone", F.col("label"))).alias("est_zone"))
    gaps = sum((F.col(c).isNull().cast("bigint") for c in ("zone", *IMPUTED)), F.lit(0).cast("bigint"))
    joined = layer.crossJoin(F.broadcast(one))  # one row
    filled = {m: F.coalesce(F.col(m).cast("double"), F.col(f"est_{m}")) for m in IMPUTED} | {"zone": F.coalesce("zone", "est_zone")}
    out = [filled[c].alias(c) if c in filled else F.col(c) for c in layer.columns]
    return joined.select(*out, gaps.alias("imputation_count"))


def imputation_events(layer: DataFrame, methods: DataFrame) -> DataFrame:
    """(record_id, field, method, value as text) of every value filled."""
    fields = ("zone", *IMPUTED)
    events = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in fields)))
    each = layer.select("record_id", F.explode(events).alias("field"))
    return each.join(F.broadcast(methods.select("field", "method", "estimate", "label")), "field").select("record_id", "field", "method", "estimate", "label")  # four rows


def scenario_group_effects(values: DataFrame) -> DataFrame:
    """eta squared of five factors and nine metrics in each scenario: 135 rows."""
    each = F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in ("city", "zone", "hour", "month", "weekday")))
    long = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))
    rows = values.select("scenario", F.explode(long).alias("v"), each.alias("gs")).filter("v.value IS NOT NULL").select("scenario", "v.metric", "v.value", F.explode("gs").alias("g")).filter("g.level IS NOT NULL")
    sums = rows.groupBy("scenario", "g.factor", "g.level", "metric").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    one = sums.groupBy("scenario", "factor", "metric").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    centre = F.col("s") * F.col("s") / F.col("n")
    return one.select("scenario", "factor", "metric", "n", F.when(F.col("ss") - centre <= 0, F.lit(0.0)).otherwise((F.col("b") - centre) / (F.col("ss") - centre)).alias("eta2"))
