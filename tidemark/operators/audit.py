"""Structure: missing values, counts by dimension, time grid and panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FACTORS, METRICS, SLOT_HOURS, SOURCE_COLUMNS, UNKNOWN
from ..functions.expressions import valid


def missingness(raw: DataFrame, layer: DataFrame) -> DataFrame:
    """Nulls of each column before and after removal of copies."""
    columns = SOURCE_COLUMNS[1:]
    after = {"zone": "raw_zone", "timestamp_text": "raw_timestamp"}
    a = raw.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).unpivot([], columns, "column_name", "raw_missing")
    b = layer.agg(*(F.count_if(F.col(after.get(c, c)).isNull()).alias(c) for c in columns), F.count("*").alias("__n"))
    b = b.unpivot(["__n"], columns, "column_name", "missing").select("column_name", "missing", F.try_divide(F.col("missing"), F.col("__n")).alias("missing_rate"))
    return a.join(b, "column_name")


def dimension_counts(layer: DataFrame) -> DataFrame:
    """Rows of each member of five dimensions, from one pass."""
    view = layer.select("city", F.coalesce("zone", F.lit(UNKNOWN)).alias("zone"), *(F.col(c).cast("string").alias(c) for c in FACTORS[2:]))
    members = F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("member")) for c in FACTORS))
    return view.select(F.explode(members).alias("x")).groupBy("x.dimension", "x.member").agg(F.count("*").alias("rows"))


def expected_slots(layer: DataFrame) -> DataFrame:
    """The four-hour grid between the first and last time stamp."""
    span = layer.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).filter("a IS NOT NULL")
    return span.select(F.explode(F.expr("sequence(a, b, interval 4 hours)")).alias("ts")).filter(F.hour("ts").isin(*SLOT_HOURS))


def missing_slots(layer: DataFrame) -> DataFrame:
    return expected_slots(layer).join(layer.select("ts").distinct(), "ts", "left_anti")


def coverage(raw: DataFrame, layer: DataFrame) -> DataFrame:
    """Keyed facts about rows, time grid and the city x zone x time panel.  The
    panel is counted as a product, never built."""
    r = raw.agg(F.count("*").alias("raw_rows"))
    one = layer.agg(
        F.count("*").alias("deduplicated_rows"), F.countDistinct("ts").alias("unique_timestamps"), F.countDistinct("city").alias("cities"), F.countDistinct("zone").alias("zones"),
        F.countDistinct(F.when(F.col("zone").isNotNull() & F.col("ts").isNotNull(), F.struct("city", "zone", "ts"))).alias("known_keys"),
    )
    slots = expected_slots(layer).agg(F.count("*").alias("expected_slots"))
    gaps = missing_slots(layer).agg(F.count("*").alias("missing_slots"))
    # four tables of one row
    wide = r.crossJoin(one).crossJoin(slots).crossJoin(gaps)
    panel = F.col("cities") * F.col("zones") * F.col("unique_timestamps")
    facts = {
        "raw_rows": F.col("raw_rows"), "deduplicated_rows": F.col("deduplicated_rows"), "exact_duplicate_rows_removed": F.col("raw_rows") - F.col("deduplicated_rows"),
        "unique_timestamps_after_dedup": F.col("unique_timestamps"), "expected_four_hour_slots": F.col("expected_slots"), "missing_four_hour_slots": F.col("missing_slots"),
        "full_panel_expected_rows": panel, "full_panel_known_observed_keys": F.col("known_keys"), "full_panel_known_coverage_pct": F.try_divide(100.0 * F.col("known_keys"), panel),
        "one_row_per_timestamp_after_dedup": (F.col("unique_timestamps") == F.col("deduplicated_rows")).cast("double"),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("audit_key"), v.cast("double").alias("value_num")) for k, v in facts.items()))
    return wide.select(F.explode(pairs).alias("x")).select("x.*")


def completeness(frame: DataFrame, fields: list[str] = METRICS) -> DataFrame:
    """Observed and missing values of each field; percentages of an empty frame
    are 0."""
    one = frame.agg(F.count("*").alias("__n"), *(F.count(c).alias(c) for c in fields))
    long = one.unpivot(["__n"], fields, "field", "observed")
    return long.select("field", "observed", (F.col("__n") - F.col("observed")).alias("missing"), F.when(F.col("__n") > 0, 100.0 * F.col("observed") / F.col("__n")).otherwise(F.lit(0.0)).alias("complete_pct"))


def kpis(raw: DataFrame, layer: DataFrame) -> DataFrame:
    """One row of headline numbers."""
    a = raw.agg(F.count("*").alias("raw_rows"))
    b = layer.agg(F.count("*").alias("canonical_rows"), F.countDistinct("ts").alias("timestamps"), F.sum(F.col("eligible").cast("bigint")).alias("eligible_rows"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_ts"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_ts"))
    return a.crossJoin(b).withColumn("duplicate_rows", F.col("raw_rows") - F.col("canonical_rows"))


def integrity(layer: DataFrame) -> DataFrame:
    """Checks of the canonical layer and how many rows break each."""
    repeated = layer.groupBy("record_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_ids"))
    rest = layer.agg(F.count_if(F.col("record_id").isNull()).alias("null_ids"), F.count_if(F.col("city").isNull()).alias("null_cities"), F.count_if(F.col("ts").isNull()).alias("null_timestamps"), F.count_if(F.col("eligible") & ~valid("avg_speed_kmph")).alias("eligible_but_invalid"))
    wide = repeated.crossJoin(rest)
    return wide.unpivot([], wide.columns, "check", "broken")
