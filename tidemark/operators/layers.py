"""Raw to canonical: exact duplicates, cleaned columns and governed views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import canonical_label, eligible, parse_timestamp
from ..schema import METRICS, SOURCE_COLUMNS, UNKNOWN
from ..sources.observations import ContractError


def dedup_exact(raw: DataFrame) -> DataFrame:
    """The first of every set of equal rows; nulls equal nulls.  Grouping on
    all source columns sums up copies before they travel."""
    return raw.groupBy(*SOURCE_COLUMNS).agg(F.min("source_row_number").alias("source_row_number")).select("source_row_number", *SOURCE_COLUMNS)


def dedup_log(raw: DataFrame) -> DataFrame:
    """Every row of the sets with more than one row, and what happened to it."""
    keyed = raw.withColumn("__key", F.md5(F.to_json(F.struct(*SOURCE_COLUMNS), {"ignoreNullFields": "false"})))
    groups = keyed.groupBy("__key").agg(F.count("*").alias("duplicate_group_size"), F.min("source_row_number").alias("kept_source_row_number")).filter("duplicate_group_size > 1")
    action = F.when(F.col("source_row_number") == F.col("kept_source_row_number"), "kept").otherwise("removed_exact_duplicate")
    return keyed.join(groups, "__key").select("source_row_number", "record_id", "duplicate_group_size", "kept_source_row_number", action.alias("action"))


def key_conflicts(deduplicated: DataFrame) -> DataFrame:
    """Ids of rows that differ in something else."""
    return deduplicated.groupBy("record_id").agg(F.count("*").alias("n")).filter("n > 1")


def check_keys(deduplicated: DataFrame) -> DataFrame:
    if (bad := key_conflicts(deduplicated).limit(5).collect()):
        raise ContractError(f"rows that are no exact copies share ids: {[r['record_id'] for r in bad]}")
    return deduplicated


def canonical(deduplicated: DataFrame) -> DataFrame:
    """Cleaned city, zone, time stamp and calendar parts beside the raw zone
    and time stamp.  Metrics are never changed, so they stand once; `paired`
    writes the raw and cleaned pairs out.  A time stamp that can't be read is
    null here; `check_timestamps` raises on one."""
    ts = parse_timestamp(F.col("timestamp_text"))
    return deduplicated.select(
        "source_row_number", "record_id", "city", F.col("zone").alias("raw_zone"), canonical_label(F.col("zone")).alias("zone"), F.col("timestamp_text").alias("raw_timestamp"), ts.alias("ts"),
        F.to_date(ts).alias("observation_date"), F.hour(ts).cast("bigint").alias("hour"), F.weekday(ts).cast("bigint").alias("weekday"), F.month(ts).cast("bigint").alias("month"), *METRICS,
    ).withColumn("eligible", eligible())


def check_timestamps(layer: DataFrame) -> DataFrame:
    if (bad := layer.filter("ts IS NULL").limit(5).collect()):
        raise ContractError(f"unreadable time stamps: {[r['raw_timestamp'] for r in bad]}")
    return layer


def paired(layer: DataFrame) -> DataFrame:
    """The 32-column form with a raw and a cleaned column for each value."""
    pairs = [c for m in METRICS for c in (F.col(m).alias(f"raw_{m}"), F.col(m).alias(f"cleaned_{m}"))]
    return layer.select("record_id", "source_row_number", F.col("city").alias("raw_city"), F.col("city").alias("cleaned_city"), "raw_zone", F.col("zone").alias("cleaned_zone"), "raw_timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("cleaned_timestamp_iso"), "observation_date", "hour", "weekday", "month", *pairs, F.col("eligible").cast("int").alias("primary_analysis_eligible"))


def primary(layer: DataFrame) -> DataFrame:
    """Rows whose nine metrics are all valid."""
    return layer.filter("eligible")


def zone_complete(layer: DataFrame) -> DataFrame:
    return primary(layer).filter("zone IS NOT NULL")


def city_zone_coverage(layer: DataFrame) -> DataFrame:
    return layer.groupBy("city", F.coalesce("zone", F.lit(UNKNOWN)).alias("zone")).agg(F.count("*").alias("rows"))


def city_zone_month(layer: DataFrame) -> DataFrame:
    """Counts and traffic of the governed primary rows."""
    return zone_complete(layer).groupBy("city", "zone", "month").agg(F.count("*").alias("records"), F.sum("traffic_volume").alias("traffic"))
