"""Rules on single rows: flags, issues, changes and decisions, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import METRICS, OUTAGE_LIMIT, PARKING_LIMIT, SPEED_RANGE, TEMPERATURE_LIMIT


def _zone_blank() -> Column:
    """As flagged: null or '', without trimming."""
    return F.col("raw_zone").isNull() | (F.col("raw_zone") == "")


def _zone_changed() -> Column:
    return ~_zone_blank() & (F.col("zone").isNull() | (F.col("raw_zone") != F.col("zone")))


def _outside_speed() -> Column:
    return (F.col("avg_speed_kmph") < SPEED_RANGE[0]) | (F.col("avg_speed_kmph") > SPEED_RANGE[1])


def flag_rules() -> list[tuple[Column, str, str, Column | None, Column | None, str]]:
    """(condition, field, flag, raw, cleaned, effect)."""
    rules = [
        (_zone_blank(), "zone", "missing", None, None, "kept as null"),
        (_zone_blank(), "zone", "unknown", None, None, "kept as null"),
        (_zone_changed(), "zone", "corrected", F.col("raw_zone"), F.col("zone"), "normalised only"),
    ]
    rules += [(F.col(m).isNull(), m, "missing", None, None, "left out for this metric") for m in METRICS]
    limits = [("avg_speed_kmph", _outside_speed(), "left out of speed analysis"), ("parking_occupancy_pct", F.col("parking_occupancy_pct") > PARKING_LIMIT, "kept"), ("temperature_c", F.col("temperature_c") >= TEMPERATURE_LIMIT, "kept"), ("power_outage_minutes", F.col("power_outage_minutes") > OUTAGE_LIMIT, "kept")]
    return rules + [(condition, m, "outlier", F.col(m).cast("string"), F.col(m).cast("string"), effect) for m, condition, effect in limits]


# The treatments and severities of issues.
PRESERVE, CANONICALIZE = "preserve_missing", "canonicalize_case_only"
VALUE_ISSUES = [
    # column, issue, treatment, severity
    ("avg_speed_kmph", "negative_value", "exclude_primary_analysis_do_not_overwrite", "high"),
    ("avg_speed_kmph", "extreme_value", "retain_flag_exclude_primary_analysis", "high"),
    ("parking_occupancy_pct", "above_100", "retain_flag_review_semantics", "medium"),
    ("temperature_c", "high_value", "retain_flag_review_sensor_context", "medium"),
    ("power_outage_minutes", "above_60", "retain_flag_review_window_definition", "low"),
]


def issue_rules() -> list[tuple[Column, str, str, Column | None, Column | None, str, bool, str]]:
    """(condition, column, issue, raw value, suggested value, treatment, needs
    the owner?, severity)."""
    rules = [
        (_zone_blank(), "zone", "missing", None, None, PRESERVE, True, "medium"),
        (_zone_changed(), "zone", "case_variant", F.col("raw_zone"), F.col("zone"), CANONICALIZE, False, "low"),
    ]
    rules += [(F.col(m).isNull(), m, "missing", None, None, PRESERVE, True, "medium") for m in METRICS]
    beyond = {
        "negative_value": F.col("avg_speed_kmph") < SPEED_RANGE[0], "extreme_value": F.col("avg_speed_kmph") > SPEED_RANGE[1], "above_100": F.col("parking_occupancy_pct") > PARKING_LIMIT,
        "high_value": F.col("temperature_c") >= TEMPERATURE_LIMIT, "above_60": F.col("power_outage_minutes") > OUTAGE_LIMIT,
    }
    return rules + [(beyond[issue], m, issue, F.col(m).cast("string"), None, treatment, True, severity) for m, issue, treatment, severity in VALUE_ISSUES]


def _events(layer: DataFrame, structs: list[tuple[Column, Column]]) -> DataFrame:
    """One row for each condition that holds, from a single scan."""
    events = F.array_compact(F.array(*(F.when(F.coalesce(condition, F.lit(False)), event) for condition, event in structs)))
    return layer.select("record_id", "source_row_number", F.explode(events).alias("e")).select("record_id", "source_row_number", "e.*")


def _text(value: Column | None) -> Column:
    return F.lit(None).cast("string") if value is None else value


def quality_flags(layer: DataFrame) -> DataFrame:
    return _events(layer, [(c, F.struct(F.lit(f).alias("field_name"), F.lit(t).alias("flag_type"), _text(raw).alias("raw_value"), _text(clean).alias("cleaned_value"), F.lit(effect).alias("effect"))) for c, f, t, raw, clean, effect in flag_rules()])


def quality_issues(layer: DataFrame) -> DataFrame:
    return _events(layer, [(c, F.struct(F.lit(f).alias("column_name"), F.lit(i).alias("issue_type"), _text(raw).alias("raw_value"), _text(to).alias("suggested_value"), F.lit(t).alias("treatment"), F.lit(owner).alias("needs_owner"), F.lit(s).alias("severity"))) for c, f, i, raw, to, t, owner, s in issue_rules()])


def row_status(layer: DataFrame) -> DataFrame:
    """issue_count and observed or flagged for every row."""
    count = sum((F.coalesce(c, F.lit(False)).cast("bigint") for c, *_ in flag_rules()), F.lit(0).cast("bigint"))
    return layer.select("record_id", count.alias("issue_count"), F.when(count > 0, "flagged").otherwise("observed").alias("quality_status"))


def flag_summary(flags: DataFrame) -> DataFrame:
    return flags.groupBy("flag_type", "field_name").agg(F.count("*").alias("flags"))


def flag_delta(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(flag_type, field_name, flags): by how much a refresh changes the
    summary; only the rows that come and go are read."""
    keys = ["flag_type", "field_name"]
    signed = removed.select(*keys, F.lit(-1).alias("sign")).unionByName(added.select(*keys, F.lit(1).alias("sign")))
    return signed.groupBy(*keys).agg(F.sum("sign").alias("flags")).filter("flags <> 0")


def with_delta(summary: DataFrame, delta: DataFrame) -> DataFrame:
    """A summary (flag_type, field_name, flags) after the delta: what a
    summary of all flags anew would be."""
    keys = ["flag_type", "field_name"]
    both = summary.select(*keys, "flags").unionByName(delta.select(*keys, "flags"))
    return both.groupBy(*keys).agg(F.sum("flags").alias("flags")).filter("flags <> 0")


def change_log(layer: DataFrame, duplicates: DataFrame) -> DataFrame:
    """What the canonical layer changed: zone spellings and removed copies."""
    spelled = quality_flags(layer).filter("flag_type = 'corrected'").select("record_id", "source_row_number", "field_name", "raw_value", "cleaned_value", F.lit("canonicalized").alias("change_type"))
    removed = duplicates.filter("action = 'removed_exact_duplicate'").select("record_id", "source_row_number", F.lit("__row__").alias("field_name"), F.col("record_id").alias("raw_value"), F.lit(None).cast("string").alias("cleaned_value"), F.lit("deduplicated").alias("change_type"))
    return spelled.unionByName(removed)


#: Fixed values: (key, column, issue, class, source confirmation).
DECISIONS = [
    ("duplicates", "__row__", "exact_duplicate", "confirmed_error", "confirmed_by_internal_key_check"),
    ("zone_case", "zone", "case_variant", "confirmed_error", "confirmed_by_controlled_vocabulary"),
    ("zone_missing", "zone", "missing", "unknown", "not_confirmed"),
    ("traffic_missing", "traffic_volume", "missing", "unknown", "not_confirmed"),
    ("speed_missing", "avg_speed_kmph", "missing", "unknown", "not_confirmed"),
    ("temperature_missing", "temperature_c", "missing", "unknown", "not_confirmed"),
    ("speed_negative", "avg_speed_kmph", "negative_value", "unknown", "not_confirmed"),
    ("speed_extreme", "avg_speed_kmph", "extreme_value", "unknown", "not_confirmed"),
    ("parking_over_100", "parking_occupancy_pct", "above_100", "unknown", "owner_confirmation_required"),
    ("temperature_high", "temperature_c", "high_value", "unknown", "historical_source_match_pending"),
    ("outage_over_60", "power_outage_minutes", "above_60", "valid_extreme", "window_assumption_pending"),
]


#: What each decision does, to the primary analysis too, and why, in our words.
DECISION_TEXTS = {
    "duplicates": ("drop all but the first copy from the canonical layer, log it, keep raw rows", "left out", "copies agree in every column of the source"),
    "zone_case": ("write the label of the vocabulary, keep the raw text", "used under the label", "spellings that differ in case alone name one zone"),
    "zone_missing": ("keep null and flag, never guess", "left out where zones matter", "nothing in the source tells the zone"),
    "traffic_missing": ("keep null, no imputation", "left out for traffic", "a row alone can't repair a gap"),
    "speed_missing": ("keep null, no imputation", "left out for speed", "a row alone can't repair a gap"),
    "temperature_missing": ("keep null, no imputation", "left out for temperature", "a row alone can't repair a gap"),
    "speed_negative": ("keep the value and flag, never turn its sign", "left out for speed", "sign error or code for missing: the source doesn't say"),
    "speed_extreme": ("keep the value and flag", "left out for speed until confirmed", "beyond the domain, but a unit or source error is possible"),
    "parking_over_100": ("keep and flag, no cap", "used, without reading it as a share", "more than nominal capacity can be parked; the denominator isn't documented"),
    "temperature_high": ("keep and flag until a station's record for that day is found", "used as flagged", "public products don't confirm single rows"),
    "outage_over_60": ("keep and flag", "used with its flag", "a window of four hours can hold more than an hour"),
}
#: Links from decisions to the sources consulted (decision, source, role, status).
EVIDENCE_LINKS = [
    ("temperature_high", "national climate service", "daily temperature products and the route to historical data", "not_confirmed"),
    ("temperature_high", "city weather reports of stations", "recorded extremes and their departures from normal", "not_confirmed"),
]


def decision_table(spark) -> DataFrame:
    rows = [(*d, *DECISION_TEXTS[d[0]]) for d in DECISIONS]
    return spark.createDataFrame(rows, "decision_key string, column_name string, issue_type string, decision_class string, confirmation string, treatment string, primary_effect string, rationale string")


def evidence_links(decided: DataFrame) -> DataFrame:
    """The sources consulted for each decision that has issues."""
    links = decided.sparkSession.createDataFrame(EVIDENCE_LINKS, "decision_key string, source string, role string, confirmation_status string")
    return links.join(decided.filter("observed_count > 0").select("decision_key", "observed_count"), "decision_key")


def decisions(layer: DataFrame, duplicates: DataFrame) -> DataFrame:
    """The decision table with the number of issues of each kind, 0 if none."""
    found = quality_issues(layer).groupBy("column_name", "issue_type").agg(F.count("*").alias("n"))
    removed = duplicates.filter("action = 'removed_exact_duplicate'").agg(F.count("*").alias("n")).select(F.lit("__row__").alias("column_name"), F.lit("exact_duplicate").alias("issue_type"), "n")
    # the right side has a row for each kind of issue, the left eleven
    return decision_table(layer.sparkSession).join(found.unionByName(removed), ["column_name", "issue_type"], "left").withColumn("observed_count", F.coalesce("n", F.lit(0).cast("bigint"))).drop("n")


def issue_signals(decided: DataFrame, validation: DataFrame) -> DataFrame:
    """The seven signals of a dashboard, largest first."""
    name = (
        F.when(F.col("decision_key") == "zone_case", "Zone case normalization").when(F.col("decision_key") == "parking_over_100", "Parking over 100%")
        .when(F.col("decision_key").isin("speed_negative", "speed_extreme"), "Speed outliers").when(F.col("decision_key") == "temperature_missing", "Temperature missing")
        .when(F.col("decision_key") == "zone_missing", "Unknown zones").when(F.col("decision_key") == "duplicates", "Exact duplicate rows removed")
    )
    known = decided.select(name.alias("signal"), F.col("observed_count").alias("n")).filter("signal IS NOT NULL")
    errors = validation.agg(F.count_if(F.col("decision") == "probable_error").alias("n")).select(F.lit("Temperature probable errors").alias("signal"), "n")
    return known.unionByName(errors).groupBy("signal").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "signal")


#: How the reasons of flags of imputed values and of benchmarks begin.
IMPUTED_PREFIX, BENCHMARK_REASON = "imputed for sensitivity:", "outside the benchmark range of its city"


def imputed_flags(events: DataFrame) -> DataFrame:
    """A flag with its reason for every value that was filled."""
    reason = F.concat_ws(" ", F.lit(IMPUTED_PREFIX), F.col("method"), F.lit("of"), F.col("field"))
    return events.select("record_id", F.col("field").alias("field_name"), F.lit("imputed").alias("flag_type"), reason.alias("reason"), F.lit("sensitivity only").alias("effect"))


def benchmark_flags(checked: DataFrame) -> DataFrame:
    """A flag for every temperature outside the range of its city."""
    outside = checked.filter(F.col("status").isin("below", "above"))
    return outside.select("record_id", F.lit("temperature_c").alias("field_name"), F.lit("outlier").alias("flag_type"), F.lit(BENCHMARK_REASON).alias("reason"), F.lit("kept, not interpreted").alias("effect"))


def with_reason(flags: DataFrame) -> DataFrame:
    return flags.select("record_id", "field_name", "flag_type", F.lit(None).cast("string").alias("reason"), "effect")


def delete_by_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """rows without those whose column begins with prefix; nulls stay."""
    return rows.filter(~F.coalesce(F.col(column).startswith(prefix), F.lit(False)))


def refreshed_flags(flags: DataFrame, new: DataFrame, prefix: str) -> DataFrame:
    """flags with those of a reason prefix replaced by new: running it twice
    gives what running it once does."""
    return delete_by_prefix(flags, "reason", prefix).unionByName(new)
