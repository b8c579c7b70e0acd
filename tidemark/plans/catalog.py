"""Named queries over the test tables: the operators put together.

Floating-point results are rounded to six places, because the order of a
distributed sum is not fixed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.saved import drop, saved, scratch
from ..operators import api, audit, governance, layers, models, plausibility, provenance, quality, resample, scenarios, stats
from ..schema import ALPHA, METRICS
from ..sources.observations import daily_benchmarks, observations, table, upsert
from ..sources.store import Store
from ..streaming.refresh import slot_counts

#: Replicates of the registered resampling queries (fixed values: those of the
#: method; PROVENANCE_PROTOCOL has its own).
PERMUTATIONS, BOOTSTRAPS, BLOCK_BOOTSTRAPS = 5000, 5000, 3000
Query = Callable[[SparkSession, str], DataFrame]
_TS = "yyyy-MM-dd HH:mm:ss"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, or all doubles, rounded to six places."""
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.select(*(F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns))


class Tables:
    """The layers of one set of test tables, all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.raw = observations(spark, sf_dir)
        self.layer = layers.canonical(layers.dedup_exact(self.raw))
        self.daily = daily_benchmarks(spark, sf_dir)

    @property
    def log(self) -> DataFrame:
        return layers.dedup_log(self.raw)

    @property
    def validation(self) -> DataFrame:
        return plausibility.neighbour_validation(self.layer, self.daily)

    @cached_property
    def marked(self) -> DataFrame:
        """Written: its plan has two joins and windows, and the queries that use
        it do so many times.  So is the layer that it is made from three times."""
        layer = saved(self.layer)
        out = saved(plausibility.with_probable_errors(layer, plausibility.neighbour_validation(layer, self.daily)))
        drop(layer)
        return out


def dashboard_city_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: governed primary rows by city and zone."""
    rows = layers.zone_complete(Tables(spark, sf_dir).layer)
    t = F.col("traffic_volume")
    return rounded(rows.groupBy("city", "zone").agg(F.count("*").alias("records"), F.sum(t).alias("traffic"), F.avg(t).alias("mean_traffic"), F.median(t.cast("double")).alias("median_traffic")))


def _text(df: DataFrame, *dates: str, ts: str | None = None) -> DataFrame:
    out = df
    for c in dates:
        out = out.withColumn(c, F.col(c).cast("string"))
    return out.withColumn(ts, F.date_format(ts, _TS)) if ts else out


CHOICE = api.Selection(cities=("ASIA", "EUROPE"), hours=(0, 8, 16), start="1996-01-01", end="1998-12-31")


def _canonical(t: Tables) -> DataFrame:
    layers.check_keys(layers.dedup_exact(t.raw))
    return _text(layers.check_timestamps(t.layer), "observation_date", ts="ts")


def _imputed(t: Tables) -> DataFrame:
    # four rows, which all scans of the layer need
    return scenarios.imputed_layer(t.marked, saved(scenarios.imputation_methods(t.marked)))


def _gates(t: Tables) -> DataFrame:
    return rounded(stats.hypothesis_gates(t.marked))


def _appended(t: Tables) -> DataFrame:
    flags = quality.quality_flags(t.layer)
    new = t.validation.filter("decision = 'probable_error'").select("record_id", F.lit("temperature_c").alias("field_name"), F.lit("outlier").alias("flag_type"), F.lit("probable error").alias("effect"))
    outside = quality.benchmark_flags(plausibility.benchmark_check(t.layer, t.daily))
    for more in (new, outside, new, outside):  # again changes nothing
        flags = plausibility.append_flags(flags, more)
    return flags


def _flags_after_imputation(t: Tables) -> DataFrame:
    """Refreshed twice, which is the same as once."""
    methods = scenarios.imputation_methods(t.marked)
    new = quality.imputed_flags(scenarios.imputation_events(t.marked, methods))
    flags = quality.with_reason(quality.quality_flags(t.layer))
    for _ in range(2):
        flags = quality.refreshed_flags(flags, new, quality.IMPUTED_PREFIX)
    return flags.groupBy("field_name", "flag_type", "reason").agg(F.count("*").alias("flags"))


def _run_twice(t: Tables) -> Store:
    """A store with two runs: over the tables, and after a row was appended."""
    store = Store(t.raw.sparkSession, scratch(t.raw.sparkSession, "store-"))
    decided = quality.decisions(t.layer, t.log)
    governance.record_run(store, {"raw": t.raw, "canonical": t.layer, "decisions": decided.filter("observed_count > 0")})
    raw = t.raw.unionByName(_new_row(t))
    governance.record_run(store, {"raw": raw, "canonical": layers.canonical(layers.dedup_exact(raw))}, ("models",))
    return store


def _latest_contracts(t: Tables) -> DataFrame:
    """Contracts with their status, and the latest run of the stage they rest on."""
    return governance.current_contracts(_run_twice(t))


def _latest_run(t: Tables) -> DataFrame:
    """The latest run by a scalar subquery with a bound parameter."""
    store = _run_twice(t)
    text = "SELECT stage, run, rows FROM {runs} WHERE run = (SELECT max(run) FROM {runs} WHERE stage = :stage)"
    return api.bound(store.spark, text, {"stage": "canonical"}, runs=store.layer("runs"))


def _registry(t: Tables, table: DataFrame, key: str) -> DataFrame:
    entries = governance.registry_conditions()
    return governance.usable_rows(table, key, t.layer, entries)


def _refreshed_summary(t: Tables) -> DataFrame:
    """The flag summary upkept over two refreshes of the imputed flags: all of
    them, and once more without those of the zone."""
    events = scenarios.imputation_events(t.marked, scenarios.imputation_methods(t.marked))
    new, fewer = quality.imputed_flags(events), quality.imputed_flags(events.filter("field <> 'zone'"))
    kept = quality.flag_summary(quality.quality_flags(t.layer))
    once = quality.with_delta(kept, quality.flag_delta(new.limit(0), new))
    return quality.with_delta(once, quality.flag_delta(new, fewer))


def _flags(t: Tables) -> DataFrame:
    """All flags; numbers stand as numbers beside texts, since engines print them differently."""
    flags = quality.quality_flags(t.layer)
    for side in ("raw", "cleaned"):
        number = F.expr(f"try_cast({side}_value AS DOUBLE)")
        flags = flags.withColumn(f"{side}_number", number).withColumn(f"{side}_value", F.when(number.isNull(), F.col(f"{side}_value")))
    return flags


def _pair_inference(t: Tables) -> DataFrame:
    """The 36 pairs by both methods with interval, p and Holm over the family."""
    both = [stats.with_inference(made).withColumn("method", F.lit(name)) for name, made in (("pearson", stats.pearson_pairs(t.layer)), ("spearman", stats.spearman_pairs(t.layer)))]
    return rounded(stats.holm(both[0].unionByName(both[1]), ["method"], ["x", "y"]).withColumn("significant", F.col("p_holm") < ALPHA))


def _new_row(t: Tables) -> DataFrame:
    return t.raw.sparkSession.range(1).select(F.lit(1 << 40).alias("source_row_number"), F.lit("NEW000000001").alias("record_id"), F.lit("ASIA").alias("city"), F.lit("Central").alias("zone"), F.lit("2026-01-03 00:00:00").alias("timestamp_text"), *(F.lit(1).cast(t.raw.schema[m].dataType).alias(m) for m in METRICS))


def _append_one(t: Tables) -> DataFrame:
    raw = t.raw.unionByName(_new_row(t))
    return raw.agg(F.count("*").alias("raw_rows")).crossJoin(layers.canonical(layers.dedup_exact(raw)).agg(F.count("*").alias("canonical_rows")))  # one row each


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("ts", "event_type")
    return _text(slot_counts(events, "ts", ["event_type"]), ts="slot_start")


_OF_TABLES: dict[str, Callable[[Tables], DataFrame]] = {
    "dedup_exact": lambda t: layers.dedup_exact(t.raw),
    "dedup_log": lambda t: t.log,
    "canonical_layer": _canonical,
    "primary_counts": lambda t: t.layer.agg(F.count_if("eligible").alias("primary_observed"), F.count_if(F.col("eligible") & F.col("zone").isNotNull()).alias("zone_complete")),
    "city_zone_coverage": lambda t: layers.city_zone_coverage(t.layer),
    "city_zone_month": lambda t: layers.city_zone_month(t.layer),
    "dimension_counts": lambda t: audit.dimension_counts(t.layer),
    "missingness": lambda t: rounded(audit.missingness(t.raw, t.layer)),
    "missing_slots": lambda t: audit.missing_slots(t.layer).select(F.date_format("ts", _TS).alias("slot")),
    "coverage_audit": lambda t: rounded(audit.coverage(t.raw, t.layer)),
    "completeness": lambda t: rounded(audit.completeness(t.layer)),
    "kpis": lambda t: audit.kpis(t.raw, t.layer),
    "integrity": lambda t: audit.integrity(t.layer),
    "quality_flags": _flags,
    "quality_flag_summary": lambda t: quality.flag_summary(quality.quality_flags(t.layer)),
    "quality_issues": lambda t: quality.quality_issues(t.layer).drop("source_row_number").withColumn("raw_number", F.expr("try_cast(raw_value AS DOUBLE)")).withColumn("raw_value", F.when(F.col("raw_number").isNull(), F.col("raw_value"))),
    "row_status": lambda t: quality.row_status(t.layer),
    "change_log": lambda t: quality.change_log(t.layer, t.log),
    "quality_decisions": lambda t: quality.decisions(t.layer, t.log),
    "evidence_links": lambda t: quality.evidence_links(quality.decisions(t.layer, t.log)),
    "imputed_flags": lambda t: _flags_after_imputation(t),
    "benchmark_flags": lambda t: quality.benchmark_flags(plausibility.benchmark_check(t.layer, t.daily)),
    "latest_contracts": lambda t: _latest_contracts(t),
    "pair_inference": lambda t: _pair_inference(t),
    "hypothesis_registry": lambda t: _registry(t, governance.registered_hypotheses(t.raw.sparkSession), "hypothesis"),
    "model_registry": lambda t: _registry(t, governance.registered_models(t.raw.sparkSession), "model"),
    "latest_run": _latest_run,
    "flag_summary_refreshed": _refreshed_summary,
    "filtered_sql": lambda t: _text(api.filtered_sql(t.layer, CHOICE), ts="ts").drop("observation_date"),
    "filtered_primary": lambda t: api.filtered_sql(t.layer, replace(CHOICE, primary_only=True)).select("record_id"),
    "paired_columns": lambda t: _text(layers.paired(t.layer), "observation_date"),
    "city_places": lambda t: t.layer.groupBy("city").agg(F.count("*").alias("rows")).join(F.broadcast(governance.coordinates(t.raw.sparkSession)), "city", "left"),
    "scenario_inference": lambda t: rounded(scenarios.scenario_inference(scenarios.scenario_values(t.layer))),
    "result_rollups": lambda t: rounded(governance.rollups(_pair_inference(t), rounded(stats.eta_squared(stats.group_sums(t.layer))), rounded(models.baseline_folds(t.marked)))),
    "issue_signals": lambda t: quality.issue_signals(quality.decisions(t.layer, t.log), t.validation),
    "city_benchmark": lambda t: _text(plausibility.city_benchmark(t.daily), "low_date", "high_date"),
    "month_envelope": lambda t: plausibility.month_envelope(t.daily),
    "benchmark_check": lambda t: plausibility.benchmark_check(t.layer, t.daily),
    "neighbour_validation": lambda t: t.validation,
    "decision_counts": lambda t: t.validation.groupBy("plausibility", "neighbour_status", "decision").agg(F.count("*").alias("rows")),
    "flags_appended": _appended,
    "metric_summary": lambda t: rounded(stats.metric_summary(t.layer)),
    "descriptive_summary": lambda t: rounded(stats.descriptive_summary(t.layer)),
    "group_extremes": lambda t: rounded(stats.group_extremes(rounded(stats.descriptive_summary(t.layer)))),
    "pearson_pairs": lambda t: rounded(stats.pearson_pairs(t.layer)),
    "spearman_pairs": lambda t: rounded(stats.spearman_pairs(t.layer)),
    "field_rank_pairs": lambda t: rounded(stats.field_rank_pairs(t.layer)),
    "hypothesis_gates": _gates,
    "hypothesis_table": lambda t: rounded(stats.hypothesis_table(t.layer)),
    "eta_squared": lambda t: rounded(stats.eta_squared(stats.group_sums(t.layer))),
    "top_effects": lambda t: rounded(stats.top_effects(stats.eta_squared(stats.group_sums(t.layer))).select("factor", "metric", "eta2")),
    "entropy_unique_rate": lambda t: rounded(stats.entropy_and_unique(t.layer)),
    "lag1_autocorrelation": lambda t: rounded(provenance.lag1(stats.long_values(t.layer, ["city", "ts", "record_id"]), [])),
    "permutation_eta_small": lambda t: rounded(stats.permutation_eta(t.marked, "city", 5, 0, True)),
    "bootstrap_mean_small": lambda t: rounded(stats.bootstrap_mean(stats.long_values(t.layer, ["record_id"]), ["metric"], 5)),
    "pairwise_differences": lambda t: rounded(stats.pairwise_differences(t.layer, "city")),
    "scenario_summary": lambda t: rounded(scenarios.scenario_summary(scenarios.scenario_values(t.layer))),
    "scenario_correlations": lambda t: rounded(scenarios.scenario_correlations(scenarios.scenario_values(t.layer))),
    "scenario_group_effects": lambda t: rounded(scenarios.scenario_group_effects(scenarios.scenario_values(t.layer))),
    "imputation_methods": lambda t: rounded(scenarios.imputation_methods(t.marked)),
    "imputed_layer": lambda t: rounded(scenarios.imputed_layer(t.marked, scenarios.imputation_methods(t.marked)).select("record_id", "zone", *scenarios.IMPUTED, "imputation_count")),
    "imputation_events": lambda t: rounded(scenarios.imputation_events(t.marked, scenarios.imputation_methods(t.marked))),
    "baseline_folds": lambda t: rounded(models.baseline_folds(t.marked)),
    "filter_options": lambda t: api.options(t.layer),
    "filtered_rows": lambda t: _text(api.filtered(t.layer, CHOICE), ts="ts").drop("observation_date"),
    "empty_selection": lambda t: api.filtered(t.layer, api.Selection(cities=("nowhere",))).select("record_id"),
    "metric_flags": lambda t: api.with_metric_flags(api.frame(t.layer), quality.quality_flags(t.layer)).select("record_id", F.coalesce("speed_primary_valid", F.lit(False)).alias("speed_primary_valid"), "temperature_primary_valid"),
    "monthly_summary": lambda t: rounded(api.period_means(api.frame(t.layer), "month", ["traffic_volume", "temperature_c"])),
    "hourly_summary": lambda t: rounded(api.period_means(api.frame(t.layer), "hour", ["traffic_volume", "temperature_c"])),
    "grouped_valid_means": lambda t: rounded(api.grouped_means(t.layer, "zone")),
    "flag_semi_join": lambda t: api.flags_of(api.filtered(t.layer, CHOICE), quality.quality_flags(t.layer)),
    "append_one": _append_one,
    "upsert": lambda t: upsert(plausibility.city_benchmark(t.daily).select("city", "low"), t.raw.sparkSession.createDataFrame([("ASIA", -1.0)], "city string, low double"), ["city"]),
    "registries": lambda t: _registry(t, governance.registries(t.raw.sparkSession), "entry"),
    "evidence_rollup": lambda t: governance.evidence(t.layer, t.raw, quality.decisions(t.layer, t.log), stats.hypothesis_table(t.layer)),
    # iterative or simulated, with the method's replicates: no SQL twin.  The
    # two named _small draw by digests, as their SQL does, a few replicates
    "permutation_eta": lambda t: rounded(resample.permutation_tests(t.marked, ["city"], PERMUTATIONS, 0, True).drop("factor", "n", "groups")),
    "bootstrap_mean": lambda t: rounded(resample.bootstrap_means(stats.long_values(t.layer, []), ["metric"], BOOTSTRAPS)),
    "group_tests": lambda t: rounded(stats.group_tests(t.layer)),
    "group_gates": lambda t: rounded(stats.group_gates(t.marked, PERMUTATIONS)),
    "provenance_diagnostics": lambda t: rounded(provenance.diagnostics(t.layer, governance.PROVENANCE_PROTOCOL[0][1])),
    "ridge_forecast": lambda t: rounded(models.ridge_forecast(t.marked)),
    "relationship_effects": lambda t: rounded(models.relationship_effects(t.marked, BLOCK_BOOTSTRAPS)),
    "group_effects": lambda t: rounded(models.group_effects(t.marked, BLOCK_BOOTSTRAPS)),
    "lagged_forecast": lambda t: rounded(models.lagged_forecast(t.marked, replicates=BLOCK_BOOTSTRAPS)),
    "descriptive_intervals": lambda t: rounded(stats.descriptive_intervals(t.layer, BLOCK_BOOTSTRAPS)),
    "imputed_group_tests": lambda t: rounded(stats.group_gates(_imputed(t), PERMUTATIONS)),
    "imputed_forecast": lambda t: rounded(models.ridge_forecast(_imputed(t))),
    "fitness_evidence": lambda t: governance.model_evidence(models.ridge_forecast(t.marked), provenance.diagnostics(t.layer, governance.PROVENANCE_PROTOCOL[0][1])),
    "imputed_gates": lambda t: rounded(stats.hypothesis_gates(scenarios.imputed_layer(t.marked, scenarios.imputation_methods(t.marked)))),
    "fitness_decision": lambda t: governance.fitness(governance.evidence(t.layer, t.raw, quality.decisions(t.layer, t.log), stats.hypothesis_table(t.layer))),
}


def _query(build: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(Tables(spark, sf_dir))


QUERIES: dict[str, Query] = {"dashboard_city_zone": dashboard_city_zone} | {name: _query(build) for name, build in _OF_TABLES.items()} | {"slot_counts": _slots}
