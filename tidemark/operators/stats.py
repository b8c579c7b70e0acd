"""Descriptive and inferential statistics over the canonical layer.

Everything reduces to sums per group or to counts of distinct values; no
operator sorts a whole column in one task.  Replicates of resampling tests draw
from MD5 of (seed, replicate, id), so results don't depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import correlation, correlation_p, fisher_bounds, masked, uniform32
from ..functions.ranks import average_ranks, in_blocks, matched, quantiles, replicate_blocks
from ..functions.saved import saved
from ..schema import ALPHA, ETA_GATE, FACTORS, METRICS, PAIRS, RHO_GATE, UNKNOWN, Z99

_ONE = 1 << 32
#: Hexadecimal digits of a prefix by which permuted values are counted.
PREFIX = 3


def long_values(layer: DataFrame, ids: list[str], probable: bool = False, metrics: list[str] = METRICS) -> DataFrame:
    """(ids, metric, value) of all valid values."""
    mark = F.col("probable_error") if probable else None
    each = F.array(*(F.struct(F.lit(m).alias("metric"), masked(m, mark).alias("value")) for m in metrics))
    return layer.select(*ids, F.explode(each).alias("x")).select(*ids, "x.metric", "x.value").filter("value IS NOT NULL")


def summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean, sd, extremes and quartiles (linear) of (keys, value), from the
    counts of distinct values; deviations are taken from the mean."""
    counts = saved(rows.groupBy(*keys, "value").agg(F.count("*").alias("k")))
    v, k = F.col("value"), F.col("k")
    one = saved(counts.groupBy(*keys).agg(F.sum("k").alias("n"), (F.sum(k * v) / F.sum(k)).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most")))
    # a row for each group, next to the counts of its values
    spread = matched(counts, one.select(*keys, "n", "mean"), keys).groupBy(*keys).agg(F.sqrt(F.try_divide(F.sum(k * (v - F.col("mean")) * (v - F.col("mean"))), F.max("n") - 1)).alias("sd"))
    q = quantiles(counts, keys, "value", [0.25, 0.5, 0.75], "k")
    out = matched(matched(one, spread, keys), q, keys)
    return out.select(*keys, "n", "mean", "sd", "least", "most", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def metric_summary(layer: DataFrame) -> DataFrame:
    """n, mean, sd, extremes and quartiles (linear) of each metric."""
    return summary(long_values(layer, []), ["metric"])


def dimension_values(layer: DataFrame) -> DataFrame:
    """(dimension, member, metric, value) over six dimensions: overall, city,
    zone, month, hour, weekday."""
    view = layer.withColumn("zone", F.coalesce("zone", F.lit(UNKNOWN))).withColumn("hour_label", F.format_string("%02d:00", F.col("hour")))
    dims = F.array(
        F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("member")), F.struct(F.lit("city").alias("dimension"), F.col("city").alias("member")), F.struct(F.lit("zone").alias("dimension"), F.col("zone").alias("member")),
        F.struct(F.lit("month").alias("dimension"), F.col("month").cast("string").alias("member")), F.struct(F.lit("hour").alias("dimension"), F.col("hour_label").alias("member")), F.struct(F.lit("weekday").alias("dimension"), F.col("weekday").cast("string").alias("member")),
    )
    rows = long_values(view, ["city", "zone", "month", "hour_label", "weekday"])
    return rows.select("metric", "value", F.explode(dims).alias("d")).select("d.dimension", "d.member", "metric", "value")


def descriptive_summary(layer: DataFrame) -> DataFrame:
    """The summary of every member of the six dimensions."""
    return summary(dimension_values(layer), ["dimension", "member", "metric"])


def descriptive_intervals(layer: DataFrame, replicates: int = 3000, seed: int = 0) -> DataFrame:
    """Means of every member of the six dimensions with their bootstrap intervals."""
    from .resample import bootstrap_means

    return bootstrap_means(dimension_values(layer), ["dimension", "member", "metric"], replicates, seed)


def group_extremes(summary: DataFrame) -> DataFrame:
    """Groups with the highest and lowest mean of each metric and dimension."""
    return summary.filter("dimension <> 'overall'").groupBy("dimension", "metric").agg(
        F.min(F.struct((-F.col("mean")).alias("x"), "member"))["member"].alias("highest_group"), F.max("mean").alias("highest"),
        F.min(F.struct("mean", "member"))["member"].alias("lowest_group"), F.min("mean").alias("lowest"), (F.max("mean") - F.min("mean")).alias("spread"),
    )


def gram(values: DataFrame, keys: list[str] = [], metrics: list[str] = METRICS) -> DataFrame:
    """(keys, x, y, n, sx, sy, sxx, syy, sxy) of every pair of metrics over the
    rows where both are there: tasks multiply matrices of values and of their
    presence, and their products are added up.  Values are doubles, or null."""
    kinds = [f"`{k}` {values.schema[k].dataType.simpleString()}" for k in keys]
    pairs = [(i, j) for i in range(len(metrics)) for j in range(i + 1, len(metrics))]
    first, second = (np.array([p[k] for p in pairs]) for k in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            v = np.stack([batch.column(len(keys) + k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in range(len(metrics))])
            have = ~np.isnan(v)
            v, members = np.where(have, v, 0.0), list(zip(*(batch.column(k).to_pylist() for k in range(len(keys))))) or [()] * batch.num_rows
            for member in dict.fromkeys(members):
                own = np.array([m == member for m in members]) if keys else slice(None)
                x, there = v[:, own], have[:, own].astype(float)
                n, s, q, c = there @ there.T, x @ there.T, (x * x) @ there.T, x @ x.T
                made = np.stack([n[first, second], s[first, second], s[second, first], q[first, second], q[second, first], c[first, second]])
                total[member] = total[member] + made if member in total else made
        for member, made in total.items():
            columns = [pa.array([part] * len(pairs), values_schema[k]) for k, part in enumerate(member)] + [pa.array([metrics[i] for i in first]), pa.array([metrics[j] for j in second]), pa.array(made[0].astype(np.int64)), *(pa.array(row) for row in made[1:])]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "x", "y", "n", "sx", "sy", "sxx", "syy", "sxy"])

    from pyspark.sql.pandas.types import to_arrow_type

    values_schema = [to_arrow_type(values.schema[k].dataType) for k in keys]
    parts = values.select(*keys, *metrics).mapInArrow(run, ", ".join([*kinds, "x string, y string, n bigint", *(f"{c} double" for c in ("sx", "sy", "sxx", "syy", "sxy"))]))
    return parts.groupBy(*keys, "x", "y").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))


def gram_correlation() -> Column:
    """Pearson r of a row of `gram`; null below four rows."""
    n = F.col("n")
    spread = lambda a, b, ab: F.col(ab) / n - F.col(a) / n * (F.col(b) / n)
    # what rounding leaves of no variance is none
    flat = lambda a, aa: F.when(spread(a, a, aa) > 1e-13 * F.col(aa) / n, spread(a, a, aa)).otherwise(F.lit(0.0))
    return F.when(n >= 4, correlation(spread("sx", "sy", "sxy"), flat("sx", "sxx"), flat("sy", "syy")))


def pearson_pairs(layer: DataFrame, probable: bool = False, pairs: list[tuple[str, str]] = PAIRS, keys: list[str] = []) -> DataFrame:
    """(x, y, n, r) of pairs of metrics over rows where both are valid: one
    aggregation of one scan."""
    mark = F.col("probable_error") if probable else None
    found = gram(layer.select(*keys, *(masked(m, mark).alias(m) for m in METRICS)), keys).select(*keys, "x", "y", "n", gram_correlation().alias("r"))
    # pairs are named as asked, whatever the order of the metrics
    named = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.array_sort(F.array(F.lit(x), F.lit(y))).alias("both")) for x, y in pairs))
    wanted = F.filter(named, lambda p: p["both"] == F.array_sort(F.array("x", "y")))
    return found.withColumn("p", F.explode(wanted)).select(*keys, "p.x", "p.y", "n", "r")


def _pair_values(layer: DataFrame, pairs: list[tuple[str, str]], probable: bool) -> DataFrame:
    mark = F.col("probable_error") if probable else None
    each = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), masked(x, mark).alias("a"), masked(y, mark).alias("b")) for x, y in pairs))
    return layer.select(F.explode(each).alias("p")).select("p.*").filter("a IS NOT NULL AND b IS NOT NULL").groupBy("x", "y", "a", "b").agg(F.count("*").alias("n"))


def _weighted_r(joint: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation of ra and rb with weights n.  Average ranks of k values mean
    (k + 1) / 2, so they are centred without a pass of their own."""
    total = joint.groupBy(*keys).agg(F.sum("n").alias("k"))
    a, b, n = F.col("ra") - (F.col("k") + 1) / 2.0, F.col("rb") - (F.col("k") + 1) / 2.0, F.col("n")
    sums = joint.join(total, keys).groupBy(*keys).agg(F.max("k").alias("k"), F.sum(n * a * b).alias("c"), F.sum(n * a * a).alias("va"), F.sum(n * b * b).alias("vb"))
    return sums.select(*keys, F.col("k").alias("n"), F.when(F.col("k") >= 4, correlation(F.col("c"), F.col("va"), F.col("vb"))).alias("r"))


def spearman_pairs(layer: DataFrame, probable: bool = False, pairs: list[tuple[str, str]] = PAIRS) -> DataFrame:
    """(x, y, n, r): rank correlation, ranked anew within each pair's rows."""
    joint = saved(_pair_values(layer, pairs, probable))
    sides = F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("value")), F.struct(F.lit("b").alias("side"), F.col("b").alias("value"))))
    counts = joint.select("x", "y", "n", sides.alias("s")).groupBy("x", "y", "s.side", "s.value").agg(F.sum("n").alias("n"))
    ranks = average_ranks(counts, ["x", "y", "side"], "value")
    for side in ("a", "b"):
        own = ranks.filter(F.col("side") == side).select("x", "y", F.col("value").alias(side), F.col("rank").alias(f"r{side}"))
        joint = joint.join(own, ["x", "y", side])
    return _weighted_r(joint, ["x", "y"])


def field_rank_pairs(layer: DataFrame, probable: bool = False) -> DataFrame:
    """(x, y, n, r): ranks of each metric over all its values, then correlated
    over the pair's rows."""
    joint = saved(_pair_values(layer, PAIRS, probable))
    ranks = average_ranks(long_values(layer, [], probable).groupBy("metric", "value").agg(F.count("*").alias("n")), ["metric"], "value").select("metric", "value", "rank")
    rx = ranks.select(F.col("metric").alias("x"), F.col("value").alias("a"), F.col("rank").alias("ra"))
    ry = ranks.select(F.col("metric").alias("y"), F.col("value").alias("b"), F.col("rank").alias("rb"))
    joint = joint.join(rx, ["x", "a"]).join(ry, ["y", "b"])
    means = joint.groupBy("x", "y").agg(F.sum("n").alias("k"), F.sum(F.col("n") * F.col("ra")).alias("sa"), F.sum(F.col("n") * F.col("rb")).alias("sb"))
    a, b, n = F.col("ra") - F.col("sa") / F.col("k"), F.col("rb") - F.col("sb") / F.col("k"), F.col("n")
    sums = joint.join(means, ["x", "y"]).groupBy("x", "y").agg(F.max("k").alias("k"), F.sum(n * a * b).alias("c"), F.sum(n * a * a).alias("va"), F.sum(n * b * b).alias("vb"))
    return sums.select("x", "y", F.col("k").alias("n"), correlation(F.col("c"), F.col("va"), F.col("vb")).alias("r"))


def with_inference(pairs: DataFrame) -> DataFrame:
    """Adds the 99 per cent interval and p value of each correlation."""
    low, high = fisher_bounds(F.col("r"), F.col("n"), Z99)
    return pairs.withColumn("ci_low", low).withColumn("ci_high", high).withColumn("p", correlation_p(F.col("r"), F.col("n")))


def holm(tests: DataFrame, family: list[str], order: list[str], p: str = "p") -> DataFrame:
    """Adds p_holm: step-down adjustment within each family; ties in p keep the
    order given.  A family is a table of tests, so its windows are small."""
    w = Window.partitionBy(*family).orderBy(p, *order)
    step = F.least(F.lit(1.0), (F.count("*").over(Window.partitionBy(*family)) - F.row_number().over(w) + 1) * F.col(p))
    return tests.withColumn("__step", step).withColumn("p_holm", F.max("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def group_sums(layer: DataFrame, factors: list[str] = FACTORS, probable: bool = False, metrics: list[str] = METRICS) -> DataFrame:
    """(factor, level, metric, n, s, ss): all that group effects need, from one
    pass.  Rows without a level are left out of that factor."""
    each = F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors))
    rows = long_values(layer, factors, probable, metrics).select("metric", "value", F.explode(each).alias("g")).filter("g.level IS NOT NULL")
    return rows.groupBy("g.factor", "g.level", "metric").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))


def eta_squared(sums: DataFrame) -> DataFrame:
    """(factor, metric, n, groups, eta2); 0 where nothing varies."""
    one = sums.groupBy("factor", "metric").agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    centre = F.col("s") * F.col("s") / F.col("n")
    return one.select("factor", "metric", "n", "groups", F.when(F.col("ss") - centre <= 0, F.lit(0.0)).otherwise((F.col("b") - centre) / (F.col("ss") - centre)).alias("eta2"))


def permutation_eta(layer: DataFrame, factor: str, replicates: int, seed: int = 0, probable: bool = False, metrics: list[str] = METRICS) -> DataFrame:
    """(metric, eta2, p): labels dealt anew to the values in the order of MD5.

    Labels in sorted order are laid along each replicate's random order of the
    values, so only ranks and the labels' counts are needed, never a shuffle of
    labels.  Values are counted and summed per MD5 prefix; a prefix that one
    label covers gives its sum, and only the rows of those where a label ends,
    fewer than labels, are ranked.  Many replicates are dealt in blocks, a job
    each.
    """
    rows = long_values(layer.filter(F.col(factor).isNotNull()), ["record_id", factor], probable, metrics).withColumn("level", F.col(factor).cast("string"))
    sums = rows.groupBy("metric", "level").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    upto = F.sum("n").over(Window.partitionBy("metric").orderBy("level").rowsBetween(Window.unboundedPreceding, 0))
    spans = sums.select("metric", F.col("level").alias("dealt"), (upto - F.col("n")).alias("lo"), upto.alias("hi"), F.col("n").alias("k"))
    spans = spans.groupBy("metric").agg(F.sort_array(F.collect_list(F.struct("hi", "dealt", "k"))).alias("spans"))  # a few levels
    spans = F.broadcast(saved(spans))
    at = lambda place: F.filter("spans", lambda s: s["hi"] >= place)[0]

    def drawn(first: int, last: int) -> DataFrame:
        each = rows.select("metric", "value", "record_id", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("rep"))
        each = each.withColumn("md5", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), "metric", "record_id"))).withColumn("prefix", F.substring("md5", 1, PREFIX))
        keys = ["metric", "rep", "prefix"]
        parts = each.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("value").alias("s"))
        upto = F.sum("n").over(Window.partitionBy("metric", "rep").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0))
        parts = parts.withColumn("start", upto - F.col("n")).join(spans, "metric").withColumn("hit", at(F.col("start") + 1)).withColumn("whole", F.col("hit") == at(F.col("start") + F.col("n")))
        parts = saved(parts.select(*keys, "s", "start", "hit", "whole"))
        # where a label ends: for each metric and replicate fewer than labels
        cut = F.broadcast(parts.filter("NOT whole").select(*keys, "start"))
        place = F.col("start") + F.row_number().over(Window.partitionBy(*keys).orderBy("md5", "record_id"))
        ranked = each.join(cut, keys).withColumn("pos", place).join(spans, "metric").select("metric", "rep", at(F.col("pos")).alias("hit"), F.col("value").alias("s"))
        dealt = parts.filter("whole").select("metric", "rep", "hit", "s").unionByName(ranked)
        groups = dealt.groupBy("metric", "rep", "hit.dealt").agg(F.sum("s").alias("s"), F.max("hit.k").alias("k"))
        return groups.groupBy("metric", "rep").agg(F.sum(F.col("s") * F.col("s") / F.col("k")).alias("b"))

    between = in_blocks(replicate_blocks(rows.count(), replicates), drawn)
    total = sums.groupBy("metric").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b0"))
    centre = F.col("s") * F.col("s") / F.col("n")
    eta = lambda b: F.when(F.col("ss") - centre <= 0, F.lit(0.0)).otherwise((b - centre) / (F.col("ss") - centre))
    both = between.join(total, "metric").withColumn("eta2", eta(F.col("b0"))).withColumn("drawn", eta(F.col("b")))
    return both.groupBy("metric").agg(F.max("eta2").alias("eta2"), ((F.count_if(F.col("drawn") >= F.col("eta2") - 1e-15) + 1) / F.lit(replicates + 1.0)).alias("p"))


def poisson_weight(u: Column) -> Column:
    """A Poisson(1) count from a 32-bit uniform."""
    total, term, bounds = 0.0, 0.36787944117144233, []
    for k in range(12):
        total += term
        bounds.append(int(total * _ONE))
        term /= k + 1
    return sum((F.when(u >= F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0))


def bootstrap_mean(values: DataFrame, keys: list[str], replicates: int, seed: int = 0, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """(keys, n, mean, ci_low, ci_high) of (keys, record_id, value).

    Each row gets a Poisson(1) weight in each replicate, which is resampling
    without knowing n: one pass, sums per replicate, no join.
    """
    each = values.select(*keys, "value", "record_id", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    w = poisson_weight(uniform32(seed, F.col("rep"), *[F.col(k) for k in keys], F.col("record_id")))
    means = each.withColumn("w", w).groupBy(*keys, "rep").agg(F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w")).alias("m"))
    ends = means.groupBy(*keys).agg(F.percentile("m", F.array(F.lit(low), F.lit(high))).alias("q"))
    point = values.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return point.join(ends, keys).select(*keys, "n", "mean", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def entropy_and_unique(layer: DataFrame) -> DataFrame:
    """Entropy in bits and rate of distinct values of each metric."""
    counts = long_values(layer, []).groupBy("metric", "value").agg(F.count("*").alias("c"))
    total = counts.groupBy("metric").agg(F.sum("c").alias("n"), F.count("*").alias("k"))
    p = F.col("c") / F.col("n")
    return counts.join(total, "metric").groupBy("metric").agg(F.sum(-p * F.log2(p)).alias("entropy_bits"), (F.max("k") / F.max("n")).alias("unique_rate"))


#: Hypotheses (id, x, y, expected sign).
GATED = [("H1", "traffic_volume", "avg_speed_kmph", -1), ("H2", "road_incidents", "waterlogging_reports", 1), ("H3", "temperature_c", "power_outage_minutes", 1)]
HYPOTHESES = [
    ("H1", "traffic_volume", "avg_speed_kmph", -1), ("H2", "traffic_volume", "road_incidents", 1), ("H3", "waterlogging_reports", "avg_speed_kmph", -1), ("H4", "waterlogging_reports", "road_incidents", 1),
    ("H5", "temperature_c", "power_outage_minutes", 1), ("H6", "temperature_c", "citizen_complaints", 1), ("H7", "power_outage_minutes", "citizen_complaints", 1), ("H8", "road_incidents", "avg_speed_kmph", -1),
]


def _tests(layer: DataFrame, specs: list, probable: bool) -> DataFrame:
    pairs = [(x, y) for _, x, y, _ in specs]
    spec = layer.sparkSession.createDataFrame(specs, "hypothesis string, x string, y string, expected int")
    s = with_inference(spearman_pairs(layer, probable, pairs)).withColumnRenamed("r", "rho")
    p = pearson_pairs(layer, probable, pairs).select("x", "y", F.col("r").alias("pearson"))
    return spec.join(s, ["x", "y"]).join(p, ["x", "y"])


def hypothesis_gates(layer: DataFrame) -> DataFrame:
    """H1 to H3: practical and significant.  layer has probable_error."""
    tests = holm(_tests(layer, GATED, True).withColumn("family", F.lit("relationship")), ["family"], ["hypothesis"])
    practical = (F.abs("rho") >= RHO_GATE) & (F.signum("rho") == F.col("expected"))
    significant = F.col("p_holm") < ALPHA
    return tests.select("hypothesis", "x", "y", "n", "rho", "ci_low", "ci_high", "p", "p_holm", practical.alias("practical"), significant.alias("significant"), (practical & significant).alias("supported"))


def hypothesis_table(layer: DataFrame) -> DataFrame:
    """The eight pairs by both methods; one family."""
    tests = holm(_tests(layer, HYPOTHESES, False).withColumn("family", F.lit("eight")), ["family"], ["hypothesis"])
    return tests.select("hypothesis", "x", "y", "n", "pearson", "rho", "ci_low", "ci_high", "p", "p_holm", (F.col("p_holm") < ALPHA).alias("significant"))


def group_gates(layer: DataFrame, replicates: int = 5000, seed: int = 0) -> DataFrame:
    """City and zone effects with permutation p, Holm within each factor, and
    both gates.  layer has probable_error; unknown zones are left out."""
    from .resample import permutation_tests

    tests = holm(permutation_tests(layer, ["city", "zone"], replicates, seed, True), ["factor"], ["metric"])
    return tests.select("factor", "metric", "eta2", "p", "p_holm", ((F.col("eta2") >= ETA_GATE) & (F.col("p_holm") < ALPHA)).alias("supported"))


def group_tests(layer: DataFrame, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """All five factors by all nine metrics: eta squared, permutation p, Holm
    over the family of 45 and over the nine of each factor, and the gate."""
    from .resample import permutation_tests

    tests = permutation_tests(layer, FACTORS, replicates, seed).withColumn("family", F.lit("all"))
    both = holm(holm(tests, ["factor"], ["metric"]).withColumnRenamed("p_holm", "p_holm_factor"), ["family"], ["factor", "metric"])
    return both.select("factor", "metric", "n", "groups", "eta2", "p", "p_holm_factor", "p_holm", (F.col("p_holm") < ALPHA).alias("significant"))


def top_effects(effects: DataFrame, k: int = 12) -> DataFrame:
    return effects.orderBy(F.desc("eta2"), "factor", "metric").limit(k)


def pairwise_differences(layer: DataFrame, factor: str, gate: float = 0.50) -> DataFrame:
    """Standardised differences of the means of two groups, every pair of levels
    of a factor: from the group sums, a row per level."""
    sums = group_sums(layer, [factor])
    a = sums.select("metric", F.col("level").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"), F.col("ss").alias("qa"))
    b = sums.select("metric", F.col("level").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"), F.col("ss").alias("qb"))
    both = a.join(b, "metric").filter("a < b AND na > 1 AND nb > 1")
    pooled = (F.col("qa") - F.col("sa") * F.col("sa") / F.col("na") + F.col("qb") - F.col("sb") * F.col("sb") / F.col("nb")) / (F.col("na") + F.col("nb") - 2)
    gap = F.col("sa") / F.col("na") - F.col("sb") / F.col("nb")
    d = F.when(pooled > 0, gap / F.sqrt(pooled)).otherwise(F.lit(0.0))
    return both.select("metric", "a", "b", d.alias("difference"), (F.abs(d) >= gate).alias("material"))
