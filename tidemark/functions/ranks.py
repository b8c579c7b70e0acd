"""Ranks, quantiles and neighbours without sorting a whole group in one task.

Rows are cut into ranges of like size by a sample of them, across all groups
together, so a group is cut into as many ranges as its share of the rows asks
for.  Only ranges are sorted; a row per group and range says what comes before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .saved import saved


def dealt(df: DataFrame, *order: str) -> DataFrame:
    """df in ranges of the order, numbered by `__range` upwards.  Spark's range
    partitioner samples the rows for the edges; rows equal in the order share a
    range.  The table is written, since another run could sample other edges."""
    return saved(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys, of which null equals null."""
    renamed = right.select(*(F.col(c).alias(f"__k_{c}") if c in keys else F.col(c) for c in right.columns))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return left.join(renamed, same, how).drop(*(f"__k_{k}" for k in keys))


def _key(*columns: str) -> Column:
    """The columns as one value that is never null and of which nulls are equal:
    windows and joins on it share an exchange, as those on nulls don't."""
    return F.struct(*columns) if columns else F.struct(F.lit(0).alias("one"))


def cumulative(counts: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    """counts (keys, value, n), one row per value, with `upto`, the sum of n up
    to the value, and `total`, that of the key."""
    cut = dealt(counts, *keys, value).withColumn("__key", _key(*keys))
    sums = cut.groupBy("__key", "__range").agg(F.sum(n).alias("__sum"))
    every = Window.partitionBy("__key")
    before = every.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each key and range
    starts = sums.select("__key", "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"), F.sum("__sum").over(every).alias("total"))
    within = Window.partitionBy("__key", "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.withColumn("__within", F.sum(n).over(within)).join(starts, ["__key", "__range"])
    return placed.withColumn("upto", F.col("__start") + F.col("__within")).drop("__key", "__range", "__within", "__start")


def quantiles(counts: DataFrame, keys: list[str], value: str, fractions: list[float], n: str = "n", name: str = "q") -> DataFrame:
    """(keys, q): exact quantiles of every key as an array, linear between two
    values, from counts (keys, value, n) with one row per value.  Nulls must be
    left out before."""
    run = cumulative(counts, keys, value, n)
    start, end = F.col("upto") - F.col(n), F.col("upto")
    places = [F.lit(float(f)) * (F.col("total") - 1) for f in fractions]
    holds = lambda place: (start <= place) & (place < end)
    wanted = F.lit(False)
    for place in places:
        wanted = wanted | holds(F.floor(place)) | holds(F.ceil(place))
    ends = []
    for k, place in enumerate(places):
        ends += [F.max(F.when(holds(F.floor(place)), F.col(value).cast("double"))).alias(f"__low{k}"), F.max(F.when(holds(F.ceil(place)), F.col(value).cast("double"))).alias(f"__high{k}"), F.max(place - F.floor(place)).alias(f"__part{k}")]
    # a few rows of each key are left
    one = run.filter(wanted).groupBy(*keys).agg(*ends)
    made = [F.when(F.col(f"__part{k}") == 0, F.col(f"__low{k}")).otherwise((1 - F.col(f"__part{k}")) * F.col(f"__low{k}") + F.col(f"__part{k}") * F.col(f"__high{k}")) for k in range(len(fractions))]
    return one.select(*keys, F.array(*made).alias(name))


def positions(df: DataFrame, keys: list[str], coarse: Column, order: list, name: str) -> DataFrame:
    """Adds a gapless rank from 1 within keys, ordered by (coarse, order).

    Rows are counted per (keys, coarse) first; the counts give where each part
    begins, and only parts are sorted.  coarse must be monotone in the order
    wanted and have bounded parts.
    """
    cut = df.withColumn("__coarse", coarse)
    counts = cut.groupBy(*keys, "__coarse").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*keys).orderBy("__coarse").rowsBetween(Window.unboundedPreceding, 0)
    starts = counts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__coarse").alias("__c"), (F.sum("__n").over(upto) - F.col("__n")).alias("__start"))
    same = F.col("__coarse").eqNullSafe(F.col("__c"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    within = Window.partitionBy(*keys, "__coarse").orderBy(*order)
    return cut.withColumn("__row", F.row_number().over(within)).join(starts, same).withColumn(name, F.col("__start") + F.col("__row")).drop("__coarse", "__row", "__start", "__c", *[f"__k_{k}" for k in keys])


#: Rows that the replicates of one job are dealt out as, about.
BLOCK_ROWS = 20_000_000


def replicate_blocks(rows: int, replicates: int) -> list[tuple[int, int]]:
    """Replicates 1 to `replicates` as (first, last) of jobs in turn, so that
    disk is bounded by one job's rows whatever their number."""
    step = max(1, BLOCK_ROWS // max(rows, 1))
    return [(k, min(k + step - 1, replicates)) for k in range(1, replicates + 1, step)]


def in_blocks(blocks: list[tuple[int, int]], make: Callable[[int, int], DataFrame]) -> DataFrame:
    """The union of make(first, last), whose rows are few per replicate.  A
    single block stays lazy; of several each is a job whose rows are written."""
    made = [make(*block) if len(blocks) == 1 else saved(make(*block)) for block in blocks]
    out = made[0]
    for part in made[1:]:
        out = out.unionByName(part)
    return out


def average_ranks(counts: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    """Average ranks of distinct values with their counts: ties share a rank.
    Works on (keys, value, n), so its size is that of the distinct values."""
    return cumulative(counts, keys, value, n).withColumn("rank", F.col("upto") - F.col(n) + (F.col(n) + 1) / 2.0).drop("upto", "total")


def neighbours(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Adds prev and next, structs of `values` of the rows before and after in
    the order within key, null at the ends.

    Only ranges are sorted; the ends of a range look across by the first and
    last rows of the key's ranges beside it, whatever ranges lie between, a row
    for each key and range.  The order must tell rows apart.
    """
    cut = dealt(df.withColumn("__value", F.struct(*values)), key, *order).withColumn("__key", _key(key))
    place = F.struct(*order)
    w = Window.partitionBy("__key", "__range").orderBy(*order)
    near = cut.withColumn("prev", F.lag("__value").over(w)).withColumn("next", F.lead("__value").over(w))
    ends = cut.groupBy("__key", "__range").agg(F.min_by("__value", place).alias("first"), F.max_by("__value", place).alias("last"))
    by_range = Window.partitionBy("__key").orderBy("__range")
    ends = ends.select("__key", "__range", F.lag("last").over(by_range).alias("__before"), F.lead("first").over(by_range).alias("__after"))
    joined = near.join(ends, ["__key", "__range"])
    return joined.withColumn("prev", F.coalesce("prev", "__before")).withColumn("next", F.coalesce("next", "__after")).drop("__key", "__range", "__value", "__before", "__after")
