"""Joins on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than 1 / HEAVY of all rows is dealt into parts, so at most
#: HEAVY keys are: that is the bound of what is broadcast.
HEAVY = 1024


def heavy(sizes: DataFrame, key: str, n: str, heaviest: int = HEAVY) -> DataFrame:
    """(key, __parts) of the keys with more than 1 / heaviest of all rows, from
    (key, n) with one row per key."""
    share = F.greatest(F.floor(sizes.agg(F.sum(n)).scalar() / heaviest), F.lit(1))
    counted = sizes.select(F.col(key).alias("__heavy"), F.col(n).alias("__n"), share.alias("__share"))
    return F.broadcast(counted.filter("__n > __share").select("__heavy", F.ceil(F.col("__n") / F.col("__share")).cast("int").alias("__parts")))


def spread_join(rows: DataFrame, small: DataFrame, key: str, salt: Column, large: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with small on key, where small has one row per key and rows
    any number.  Keys in `large` (from `heavy`) are dealt into parts by salt, a
    column of rows, and small's row goes to each part."""
    parts = F.coalesce("__parts", F.lit(1))
    left = rows.join(large, F.col(key) == F.col("__heavy"), "left").withColumn("__part", F.pmod(F.xxhash64(salt), parts).cast("int")).drop("__heavy", "__parts")
    right = small.join(large, F.col(key) == F.col("__heavy"), "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__heavy", "__parts")
    # the parts must not be undone by a broadcast at one size and not at another
    return left.join(right.hint("merge"), [key, "__part"], how).drop("__part")
