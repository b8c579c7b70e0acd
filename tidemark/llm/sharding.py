"""Operator 3: sharding by balanced label propagation.

Documents with equal texts are linked.  Linked documents start on shards dealt
by hash and then move, round by round, towards the shard where most of their
neighbours are, as far as that shard's quota allows.  Documents of one group
that began in the same cell of a shard are interchangeable, so the rounds join
and move cells (group, cell) with a count instead of single documents: a group
of any size is at most CELLS rows per shard.  Documents without links have no
preference; they fill the shards up to their quotas at the end, which makes the
law exact: the shards' row counts are at most one apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .saved import saved

SHARDS = 40
ROUNDS = 12
#: A group's documents of one first shard are up to so many cells.
CELLS = 16
#: Parts of the moves towards a shard; a part is accepted or waits whole.
PARTS = 64
#: Rows of one sort task of the final slots, about.
BUCKET_ROWS = 20_000
#: Buckets at least, so that small inputs spread as well.
LEAST_BUCKETS = 256


def _loads(cells: DataFrame, shards: int) -> list[int]:
    """Linked documents on every shard: `shards` numbers come to the driver."""
    load = [0] * shards
    for row in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        load[row["shard"]] = row["n"]
    return load


def _lookup(values: list[int], index: str) -> Column:
    return F.element_at(F.array(*(F.lit(int(v)) for v in values)), (F.col(index) + 1).cast("int")).cast("bigint")


def propagate(cells: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Cells (grp, first, n, shard) after label propagation.

    In a round each group ranks its shards by how many of its documents they
    hold and keeps the first ones that, with their room, can hold it all: one
    for nearly every group.  Its cells elsewhere ask for one of those.
    Requests for a shard are taken in order of size while their counts fit its
    room and, but for the last rounds, what asks to leave it.  The last rounds
    take no more than the room, so shards end at or near their quotas; what is
    over then goes to the gaps when slots are given out.
    """
    shards = len(quotas)
    for step in range(rounds):
        strict = step >= rounds - 3
        load = _loads(cells, shards)
        room = [max(0, q - n) for q, n in zip(quotas, load)]
        if not strict:
            room = [max(r, q // 8 + 1) for r, q in zip(room, quotas)]
        held = cells.groupBy("grp", "shard").agg(F.sum("n").alias("here")).withColumn("room", _lookup(room, "shard"))
        order = Window.partitionBy("grp").orderBy(F.desc("here"), F.xxhash64("grp", "shard"), "shard")  # at most one row per shard
        before = F.coalesce(F.sum(F.col("here") + F.col("room")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        first = held.withColumn("before", before).withColumn("all", F.sum("here").over(Window.partitionBy("grp"))).filter("before < all")
        wanted = first.groupBy("grp").agg(F.collect_set("shard").alias("kept"), F.sort_array(F.collect_set(F.when(F.col("room") > 0, F.col("shard")))).alias("open"))
        pick = F.pmod(F.xxhash64(F.lit(step), "grp", "first"), F.size("open")) + 1
        asks = (
            cells.join(wanted, "grp")
            .filter(~F.array_contains("kept", F.col("shard")) & (F.size("open") > 0))
            .select("grp", "first", "n", "shard", F.element_at("open", pick.cast("int")).alias("to"), F.pmod(F.xxhash64(F.lit(step), "grp", "first"), F.lit(PARTS)).alias("part"))
        )
        asks = saved(asks)
        leaving = [0] * shards if strict else _loads(asks, shards)
        room = [max(0, q - n + m) for q, n, m in zip(quotas, load, leaving)]
        # a table of at most shards * PARTS rows
        parts = asks.groupBy("to", "part").agg(F.sum("n").alias("n"))
        before = F.sum("n").over(Window.partitionBy("to").orderBy("n", "part").rowsBetween(Window.unboundedPreceding, 0))
        taken = parts.withColumn("upto", before).filter(F.col("upto") <= _lookup(room, "to")).select("to", "part")
        moves = asks.join(F.broadcast(taken), ["to", "part"]).select("grp", "first", "to")
        cells = saved(cells.join(moves, ["grp", "first"], "left").select("grp", "first", "n", F.coalesce("to", "shard").alias("shard"), F.col("to").isNotNull().alias("moved")))
        if cells.filter("moved").limit(1).count() == 0:
            break
        cells = cells.drop("moved")
    return cells.select("grp", "first", "n", "shard")


def ranks(df: DataFrame, key: str, rows: int, tie: list[str]) -> DataFrame:
    """Adds `rank`, gapless from 0 within each key: keys are cut into hash
    buckets of about BUCKET_ROWS, whose counts give where each begins."""
    buckets = max(LEAST_BUCKETS, rows // BUCKET_ROWS)
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(3), *tie), F.lit(buckets)))
    counts = dealt.groupBy(key, "__bucket").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    starts = counts.select(key, "__bucket", (F.sum("n").over(upto) - F.col("n")).alias("__start"))
    within = Window.partitionBy(key, "__bucket").orderBy(*tie)
    return dealt.join(starts, [key, "__bucket"]).withColumn("rank", F.col("__start") + F.row_number().over(within) - 1).drop("__bucket", "__start")


def cut_edges(placed: DataFrame, key: str) -> DataFrame:
    """One row: groups of two or more, edges and cut.  A group of n is linked as
    a star of n - 1 edges, of which those to other shards than its fullest are
    cut; rows with a null key have no links."""
    held = placed.filter(F.col(key).isNotNull()).groupBy(key, "shard").agg(F.count("*").alias("n"))
    groups = held.groupBy(key).agg(F.sum("n").alias("n"), F.max("n").alias("most")).filter("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("edges"), F.coalesce(F.sum(F.col("n") - F.col("most")), F.lit(0)).alias("cut"))


def shard_documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Per row: id_column, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes (null: none) and 16; the law is `rows`.
    Equal texts are linked; null texts have no links.  A group that no shard
    can hold is spread over as many as it needs.  Rows that repeat are rows of
    their own, and of ties any takes the lower slot.  Slots are gapless from 0
    within each shard.  Empty in, empty out; with fewer rows than shards some
    shards stay empty.  Other columns of df are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    # rows that repeat are told apart by their numbers, which are written here
    number = F.monotonically_increasing_id()
    first = F.pmod(F.xxhash64(F.lit(1), id_column, number), F.lit(shards * CELLS)).cast("int")
    rows = df.select(
        id_column,
        number.alias("number"),
        (F.octet_length(text) + F.lit(16)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.col(text_column).cast("binary")).alias("grp"),
        first.alias("first"),
    )
    rows = saved(rows)
    total = rows.count()
    quotas = [total // shards + (k < total % shards) for k in range(shards)]
    cells = rows.filter("grp IS NOT NULL").groupBy("grp", "first").agg(F.count("*").alias("n"))
    members = F.sum("n").over(Window.partitionBy("grp"))  # at most shards * CELLS rows
    linked = saved(cells.withColumn("__all", members).filter("__all > 1").select("grp", "first", "n", (F.col("first") % shards).alias("shard")))
    settled = propagate(linked, quotas, rounds)
    # -1: no links, so any shard will do
    placed = rows.join(settled.select("grp", "first", F.col("shard").alias("want")), ["grp", "first"], "left").withColumn("want", F.coalesce("want", F.lit(-1)))
    placed = ranks(placed, "want", total, [id_column, "text_crc32", "number"])
    load = _loads(settled, shards)
    # the chance start may overfill shards where nearly all rows are linked; what is over fills gaps as well
    over = [max(0, n - q) for n, q in zip(load, quotas)]
    free = total - sum(load)
    pool_start = [free + sum(over[:k]) for k in range(shards)]
    gaps = [q - min(n, q) for n, q in zip(load, quotas)]
    gap_start = [sum(gaps[:k]) for k in range(shards)]
    home = F.greatest("want", F.lit(0))  # only read where want is a shard
    placed = placed.withColumn("home", home).withColumn("stays", (F.col("want") >= 0) & (F.col("rank") < _lookup(quotas, "home")))
    spilled = _lookup(pool_start, "home") + F.col("rank") - _lookup(quotas, "home")
    placed = placed.withColumn("pool", F.when(F.col("want") < 0, F.col("rank")).otherwise(spilled))
    open_shards = [k for k, g in enumerate(gaps) if g] or [0]
    begun = sum((F.when(F.col("pool") >= F.lit(gap_start[k]), 1).otherwise(0) for k in open_shards), F.lit(0))
    placed = placed.withColumn("gap", F.greatest(begun - 1, F.lit(0)))
    shard = F.when(F.col("stays"), F.col("home")).otherwise(_lookup(open_shards, "gap")).cast("int")
    kept = [min(load[k], quotas[k]) - gap_start[k] for k in open_shards]
    slot = F.when(F.col("stays"), F.col("rank")).otherwise(_lookup(kept, "gap") + F.col("pool"))
    return placed.select(id_column, "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_sharding": op3_sharding}
ORACLE: dict[str, str] = {}
