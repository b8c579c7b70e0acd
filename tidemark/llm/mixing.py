"""Operator 6: mixing sources to target weights by systematic sampling.

A source's documents all have the same expected number of copies, its target
over its size.  They are laid in order of size; the prefix sum of expected
copies starts from one pseudo-random offset per source, and a document is
emitted once for each integer that the sum crosses within it.  Neighbours in
that order have like sizes, so the words taken stay near the target.

The prefix sum needs each document's rank within its source.  Ranks come from
counts per (source, size) and per (source, size, bucket), which are summed
before they travel, so a source of any size is spread over many tasks.  Buckets
are digests of ids; the rows of an id that has a large share of all rows, or of
none, are dealt by their numbers as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import worker
from .saved import saved
from .spread import heavy

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Buckets of the documents of one source and size, and of the rows of one id.
BUCKETS = 4096
PARTS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Adds target to a table of (source, source_size), one row per source.

    Sources in code-point order, null last, take the weights in turn and share
    the sum of all sizes.  No target exceeds `most` times its source's size;
    what is over goes to the others by weight.  The shares are a water level:
    sources are capped in the order of cap over weight for as long as the
    level, the rest over the weights left, is above that ratio.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    # one row per source: few enough for the windows without partitions below
    numbered = sources.withColumn("position", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", weight.cast("bigint"))
    ordered = Window.orderBy("ratio", "position")
    everything = Window.orderBy("ratio", "position").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = (
        numbered.withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("rest", F.sum("source_size").over(everything) - F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) + F.col("cap"))
        .withColumn("weights", F.sum("weight").over(everything) - F.sum("weight").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) + F.col("weight"))
        .withColumn("level", F.col("rest") / F.col("weights"))
    )
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "position", "level"))).over(everything)["level"]
    return capped.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))).select("source", "source_size", "target")


def with_copies(df: DataFrame, id_column: str = "doc_id", source_column: str = "source", size_column: str = "size", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The row of df as `__row`, with size, source_size, target and copies (how
    often the mix emits the row), so that no column of df can clash.

    df has the integer columns id_column and size_column, both may repeat and
    the id may be null; a null size counts as 0.  A source without words has
    target 0 and no copies.  Empty in, empty out.  The offset of a source is 16
    bits of the MD5 of its name and ties in size go by digest of the id, so
    reruns agree; rows that tie in source, size and id are ranked by their
    place in the files.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_column}`").cast("string")), F.lit(""))
    size = F.coalesce(F.col(f"`{size_column}`").cast("bigint"), F.lit(0).cast("bigint"))
    rows = worker.boxed(df, F.col(f"`{id_column}`").cast("bigint").alias("id"), key.alias("key"), size.alias("size"))
    # written once: texts are read and counted once, and numbers must not change
    rows = saved(rows.withColumn("number", F.monotonically_increasing_id()))
    bucket = F.coalesce(F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 3), 16, 10).cast("int"), F.lit(BUCKETS))
    ids = saved(rows.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"))
    narrow = rows.drop("__row").join(heavy(ids, "id", "n"), F.col("id") == F.col("__heavy"), "left")
    part = F.when(F.col("id").isNull() | F.col("__heavy").isNotNull(), F.pmod(F.xxhash64("number"), F.lit(PARTS))).otherwise(F.lit(0)).cast("int")
    narrow = narrow.withColumn("bucket", bucket).withColumn("part", part).drop("__heavy", "__parts")
    cells = narrow.groupBy("key", "size", "bucket", "part").agg(F.count("*").alias("n"))
    sizes = cells.groupBy("key", "size").agg(F.sum("n").alias("n"))
    sources = sizes.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = sources.select(F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).alias("source"), "source_size")
    shares = targets(sources, weights, most).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    by_size = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.select("key", "size", (F.sum("n").over(by_size) - F.col("n")).alias("before_size"))
    by_bucket = Window.partitionBy("key", "size").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("before_bucket", F.sum("n").over(by_bucket) - F.col("n")).drop("n")
    cells = cells.join(sizes, ["key", "size"]).join(shares, "key")
    within = Window.partitionBy("key", "size", "bucket", "part").orderBy("id", "number")
    rank = F.col("before_size") + F.col("before_bucket") + F.row_number().over(within) - 1
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.expr("substring(key, 2)")), 1, 4), 16, 10).cast("double") / 65536
    ranked = narrow.join(cells, ["key", "size", "bucket", "part"]).withColumn("rank", rank).withColumn("f", expected).withColumn("u", offset)
    copies = F.floor(F.col("f") * (F.col("rank") + 1) + F.col("u")) - F.floor(F.col("f") * F.col("rank") + F.col("u"))
    # only numbers and sizes were ranked; the rows are sent once
    ranked = ranked.select("number", "size", "source_size", "target", copies.alias("copies"))
    return rows.select("__row", "number").join(ranked.hint("merge"), "number").drop("number")


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def emit(mixed: DataFrame) -> DataFrame:
    """The rows of df, one for each copy, from the rows of with_copies."""
    return mixed.filter("copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count().alias("size"))
    mixed = with_copies(documents)
    return mixed.select("__row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"), "copies")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS z FROM d GROUP BY source),
n AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS p FROM s),
w AS (
  SELECT *, CASE p % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM n),
r AS (
  SELECT *, 3 * z AS cap, CAST(3 * z AS DOUBLE) / w AS ratio FROM w),
l AS (
  SELECT *, CAST(sum(z) OVER () - (sum(cap) OVER (ORDER BY ratio, p ROWS UNBOUNDED PRECEDING) - cap) AS DOUBLE)
            / CAST(sum(w) OVER () - (sum(w) OVER (ORDER BY ratio, p ROWS UNBOUNDED PRECEDING) - w) AS DOUBLE) AS lv
  FROM r),
t AS (
  SELECT source, z, least(CAST(cap AS DOUBLE), coalesce((SELECT arg_min(lv, (ratio, p)) FROM l WHERE lv <= ratio), 0.0) * w) AS target,
         CAST(CAST('0x' || substr(md5(coalesce(source, '')), 1, 4) AS BIGINT) AS DOUBLE) / 65536 AS u
  FROM l),
k AS (
  SELECT d.doc_id, d.size, t.z AS source_size, t.target, t.u,
         CASE WHEN t.z > 0 THEN t.target / t.z ELSE 0.0 END AS f,
         CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 3), d.doc_id) - 1 AS DOUBLE) AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(floor(f * (i + 1) + u) - floor(f * i + u) AS BIGINT) * size AS taken,
       CAST(floor(f * (i + 1) + u) - floor(f * i + u) AS BIGINT) AS copies
FROM k
"""

QUERIES = {"op6_mixing": op6_mixing}
ORACLE = {"op6_mixing": OP6_SQL}
