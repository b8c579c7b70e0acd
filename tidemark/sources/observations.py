"""Readers and writers of the observation model, and the test adapter."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import positions
from ..schema import SOURCE_COLUMNS, SOURCE_SCHEMA
from .store import Store


class ContractError(ValueError):
    """The input breaks the declared contract."""


def check_header(df: DataFrame, expected: list[str] = SOURCE_COLUMNS) -> DataFrame:
    """df, if its columns are the expected ones in order; else ContractError."""
    if df.columns != expected:
        raise ContractError(f"expected columns {expected}, found {df.columns}")
    return df


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header line: ragged or mistyped rows fail, all-null rows go."""
    header = spark.read.option("header", True).csv(path).columns
    if header != SOURCE_COLUMNS:
        raise ContractError(f"expected columns {SOURCE_COLUMNS}, found {header}")
    rows = spark.read.schema(SOURCE_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)
    return rows.na.drop("all")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return check_header(spark.read.parquet(path)).na.drop("all")


#: Bytes of a file that a task holds at once.
PIECE = 1 << 20


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file: tasks feed the hash from a stream,
    piece by piece, so no file is a value and none is too long.  Only names and
    lengths come from the listing.  Streams are opened by Arrow, which knows
    local files, HDFS and the usual object stores."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [digest_of(name) for name in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=["path", "bytes", "sha256"])

    # a listing of many files is one small partition, their contents are not
    return files.repartition("path").mapInArrow(run, "path string, bytes bigint, sha256 string")


def digest_of(name: str) -> str:
    """SHA-256 of a file by its URI."""
    system, path = fs.FileSystem.from_uri(quote(name.replace("file:///", "file:/").replace("file:/", "file:///"), safe=":/%?=&@") if "://" not in name or name.startswith("file:") else name)
    made = hashlib.sha256()
    with system.open_input_stream(path, buffer_size=0) as stream:
        while piece := stream.read(PIECE):
            made.update(piece)
    return made.hexdigest()


def readings_from_json(df: DataFrame, column: str, sentinel: float = -900.0) -> DataFrame:
    """(parameter, day, value) of weather documents {parameter: {day: value}};
    values at or below the sentinel are missing."""
    parsed = F.from_json(F.col(column), "map<string,map<string,double>>")
    each = df.select(F.explode(parsed).alias("parameter", "days")).select("parameter", F.explode("days").alias("day", "value"))
    return each.filter(F.col("value") > sentinel)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def refresh(layers: dict[str, DataFrame], path: str, version: str) -> None:
    """All layers of a version, published at once: see `store.Store`."""
    Store(next(iter(layers.values())).sparkSession, path).refresh(layers, version)


def current(spark: SparkSession, path: str, layer: str) -> DataFrame:
    return Store(spark, path).layer(layer)


def upsert(base: DataFrame, new: DataFrame, keys: list[str], order: list[str] = ()) -> DataFrame:
    """base with the rows of new put in by key.  Of several rows of a key in
    new the last by `order` counts, then by all columns."""
    place = F.struct(*order, *(c for c in new.columns if c not in order))
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), place).alias("row")).select("row.*")
    return base.join(last.select(*keys), keys, "left_anti").unionByName(last)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables as raw observations, with lineage numbers from 2.

    One observation per order; missing values, case variants, values outside
    their domain and exact duplicates follow from the order key.
    """
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("qty"))
    # nation and region have 25 and 5 rows at every scale
    places = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    customers = table(spark, sf_dir, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_mktsegment", "r_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    base = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    base = base.select(F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), F.col("o_orderdate").alias("d"), F.col("r_name").alias("rn"), F.col("c_mktsegment").alias("seg"), "n_lines", "qty")
    rows = base.selectExpr(
        "k",
        "concat('OBS', lpad(cast(k as string), 9, '0')) AS record_id",
        "rn AS city",
        "CASE WHEN k % 50 = 7 THEN NULL WHEN k % 4 = 1 THEN lower(seg) ELSE concat(upper(substr(seg, 1, 1)), lower(substr(seg, 2))) END AS zone",
        "concat(substr(cast(cast(d AS date) AS string), 1, 10), ' ', lpad(cast((k % 6) * 4 AS string), 2, '0'), CASE WHEN k % 10 = 0 THEN ':00' ELSE ':00:00' END) AS timestamp_text",
        "CASE WHEN k % 53 = 3 THEN NULL ELSE cast(qty AS bigint) END AS traffic_volume",
        "CASE WHEN k % 320 = 5 THEN -10D WHEN k % 320 = 6 THEN 150D WHEN k % 41 = 2 THEN NULL ELSE (cents % 900) / 10D END AS avg_speed_kmph",
        "(cents % 2399) + 100 AS public_transport_usage",
        "5 + (cents % 1060) / 10D AS parking_occupancy_pct",
        "cents % 9 AS road_incidents",
        "cents % 7 AS waterlogging_reports",
        "(cents % 1273) / 10D AS power_outage_minutes",
        "n_lines AS citizen_complaints",
        "CASE WHEN k % 53 = 9 THEN NULL ELSE 6 + (cents % 479) / 10D END AS temperature_c",
    )
    copies = rows.withColumn("dup", F.explode(F.expr("CASE WHEN k % 45 = 11 THEN array(0, 1) ELSE array(0) END")))
    # second copies come after all first ones
    numbered = positions(copies, [], F.expr("dup * 1000000000000L + k div 10000"), ["k"], "place").withColumn("source_row_number", (F.col("place") + 1).cast("bigint"))
    return numbered.select("source_row_number", *SOURCE_COLUMNS)


def daily_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(city, obs_date, t_min, t_max): the reference range by day."""
    places = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    customers = table(spark, sf_dir, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    cents, month = F.round(F.col("o_totalprice") * 100).cast("bigint"), F.month("o_orderdate")
    return joined.groupBy(F.col("r_name").alias("city"), F.to_date("o_orderdate").alias("obs_date")).agg(F.min(6 + month + (cents % 97) / F.lit(10.0)).alias("t_min"), F.max(30 + month + (cents % 113) / F.lit(10.0)).alias("t_max"))
