"""Operator 11: centroid clustering by delta Lloyd.

Assignments live in a written table beside the quantised vectors; the sums of
every centroid are kept from round to round.  A round compares a vector with
the centroids that moved since the last one, and with all of them only where
its own centroid moved, since nothing else can have become nearer.  A vector
that changes its owner gives a signed transfer: its components leave the sum of
the old owner and join that of the new one.  Tasks add their transfers up and
write them as rows of the same table, so a round is one pass.

All arithmetic is on integers and exact.  A centroid is the floor of an exact
mean, so neither partitions nor the order of the rows matter, and skipping what
did not change gives the same result as comparing everything.

What reaches the driver is bounded by the centroids: their sums, a row each.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ship, worker
from .saved import drop, saved

ship(__name__)

#: Vectors that a task compares at once.
ROWS = 4096
#: Components up to which double precision is exact: 64 products of two such
#: numbers, doubled, stay far below 2**53.
PLAIN = 1 << 20
_SMALL = 1 << 15
_LONGEST = (1 << 63) - 1
_STATE = "kind tinyint, id {}, vector binary, owner int, distance bigint"


def quantised(values: list[float], scale: int) -> bytes:
    """floor(scale * x) of every component: two bytes each, or, where one needs
    more, as decimals joined by commas (which is always longer)."""
    # a double beyond 2**60 is an integer, and scale times it might overflow
    made = [int(x) * scale if abs(x) > 2.0**60 else math.floor(scale * x) for x in values]
    if all(-_SMALL <= x < _SMALL for x in made):
        return np.array(made, "<i2").tobytes()
    return ",".join(map(str, made)).encode()


def components(vector: bytes, size: int) -> list[int]:
    if len(vector) == 2 * size:
        return np.frombuffer(vector, "<i2").tolist()
    return [int(x) for x in vector.split(b",")]


def matrix(vectors: list[bytes], size: int) -> np.ndarray:
    """A row per vector: doubles where those are exact, else Python integers."""
    if all(len(v) == 2 * size for v in vectors):
        return np.frombuffer(b"".join(vectors), "<i2").reshape(-1, size).astype(float)
    rows = [components(v, size) for v in vectors]
    exact = np.array(rows, object)
    return exact.astype(float) if max(abs(x) for row in rows for x in row) <= PLAIN else exact


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, exact in either kind of number."""
    if x.dtype == object or centroids.dtype == object:
        x, centroids = x.astype(object), centroids.astype(object)
        if x.dtype == object:
            # doubles that met integers are integers in value
            x = np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
            centroids = np.array([[int(v) for v in row] for row in centroids], object).reshape(centroids.shape)
    return (x * x).sum(axis=1)[:, None] - 2 * x.dot(centroids.T) + (centroids * centroids).sum(axis=1)[None, :]


def nearest(x: np.ndarray, centroids: np.ndarray, owner: np.ndarray, distance: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and distance of every row, given those before only the centroids
    in `changed` moved; owner -1 has none yet."""
    owner, distance = owner.copy(), distance.copy()
    stale = (owner < 0) | np.isin(owner, changed)
    for rows, among in ((np.flatnonzero(stale), np.arange(len(centroids))), (np.flatnonzero(~stale), changed)):
        if not len(rows) or not len(among):
            continue
        found = distances(x[rows], centroids[among])
        best = np.array(found.argmin(axis=1), np.int64)  # the first, so the smaller number
        low, number = found[np.arange(len(rows)), best], among[best]
        if among is not changed:
            owner[rows], distance[rows] = number, low
        else:
            better = (low < distance[rows]) | ((low == distance[rows]) & (number < owner[rows]))
            owner[rows[better]], distance[rows[better]] = number[better], low[better]
    return owner, distance


def numbers(rows: list[list[int]]) -> np.ndarray:
    """Centroids as doubles where those are exact."""
    exact = np.array(rows, object)
    return exact.astype(float) if all(abs(v) <= PLAIN for row in rows for v in row) else exact


def assign(state: DataFrame, centroids: list[list[int]], changed: list[int], size: int) -> DataFrame:
    """The next state: rows of kind 0 are vectors with owner and distance,
    those of kind 1 are transfers (owner, count and sums as decimals)."""
    moved = np.array(sorted(changed), np.int64)
    k = len(centroids)
    schema = state.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means = numbers(centroids)
        # the first entry counts vectors
        transfers = {}
        kind = None

        def transfer(which: np.ndarray, x: np.ndarray, sign: int) -> None:
            for c in np.unique(which[which >= 0]).tolist():
                rows = x[which == c]
                # doubles of one batch add up exactly: ROWS * PLAIN < 2**53
                total = [len(rows), *(int(v) for v in rows.sum(axis=0))]
                held = transfers.setdefault(c, [0] * (size + 1))
                transfers[c] = [a + sign * b for a, b in zip(held, total)]

        for whole in batches:
            kind = whole.schema
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = matrix(batch.column(2).to_pylist(), size)
                was = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
                before = batch.column(4)
                plain = x.dtype != object and means.dtype != object
                # a distance that is no long is unknown: such vectors are compared anew
                was_known = np.where(np.asarray(before.is_null()), -1, was)
                far = np.asarray(before.fill_null(0)).astype(float if plain else object)
                owner, distance = nearest(x, means, was_known, far, moved)
                gone = np.flatnonzero(owner != was)
                transfer(was[gone], x[gone], -1)
                transfer(owner[gone], x[gone], 1)
                low = [int(d) if d <= _LONGEST else None for d in distance]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(owner.astype(np.int32)), pa.array(low, pa.int64())], schema=kind)
        if transfers:
            made = sorted(transfers.items())
            columns = [[1] * len(made), [None] * len(made), [",".join(map(str, v)).encode() for _, v in made], [c for c, _ in made], [0] * len(made)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind.types)], schema=kind)

    assert k
    worker.small_batches(state.sparkSession)
    return state.filter("kind = 0").mapInArrow(run, schema)


def transferred(state: DataFrame, size: int) -> dict[int, list[int]]:
    """Counts and sums that the centroids gain in this state, negative where
    they lose: at most a row for each centroid and task is added up."""
    parts = F.split(F.col("vector").cast("string"), ",")
    rows = state.filter("kind = 1").select("owner", *(parts[j].cast("decimal(38,0)").alias(f"s{j}") for j in range(size + 1)))
    found = rows.groupBy("owner").agg(*(F.sum(f"s{j}").alias(f"s{j}") for j in range(size + 1))).collect()  # a row per centroid
    return {r["owner"]: [int(v) for v in r[1:]] for r in found}


def kept_vectors(df: DataFrame, id_column: str, vector_column: str, size: int, scale: int) -> DataFrame:
    """The first state: vectors of `size` finite components, without owners."""
    v = F.col(vector_column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = df.filter(F.coalesce((F.size(v) == size) & finite, F.lit(False))).select(F.col(id_column).alias("id"), v.cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            x = np.asarray(batch.column(1).flatten()).reshape(-1, size)
            for at in range(0, len(x), ROWS):
                part = x[at : at + ROWS]
                whole = np.floor(part * scale)
                small = ((whole >= -_SMALL) & (whole < _SMALL)).all(axis=1)
                packed = np.where(small[:, None], whole, 0).astype("<i2")
                out += [packed[i].tobytes() if small[i] else quantised(part[i].tolist(), scale) for i in range(len(part))]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int8()), batch.column(0), pa.array(out, pa.binary()), pa.array([-1] * n, pa.int32()), pa.nulls(n, pa.int64())], names=["kind", "id", "vector", "owner", "distance"])

    kind = df.schema[id_column].dataType.simpleString()
    worker.small_batches(df.sparkSession)
    return rows.mapInArrow(run, _STATE.format(kind))


def first_centroids(state: DataFrame, k: int, seed: int, size: int) -> list[list[int]]:
    """Of the k vectors with the smallest SHA-256 of `seed:id`, in that order;
    rows that repeat an id follow each other by their bytes."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    rows = state.select("vector", place.alias("place")).orderBy("place", "vector").limit(k).collect()  # k rows
    return [components(bytes(r["vector"]), size) for r in rows]


def delta_lloyd(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", size: int = 64, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256) -> DataFrame:
    """Per kept vector: id_column, cluster, distance, cluster_inertia, inertia,
    centroid_sha256.

    Kept are vectors of exactly `size` components, none null, NaN or infinite;
    each becomes the integer floor(scale * x).  Fewer vectors than k give as
    many centroids, equal ones stay apart (the smaller number wins their
    vectors, the other is empty and stays); no vector, no row.  Rows that
    repeat, and null ids, are vectors of their own (a null id is hashed as
    `null`).  Distances and sums of distances that no long can hold are null.
    Other columns of df take no part, whatever their names.
    """
    state = saved(kept_vectors(df, id_column, vector_column, size, scale))
    centroids = first_centroids(state, k, seed, size)
    sums = {c: [0] * (size + 1) for c in range(len(centroids))}
    changed = list(range(len(centroids)))
    for r in range(rounds + 1):
        if not changed:
            break
        last, state = state, saved(assign(state, centroids, changed, size))
        drop(last)
        if r == rounds:
            break
        for c, gained in transferred(state, size).items():
            sums[c] = [a + b for a, b in zip(sums[c], gained)]
        means = [[s // n for s in own] if n else centroids[c] for c, (n, *own) in sorted(sums.items())]
        changed = [c for c, mean in enumerate(means) if mean != centroids[c]]
        centroids = means
    return described(state, centroids, id_column)


def described(state: DataFrame, centroids: list[list[int]], id_column: str) -> DataFrame:
    spark = state.sparkSession
    vectors = state.filter("kind = 0").select(F.col("id").alias(id_column), F.col("owner").alias("cluster"), "distance")
    digest = [(c, hashlib.sha256(",".join(map(str, mean)).encode()).hexdigest()) for c, mean in enumerate(centroids)]
    whole = lambda c: F.expr(f"try_cast({c} AS BIGINT)")
    # a null distance makes its sums null
    sums = vectors.groupBy("cluster").agg(F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("own"))
    rows = sums.collect()  # a row per centroid
    total = None if any(r["own"] is None for r in rows) else sum((r["own"] for r in rows), Decimal(0))
    named = spark.createDataFrame([(r["cluster"], r["own"], total, dict(digest)[r["cluster"]]) for r in rows], "cluster int, own decimal(38,0), total decimal(38,0), centroid_sha256 string")
    named = named.select("cluster", whole("own").alias("cluster_inertia"), whole("total").alias("inertia"), "centroid_sha256")
    # as many rows as centroids
    return vectors.join(F.broadcast(named), "cluster").select(id_column, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int = 40, rounds: int = 5, size: int = 64) -> str:
    """Plain Lloyd: every round compares everything."""
    parts = [
        f"""v AS MATERIALIZED (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE len(embedding) = {size} AND len([x FOR x IN embedding IF x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x)]) = {size})""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS cluster, q FROM v QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id)) <= {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v.q, min(struct_pack(d := list_sum([(v.q[i] - c.q[i]) * (v.q[i] - c.q[i]) FOR i IN range(1, {size + 1})]), cluster := c.cluster)) AS best
  FROM v, c{r} c GROUP BY vec_id, v.q)"""
        )
        if r < rounds:
            parts.append(
                f"""m{r} AS MATERIALIZED (
  SELECT cluster, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS q
  FROM (SELECT best.cluster AS cluster, i, CAST(sum(q[i]) AS HUGEINT) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, {size + 1})) AS i) GROUP BY 1, 2) GROUP BY cluster)"""
            )
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.cluster)")
    return f"""
WITH {", ".join(parts)}
SELECT a.vec_id, a.best.cluster AS cluster, CAST(a.best.d AS BIGINT) AS distance,
       CAST(sum(a.best.d) OVER (PARTITION BY a.best.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.best.cluster
"""


QUERIES = {"op11_delta_lloyd": op11_delta_lloyd}
ORACLE = {"op11_delta_lloyd": _sql()}
