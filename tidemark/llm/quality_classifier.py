"""Operator 8: a kernel quality classifier.

Statistics of the whole text are standardised over all documents and mapped to
random Fourier features, whose inner products approximate a Gaussian kernel.
Ridge regression of the labels needs only the sums of z z' and z y, which each
partition adds up by itself.  Two halves of the labelled rows score each other,
and isotonic regression of the labels on those scores calibrates the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quality_rules, ship, textkit, worker
from .saved import saved

ship(__name__)
ship(quality_rules.__name__)

#: Random features, length scale of the kernel in standard deviations, ridge.
FEATURES, SCALE, RIDGE, SEED = 256, 3.0, 0.3, 8
#: At most about this many labelled rows fit the model (a documented bound).
FIT_ROWS = 200_000
FIT_TASKS = 16
#: Scores are counted in so many bins for the isotonic fit.
BINS = 4096
CLIP = 6.0
N_STATS = 16

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in "!\"'(),-./:;?[]_{}"]] = True


def statistics(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """N_STATS numbers for every document of a slice, as one list column."""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat, n_lines, n_upper, n_lower = quality_rules.measure(data, offsets)
    starts, ends, first = textkit.words(data, offsets)
    documents = len(offsets) - 1
    document = np.repeat(np.arange(documents), np.diff(first))
    hashes = textkit.Hasher(data).of(starts, ends)
    # hashes alone: a statistic that feeds a fit, not an equality that is reported
    _, one = np.unique(textkit.in_document(hashes, document), return_index=True)
    distinct = np.bincount(document[one], minlength=documents)
    size = ends - starts
    long_words = textkit.per_row(size > 15, first)
    short_words = textkit.per_row(size <= 3, first)
    same_as_last = np.zeros(len(starts), bool)
    same_as_last[1:] = (hashes[1:] == hashes[:-1]) & (document[1:] == document[:-1])
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    stops = textkit.per_row((last == 0x2E) | (last == 0x3F), first)
    shouts = textkit.per_row(data == 0x21, offsets)
    digits = textkit.per_row((data >= 48) & (data <= 57), offsets)
    marks = textkit.per_row(_PUNCTUATION[data], offsets)
    size_bytes = np.maximum(np.diff(offsets), 1)
    w, letters, lines = np.maximum(n_words, 1), np.maximum(n_upper + n_lower, 1), np.maximum(n_lines, 1)
    table = np.stack([
        np.log1p(n_words), word_chars / w, np.sqrt(n_symbols / w), n_dup_lines / lines, n_repeat / w, n_upper / letters, digits / size_bytes, marks / size_bytes,
        distinct / w, np.log1p(n_words / lines), long_words / w, short_words / w, textkit.per_row(same_as_last, first) / w, stops / w, np.sqrt(shouts / w), n_lower / size_bytes,
    ], axis=1)
    return [pa.FixedSizeListArray.from_arrays(pa.array(table.reshape(-1)), N_STATS).cast(pa.list_(pa.float64()))]


def projection() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    return draw.normal(0, 1 / SCALE, (N_STATS, FEATURES)), draw.uniform(0, 2 * np.pi, FEATURES)


def transform(stats: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Random Fourier features, and a constant."""
    weights, phases = projection()
    x = np.clip((stats - mean) / spread, -CLIP, CLIP)
    z = np.sqrt(2 / FEATURES) * np.cos(x @ weights + phases)
    return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, N_STATS)


def normal_sums(rows: DataFrame, mean: np.ndarray, spread: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per half: z'z and z'y of all rows (stats, y, half), summed in tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = transform(matrix(batch.column(0)), mean, spread)
            y, half = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for h in (0, 1):
                own = half == h
                sums[h] += z[own].T @ np.concatenate([z[own], y[own, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    # FIT_TASKS rows of two 257 x 258 matrices: a fixed size
    parts = rows.select("stats", "y", "half").repartition(FIT_TASKS).mapInArrow(add, "sums binary").collect()
    total = sum(np.frombuffer(r["sums"]).reshape(2, FEATURES + 1, FEATURES + 2) for r in parts)
    return {h: (total[h][:, :-1], total[h][:, -1]) for h in (0, 1)}


def ridge(gram: np.ndarray, moment: np.ndarray) -> np.ndarray:
    penalty = np.full(len(gram), RIDGE)
    penalty[-1] = 1e-9  # the constant
    return np.linalg.solve(gram + np.diag(penalty), moment)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing fit: neighbours that fall are pooled."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x.tolist(), y.tolist(), weight.tolist()):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top)]
    made = np.array(blocks)
    return made[:, 0] / made[:, 2], made[:, 1] / made[:, 2]


def held_out(id_column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def document_statistics(df: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    return worker.map_text(df, keep, text_column, "stats array<double>", statistics)


@dataclass(frozen=True)
class Model:
    """A fitted classifier: a few thousand numbers."""

    mean: np.ndarray
    spread: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(transform(stats, self.mean, self.spread) @ self.beta, self.knots, self.values), 0, 1)


def fit(stats: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> Model:
    """A model from stats (id_column, stats) and the rows of labels (id_column,
    quality) that are not held out.

    Null labels are ignored and repeated ones averaged.  Without labels on both
    sides of a split every score is 0.5.
    """
    moments = [x for k in range(N_STATS) for x in (F.avg(F.col("stats")[k]).alias(f"m{k}"), F.stddev_pop(F.col("stats")[k]).alias(f"s{k}"))]
    row = stats.agg(*moments).first()
    mean = np.array([row[f"m{k}"] or 0.0 for k in range(N_STATS)])
    spread = np.array([row[f"s{k}"] or 1.0 for k in range(N_STATS)])
    usable = labels.filter(F.col("quality").isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column))
    known = usable.groupBy(id_column).agg(F.avg("quality").alias("y"))
    n = known.count()
    if n > FIT_ROWS:
        roll = F.pmod(F.xxhash64(F.lit(8), id_column), F.lit(1 << 20))
        known = known.filter(roll < int(FIT_ROWS / n * (1 << 20)))
    known = known.withColumn("half", F.pmod(F.xxhash64(F.lit(9), id_column), F.lit(2)).cast("int"))
    rows = saved(stats.select(id_column, "stats").join(known, id_column).select("stats", "y", "half"))
    sums = normal_sums(rows, mean, spread)
    if not all(gram[-1, -1] for gram, _ in sums.values()):
        return Model(mean, spread, np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    across = {h: ridge(*sums[1 - h]) for h in (0, 1)}
    beta = ridge(sums[0][0] + sums[1][0], sums[0][1] + sums[1][1])

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, half = transform(matrix(batch.column(0)), mean, spread), batch.column(2).to_numpy(zero_copy_only=False)
            score = np.where(half == 0, z @ across[0], z @ across[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.round(np.clip(score, -1, 2) * BINS).astype(np.int64)), batch.column(1)], names=["bin", "y"])

    # at most 3 * BINS rows come back
    bins = rows.mapInArrow(crossed, "bin bigint, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).toPandas().sort_values("bin")
    knots, values = isotonic(bins["bin"].to_numpy(float) / BINS, bins["y"].to_numpy(float), bins["n"].to_numpy(float))
    return Model(mean, spread, beta, knots, values)


def apply(model: Model, stats: DataFrame) -> DataFrame:
    """stats (any columns, stats) with `score`.  A document without words has
    statistics of 0 and is scored as all others."""
    index = stats.columns.index("stats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(matrix(batch.column(index))))], names=[*batch.schema.names, "score"])

    return stats.mapInArrow(run, T.StructType([*stats.schema.fields, T.StructField("score", T.DoubleType())]))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    stats = saved(document_statistics(documents, ["doc_id"]))
    return apply(fit(stats, labels), stats).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
ORACLE: dict[str, str] = {}
