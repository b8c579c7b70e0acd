"""Helpers that run inside Spark's Python workers, and the bridge to them."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit

#: Rows and bytes of one Arrow batch.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def state(key, make: Callable[[], object]):
    """An object that a worker process keeps between its tasks: a pure cache,
    made anew in any other process."""
    shelf = sys.modules.setdefault("_tidemark_worker_state", types.ModuleType("_tidemark_worker_state")).__dict__
    if key not in shelf:
        shelf[key] = make()
    return shelf[key]


def map_text(df: DataFrame, keep: list[str], text: str, schema: str, kernel: Callable) -> DataFrame:
    """`keep` columns of df, then the columns of `schema`, which kernel(data,
    offsets) returns as a list of arrays for a slice of documents.  A text that
    is a field of a kept struct, as `__row.text`, isn't sent twice."""
    kept = df.select(*keep).schema.fields
    new = T._parse_datatype_string(schema).fields
    names, out = [f.name for f in kept], [f.name for f in new]
    source = text if "." in text and text.split(".")[0] in names else "__text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in textkit.slices(batch, source):
                made = kernel(data, offsets)
                columns = [rows.column(rows.schema.get_field_index(n)) for n in names]
                made = [x if isinstance(x, pa.Array) else pa.array(x) for x in made]
                yield pa.RecordBatch.from_arrays(columns + made, names=names + out)

    small_batches(df.sparkSession)
    sent = df.select(*keep) if source != "__text" else df.select(*keep, F.col(text).alias("__text"))
    return sent.mapInArrow(run, T.StructType([*kept, *new]))


def small_batches(spark: SparkSession) -> None:
    """Have Spark cut Arrow batches by size: rows of text differ in length by
    orders of magnitude, and several batches are in memory at once."""
    for limit, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{limit}"
        try:
            held = int(re.sub("[^0-9-]", "", spark.conf.get(name)) or -1)
        except Exception:  # a setting that this version of Spark doesn't have
            continue
        if held <= 0 or held > most:
            spark.conf.set(name, str(most))


def boxed(df: DataFrame, *columns) -> DataFrame:
    """All columns of df as one, `__row`, beside the named ones: what an
    operator adds then can't clash with a column of df."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), *columns)


def room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    """array with place for `more` entries after the first `used`; it doubles,
    so appending costs by what is appended."""
    if used + more <= len(array):
        return array
    out = np.zeros(max(2 * len(array), used + more), array.dtype)
    out[:used] = array[:used]
    return out


class Units:
    """Byte strings that a worker has met, numbered in the order they came.

    Strings are found in bulk by hash and then compared byte by byte, so a hash
    never stands for a string.  Hashes are kept in sorted runs that are merged
    as they grow.  More than `limit` strings or `most` bytes are too many for
    `full`; the owner then clears everything and works values out again, so a
    worker's memory stays bounded."""

    def __init__(self, limit: int, most: int = 64 << 20):
        self.limit, self.most = limit, most
        self.clear()

    def clear(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.count = self.used = 0
        self.bytes = np.zeros(1 << 16, np.uint8)
        self.starts = np.zeros(1 << 10, np.int64)
        self.ends = np.zeros(1 << 10, np.int64)

    def full(self, starts: np.ndarray, ends: np.ndarray) -> bool:
        """Whether that many more strings are too many."""
        return self.count + len(starts) > self.limit or self.used + int((ends - starts).sum()) > self.most

    def find(self, hasher: textkit.Hasher, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the byte ranges with these hashes, -1 where unknown."""
        out = np.full(len(keys), -1, np.int64)
        for run, at in self.runs:
            i = np.minimum(np.searchsorted(run, keys), len(run) - 1)
            hit = (out < 0) & (run[i] == keys)
            out[hit] = at[i[hit]]
        hit = np.flatnonzero(out >= 0)
        mine = textkit.Hasher.over(self.bytes)
        wrong = ~hasher.same(starts[hit], ends[hit], mine, self.starts[out[hit]], self.ends[out[hit]])
        out[hit[wrong]] = -1
        return out

    def add(self, hasher: textkit.Hasher, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of new byte ranges.  Of two strings with one hash the first
        is found again, the other is new each time."""
        size = ends - starts
        to = np.cumsum(size)
        total = int(to[-1]) if len(to) else 0
        self.bytes = room(self.bytes, self.used, total + 8)
        self.bytes[self.used : self.used + total] = hasher.data[np.arange(total) + np.repeat(starts - (to - size), size)]
        self.starts, self.ends = room(self.starts, self.count, len(keys)), room(self.ends, self.count, len(keys))
        out = np.arange(self.count, self.count + len(keys))
        self.starts[out], self.ends[out] = self.used + to - size, self.used + to
        self.count, self.used = self.count + len(keys), self.used + total
        order = np.argsort(keys, kind="stable")
        self.runs.append((keys[order], out[order]))
        while len(self.runs) > 1 and 2 * len(self.runs[-1][0]) > len(self.runs[-2][0]):
            (a, b), (c, d) = self.runs.pop(-2), self.runs.pop()
            run, at = np.concatenate([a, c]), np.concatenate([b, d])
            order = np.argsort(run, kind="stable")
            self.runs.append((run[order], at[order]))
        return out
