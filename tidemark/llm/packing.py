"""Operator 2: packing documents into training sequences by sums of squares.

Documents become token ids; only those longer than a sequence are cut.  Pieces
are dealt at random into groups of bounded size, and each group is packed by
the sum-of-squares rule: with N(g) open bins of residual gap g, a piece of
length s goes where the sum of N(g)**2 becomes smallest, opening a bin being
weighed like any other place.  Pieces come longest first.  The README compares
orders, and openings as a last resort, with the bound.  Only lengths and
digests travel to the groups; `sequences` joins the ids to the places.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ship, textkit, worker
from .saved import saved

ship(__name__)

SEQUENCE_TOKENS = 4096
END_OF_TEXT = 1
#: Mean rows of a packing group.
GROUP_ROWS = 8192
#: Units that a worker remembers.
CACHE_UNITS = 500_000
PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"
#: The row of a piece's document within its scan task, so that equal pieces differ.
ORDINAL = ", ordinal bigint"
IDS = ", ids array<int>"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of a lower-casing, white-space-dropping tokenizer.  Words are looked
    up by hash and then byte by byte; the library encodes those that a worker
    hasn't met."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.units = worker.Units(CACHE_UNITS)
        self.forget()

    def forget(self) -> None:
        self.units.clear()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.begin = np.zeros(1 << 10, np.int64)
        self.size = np.zeros(1 << 10, np.int64)

    def learn(self, at: np.ndarray, texts: list[str]) -> None:
        """Keep the ids of the units numbered at."""
        ids, sizes = [], np.zeros(len(texts), np.int64)
        for k in range(0, len(texts), 20_000):
            made = self.library.encode(texts[k : k + 20_000], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(made.ids, np.uint32))
            sizes[k : k + 20_000] = np.bincount(np.array(made.word_ids, np.int64), minlength=len(texts[k : k + 20_000]))
        ids = np.concatenate(ids)
        self.flat = worker.room(self.flat, self.used, len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin, self.size = worker.room(self.begin, int(at[0]), len(at)), worker.room(self.size, int(at[0]), len(at))
        self.begin[at], self.size[at] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a slice end to end, and their offsets."""
        data = textkit.lower_ascii(raw)
        starts, ends, first = textkit.words(data, offsets)
        cut = textkit.split_trailing(data, starts, ends)
        closing = np.flatnonzero(cut < ends)
        place = np.arange(len(starts)) + np.searchsorted(closing, np.arange(len(starts)))
        lo = np.zeros(len(starts) + len(closing), np.int64)
        hi = np.zeros_like(lo)
        lo[place], hi[place] = starts, cut
        lo[place[closing] + 1], hi[place[closing] + 1] = cut[closing], ends[closing]
        first = np.concatenate([place, [len(lo)]])[first]
        hasher = textkit.Hasher(data)
        keys, one, which = hasher.classes(lo, hi)
        lo, hi = lo[one], hi[one]
        at = self.units.find(hasher, keys, lo, hi)
        new = np.flatnonzero(at < 0)
        if len(new):
            if self.units.full(lo[new], hi[new]):
                self.forget()
                new = np.arange(len(keys))
            text = data.tobytes()
            at[new] = self.units.add(hasher, keys[new], lo[new], hi[new])
            self.learn(at[new], [text[a:b].decode("utf-8", "replace") for a, b in zip(lo[new].tolist(), hi[new].tolist())])
        begin, size = self.begin[at][which], self.size[at][which]
        ends_of = np.cumsum(size)
        ids = self.flat[np.arange(int(ends_of[-1]) if len(ends_of) else 0) + np.repeat(begin - (ends_of - size), size)]
        out = np.concatenate([[0], ends_of])[first]
        special = np.zeros(len(raw), bool)
        special[:-1] = (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)  # '<|': special strings may follow
        for d in np.flatnonzero(textkit.per_row(special, offsets)).tolist():
            whole = self.library.encode(raw[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids
            ids = np.concatenate([ids[: out[d]], np.array(whole, np.uint32), ids[out[d + 1] :]])
            out[d + 1 :] += len(whole) - (out[d + 1] - out[d])
        return ids, out


def pieces(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, size: int = SEQUENCE_TOKENS, end: int = END_OF_TEXT, ids: bool = True) -> DataFrame:
    """Per piece of a document: id_column, piece, start, length, ids_crc32,
    ordinal (the number of its document within the scan task) and ids, its
    token ids.  Without `ids` they aren't sent from the workers."""
    with_ids = ids
    with open(path or default_path(), encoding="utf-8") as file:
        spec = file.read()
    shared = df.sparkSession.sparkContext.broadcast(spec)  # one vocabulary file, about 1.7 MB
    key = ("encoder", hash(spec))
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = worker.state(key, lambda: Encoder(shared.value)), 0
        for batch in batches:
            for rows, data, offsets in textkit.slices(batch, "__text"):
                ids, ends = encoder.encode(data, offsets)
                row, piece, length, crc, parts = [], [], [], [], []
                for d, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    own = np.empty(b - a + 1, "<u4")
                    own[:-1], own[-1] = ids[a:b], end
                    for p, k in enumerate(range(0, len(own), size)):
                        part = own[k : k + size]
                        row.append(d), piece.append(p), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            parts.append(part.astype(np.int32))
                extra = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))] if with_ids else []
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(np.array(piece, np.int64) * size), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.array(row, np.int64) + before), *extra], names=[id_column, "piece", "start", "length", "ids_crc32", "ordinal", *["ids"] * with_ids])
                before += rows.num_rows

    worker.small_batches(df.sparkSession)
    return df.select(id_column, F.col(text_column).alias("__text")).mapInArrow(run, f"`{id_column}` {kind}, {PIECES}{ORDINAL}{IDS * with_ids}")


def sum_of_squares(lengths: np.ndarray, size: int, weigh_opening: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken in the given order.

    Every choice is weighed by what it does to the sum of squared counts: an
    open bin passes from one gap to another, or is full and no longer open; a
    new bin adds one to a gap.  Without weigh_opening a new bin is the last
    resort.  Among equals the smallest gap is taken, a new bin last."""
    count = np.zeros(size + 1, np.int64)  # open bins by gap
    bins: list[list[int]] = [[] for _ in range(size + 1)]
    opened = 0
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, s in enumerate(lengths.tolist()):
        if s >= size:
            where[k], opened = opened, opened + 1
            continue
        have = count[s:]
        change = 2 * (count[: size + 1 - s] - have) + 2
        change[0] = 1 - 2 * have[0]
        change[have == 0] = 1 << 40
        g = int(change.argmin())
        new = 2 * int(count[size - s]) + 1 if weigh_opening else (1 << 40) - 1
        if change[g] <= new:
            gap = g + s
            b = bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b, opened = size, opened, opened + 1
        where[k], offset[k] = b, size - gap
        if gap > s:
            bins[gap - s].append(b)
            count[gap - s] += 1
    return where, offset


def pack(parts: DataFrame, rows: int, id_column: str = "doc_id", size: int = SEQUENCE_TOKENS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id and offset to the pieces; `rows` is how many there are.
    Pieces that are equal in everything are told apart by their ordinals, so
    they are dealt to all groups like others."""
    groups = max(1, round(rows / group_rows))
    kind = parts.schema[id_column].dataType.simpleString()

    def place(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", id_column, "piece", "ids_crc32", "ordinal"], ascending=[False, True, True, True, True], kind="stable")
        where, group["offset"] = sum_of_squares(group["length"].to_numpy(), size)
        group["sequence_id"] = (np.int64(key[0]) << 32) + where
        return group[[id_column, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = parts.withColumn("__group", F.pmod(F.xxhash64(F.lit(2), id_column, "piece", "ids_crc32", "ordinal"), F.lit(groups)))
    return dealt.groupBy("__group").applyInPandas(place, f"`{id_column}` {kind}, {PIECES}, sequence_id bigint, offset bigint")


def pack_documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, size: int = SEQUENCE_TOKENS) -> DataFrame:
    """Per piece: id_column, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the single end id.  Rows that repeat are packed
    each, and ties in length are taken by id, piece and digest.  An empty table
    gives no rows.  Other columns of df are ignored, whatever their names.
    Reruns over the same files give the same places.
    """
    # written: the groups are sized by the pieces, and no text is encoded twice
    parts = saved(pieces(df, id_column, text_column, path, size, ids=False))
    return pack(parts, parts.count(), id_column, size)


def sequences(placed: DataFrame, parts: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence, its pieces in the
    order of their offsets; placed are pack's rows, parts are pieces with ids.

    They meet by document, piece, length and digest.  Parts equal in all four
    are one: rows that repeat have the same ids, and two texts under one id
    would have to share length and CRC."""
    keys = [id_column, "piece", "length", "ids_crc32"]
    one = parts.dropDuplicates(keys).select(*(F.col(f"`{k}`").alias(f"__{n}") for n, k in enumerate(keys)), "ids")
    same = F.lit(True)
    for n, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__{n}"))
    found = placed.join(one, same)
    whole = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return found.groupBy("sequence_id").agg(whole.alias("x")).select("sequence_id", F.flatten("x.ids").alias("ids"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_packing": op2_packing}
ORACLE: dict[str, str] = {}
