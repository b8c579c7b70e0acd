"""Operator 5: exact token counts by heap-and-linked-list byte-pair merging.

A pre-token's bytes are the initial symbols of a linked list.  A heap holds the
rank of every adjacent pair that the vocabulary merges; the lowest rank (then
the leftmost place) is popped, merged if it still stands, and its new
neighbours are pushed.  The count is the number of initial symbols less the
number of merges, so no token identifier is ever made.

The same words recur throughout a corpus.  Texts are therefore cut into units
(a word with the one space before it, its closing punctuation, and the pieces
of white space that the pre-tokenizer keeps apart), units are looked up in bulk,
by hash and then byte by byte, and only those that a worker hasn't met are merged.  Texts in which that cut
might differ from the pre-tokenizer's (a special string, Unicode white space)
are pre-tokenized whole instead.  Both ways give the library's counts.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from . import ship, textkit, worker

ship(__name__)

#: The published pattern of this byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units that a worker remembers.
CACHE_UNITS = 1_500_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for a byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Merger:
    """Counts the tokens of strings for one vocabulary file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        symbol = byte_alphabet()
        self.ranks: dict[int, int] = {}
        for rank, (a, b) in enumerate(pairs):
            self.ranks[symbol[a] << 20 | symbol[b]] = rank
            symbol.setdefault(a + b, 256 + rank)
        #: The symbol that the merge of a rank makes.
        self.made = [symbol[a + b] for a, b in pairs]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}
        self.units = worker.Units(CACHE_UNITS)
        self.counts = np.zeros(1 << 10, np.int64)

    def merge(self, word: bytes) -> int:
        """Tokens of one pre-token."""
        ranks, made, symbols = self.ranks, self.made, list(word)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        standing = [-1] * n  # rank of the pair that begins at a symbol, -1: none
        heap = []
        for i in range(n - 1):
            rank = ranks.get(symbols[i] << 20 | symbols[i + 1])
            if rank is not None:
                standing[i] = rank
                heap.append(rank << 32 | i)
        heapq.heapify(heap)
        merges = 0
        while heap:
            top = heapq.heappop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            if standing[i] != rank:
                continue
            merges += 1
            j = after[i]
            symbols[i] = made[rank]
            standing[j] = standing[i] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get(symbols[i] << 20 | symbols[k])
                if rank is not None:
                    standing[i] = rank
                    heapq.heappush(heap, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = ranks.get(symbols[h] << 20 | symbols[i])
                if rank is None:
                    standing[h] = -1
                else:
                    standing[h] = rank
                    heapq.heappush(heap, rank << 32 | h)
        return n - merges

    def count(self, text: str) -> int:
        """Tokens of a text without special strings."""
        total, known = 0, self.known
        for piece in self.pattern.findall(text):
            n = known.get(piece)
            if n is None:
                if len(known) >= 200_000:
                    known.clear()
                n = self.merge(piece.encode())
                if len(piece) <= 64:
                    known[piece] = n
            total += n
        return total

    def count_whole(self, text: str) -> int:
        """Tokens of a text; each special string is one."""
        if self.split_special is None:
            return self.count(text)
        return sum(map(self.count, self.split_special.split(text))) + len(self.split_special.findall(text))

    def count_slice(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of every document of a slice."""
        documents = len(offsets) - 1
        document, lo, hi = units(data, offsets)
        hasher = textkit.Hasher(data)
        keys, one, which = hasher.classes(lo, hi)
        lo, hi = lo[one], hi[one]
        at = self.units.find(hasher, keys, lo, hi)
        new = np.flatnonzero(at < 0)
        if len(new):
            if self.units.full(lo[new], hi[new]):
                self.units.clear()
                new = np.arange(len(keys))
            raw = data.tobytes()
            found = [self.count(raw[a:b].decode("utf-8", "replace")) for a, b in zip(lo[new].tolist(), hi[new].tolist())]
            at[new] = self.units.add(hasher, keys[new], lo[new], hi[new])
            self.counts = worker.room(self.counts, int(at[new[0]]), len(new))
            self.counts[at[new]] = found
        sums = np.zeros(len(which) + 1, np.int64)
        np.cumsum(self.counts[at][which], out=sums[1:])
        ends = np.searchsorted(document, np.arange(documents + 1))
        totals = sums[ends[1:]] - sums[ends[:-1]]
        for d in np.flatnonzero(unusual(data, offsets)).tolist():
            totals[d] = self.count_whole(data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"))
        return totals


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the pieces that are merged apart, by document."""
    starts, ends, first = textkit.words(data, offsets)
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    # the white space before each word: all but its last character is a piece;
    # the last is one too unless it is a space, which belongs to the word
    reach = np.zeros(len(starts), np.int64)
    reach[1:] = ends[:-1]
    opening = first[:-1][np.diff(first) > 0]
    reach[opening] = offsets[:-1][np.diff(first) > 0]
    gap = starts - reach
    joined = (gap > 0) & (data[np.maximum(starts - 1, 0)] == 0x20) if len(starts) else np.zeros(0, bool)
    long, lone = gap > 1, (gap > 0) & ~joined
    cut = textkit.split_trailing(data, starts, ends)
    closing = cut < ends
    # the white space that ends a document is one piece
    last = offsets[:-1].copy()
    some = np.diff(first) > 0
    last[some] = ends[first[1:][some] - 1]
    tail = last < offsets[1:]
    whose = np.concatenate([document, document[closing], document[long], document[lone], np.flatnonzero(tail)])
    lo = np.concatenate([starts - joined, cut[closing], reach[long], starts[lone] - 1, last[tail]])
    hi = np.concatenate([cut, ends[closing], starts[long] - 1, starts[lone], offsets[1:][tail]])
    order = np.argsort(whose, kind="stable")
    return whose[order], lo[order], hi[order]


def unusual(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents with '<|', with white space beyond ASCII, or with the control
    characters 0x1C-0x1F, which some engines take for white space."""
    marks = np.zeros(len(data), bool)
    if len(data) > 1:
        a, b = data[:-1], data[1:]
        marks[:-1] |= (a == 0x3C) & (b == 0x7C)
        marks[:-1] |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        marks[:-1] |= (a == 0xE1) & (b == 0x9A)
        marks[:-1] |= (a == 0xE2) & ((b == 0x80) | (b == 0x81))
        marks[:-1] |= (a == 0xE3) & (b == 0x80)
    marks |= (data >= 0x1C) & (data <= 0x1F)
    return textkit.per_row(marks, offsets) > 0


def token_counts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, limit: int = 512) -> DataFrame:
    """Per row: id_column, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    No token is added; special strings inside texts count as one token each, as
    the library does by default.  A null or empty text has 0 bytes and 0 tokens.
    Rows that repeat are counted each; other columns of df are ignored.  The
    whole text counts, however long.
    """
    with open(path or default_path(), encoding="utf-8") as file:
        spec = file.read()
    shared = df.sparkSession.sparkContext.broadcast(spec)  # one vocabulary file, about 1.5 MB
    key = ("merger", hash(spec))

    def kernel(data, offsets):
        counts = worker.state(key, lambda: Merger(shared.value)).count_slice(data, offsets)
        return [np.diff(offsets), counts, counts > limit]

    return worker.map_text(df, [id_column], text_column, "n_bytes bigint, n_tokens bigint, over_limit boolean", kernel)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLE: dict[str, str] = {}
