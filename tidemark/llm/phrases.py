"""Operator 12: collocations by merged count-min sketches and an exact pass.

1. Sketch.  Every phrase of one to five words of a piece of text adds one to a
   cell in each of DEPTH rows of counters.  Tasks count the cells that they
   touch and send them block by block; equal blocks are added up.  A cell's
   count is never below that of a phrase in it, so phrases with a cell below
   the least count are rare for sure.  Only that yes or no leaves the sketch:
   one bit a cell.
2. Exact pass.  Phrases whose cells all reach the least count are counted as
   text, first within tasks, then by Spark.  All frequent phrases are among
   them, and so are the parts of each, whose counts the score needs.
3. Scores, in decimals, and subsumption, by joins of phrases with their parts.

The sketch grows with the corpus up to MOST_CELLS a row, so its bits are small
enough to broadcast (64 MB at most).  In a larger corpus, with as low a least
count, more rare phrases pass it, and the exact pass counts them in vain; the
result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ship, textkit, worker
from .saved import drop, saved
from .spread import heavy, spread_join

ship(__name__)

#: Rows of the sketch; cells of a row at least and at most; of a block.
DEPTH, LEAST_CELLS, MOST_CELLS, BLOCK = 2, 1 << 20, 1 << 28, 1 << 16
#: Cells of a row for each phrase that could reach the least count.
ROOM = 8
#: Cells that a task holds before it sends them.
HELD_CELLS = 1 << 22
#: Language of documents that have none.
NONE = "und"
_U = np.uint64
_APART = np.zeros(256, bool)
_APART[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _APART.copy()
_GAP[[0x20, 0x09]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, document and piece of every word.  Pieces are numbered across
    the slice, so two words are in one piece if its number is the same."""
    inside = ~_GAP[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before, after = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    before[1:], after[:-1] = inside, inside
    before[offsets] = after[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    document = np.searchsorted(offsets, starts, side="right") - 1
    piece = np.cumsum(_APART[data])[starts] + document if len(data) else starts
    return starts, ends, document, piece


class Words:
    """The words of a slice, A-Z in lower case, with the language of each."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.data = textkit.lower_ascii(data)
        self.starts, self.ends, document, self.piece = words(self.data, offsets)
        language = rows.column(rows.schema.get_field_index("lang")).dictionary_encode()
        self.languages = language.dictionary.to_pylist()
        self.language = language.indices.to_numpy(zero_copy_only=False)[document] if len(document) else document

    def __len__(self) -> int:
        return len(self.starts)

    def runs(self, n: int) -> np.ndarray:
        """Where n words of one piece begin."""
        last = len(self) - n + 1
        return np.flatnonzero(self.piece[: max(last, 0)] == self.piece[n - 1 :]) if last > 0 else np.zeros(0, np.int64)

    def hashes(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, starts of the phrases of n words, their hashes with language)."""
        hasher = textkit.Hasher(self.data)
        one = hasher.of(self.starts, self.ends)
        tongues = [name.encode() for name in self.languages]
        ends = np.cumsum([0] + [len(t) for t in tongues])
        salt = textkit.Hasher(np.frombuffer(b"".join(tongues), np.uint8)).of(ends[:-1], ends[1:], 1)
        salted = salt[self.language] if len(self) else one
        for n in range(1, longest + 1):
            at = self.runs(n)
            yield n, at, textkit.mix(textkit.windows(one, n)[at] + salted[at] * _U(2 * n + 1))


def cells(hashes: np.ndarray, bits: int, row: int) -> np.ndarray:
    """The cell of each hash in a row of 2**bits."""
    return (textkit.mix(hashes + _U(0x9E3779B97F4A7C15 * (row + 1) & 0xFFFFFFFFFFFFFFFF)) >> _U(64 - bits)).astype(np.int64)


def packed(gaps: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted cells of a block as planes of bytes, which compress well."""
    return gaps.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes() + counts.tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 4
    low, high, counts = np.frombuffer(data, np.uint8, n), np.frombuffer(data, np.uint8, n, n), np.frombuffer(data, "<u2", n, 2 * n)
    return np.cumsum(low.astype(np.int64) + (high.astype(np.int64) << 8)), counts.astype(np.int64)


def sketched(docs: DataFrame, bits: int, longest: int, least: int) -> DataFrame:
    """(block, touched): blocks of counters from all tasks, several of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> pa.RecordBatch:
            cell, count = counted(np.concatenate(held)) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            # a cell that is past the least count in one task is past it in all
            count = np.minimum(count, min(least, 0xFFFF)).astype("<u2")
            block = cell // BLOCK
            begin = np.flatnonzero(np.diff(block, prepend=-1))
            end = [*begin[1:].tolist(), len(cell)]
            inside = cell % BLOCK
            gaps = np.diff(inside, prepend=0)
            gaps[begin] = inside[begin]
            rows = [packed(gaps[a:b], count[a:b]) for a, b in zip(begin.tolist(), end)] if len(cell) else []
            return pa.RecordBatch.from_arrays([pa.array(block[begin], pa.int64()), pa.array(rows, pa.binary())], names=["block", "touched"])

        for batch in batches:
            for rows, data, offsets in textkit.slices(batch):
                for _, _, hashes in Words(rows, data, offsets).hashes(longest):
                    for row in range(DEPTH):
                        held.append(((row << bits) + cells(hashes, bits, row)).astype(np.uint32))
                        size += len(hashes)
                if size >= HELD_CELLS:
                    yield sent()
                    held, size = [], 0
        yield sent()

    return docs.mapInArrow(run, "block bigint, touched binary")


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, in order, and how often each occurs."""
    values.sort()
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[begin].astype(np.int64), np.diff(np.append(begin, len(values)))


def merged(blocks: DataFrame, least: int) -> DataFrame:
    """(block, full): one bit a cell, set where the counts of all tasks reach
    `least`.  Blocks are added up one row at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, np.zeros(BLOCK, np.int64)

        def done() -> pa.RecordBatch:
            bits = np.packbits(total >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([bits], pa.binary())], names=["block", "full"])

        for batch in batches:
            for block, touched in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block != last:
                    if last is not None:
                        yield done()
                    last, total = block, np.zeros(BLOCK, np.int64)
                cell, count = unpacked(touched.as_py())
                total[cell] += count
        if last is not None:
            yield done()

    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block bigint, full binary")


def survivors(docs: DataFrame, full: object, bits: int, longest: int) -> DataFrame:
    """(lang, phrase, n) of the phrases that the sketch (a broadcast array of
    bits) lets through, summed within slices; a null phrase has all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = full.value
        for batch in batches:
            for rows, data, offsets in textkit.slices(batch):
                text = Words(rows, data, offsets)
                if not len(text):
                    continue
                _, one, which = textkit.Hasher(text.data).classes(text.starts, text.ends)
                vocabulary = pa.array([text.data[a:b].tobytes() for a, b in zip(text.starts[one].tolist(), text.ends[one].tolist())], pa.binary()).cast(pa.string())
                kinds = len(one)
                yield pa.RecordBatch.from_arrays([pa.array(text.languages, pa.string()), pa.nulls(len(text.languages), pa.string()), pa.array(np.bincount(text.language, minlength=len(text.languages)))], names=["lang", "phrase", "n"])
                # a phrase is the number of the one without its last word, and that word: so numbers are exact
                known, alive = text.language.astype(np.int64), np.ones(len(text), bool)
                for n, at, hashes in text.hashes(longest):
                    through = alive[at]  # what is frequent begins with what is frequent
                    for row in range(DEPTH):
                        cell = (row << bits) + cells(hashes, bits, row)
                        through &= (flags[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0
                    at = at[through]
                    alive = np.zeros(len(text), bool)
                    alive[at] = True
                    if not len(at):
                        break
                    keys = known[at] * kinds + which[at + n - 1]
                    distinct, first, number, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
                    known = np.zeros(len(text), np.int64)
                    known[at] = number
                    begin = at[first]
                    parts = [vocabulary.take(pa.array(which[begin + k])) for k in range(n)]
                    phrase = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
                    language = pa.array(text.languages, pa.string()).take(pa.array(text.language[begin]))
                    yield pa.RecordBatch.from_arrays([language, phrase, pa.array(count)], names=["lang", "phrase", "n"])

    return docs.mapInArrow(run, "lang string, phrase string, n bigint")


def frequent(docs: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, phrase, f) of all phrases of up to `longest` words that occur
    `least` times or more, from (lang, text); a null phrase has all words."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # a word and its space are six bytes or so, and begin a phrase of each length
    wanted = ROOM * longest * size // (6 * least)
    bits = int(np.clip(int(wanted).bit_length(), LEAST_CELLS.bit_length() - 1, MOST_CELLS.bit_length() - 1))
    made = saved(merged(sketched(docs, bits, longest, least), least))
    flags = np.zeros(DEPTH << bits >> 3, np.uint8)
    for r in made.toLocalIterator():  # BLOCK bits a row, of a sketch of bounded size
        flags[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["full"], np.uint8)
    drop(made)
    full = spark.sparkContext.broadcast(flags)
    counts = saved(survivors(docs, full, bits, longest).groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter((F.col("f") >= least) | F.col("phrase").isNull()))
    full.unpersist()
    return counts


def _among(phrase: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, n), " ")


def scored(counts: DataFrame, words_of: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words or more: at
    the cut with the lowest score, the first of several."""
    m = F.size(F.split("phrase", " "))
    cuts = counts.filter(m > 1).select("lang", "phrase", F.col("f").alias("a"), m.alias("m")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.struct("lang", _among(F.col("phrase"), F.lit(1), F.col("k")).alias("phrase")).alias("first"), F.struct("lang", _among(F.col("phrase"), F.col("k") + 1, F.col("m")).alias("phrase")).alias("rest"))
    for part, name in (("first", "l"), ("rest", "r")):
        # a common word begins or ends any number of phrases
        uses = saved(cuts.groupBy(part).agg(F.count("*").alias("uses")))
        known = counts.select(F.struct("lang", "phrase").alias(part), F.col("f").alias(name))
        cuts = spread_join(cuts, known, part, F.xxhash64("phrase", "k"), heavy(uses, part, "uses")).drop(part)
    uses = saved(counts.groupBy("lang").agg(F.count("*").alias("uses")))
    cuts = spread_join(cuts, words_of, "lang", F.xxhash64("phrase", "k"), heavy(uses, "lang", "uses"))
    wide = lambda c: f"CAST({c} AS DECIMAL(16,0))"
    # 37 digits at most, so nothing is rounded
    score = F.expr(f"CAST((1000 * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')}) AS BIGINT)")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r", "n")).alias("x"))
    return best.select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")


def unsubsumed(candidates: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """Candidates without those whose words lie in a longer one that is at least
    `percent` hundredths as frequent."""
    m = F.size(F.split("phrase", " "))
    longer = counts.select("lang", "phrase", "f", m.alias("m")).filter("m > 2").withColumn("k", F.explode(F.sequence(F.lit(2), F.col("m") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("k") + 1)))
    most = longer.select("lang", _among(F.col("phrase"), F.col("at"), F.col("k")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    # one row of each phrase on both sides
    joined = candidates.join(most.hint("merge"), ["lang", "phrase"], "left")
    return joined.filter(F.coalesce(F.col("within") * 100 < F.col("a") * percent, F.lit(True))).drop("within")


def top(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """rows with their rank from 1 within key, up to `most`.  Groups are thinned
    out part by part, so no task sorts all rows of a key."""
    for parts in (1024, 32):
        part = Window.partitionBy(key, F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= most)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= most)


def collocations(df: DataFrame, text_column: str = "text", lang_column: str = "lang", longest: int = 5, least: int = 100, percent: int = 100, most: int = 2000) -> DataFrame:
    """Per language its `most` best phrases: lang, rank, phrase, a, l, r, n, score.

    Texts, A-Z in lower case, are cut at `[.,;:!?\\x0A-\\x0D]` into pieces and
    those at spaces and tabs into words.  Candidates are phrases of 2 to
    `longest` words of a piece that occur a >= least times.  A cut of one has
    l and r occurrences of its sides and the score 1000 * a * n / (l * r),
    floored, n being the language's words; the lowest counts.  Candidates that
    lie within a longer one with `percent` hundredths of their count or more
    are dropped.  Null texts are empty, a null language is `und`; rows that
    repeat count each; equal scores go by a, then by phrase; empty in, empty
    out.  Other columns take no part, whatever their names.
    """
    lang = F.coalesce(F.col(lang_column).cast("string"), F.lit(NONE))
    docs = df.select(lang.alias("lang"), F.col(text_column).alias("text")).filter("text IS NOT NULL")
    worker.small_batches(df.sparkSession)
    found = frequent(docs, longest, least)
    counts, words_of = found.filter("phrase IS NOT NULL"), found.filter("phrase IS NULL").select("lang", F.col("f").alias("n"))
    rows = unsubsumed(scored(counts, words_of), counts, percent)
    ranked = top(rows, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], most)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH pieces AS MATERIALIZED (
  SELECT lang, piece, [w FOR w IN regexp_split_to_array(body, '[ \t]') IF w <> ''] AS w
  FROM (SELECT lang, row_number() OVER () AS piece, body
        FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]')) AS body FROM documents))),
n AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS f
  FROM (SELECT lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS phrase
        FROM pieces, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)
  GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, m, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS p, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS q
  FROM f, (SELECT unnest(range(1, 5)) AS k) WHERE m > k),
scores AS (
  SELECT c.lang, c.m, c.phrase, c.a, min(struct_pack(score := (CAST(1000 AS HUGEINT) * c.a * n.n) // (CAST(x.f AS HUGEINT) * y.f), k := c.k, l := x.f, r := y.f, n := n.n)) AS s
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.p JOIN f y ON y.lang = c.lang AND y.phrase = c.q JOIN n ON n.lang = c.lang
  GROUP BY ALL),
within AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + k - 1], ' ') AS phrase, max(f) AS most
  FROM (SELECT lang, phrase, f, m, k, unnest(range(1, m - k + 2)) AS i FROM f, (SELECT unnest(range(2, 5)) AS k) WHERE m > k)
  GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.s.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a,
         s.s.l AS l, s.s.r AS r, CAST(s.s.n AS BIGINT) AS n, CAST(s.s.score AS BIGINT) AS score
  FROM scores s LEFT JOIN within w ON w.lang = s.lang AND w.phrase = s.phrase
  WHERE w.most IS NULL OR 100 * w.most < 100 * s.a)
WHERE rank <= 2000
"""

QUERIES = {"op12_collocations": op12_collocations}
ORACLE = {"op12_collocations": OP12_SQL}
