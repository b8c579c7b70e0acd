"""Operator 13: fingerprints by consistent weighted sampling, DataFrame functions only.

A text is a set of words weighted by how often each occurs.  Sample k of a word
h with weight w draws r and c from Gamma(2, 1) and beta from [0, 1), all three
by a hash of (h, k) alone, and sets t = floor(ln w / r + beta) and
ln a = ln c - r (t + 1 - beta).  The word with the least a is the text's k-th
sample.  Two texts agree in a sample with probability sum min(w) / sum max(w),
the generalised Jaccard similarity of their weights.  Since a follows from word,
t and k, the least a stands for the sample, and a fingerprint is SAMPLES of them,
16 bits each.

Texts move once: rows are cut into ranges of the id, and everything about a row
and the one after it is worked out where its range is.  Only the first row of a
range is sent to the range before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .saved import saved
from .spread import heavy

#: Samples of a fingerprint: the standard error of a likeness is 0.072 at most.
SAMPLES = 48
#: Ranges of ids, each cut into FINE more: 65,536 at most; bytes of one about.
COARSE, FINE, RANGE_BYTES = 256, 256, 4 << 20
#: Rank of a null id, which comes after all others.
NO_ID = -(1 << 63)
_INFINITE = float("inf")


def gamma_sample(word: Column, k: int, log_weight: Column) -> Column:
    """ln a of sample k of a word: four uniforms of 12 bits make the two gamma
    variates (minus the logarithm of a product of two uniforms each)."""
    bits = F.xxhash64(word, F.lit(k))
    uniform = lambda at: (F.shiftrightunsigned(bits, at).bitwiseAND(F.lit(4095)).cast("double") + 0.5) / 4096.0
    r, c, beta = -F.ln(uniform(0) * uniform(12)), -F.ln(uniform(24) * uniform(36)), uniform(48)
    t = F.floor(log_weight / r + beta)
    return F.ln(c) - r * (t + 1.0 - beta)


def code(sample: Column) -> Column:
    """16 bits of a sample in hexadecimal."""
    return F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(sample), F.lit(1 << 16)))), 4, "0")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples in which two fingerprints agree; of texts without
    words, 1 with each other and 0 with others."""
    same = sum((F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4)).cast("int") for k in range(samples)) / float(samples)
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(same)


def _below(edges: Column, value: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e < value))


def _fractions(parts: int) -> list[float]:
    return [(k + 1) / parts for k in range(parts - 1)] or [0.5]


def ranged(rows: DataFrame) -> DataFrame:
    """rows (key, digest, text, ...) with `range`, a number such that (key
    descending, digest) goes with range descending.  Ranges come from
    approximate quantiles of the keys of all rows, on two levels, and a key with
    more than a thousandth of all rows is cut by digest."""
    facts = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size"), F.percentile_approx("key", _fractions(COARSE), 20 * COARSE).alias("edges")).first()
    fine = min(max(facts["size"] // (COARSE * RANGE_BYTES), 1), FINE)
    edges = F.array(*map(F.lit, sorted(set(facts["edges"] or [0]))))
    coarse = rows.withColumn("coarse", _below(edges, F.col("key")))
    # COARSE rows at most
    inner = F.broadcast(saved(coarse.groupBy("coarse").agg(F.percentile_approx("key", _fractions(fine), 20 * FINE).alias("inner"))))
    sizes = saved(rows.groupBy("key").agg(F.count("*").alias("n")))
    cut = coarse.join(inner, "coarse").join(heavy(sizes, "key", "n"), F.col("key") == F.col("__heavy"), "left")
    part = F.when(F.col("__heavy").isNotNull(), F.conv(F.substring("digest", 1, 2), 16, 10).cast("int")).otherwise(0)
    number = (F.col("coarse") * FINE + _below(F.col("inner"), F.col("key"))).cast("bigint") * 256 + 255 - part
    return cut.withColumn("range", number).drop("coarse", "inner", "__heavy", "__parts")


def with_next(rows: DataFrame, value: str, order: list[Column], number: str = "place") -> DataFrame:
    """Adds `next`, the value of the row after within descending ranges and the
    order; the last row's is that of the first.  `number` counts rows of a range."""
    window = Window.partitionBy("range").orderBy(*order)
    near = rows.withColumn(number, F.row_number().over(window)).withColumn("__after", F.lead(value).over(window)).withColumn("__last", F.lead(F.lit(1)).over(window).isNull())
    first = near.filter(F.col(number) == 1).select("range", F.col(value).alias("__first"))
    # a row for each range, of which there are some 300,000 at most
    whole = Window.orderBy(F.desc("range"))
    ends = rows.select("range").distinct().select("range", F.lead("range").over(whole).alias("then"), F.max("range").over(Window.partitionBy()).alias("top"))
    ends = ends.select(F.col("range").alias("__range"), F.coalesce("then", "top").alias("range")).join(first, "range").select(F.col("__range").alias("range"), "__first")
    return near.join(ends.hint("merge"), "range").withColumn("next", F.when(F.col("__last"), F.col("__first")).otherwise(F.col("__after"))).drop("__after", "__last", "__first")


def signatures(texts: DataFrame, keys: list[str], first: str, second: str, samples: int = SAMPLES) -> DataFrame:
    """(keys, first_print, second_print) of two texts of each row; rows without a word in
    either are left out.  A word with one weight in both is sampled once."""
    both = texts.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(first).alias("text")), F.struct(F.lit(1).alias("side"), F.col(second).alias("text")))).alias("x"))
    words = both.select(*keys, "x.side", F.explode(F.split(F.lower("x.text"), "[ \\t-\\r]+")).alias("word")).filter("word <> ''")
    counts = words.select(*keys, "side", F.xxhash64("word").alias("word")).groupBy(*keys, "word").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    here, gone = F.lit(0.0), F.lit(_INFINITE)
    weight = lambda n, a, b: F.struct(F.ln(n.cast("double")).alias("log_weight"), a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    kinds = F.when(a == b, F.array(weight(a, here, here))).when(a == 0, F.array(weight(b, gone, here))).when(b == 0, F.array(weight(a, here, gone))).otherwise(F.array(weight(a, here, gone), weight(b, gone, here)))
    terms = counts.select(*keys, "word", F.explode(kinds).alias("x")).select(*keys, "word", "x.*")
    # a sample that counts for one side only is infinite on the other; each is worked out once
    least = [F.min(gamma_sample(F.col("word"), k, F.col("log_weight")) + F.col(side)).alias(f"{side}{k}") for k in range(samples) for side in "ab"]
    found = terms.groupBy(*keys).agg(*least)
    made = lambda side: F.when(F.col(f"{side}0") == gone, F.lit("")).otherwise(F.concat(*(code(F.col(f"{side}{k}")) for k in range(samples))))
    return found.select(*keys, made("a").alias("first_print"), made("b").alias("second_print"))


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id_column, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next row's text by descending id, that of the
    first row after the last.  Rows that share an id follow each other by the
    MD5 of their texts, null ids come last; a single row is its own next.  A
    null text is empty; a text without words has the fingerprint ''.  Ids are
    integers above -2**63, which would be taken for null.  Empty in, empty out.  Other columns take no part, whatever their
    names.  Rows that repeat both id and text lie in one range.
    """
    # no column beside those that order the texts, so that one exchange serves rows and first rows
    rows = df.select(F.coalesce(F.col(id_column).cast("bigint"), F.lit(NO_ID)).alias("key"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary")))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    placed = with_next(ranged(rows), "text", [F.desc("key"), F.asc("digest")])
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    texts = placed.select("range", "place", "key", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"))
    prints = signatures(texts, ["range", "place"], "text", "edited")
    narrow = texts.select("range", "place", "key", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    whole = narrow.join(prints.hint("merge"), ["range", "place"], "left").select("range", "place", "key", "n_chars", "edited_sha256", F.coalesce("first_print", F.lit("")).alias("fingerprint"), F.coalesce("second_print", F.lit("")).alias("edited_fingerprint"))
    found = with_next(saved(whole), "fingerprint", [F.asc("place")], "again")
    own = F.when(F.col("key") != NO_ID, F.col("key")).cast(df.schema[id_column].dataType)
    return found.select(own.alias(id_column), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next")).alias("near_next"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_fingerprints": op13_fingerprints}
ORACLE: dict[str, str] = {}
