"""Operator 1: a ledger of quality rules as bitmasks, policies and ablations.

Every rule is evaluated once per document.  The ledger holds the measurements
and one integer whose bit r is set where rule r fails.  A policy is a version
name with a mask of the rules it applies: a document is kept where the masked
bits are zero.  Policies and ablations only read the ledger's bits, never the
texts again.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ship, textkit, worker
from .saved import saved

ship(__name__)

MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_upper bigint, n_lower bigint"

#: Rule names with the condition under which each fails, in bit order.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "upper_case": "n_upper > n_lower",
}
#: Policy versions and the rules that each applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_windows"),
    "full-1": tuple(RULES),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_U = np.uint64


def repeated(words: list[bytes]) -> np.ndarray:
    """Which words are in a three-word window that comes twice or more."""
    places: dict[tuple, list[int]] = {}
    for k, run in enumerate(zip(words, words[1:], words[2:])):
        places.setdefault(run, []).append(k)
    out = np.zeros(len(words), bool)
    for found in places.values():
        for k in found if len(found) > 1 else ():
            out[k : k + 3] = True
    return out


def measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """MEASURES of every document of a slice."""
    documents = len(offsets) - 1
    starts, ends, first = textkit.words(data, offsets)
    hasher = textkit.Hasher(data)
    document = np.repeat(np.arange(documents), np.diff(first))

    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    inside = np.cumsum(inside, dtype=np.int8)[:-1].astype(bool)
    word_chars = textkit.per_row(inside & ((data & 0xC0) != 0x80), offsets)

    # lines with a word, and those equal to an earlier line of their document
    breaks = np.flatnonzero(data == 0x0A)
    line_from = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    line_from = line_from[line_from < len(data)]
    owner = np.searchsorted(offsets, line_from, side="right") - 1
    line_to = offsets[owner + 1].copy()
    k = np.searchsorted(breaks, line_from)
    some = k < len(breaks)
    line_to[some] = np.minimum(line_to[some], breaks[k[some]])
    worded = np.searchsorted(starts, line_to) > np.searchsorted(starts, line_from)
    line_from, line_to, owner = line_from[worded], line_to[worded], owner[worded]
    n_lines = np.bincount(owner, minlength=documents)
    _, alike, line = hasher.classes(line_from, line_to)
    one = np.unique(owner * max(len(alike), 1) + line, return_index=True)[1]
    n_dup_lines = n_lines - np.bincount(owner[one], minlength=documents)

    # words inside a three-word window that its document holds twice or more
    covered = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        whole = np.flatnonzero(document[2:] == document[:-2])
        keys = textkit.in_document(textkit.windows(hasher.of(starts, ends), 3)[whole], document[whole])
        order = np.argsort(keys, kind="stable")
        at = whole[order]
        same = keys[order][1:] == keys[order][:-1]
        pairs = np.flatnonzero(same)
        equal = document[at[pairs]] == document[at[pairs + 1]]
        for k in range(3):
            equal &= hasher.same(starts[at[pairs] + k], ends[at[pairs] + k], hasher, starts[at[pairs + 1] + k], ends[at[pairs + 1] + k])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        for k in range(3):
            covered[at[twice] + k] = True
        # unequal windows of one hash: count their documents by the words
        for d in np.unique(document[np.concatenate([at[pairs[~equal]], at[pairs[~equal] + 1]])]).tolist():
            a, b = int(first[d]), int(first[d + 1])
            covered[a:b] = repeated([data[i:j].tobytes() for i, j in zip(starts[a:b].tolist(), ends[a:b].tolist())])

    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    return [np.diff(first), word_chars, textkit.per_row(_SYMBOL[data], offsets), n_dup_lines, textkit.per_row(covered, first), n_lines, textkit.per_row(upper, offsets), textkit.per_row(lower, offsets)]


def failure_bits(rules: dict[str, str] = RULES) -> Column:
    """Bit r is set where the r-th rule fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << r)).otherwise(F.lit(0)) for r, rule in enumerate(rules.values())]
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("bigint")


def mask(policy: str, rules: dict[str, str] = RULES, policies: dict[str, tuple[str, ...]] = POLICIES) -> int:
    return sum(1 << list(rules).index(name) for name in policies[policy])


def ledger(df: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """`keep` columns of df, the measurements, and fail_bits.

    A null or empty text has no words, so the rule few_words fails and no rule
    that compares with the number of words does.  Rows that repeat each get
    their entry; texts of any length are measured whole.
    """
    return worker.map_text(df, keep, text_column, MEASURES, measure).withColumn("fail_bits", failure_bits())


def passes(policy: str) -> Column:
    """Whether a ledger entry passes a policy version."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: n_fail, n_only (documents that no other rule of
    the policy rejects) and kept_without (documents kept if the rule goes).

    The entries are first counted by their bits, so only a few rows travel.
    """
    masked = mask(policy)
    counts = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(masked)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [(r, name, 1 << r) for r, name in enumerate(RULES) if masked >> r & 1]
    table = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(name).alias("name"), F.lit(bit).cast("bigint").alias("bit")) for r, name, bit in rules)))
    each = counts.select("bits", "n", table.alias("x")).select("bits", "n", "x.*")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    zero = F.lit(0).cast("bigint")
    return each.groupBy("rule", "name").agg(F.sum(F.when(fails, F.col("n")).otherwise(zero)).alias("n_fail"), F.sum(F.when(fails & rest, F.col("n")).otherwise(zero)).alias("n_only"), F.sum(F.when(rest, F.col("n")).otherwise(zero)).alias("kept_without"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    base_failed = ~passes("base-1")
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), passes("full-1").alias("kept"), "fail_bits")


#: The same table over whole texts, word by word.  Upper-case counts take A-Z.
OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rn, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
  FROM d),
g AS (
  SELECT rn, i, count(*) OVER (PARTITION BY rn, ws[i], ws[i + 1], ws[i + 2]) AS c
  FROM (SELECT rn, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (
  SELECT rn, count(DISTINCT i + k) AS n_repeat_words
  FROM g, (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY rn),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(ls) AS n_lines,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
         length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS n_lower
  FROM w LEFT JOIN r ON r.rn = w.rn),
f AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
       + 4 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT
       + 8 * (10 * n_symbols > 3 * n_words)::INT + 16 * (2 * n_dup_lines > n_lines)::INT
       + 32 * (n_upper > n_lower)::INT AS BIGINT) AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM f
"""

def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ablations of every policy version, from one ledger."""
    entries = saved(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"), []).select("fail_bits"))
    return reduce(DataFrame.unionByName, (ablations(entries, policy).select(F.lit(policy).alias("policy"), "name", "n_fail", "n_only", "kept_without") for policy in POLICIES))


def _ablation_sql() -> str:
    out = []
    for policy, names in POLICIES.items():
        for name in names:
            bit = 1 << list(RULES).index(name)
            rest = f"fail_bits & {mask(policy) & ~bit} = 0"
            out.append(f"SELECT '{policy}' AS policy, '{name}' AS name, count(*) FILTER (fail_bits & {bit} <> 0) AS n_fail, count(*) FILTER (fail_bits & {bit} <> 0 AND {rest}) AS n_only, count(*) FILTER ({rest}) AS kept_without FROM o")
    return f"WITH o AS ({OP1_SQL})\n" + " UNION ALL ".join(out)


QUERIES = {"op1_quality_rules": op1_quality_rules, "quality_rule_ablations": quality_rule_ablations}
ORACLE = {"op1_quality_rules": OP1_SQL, "quality_rule_ablations": _ablation_sql()}
