"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept.  All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, near_duplicates, packing, quality_classifier, quality_rules, worker
from tidemark.llm.saved import drop, saved
from tidemark.llm.spread import heavy, spread_join

#: Documents that score less are rejected.
LOWEST_SCORE = 0.5


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the newest policy of the rule ledger.  The rule
    few_words rejects null and empty texts; repeated rows are judged each."""
    entries = quality_rules.ledger(worker.boxed(docs), ["__row"], "__row.text")
    return entries.filter(quality_rules.passes("full-1")).select("__row.*")


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores LOWEST_SCORE or more.  It
    learns from the labelled rows of the raw documents, since those left by
    the rules are nearly all of one class.  Null and empty texts are scored as
    texts without words; rows that repeat are scored each; without usable
    labels all stay; empty in, empty out."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality_classifier.fit(saved(quality_classifier.document_statistics(raw, ["doc_id"])), labels)
    scored = quality_classifier.apply(model, quality_classifier.document_statistics(worker.boxed(docs), ["__row"], "__row.text"))
    return scored.filter(F.col("score") >= LOWEST_SCORE).select("__row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, similarity 0.8): that
    with the smallest id, null ids last; of rows that repeat it, one.  Rows
    without words stay."""
    # numbers are written with their rows, since they depend on the scan
    rows = saved(worker.boxed(docs).withColumn("number", F.monotonically_increasing_id()))
    texts = rows.select("number", "__row.doc_id", "__row.text")
    found = saved(near_duplicates.near_duplicates(texts, "number").filter("n_shingles > 0").select("number", "component_id"))
    # only groups of several rows have a row that isn't named by its own number
    sizes = saved(found.groupBy("component_id").agg(F.count("*").alias("n")).filter("n > 1"))
    large = heavy(sizes, "component_id", "n")
    members = saved(spread_join(found, sizes, "component_id", F.col("number"), large).join(texts.select("number", "doc_id"), "number"))
    one = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "number"))["number"].alias("first"))
    gone = saved(spread_join(members, one, "component_id", F.col("number"), large).filter("number <> first").select("number"))
    return rows.join(gone, "number", "left_anti").select("__row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the shares of mixing.WEIGHTS: a document is a row for each of
    its copies, or none.  A null source is one of its own, a text without
    words has size 0 and takes part like others, a source without words has no
    copies, rows that repeat take part each; empty in, empty out."""
    sized = worker.boxed(docs, "doc_id", "source", mixing.word_count().alias("size"))
    return mixing.emit(mixing.with_copies(sized)).select("__row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all copies, packed into sequences.  A null or empty text
    is the end token alone; rows that repeat are packed each; empty in, empty
    out."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("near-duplicates", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]
#: SQL has neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the tables between them are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        last, docs = docs, saved(stage(spark, docs, sf_dir))
        if k:  # the first are the input
            drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)
