"""A training corpus from ``documents``: rules, classifier, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns the columns of ``docs`` (the last:
the places in batches). ``run`` writes each result as Parquet and reads it again. Columns of any name pass through: stages
keep them in one struct beside what they add.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm import importance, jaccard, mixing, packing, rules
from residua.llm.common import bounded, delete, n_words, read, scratch, settled, stored

#: Near duplicates: words in a shingle and least similarity in percent.
SHINGLE, PERCENT = 5, 80
ORACLE_SQL = None


def _kept_whole(docs: DataFrame, *used: str) -> DataFrame:
    """The columns a stage works on, and all columns of ``docs`` as the struct _row."""
    return docs.select(*used, F.struct(*[docs[c] for c in docs.columns]).alias("_row"))


def _ids_will_do(docs: DataFrame) -> bool:
    """Whether no doc_id is null or repeated, so that rows can be told apart by it."""
    return docs.select("doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("doc_id is null or n > 1").isEmpty()


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the boosted trees keep. Null and empty texts go."""
    t = _kept_whole(docs, "doc_id", "text")
    return rules.judge(t, rules.train(docs, read(spark, sf_dir, "labels"))).filter("kept").select("_row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling towards those labelled good.

    Null texts weigh as empty ones. Where an id is null or repeated, whole rows are stored with their weights, else weights only.
    Empty table: empty result.
    """
    labels = read(spark, sf_dir, "labels")
    if _ids_will_do(docs):
        gone = settled(spark, lambda: importance.resample(docs.select("doc_id", "text"), labels).filter("not _kept").select("doc_id"), "rejected")
        return docs.join(bounded(gone, 1_000_000), "doc_id", "left_anti").select(docs.columns)
    t = importance.resample(_kept_whole(docs, "doc_id", "text"), labels, store_text=True)
    return t.filter("_kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: the one with the smallest doc_id.

    Where an id is null or repeated, rows get ids of their own first, so that one row stays all the same.
    """
    if _ids_will_do(docs):
        found = settled(spark, lambda: jaccard.linked(docs, SHINGLE, PERCENT).filter("component_id < doc_id").select("doc_id"), "duplicates")
        return docs.join(bounded(found, 1_000_000), "doc_id", "left_anti").select(docs.columns)
    t, _ = stored(docs.select(F.monotonically_increasing_id().alias("_id"), "text", F.struct(*[docs[c] for c in docs.columns]).alias("_row")), "rows")
    found = settled(spark, lambda: jaccard.linked(t.select(F.col("_id").alias("doc_id"), "text"), SHINGLE, PERCENT).filter("component_id < doc_id").select(F.col("doc_id").alias("_id")), "duplicates")
    return t.join(bounded(found, 1_000_000), "_id", "left_anti").select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the systematic sample of its source takes it: not at all, or up to three times.

    Sizes are ranked without the texts, and the numbers of copies are joined to them; where an id is null or repeated, whole rows are ranked.
    Null text: size 0. Null source: a source of its own. Rows equal in size and id are interchangeable. Empty table: empty result.
    """
    row, size = F.struct(*[docs[c] for c in docs.columns]).alias("_row"), n_words(F.col("text")).alias("_size")
    if _ids_will_do(docs):
        copies = settled(spark, lambda: mixing.mix(docs.select("doc_id", "source", size)).filter("_copies > 0").select("doc_id", "_copies"), "copies")
        t = docs.select("doc_id", row).join(bounded(copies, 1_000_000), "doc_id")
    else:
        t = mixing.mix(docs.select("doc_id", "source", size, row)).filter("_copies > 0")
    return t.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's bucket, batch and place, a row each for repeated rows. Null text: no tokens. Empty table: empty result."""
    t = packing.pack(docs.select("doc_id", n_words(F.col("text")).alias("n_tokens")))
    return t.select("doc_id", "n_tokens", "bucket", "bucket_len", "batch", "place")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as paths:
            docs, path = stored(stage(spark, docs, sf_dir), f"stage-{name}")
            paths.remove(path)
        if last is not None:
            delete(spark, last)
        last = path
    return docs
