"""Sequence files: FASTA folders, FASTA output, tab-separated search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("fasta", "fa", "fna", "faa")
HITS = "query string, target string, fident double, alnlen int, qcov double, tcov double"


def read_fasta(spark: SparkSession, folder: str) -> DataFrame:
    """(path, item_id, sequence) of all FASTA files of a folder; an empty folder is an error. Records are split inside the JVM."""
    t = spark.read.option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").option("lineSep", ">").text(folder).select(F.col("_metadata.file_path").alias("path"), "value")
    if t.isEmpty():
        raise ValueError(f"no FASTA files in {folder}")
    t = t.filter(F.trim("value") != "")
    head = F.split_part("value", F.lit("\n"), F.lit(1))
    body = F.regexp_replace(F.expr("substring(value, length(split_part(value, '\n', 1)) + 1)"), r"\s", "")
    return t.select("path", F.split_part(F.btrim(head, F.lit(" \r\t")), F.lit(" "), F.lit(1)).alias("item_id"), body.alias("sequence"))


def write_fasta(items: DataFrame, path: str) -> None:
    items.select(F.concat(F.lit(">"), "item_id", F.lit("\n"), "sequence").alias("value")).write.mode("overwrite").text(path)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Search results as (query, target, score, coverage, line_no): score is the identity, coverage the lesser of both."""
    t = spark.read.schema(HITS).option("sep", "\t").csv(path)
    return t.select("query", "target", F.col("fident").alias("score"), F.least("qcov", "tcov").alias("coverage"), F.monotonically_increasing_id().alias("line_no"))
