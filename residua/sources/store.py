"""Datasets and artifacts on disk: Parquet tables and small JSON files, through Spark's file systems."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

GRANULARITIES = ("structures", "chains", "interfaces", "residues")


def write_dataset(root: str, mode: str = "overwrite", **tables: DataFrame) -> None:
    """One Parquet folder per granularity."""
    for name, t in tables.items():
        if name not in GRANULARITIES:
            raise ValueError(f"unknown granularity: {name}")
        t.write.mode(mode).parquet(f"{root}/{name}.parquet")


def read_dataset(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def compact(value) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def digest(value) -> str:
    return hashlib.sha256(compact(value).encode()).hexdigest()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, in whichever store the path names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_artifact(root: str, splits: DataFrame, manifest: dict, provenance: dict) -> dict:
    """splits/<name>.parquet, manifest.json, provenance.json, checksums.json; returns the checksums."""
    from residua.operators.similarity import SPLITS, split_checksum

    spark = splits.sparkSession
    splits.write.mode("overwrite").partitionBy("split").parquet(f"{root}/splits")
    sums = {"splits": split_checksum(splits).first()[0], "manifest": digest(manifest), "provenance": digest(provenance), "names": list(SPLITS)}
    for name, value in (("manifest", manifest), ("provenance", provenance), ("checksums", sums)):
        write_text(spark, f"{root}/{name}.json", json.dumps(value, sort_keys=True, indent=1))
    return sums
