"""Structures as they arrive: a file stream, per-entry plans inside each micro-batch, an append store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from residua.sources import cif


def file_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """(path, content) of CIF files as they arrive."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.cif*").option("maxFilesPerTrigger", files_per_trigger).load(folder)


def ingest(files: DataFrame, store: str, checkpoint: str, plan: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None, available_now: bool = True) -> StreamingQuery:
    """Parses each micro-batch, applies ``plan`` to its tables and appends them under ``store``, one folder a table and batch.

    Every entry arrives whole in one file, so windows and joins by entry are those of a batch job. A batch writes to the folder of its
    number and overwrites it when it is run again, so a restart repeats nothing. Entries that arrive twice are told apart by ``latest``.
    """

    def batch(df: DataFrame, number: int) -> None:
        rows = cif.read_rows(df).persist()
        try:
            t = cif.tables(rows)
            for name, table in (plan(t) if plan else t).items():
                table.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{store}/{name}/batch_no={number}")
        finally:
            rows.unpersist()

    w = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def latest(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A table of the store with the rows of each entry's last batch."""
    t = spark.read.option("mergeSchema", "true").parquet(f"{store}/{name}").drop("batch_no")
    last = t.groupBy("entry_id").agg(F.max("batch").alias("batch"))
    return t.join(last, ["entry_id", "batch"], "left_semi").drop("batch")


def event_counts(events: DataFrame, watermark: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Tumbling counts over (ts, event_type) with late rows dropped beyond the watermark; for monitoring an ingest."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
