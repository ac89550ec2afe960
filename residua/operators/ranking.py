"""Numbering rows in order without a window over everything, and cutting lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Per-partition offsets are broadcast up to this many rows (counted first); beyond, the same join shuffles.
FEW = 100_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage with a written table in the shared checkpoint folder, so that a lost executor costs a re-read only.

    Where spark.checkpoint.dir is unset: a temporary folder in local mode, an error on a cluster.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="residua-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/residua/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, order: Sequence[Column], groups: Sequence[str] = ()) -> DataFrame:
    """``df`` with 0, 1, 2 ... in the given order, within each group.

    Rows are range-partitioned by (groups, order), sorted and written; a row's number is its place in its partition's run of the group
    plus the rows of the group in earlier partitions. No task holds a group, and no window runs over one.
    """
    keys = [F.col(g).asc_nulls_last() for g in groups] + list(order)
    t = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    t = t.withColumn("_part", F.shiftright("_at", 33))
    runs = t.groupBy(*groups, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*(groups or [F.lit(1)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored(runs.withColumn("_base", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows"), "runs")
    runs = runs.toDF(*[f"_r{c}" for c in runs.columns])
    on = t["_part"] == runs["_r_part"]
    for g in groups:
        on = on & t[g].eqNullSafe(runs[f"_r{g}"])
    small = F.broadcast(runs) if runs.limit(FEW + 1).count() <= FEW else runs
    return t.join(small, on, "inner").select(*[t[c] for c in df.columns], (F.col("_r_base") + F.col("_at") - F.col("_r_first")).alias(name))
