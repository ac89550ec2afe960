"""Helpers shared by the training-data operators.

Intermediate tables go to the folder in ``spark.checkpoint.dir`` (all executors share it), so that a lost executor costs a
re-read and never a recomputation from data that only it held.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, for every operator of this subpackage: a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that go to Python at a time.
ARROW_ROWS = 1000
#: At most so many rows are broadcast after their number has been counted; beyond, the same join shuffles.
BROADCAST_ROWS = 100_000

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths that ``stored`` has written inside the innermost ``scratch``.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def work_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary folder in local mode, where all
    run on one machine; an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="residua-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/residua-llm"


def delete(spark: SparkSession, path: str) -> None:
    """Removes an intermediate table, in whichever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Writes ``df`` as Parquet in the work folder; returns the reread table and its path. Its shuffle files go at once."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    try:
        spark.conf.set(_CLEANUP, "true")
    except Exception:  # a session that forbids it merely keeps the files longer
        before = None
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes what ``stored`` writes inside it when it ends, but for paths taken off the list."""
    token = _WRITTEN.set(paths := [])
    try:
        yield paths
    finally:
        _WRITTEN.reset(token)
        for path in paths:
            delete(spark, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, stored; all other tables that it stores on the way are deleted once that is written."""
    with scratch(spark) as paths:
        out, path = stored(make(), name)
        paths.remove(path)
    if (outer := _WRITTEN.get()) is not None:
        outer.append(path)
    return out


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already stored, so that counting is cheap), marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def n_words(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Null-safe equality on all ``names``."""
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[n])
    return out


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without columns of these names, whatever their case: operators replace columns named like what they add."""
    gone = {n.lower() for n in names}
    return df.select(*[df[c] for c in df.columns if c.lower() not in gone])


def grouped_rank(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Adds ``name``, 0, 1, 2 ... within each group in the given order, without a window over a group.

    Rows are dealt out by range over (groups, order), sorted and written once; a row's place is its place in its partition's
    run of the group plus the group's rows in earlier partitions. A group with a third of all rows spreads over a third of
    the partitions. Rows that tie in everything get places in any order among themselves.
    """
    keys = [F.col(g).asc_nulls_last() for g in groups] + list(order)
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_gr_at", F.monotonically_increasing_id())
    t, _ = stored(dealt, "rank")
    t = t.withColumn("_gr_part", F.shiftright("_gr_at", 33))
    runs = t.groupBy(*groups, "_gr_part").agg(F.min("_gr_at").alias("_gr_first"), F.count(F.lit(1)).alias("_gr_rows"))
    before = Window.partitionBy(*groups).orderBy("_gr_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_gr_base", F.coalesce(F.sum("_gr_rows").over(before), F.lit(0))).drop("_gr_rows")
    runs, _ = stored(runs, "runs")
    runs = runs.toDF(*[f"_r_{c}" for c in runs.columns])
    on = t["_gr_part"] == runs["_r__gr_part"]
    for g in groups:
        on = on & t[g].eqNullSafe(runs[f"_r_{g}"])
    return t.join(bounded(runs), on, "inner").select(*[t[c] for c in df.columns], (F.col("_r__gr_base") + F.col("_gr_at") - F.col("_r__gr_first")).alias(name))


def kth_largest(df: DataFrame, key: str, k: int) -> int | None:
    """The k-th largest value of the long column ``key`` (None if k < 1; the smallest if k exceeds the rows).

    Radix selection: four counts over 65,536 bins at most, each narrowing to one bin of the last. Only counts come to the driver.
    """
    if k < 1:
        return None
    left, fixed = k, None
    for bits in (48, 32, 16, 0):
        part = df if fixed is None else df.filter(F.shiftright(key, bits + 16) == F.lit(fixed))
        bins = sorted(((r[0], r[1]) for r in part.groupBy(F.shiftright(key, bits).alias("b")).count().collect()), reverse=True)
        if not bins:
            return None
        for fixed, n in bins:  # noqa: B007
            if n >= left:
                break
            left -= n
        else:
            left = bins[-1][1]
    return fixed


def hot_keys(df: DataFrame, key: str, parts: int = 1000) -> DataFrame:
    """Keys that hold over 1/``parts`` of all rows, with their counts: fewer than ``parts`` rows, whatever the input."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    return stored(counts.filter(F.col("n") > max(total // parts, 100)), "hot")[0]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of whole texts; Python is handed fewer rows at a time than the default, as they can be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node that has an edge.

    The edges and all but the last labels are deleted. Every round hooks each component to the smallest label among its neighbours' labels and then jumps along labels, so the
    number of rounds grows with the logarithm of the longest path. All state is in written tables.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).filter("u <> v").distinct()
    both, edges_path = stored(both, "edges")
    labels, path = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "labels")
    for _ in range(most_rounds):
        lu, lv = labels.toDF("u", "lu"), labels.toDF("v", "lv")
        cross = both.join(lu, "u").join(lv, "v").filter("lv < lu").select("lu", "lv")
        hooks, hooks_path = stored(cross.groupBy("lu").agg(F.min("lv").alias("lv")), "hooks")
        if hooks.isEmpty():
            delete(spark, hooks_path)
            break
        # a hooked label may itself be hooked: follow, in the small table of labels, until nothing moves
        while True:
            nxt = hooks.toDF("lv", "to")
            jumped, jumped_path = stored(hooks.join(nxt, "lv", "left").select("lu", F.coalesce("to", "lv").alias("lv"), F.col("to").isNotNull().alias("moved")), "jump")
            moved = not jumped.filter("moved").isEmpty()
            delete(spark, hooks_path)
            hooks, hooks_path = jumped.select("lu", "lv"), jumped_path
            if not moved:
                break
        new, new_path = stored(labels.join(hooks.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        delete(spark, hooks_path)
        delete(spark, path)
        labels, path = new, new_path
    delete(spark, edges_path)
    return labels
