"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residua.llm.common import bounded, grouped_rank, n_words, read, settled, stored, without

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix"
#: Offsets that are tried for a source, evenly spaced from a random one.
OFFSETS = 32


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, ...) -> the same with target.

    Sources by code point, null last, weigh ``weights`` in turn. Targets share the sum of all sizes; a source stops at ``cap``
    times its size and what it can't take is shared by weight among the rest until none is above. That fixed point is
    ``least(cap, level * weight)`` with one level for all, found from running sums over the sources by cap / weight: sources
    before the level are full. The table has a row per source, so its windows are small.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size").cast("double") * cap).withColumn("full_at", F.col("cap") / F.col("w"))
    up = Window.orderBy("full_at", F.col("source").isNull(), F.col("source"))
    before, rest, everything = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(1))
    t = t.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"])
    return t.select(*sizes.columns, F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.lit(0.0))).alias("target"))


def mix(docs: DataFrame, seed: str = SEED, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``docs`` (doc_id, source, text or _size, any others) with _size, _source_size, _target and _copies.

    Every document's expected number of copies is target / source size of its source. Within a source, documents stand by size
    (ties by doc_id), first every other one upwards and then the rest downwards; the expected copies are summed up along that
    order, one offset in [0, 1) is added, and a document is emitted once for every whole number that the sum crosses at it. In that
    order the sample follows the sizes, and what an offset adds on the way up it takes on the way down. The offset is random, from
    the source's name and ``seed``, up to its choice among OFFSETS evenly spaced ones: the one whose words come nearest the target, so that
    a source with few documents isn't far off because its longest is in or out.

    Columns named like those that are added are replaced. Null text: size 0. Null source: a source of its own. A source without words has target 0. Rows equal in size and doc_id are
    interchangeable. Empty table: empty result.
    """
    return settled(docs.sparkSession, lambda: _mix(docs, seed, weights, cap), "mixed")


def _mix(docs: DataFrame, seed: str, weights: Sequence[int], cap: int) -> DataFrame:
    docs = without(docs, ["_source_size", "_target", "_copies", "_rank", "_n", "_s", "_u", "_k", "_rate"])
    t, _ = stored(docs if "_size" in docs.columns else docs.withColumn("_size", n_words(F.col("text"))), "sizes")
    sums, _ = stored(targets(t.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, cap), "targets")
    ranked = grouped_rank(t, ["source"], [F.col("_size").asc(), F.col("doc_id").asc_nulls_first()], "_rank")
    s = sums.toDF("_s", "_source_size", "_n", "_target")
    j = ranked.join(bounded(s), F.col("source").eqNullSafe(F.col("_s")), "inner").drop("_s")
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit(":"), "source"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    odd, half = F.col("_rank") % 2, F.floor(F.col("_rank") / 2).cast("long")
    j = j.withColumn("_rate", rate).withColumn("_u", u).withColumn("_rank", F.when(odd == 0, half).otherwise(F.col("_n") - 1 - half))

    def copies(offset: Column) -> Column:
        return (F.floor((F.col("_rank") + 1) * F.col("_rate") + offset) - F.floor(F.col("_rank") * F.col("_rate") + offset)).cast("long")

    def shifted(k: int) -> Column:
        v = F.col("_u") + F.lit(k / OFFSETS)
        return F.when(v >= 1.0, v - 1.0).otherwise(v)

    tried = j.groupBy("source").agg(F.first("_target").alias("t"), *[F.sum(copies(shifted(k)) * F.col("_size")).alias(f"w{k}") for k in range(OFFSETS)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{k}") - F.col("t")).alias("off"), F.lit(k).alias("k")) for k in range(OFFSETS)]))["k"]
    tried, _ = stored(tried.select(F.col("source").alias("_s"), best.alias("_k")), "offsets")
    j = j.join(bounded(tried), F.col("source").eqNullSafe(F.col("_s")), "inner")
    v = F.col("_u") + F.col("_k") / F.lit(float(OFFSETS))
    return j.withColumn("_copies", copies(F.when(v >= 1.0, v - 1.0).otherwise(v))).drop("_u", "_rate", "_rank", "_n", "_s", "_k")


def op3_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of all documents."""
    m = mix(read(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("_size")))
    return m.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").cast("long").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").alias("copies"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, (CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS w FROM s),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS full_at FROM w),
l AS (SELECT *, ((SELECT sum(size) FROM d)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY full_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY full_at, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, n, least(cap, coalesce((SELECT level FROM l WHERE level <= full_at ORDER BY full_at, level LIMIT 1) * w, 0)) AS target FROM l),
r AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.n, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) - 1 AS up,
  CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('mix' || coalesce(':' || d.source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN up % 2 = 0 THEN up // 2 ELSE n - 1 - up // 2 END AS k FROM r),
o AS (SELECT p.*, j, CASE WHEN u + j / 32.0::DOUBLE >= 1 THEN u + j / 32.0::DOUBLE - 1 ELSE u + j / 32.0::DOUBLE END AS v FROM p, (SELECT unnest(range(32)) AS j)),
c2 AS (SELECT *, (floor((k + 1) * rate + v) - floor(k * rate + v))::BIGINT AS copies FROM o),
w2 AS (SELECT source, j, abs(sum(copies * size)::DOUBLE - first(target)) AS off FROM c2 GROUP BY source, j),
b2 AS (SELECT source, j FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY off, j) AS r FROM w2) WHERE r = 1)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c2 JOIN b2 ON c2.j = b2.j AND c2.source IS NOT DISTINCT FROM b2.source
"""
