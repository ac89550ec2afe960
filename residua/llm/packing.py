"""Packing into length buckets whose bounds minimise padding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm.common import grouped_rank, n_words, read, settled, stored, without

BUCKETS = 12
TOKEN_BUDGET = 8192


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding, by dynamic programming.

    lengths: ascending. cost(i, j) of a bucket over lengths i..j is lengths[j] * rows - tokens. It meets the quadrangle inequality, so the
    best start of the last bucket never moves back as j grows: the starts of all j of a level are found by halving, each between those of its
    neighbours, in about D * log D steps for D lengths.
    """
    d = len(lengths)
    if d == 0:
        return []
    rows, tokens = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)]), np.concatenate([[0], np.cumsum(lengths.astype(np.float64) * counts)])
    k = min(buckets, d)
    best = lengths * rows[1:] - tokens[1:]
    cuts = [np.zeros(d, dtype=np.int64)]
    for _ in range(1, k):
        before, new, cut = np.concatenate([[0.0], best]), np.empty(d), np.zeros(d, dtype=np.int64)
        todo = [(0, d - 1, 0, d - 1)]
        while todo:  # the last bucket starts after length i - 1; i = 0: it holds all
            lo, hi, first, last = todo.pop()
            j = (lo + hi) // 2
            i = np.arange(first, min(j, last) + 1)
            total = before[i] + lengths[j] * (rows[j + 1] - rows[i]) - (tokens[j + 1] - tokens[i])
            at = int(np.argmin(total))
            cut[j], new[j] = i[at], total[at]
            if lo < j:
                todo.append((lo, j - 1, first, int(cut[j])))
            if j < hi:
                todo.append((j + 1, hi, int(cut[j]), last))
        best = new
        cuts.append(cut)
    bounds, j = [], d - 1
    for cut in reversed(cuts):
        bounds.append(int(lengths[j]))
        j = int(cut[j]) - 1
        if j < 0:
            break
    return sorted(bounds)


def pack(sizes: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """(doc_id, n_tokens, ...) with bucket_len, bucket, batch, place.

    The histogram of exact lengths is all that reaches the driver: at most a row per length up to the longest, and no more than the square
    root of twice the corpus's tokens. Rows without n_tokens count as empty. Documents of a
    bucket stand by length, then doc_id, and fill batches of floor(budget / bucket_len) rows (1 at least: a document over
    the budget is a batch of its own); each row of a batch is padded to bucket_len. A bucket that holds most documents is ranked over
    many tasks. Documents without tokens go to the first bucket. Nothing is dropped or cut. Columns named like those that are
    added are replaced. Empty table: empty result.
    """
    return settled(sizes.sparkSession, lambda: _pack(sizes, buckets, budget), "packed")


def _pack(sizes: DataFrame, buckets: int, budget: int) -> DataFrame:
    sizes = without(sizes, ["bucket_len", "bucket", "batch", "place", "_rank"])
    t, _ = stored(sizes.withColumn("n_tokens", F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long"))), "lengths")
    hist = sorted((r[0], r[1]) for r in t.groupBy("n_tokens").count().collect())
    bounds = best_bounds(np.array([x for x, _ in hist], dtype=np.int64), np.array([n for _, n in hist], dtype=np.int64), buckets)
    limits = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(0).cast("long"))
    t = t.withColumn("bucket", F.size(F.filter(limits, lambda b: b < F.col("n_tokens"))).cast("int")).withColumn("bucket_len", F.element_at(limits, F.col("bucket") + 1))
    ranked = grouped_rank(t, ["bucket"], [F.col("n_tokens").asc(), F.col("doc_id").asc_nulls_first()], "_rank")
    cap = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1).cast("long"))))
    return ranked.withColumn("batch", F.floor(F.col("_rank") / cap).cast("long")).withColumn("place", (F.col("_rank") % cap).cast("long")).drop("_rank")


def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch, place, padding of all documents; tokens are words.

    Null, empty and blank texts have none. Repeated ids and rows: a place each. Empty table: empty result. Other columns don't matter.
    """
    t = pack(read(spark, sf_dir, "documents").select("doc_id", n_words(F.col("text")).alias("n_tokens")))
    return t.select("doc_id", "n_tokens", "bucket", "bucket_len", "batch", "place", (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
