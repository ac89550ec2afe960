"""Quality classifier by importance resampling: ratios of hashed n-gram models, sampled by Gumbel top-k."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residua.llm.arrow import ROWS, appended, labelled_sample
from residua.llm.common import kth_largest, read, scratch, settled, stored, without

#: Buckets: ROOT times the square root of the characters of all texts, as different n-grams grow about so (131 thousand at 0.5 GB, 60 million at
#: 100 TB), at least LEAST, in whole slices. The first eighth is for 1-grams, the rest for 2-grams.
ROOT, LEAST, SLICE = 6.0, 1 << 14, 4096
#: N-grams that a task holds before it sums them by bucket.
HOLD = 1 << 20
#: Good labelled documents that the target model is counted from, at most.
SAMPLE = 20_000
#: The log weight from which on documents count towards k: that under which a share TAIL of the good documents lies, each weighed by a target
#: model that lacks it, less SLACK.
TAIL, SLACK = 0.001, 5.0
#: N-grams of a long text that count as independent: its log weight is its mean times this. None: all, so that the weight is the plain sum.
LENGTH = 256
#: N-grams that the raw model is worth in the target model, so that n-grams it has hardly seen count as neither good nor bad.
PRIOR = 20_000.0
SEED = 17
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """Token -> 64-bit hash, forgetting all when it holds a million tokens."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        self[token] = h = xxhash.xxh64_intdigest(token)
        return h


def ngrams(texts: list[str], known: Hashes, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all 1-grams, one text after another; each text's number of tokens; and buckets of all pairs of neighbours. No bucket has both."""
    lists = [_TOKEN.findall(s.lower()) for s in texts]
    n = np.array([len(x) for x in lists], dtype=np.int64)
    h = np.fromiter((known[w] for x in lists for w in x), dtype=np.uint64, count=int(n.sum()))
    first = buckets // 8
    one = (h % np.uint64(first)).astype(np.int64)
    two = np.empty(0, dtype=np.int64)
    if len(h) > 1:
        x = h[:-1] * _MUL + h[1:]
        x ^= x >> np.uint64(29)
        two = first + ((x * _MUL >> np.uint64(20)) % np.uint64(buckets - first)).astype(np.int64)
    return one, n, two


def sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of each text's run of ``values``."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


def size(docs: DataFrame) -> int:
    """Buckets of a model of ``docs``: they grow with the n-grams to count."""
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    return max(LEAST, SLICE * math.ceil(ROOT * math.sqrt(chars) / SLICE))


def counted(docs: DataFrame, good: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket is hit by all of ``docs``, and by those in ``good`` (doc_id), which must be bounded: it is broadcast.

    A task sends its sums in packed slices, those that have any; slices are summed by slice and come to the driver one partition
    after another.
    """
    t = docs.select("doc_id", "text").join(F.broadcast(good.select("doc_id").distinct().withColumn("_good", F.lit(True))), "doc_id", "left").select("text", F.coalesce("_good", F.lit(False)).alias("_good"))
    names = ["slice", "n", "good"]
    n_slices = -(-buckets // SLICE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, waiting = Hashes(), ([], []), 0
        total = np.zeros((2, n_slices * SLICE), dtype=np.int32)

        def summed() -> None:
            for x, of in zip(held, total, strict=True):
                if x:
                    at, n = np.unique(np.concatenate(x), return_counts=True)
                    of[at] += n.astype(np.int32)
                x.clear()

        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                texts, is_good = [x or "" for x in part.column(0).to_pylist()], np.array(part.column(1).to_pylist(), dtype=bool)
                one, n, two = ngrams(texts, known, buckets)
                of = np.repeat(is_good, n)
                held[0].append(one)
                held[1].append(one[of])
                if len(two):
                    ends = np.cumsum(n)[:-1]
                    inner = np.ones(len(two), dtype=bool)
                    inner[ends[(ends > 0) & (ends <= len(two))] - 1] = False  # pairs across two texts
                    held[0].append(two[inner])
                    held[1].append(two[inner & of[:-1]])
                waiting += len(one) + len(two)
                if waiting > HOLD:
                    summed()
                    waiting = 0
        summed()
        some = np.flatnonzero(total[0].reshape(n_slices, SLICE).any(axis=1))
        for k in some.tolist():
            at = slice(k * SLICE, (k + 1) * SLICE)
            yield pa.RecordBatch.from_arrays([pa.array([k], type=pa.int32()), *(pa.array([x[at].tobytes()], type=pa.binary()) for x in total)], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, *x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                got[k] = got.get(k, 0) + np.stack([np.frombuffer(y, dtype=np.int32) for y in x]).astype(np.int64)
        for k, x in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], type=pa.int32()), *(pa.array([y.tobytes()], type=pa.binary()) for y in x)], names=names)

    kinds = "slice int, n binary, good binary"
    raw, target = np.zeros(n_slices * SLICE, dtype=np.int64), np.zeros(n_slices * SLICE, dtype=np.int64)
    with scratch(docs.sparkSession):
        sums_, _ = stored(t.mapInArrow(count, kinds).repartition("slice").mapInArrow(add, kinds), "counts")
        for k, n, m in sums_.toLocalIterator():
            at = slice(k * SLICE, (k + 1) * SLICE)
            raw[at], target[at] = np.frombuffer(n, dtype=np.int64), np.frombuffer(m, dtype=np.int64)
    return raw[:buckets], target[:buckets]


def ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p(target) - log p(raw) of each bucket, from counts."""
    q = (raw + 1.0) / (raw.sum() + len(raw))
    p = target + PRIOR * q
    return np.log(p / p.sum()) - np.log(q)


def fit(docs: DataFrame, good: DataFrame, buckets: int | None = None) -> np.ndarray:
    """log p(target) - log p(raw) of each bucket; raw counts cover all of ``docs``, target counts the documents in ``good``."""
    return ratios(*counted(docs, good, buckets or size(docs)))


def without_each(docs: DataFrame, good: DataFrame, raw: np.ndarray, target: np.ndarray, length: int | None = LENGTH) -> np.ndarray:
    """The log weights, ascending, of the documents in ``good`` (bounded), each by a target model from which its own n-grams are taken."""
    model = docs.sparkSession.sparkContext.broadcast((raw, target))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        raw, target = model.value
        q, total = (raw + 1.0) / (raw.sum() + len(raw)), float(target.sum())
        for batch in batches:
            out = []
            for s in batch.column(0).to_pylist():
                one, _, two = ngrams([s or ""], known, len(raw))
                at, n = np.unique(np.concatenate([one, two]), return_counts=True)
                p = (target[at] - n + PRIOR * q[at]) / (total - n.sum() + PRIOR)
                out.append(float((n * (np.log(p) - np.log(q[at]))).sum()) * (min(1.0, length / max(n.sum(), 1)) if length else 1.0))
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.float64())], names=["w"])

    t = docs.select("doc_id", "text").join(F.broadcast(good.select("doc_id").distinct()), "doc_id").select("text")
    return np.sort(np.array([r[0] for r in t.mapInArrow(run, "w double").collect()], dtype=np.float64))


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = SEED, length: int | None = LENGTH, names: tuple[str, str, str] = ("log_weight", "gumbel_key", "_order")) -> DataFrame:
    """``docs`` with the log importance weight, that plus Gumbel noise, and the latter as a long in the same order.

    The log weight is the sum of log ratios over all n-grams of the whole text, scaled down to ``length`` of them where there are more
    (None: the plain sum): neighbouring n-grams of a long text don't testify independently, and unscaled sums would rank texts by their
    length.
    The noise is a hash of ``seed`` and doc_id, so reruns agree. Empty or null text: log weight 0.
    """
    buckets = len(ratio)
    model = docs.sparkSession.sparkContext.broadcast(ratio)
    known = Hashes()
    unit = (F.shiftright(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / F.lit(float(1 << 52))

    def make(texts: list[str]) -> list:
        one, n, two = ngrams(texts, known, buckets)
        ratio = model.value
        v = ratio[one]
        total = sums(v, n)
        if len(two):
            w = np.append(ratio[two], 0.0)  # w[i]: the pair that begins at token i
            ends = np.cumsum(n)[n > 0]
            w[ends - 1] = 0.0
            total = total + sums(w, n)
        return [total * np.minimum(1.0, length / np.maximum(2 * n - 1, 1)) if length else total]

    out = appended(docs, "text", [(names[0], T.DoubleType(), pa.float64())], make)
    out = out.withColumn(names[1], F.col(names[0]) - F.log(-F.log(unit)))
    return out.withColumn(names[2], F.floor(F.greatest(F.lit(-4.0e9), F.least(F.lit(4.0e9), F.col(names[1]))) * F.lit(1.0e9)).cast("long"))


def resample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, seed: int = SEED, length: int | None = LENGTH, store_text: bool = False) -> DataFrame:
    """``docs`` with _log_weight, _key, _kept: a sample without replacement, proportional to importance weights.

    The target is the documents labelled good (at most ``rows``), raw text is everything. k is the number of documents whose weight
    isn't under nearly all of the good ones (each of which is weighed for this without its own n-grams); the k largest keys are kept
    (rows that tie with the k-th as well). Without good documents all stay. Weights are stored; texts only with ``store_text``, else other columns than doc_id are left out.
    Null or empty text: log weight 0. Null ids share a noise value, as repeated ids do. Empty table: empty result.
    """
    spark = docs.sparkSession

    def make() -> DataFrame:
        good, _ = stored(labelled_sample(labels, "quality", rows).filter("y = 1").select("doc_id"), "good")
        slim = without(docs, ["_log_weight", "_key", "_order", "_kept"])
        raw, target = counted(slim, good, size(slim))
        names = ("_log_weight", "_key", "_order")
        t = weigh(slim, ratios(raw, target), seed, length, names) if store_text else weigh(slim.select("doc_id", "text"), ratios(raw, target), seed, length, names).drop("text")
        t, path = stored(t, "weights")
        seen = without_each(slim, good, raw, target, length)
        if not len(seen):
            return t.withColumn("_kept", F.lit(True)).drop("_order")
        k = t.filter(F.col("_log_weight") >= float(seen[int(TAIL * len(seen))]) - SLACK).count()
        least = kth_largest(t, "_order", k)
        return t.withColumn("_kept", F.col("_order") >= F.lit(least if least is not None else 0)).drop("_order")

    return settled(spark, make, "resampled")


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, log_weight, gumbel_key, kept of all documents.

    Null or empty text: log weight 0. Repeated or null ids: a row each, with the same noise. Rows whose keys tie with the last kept one are
    kept. Empty table: empty result. Other columns don't matter.
    """
    t = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return t.select("doc_id", F.col("_log_weight").alias("log_weight"), F.col("_key").alias("gumbel_key"), F.col("_kept").alias("kept"))
