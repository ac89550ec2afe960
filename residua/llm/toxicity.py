"""Toxicity: a counterfactually regularised linear classifier over word parts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residua.llm.arrow import ROWS, appended, labelled_sample
from residua.llm.common import read

BITS = 18
#: Labelled documents of each class used for fitting, at most.
SAMPLE = 12_000
#: Word parts that the classifier keeps: those most unlike between the classes, and all parts of identity terms.
KEPT = 6_000
#: Least difference of a kept part's rates, in standard errors (of 2 ** BITS parts, about 16 differ so much by chance); penalties on squared and
#: absolute weights.
LEAST_Z, L2, L1 = 4.0, 2e-5, 1e-4
#: Weight of the squared change in score when an identity term is swapped.
COUNTERFACTUAL = 5.0
#: Terms that name a group, in sets within which one can stand for another.
IDENTITY = (
    ("muslim", "christian", "jewish", "buddhist", "hindu", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "buddhists", "hindus", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "african", "european", "american", "arab"),
    ("woman", "man", "girl", "boy", "female", "male", "nonbinary", "transgender"),
    ("women", "men", "girls", "boys", "females", "males"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual", "homosexual"),
    ("immigrant", "refugee", "native", "foreigner", "citizen"),
    ("immigrants", "refugees", "natives", "foreigners", "citizens"),
    ("blind", "deaf", "disabled", "elderly", "young", "old"),
    ("mexican", "chinese", "indian", "german", "french", "spanish", "russian", "turkish"),
)
#: Words that name no group; any identity term may be swapped for them.
PLAIN = ("person", "people")
#: Words around an identity term in the neutral sentences that counterfactuals are also drawn from.
NEUTRAL = ("the", "people", "community", "is", "are", "my", "friend", "neighbour", "and", "with", "group", "of", "we", "met", "a", "person", "who", "proud", "to", "be")
_WORD = re.compile(r"[^\W_]+")


class Parts(dict):
    """Word -> features: the word, its first 4 to 7 letters where longer, its last 4 and 5; forgotten at half a million words."""

    def __missing__(self, word: str) -> np.ndarray:
        if len(self) >= 500_000:
            self.clear()
        names = [f"={word}"] + [f"^{word[:k]}" for k in (4, 5, 6, 7) if len(word) >= k] + [f"{word[-k:]}$" for k in (4, 5) if len(word) > k]
        self[word] = out = np.unique(np.array([xxhash.xxh32_intdigest(x) & ((1 << BITS) - 1) for x in names], dtype=np.int64))
        return out


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(text: str, parts: Parts) -> np.ndarray:
    """Distinct features of the whole text."""
    found = [parts[w] for w in words(text)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)


@dataclass(frozen=True)
class Linear:
    """Score = sigmoid(bias + sum of the weights of the features that occur)."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.features] = self.weights
        return out


def swaps(found: set[str], parts: Parts) -> list[np.ndarray]:
    """For each identity term of a sentence and each that can stand for it: features that come and go, as (feature, +1 or -1)."""
    out = []
    for group in IDENTITY:
        for a in group:
            if a in found:
                rest = features(" ".join(found - {a}), parts)
                fa = np.setdiff1d(parts[a], rest)
                for b in (*group, *PLAIN):
                    if b != a:
                        fb = np.setdiff1d(parts[b], rest)
                        out.append(np.stack([np.concatenate([fa, fb]), np.concatenate([-np.ones(len(fa)), np.ones(len(fb))]).astype(np.int64)]))
    return out


def changes(text: str, parts: Parts, place: np.ndarray) -> Counter[tuple[int, ...]]:
    """How often each change of kept features, as their places and then +1 or -1 of each, comes from the swaps of a text's lines."""
    out: Counter[tuple[int, ...]] = Counter()
    for line in text.split("\n"):
        for d in swaps(words(line), parts):
            near = np.stack([place[d[0]], d[1]])[:, place[d[0]] >= 0]
            if near.size:
                out[tuple(near.ravel().tolist())] += 1
    return out


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, label: str = "toxic", rows: int = SAMPLE, counterfactual: float = COUNTERFACTUAL) -> Linear:
    """Fits on at most ``rows`` labelled documents of each class among the label rows that meet ``where``.

    First pass: each task counts, per feature, the documents of either class that have it; 2 ** BITS counts come to the driver,
    which keeps the KEPT features whose rates differ most, and those of identity terms. Second pass: the documents' kept features and, for identity terms in
    them, the changes that swapping one brings. Then logistic loss with an L2 penalty plus ``counterfactual`` times the squared
    change in log-odds of every swap is brought down by full-batch Adam, on the driver, over bounded arrays.
    """
    ids = labelled_sample(labels, label, rows, where)
    t = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("y", "text")
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, got = Parts(), np.zeros((2, size), dtype=np.int64)
        n = [0, 0]
        for batch in batches:
            for y, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got[y, features(s or "", parts)] += 1
                n[y] += 1
        at = np.flatnonzero(got.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(got[0, at], n[0])), pa.array(np.append(got[1, at], n[1]))], names=["f", "n0", "n1"])

    c = np.zeros((2, size))
    n = [0, 0]
    for f, a, b in t.mapInArrow(count, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0"), F.sum("n1")).filter("f < 0 or `sum(n1)` + `sum(n0)` >= 3").collect():
        if f < 0:
            n = [a, b]
        else:
            c[:, f] = a, b
    if not n[0] or not n[1]:
        return Linear(np.empty(0, dtype=np.int64), np.empty(0), float(np.log((n[1] + 0.5) / (n[0] + 0.5)) if n[0] + n[1] else -2.0))
    p = (c + 0.5) / (np.array(n)[:, None] + 1)
    mean = (c.sum(axis=0) + 0.5) / (sum(n) + 1)
    z = (p[1] - p[0]) / np.sqrt(mean * (1 - mean) * (1 / n[0] + 1 / n[1]))
    keep = np.sort(np.argsort(-np.abs(z), kind="stable")[:KEPT])
    keep = keep[np.abs(z[keep]) > LEAST_Z]
    named = Parts()
    keep = np.union1d(keep, np.concatenate([named[a] for g in (*IDENTITY, PLAIN) for a in g]))
    place = np.full(size, -1, dtype=np.int64)
    place[keep] = np.arange(len(keep))

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts()
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                xs, cf = [], []
                for s in part.column(1).to_pylist():
                    found = place[features(s or "", parts)]
                    xs.append(found[found >= 0])
                    cf.append([[n, *d] for d, n in sorted(changes(s or "", parts, place).items())])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(xs, type=pa.list_(pa.int32())), pa.array(cf, type=pa.list_(pa.list_(pa.int32())))], names=["y", "x", "cf"])

    got = sorted(((r[0], tuple(r[1]), tuple(map(tuple, r[2]))) for r in t.mapInArrow(restrict, "y int, x array<int>, cf array<array<int>>").collect()))
    y = np.array([r[0] for r in got], dtype=np.float64)
    cols = np.concatenate([np.array(r[1], dtype=np.int64) for r in got])
    rows_ = np.repeat(np.arange(len(got)), [len(r[1]) for r in got])
    parts = Parts()
    seen: Counter[tuple[int, ...]] = Counter()  # equal changes once, with how often they occur
    for r in got:
        for n, *d in r[2]:
            seen[tuple(d)] += n
    # half of the penalty is on swaps in labelled texts, as often as they occur, half on those in neutral sentences, so that no term goes free
    share = 0.5 if seen else 0.0
    times: Counter[tuple[int, ...]] = Counter({d: share * n / sum(seen.values()) for d, n in seen.items()})
    plain: Counter[tuple[int, ...]] = Counter()
    for near in (np.stack([place[d[0]], d[1]])[:, place[d[0]] >= 0] for g in IDENTITY for a in g for d in swaps({a, *NEUTRAL}, parts)):
        if near.size:
            plain[tuple(near.ravel().tolist())] += 1
    for d, n in plain.items():
        times[d] += (1 - share) * n / sum(plain.values())
    deltas = [np.array(d, dtype=np.int64).reshape(2, -1) for d in times]
    often = np.array(list(times.values()), dtype=np.float64)
    d_rows = np.repeat(np.arange(len(deltas)), [d.shape[1] for d in deltas]) if deltas else np.empty(0, dtype=np.int64)
    d_cols, d_sign = (np.concatenate([d[0] for d in deltas]), np.concatenate([d[1] for d in deltas]).astype(float)) if deltas else (np.empty(0, dtype=np.int64), np.empty(0))
    m, docs_n = len(keep), len(y)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, bias = np.zeros(m + 1), 0.0
    mom, var = np.zeros(m + 1), np.zeros(m + 1)
    for step in range(1, 401):
        logit = np.bincount(rows_, w[cols], docs_n) + w[m]
        err = weight * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y)
        grad = np.append(np.bincount(cols, err[rows_], m), err.sum())
        grad[:m] += L2 * w[:m] + L1 * np.sign(w[:m])
        if len(deltas):
            change = np.bincount(d_rows, w[d_cols] * d_sign, len(deltas))
            grad[:m] += counterfactual * 2 / often.sum() * np.bincount(d_cols, (often * change)[d_rows] * d_sign, m)
        mom = 0.9 * mom + 0.1 * grad
        var = 0.999 * var + 0.001 * grad**2
        w -= 0.05 * (mom / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-9)
    bias = float(w[m])
    # the classes weighed alike in the loss; even odds go where most sampled documents are put right, into the widest such gap
    value, at = np.unique(np.bincount(rows_, w[cols], docs_n) + bias, return_inverse=True)
    gain = np.bincount(at, np.where(y == 1, -1.0, 1.0), len(value))
    right = np.concatenate([[0.0], np.cumsum(gain)])
    ends = np.concatenate([[value[0] - 1], value, [value[-1] + 1]])
    gap = np.where(right >= right.max() - 0.5, np.diff(ends), -1.0)
    cut = int(np.argmax(gap))
    return Linear(keep, w[:m], bias - float((ends[cut] + ends[cut + 1]) / 2))


def score(docs: DataFrame, model: Linear, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with the score of each whole text and 1 where it is 0.5 or more; null or empty text scores by the bias alone.

    A word's weight is the sum of its parts' weights. Parts that several words of a text share count once.
    """
    table = model.table()
    live = table != 0
    cache: dict[str, np.ndarray] = {}
    parts = Parts()

    def make(texts: list[str]) -> list:
        out = []
        for s in texts:
            found = []
            for word in words(s):
                got = cache.get(word)
                if got is None:
                    if len(cache) >= 500_000:
                        cache.clear()
                        parts.clear()
                    fs = parts[word]
                    got = cache[word] = fs[live[fs]]
                if len(got):
                    found.append(got)
            out.append(table[np.unique(np.concatenate(found))].sum() if found else 0.0)
        p = 1 / (1 + np.exp(-np.clip(np.array(out) + model.bias, -40, 40)))
        return [p, (p >= 0.5).astype(np.int32)]

    return appended(docs, "text", [(names[0], T.DoubleType(), pa.float64()), (names[1], T.IntegerType(), pa.int32())], make)


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learnt from; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def op6_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents.

    Null or empty text: scored by the bias alone. Null ids: held out. Repeated rows: a row each. Without both classes among the labels that may be
    learnt from: one score for all. Empty table: empty result. Other columns don't matter.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
