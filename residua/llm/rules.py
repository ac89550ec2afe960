"""Quality rules: document statistics and gradient-boosted trees over them."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residua.llm.arrow import appended, labelled_sample
from residua.llm.common import WORD, read

#: Labelled rows of each class that the trees are fitted on at most.
SAMPLE = 10_000
#: Share of the labelled good documents that may score under the cut.
MISSED = 0.002
_WORD = re.compile(WORD)
_SYMBOLS = "#*$%&|<>"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees, with the direction in which the score may move as one grows (0: either).
FEATURES = (("mean_length", 0), ("symbols_per_word", -1), ("dup_line_share", -1), ("repeat_share", -1), ("upper_share", -1), ("exclaims_per_word", -1), ("stops_per_word", 0), ("distinct_share", 0), ("words_per_line", 0), ("log_words", 0), ("longest_word", -1), ("digit_share", 0))


def repeated_words(words: list[str]) -> tuple[int, int]:
    """Words that lie in a 3-word window found at least twice, each counted once; and the number of distinct words."""
    seen: dict[str, int] = {}
    a = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    m, n = len(seen), len(a)
    if n < 4 or m == n:
        return 0, m
    _, inv, counts = np.unique((a[:-2] * m + a[1:-1]) * m + a[2:], return_inverse=True, return_counts=True)
    twice = counts[inv] > 1
    if not twice.any():
        return 0, m
    cover = np.zeros(n, dtype=bool)
    for k in range(3):
        cover[k : n - 2 + k] |= twice
    return int(cover.sum()), m


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The five base counts and the features of one whole text."""
    words = _WORD.findall(text)
    n = len(words)
    if not n:
        return [0, 0, sum(map(text.count, _SYMBOLS)), 0, 0], [0.0] * len(FEATURES)
    lengths = list(map(len, words))
    chars, symbols = sum(lengths), sum(map(text.count, _SYMBOLS))
    repeats, distinct = repeated_words(words)
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line in seen:
            dups += 1
        elif _WORD.search(line):
            lines += 1
            seen.add(line)
    lines += dups
    base = [n, chars, symbols, dups, repeats]
    return base, [chars / n, symbols / n, dups / lines, repeats / n, sum(map(str.isupper, words)) / n, text.count("!") / n, (text.count(".") + text.count(",")) / n, distinct / n, n / lines, float(np.log1p(n)), float(max(lengths)), sum(map(str.isdigit, words)) / n]


@dataclass(frozen=True)
class Trees:
    """All trees as flat node arrays; a leaf points to itself. Node k goes left if feature[k] <= threshold[k]."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float
    cut: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds for every row, all trees stepped down at once."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Boosts the logistic loss with second-order histogram trees.

    A feature with sign s never splits so that the side with larger values scores against s, and every node's value stays
    within the bounds that the constrained splits above it set, so the whole score is monotonic in that feature.
    """
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.array([]) for j in range(d)]
    b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if n else np.zeros((0, d), dtype=np.int64)
    p0 = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    score = np.full(n, base := float(np.log(p0 / (1 - p0))))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        k = len(feature)
        for a, z in zip((feature, threshold, left, right, value), (0, np.inf, k, k, v), strict=True):
            a.append(z)
        return k

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(node(0.0))
        step = np.zeros(n)
        open_ = [(roots[-1], np.arange(n), -np.inf, np.inf, 0)]
        while open_:
            k, rows, lo, hi, level = open_.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            v = float(np.clip(-gs / (hs + ridge), lo, hi))
            value[k] = rate * v
            step[rows] = rate * v
            if level == depth or len(rows) < 4:
                continue
            best = (1e-6, None)
            for j in range(d):
                if not len(edges[j]):
                    continue
                gl = np.cumsum(np.bincount(b[rows, j], g[rows], len(edges[j]) + 1))[:-1]
                hl = np.cumsum(np.bincount(b[rows, j], h[rows], len(edges[j]) + 1))[:-1]
                vl, vr = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-(gs - gl) / (hs - hl + ridge), lo, hi)
                gain = -(gl * vl + (hl + ridge) * vl**2 / 2) - ((gs - gl) * vr + (hs - hl + ridge) * vr**2 / 2) + (gs * v + (hs + ridge) * v**2 / 2)
                gain[(hl < least) | (hs - hl < least) | (signs[j] * (vr - vl) < 0)] = -1
                c = int(np.argmax(gain))
                if gain[c] > best[0]:
                    best = (float(gain[c]), (j, c, float(vl[c]), float(vr[c])))
            if best[1] is None:
                continue
            j, c, vl, vr = best[1]
            feature[k], threshold[k] = j, float(edges[j][c])
            left[k], right[k] = node(0.0), node(0.0)
            mid = (vl + vr) / 2
            low, high = ((lo, hi), (lo, hi)) if not signs[j] else ((lo, mid), (mid, hi)) if signs[j] > 0 else ((mid, hi), (lo, mid))
            goes = b[rows, j] <= c
            open_ += [(left[k], rows[goes], *low, level + 1), (right[k], rows[~goes], *high, level + 1)]
        score += step
    return Trees(np.array(feature, dtype=np.int64), np.array(threshold, dtype=np.float64), np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), np.array(value, dtype=np.float64), np.array(roots, dtype=np.int64), depth, base)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE) -> Trees:
    """Trees for ``label`` from at most ``rows`` labelled documents of each class; only their features come to the driver.

    The cut is the score under which a share MISSED of the good documents lies, and never above even odds, so that clean documents stay.
    Without both classes the trees are none and everything passes.
    """
    ids = labelled_sample(labels, label, rows)
    t = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("y", "text")
    got = appended(t, "text", [("_x", T.ArrayType(T.DoubleType()), pa.list_(pa.float64()))], lambda texts: [[statistics(s)[1] for s in texts]]).select("y", "_x").collect()
    y, x = np.array([r[0] for r in got], dtype=np.float64), np.array([r[1] for r in got], dtype=np.float64).reshape(len(got), len(FEATURES))
    if len(set(y.tolist())) < 2:
        return replace(fit(x[:0], y[:0], [s for _, s in FEATURES]), cut=-np.inf)
    order = np.lexsort((*x.T, y))  # the same trees in whatever order the rows came
    model = fit(x[order], y[order], [s for _, s in FEATURES])
    good = np.sort(model.margin(x[y == 1]))
    return replace(model, cut=min(0.0, float(good[int(MISSED * len(good))]) - 1e-9))


def judge(docs: DataFrame, model: Trees, names: list[str] | None = None) -> DataFrame:
    """``docs`` with the base counts, base_failed, the score and kept (``names`` renames the eight).

    Null or empty text: zeros, base_failed. Every row is judged by its own text alone, in one pass without a shuffle.
    """
    names = names or [*BASE, "base_failed", "score", "kept"]
    kinds = [(T.LongType(), pa.int64())] * 5 + [(T.BooleanType(), pa.bool_()), (T.DoubleType(), pa.float64()), (T.BooleanType(), pa.bool_())]

    def make(texts: list[str]) -> list:
        both = [statistics(s) for s in texts]
        base = np.array([b for b, _ in both], dtype=np.int64)
        failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
        margin = model.margin(np.array([x for _, x in both], dtype=np.float64))
        return [*base.T, failed, 1 / (1 + np.exp(-margin)), ~failed & (margin >= model.cut)]

    return appended(docs, "text", [(n, *k) for n, k in zip(names, kinds, strict=True)], make)


def op5_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed, score, kept of all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, train(docs, read(spark, sf_dir, "labels"))).drop("text")
