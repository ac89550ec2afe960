"""N-gram Jaccard join by signature trees.

Plan, in passes over the texts and joins of small tables:

1. Every text's shingle set gets a size and a 64-bit digest; texts with equal sets form a class, and only classes go on. The same
   pass counts shingles into a sketch of fixed size.
2. Shingles are put in one global order, those in rarely hit sketch cells first, so that passages that many texts quote come
   last. Two sets that link share at least m of the first ``d + m`` shingles of either in any global order, where d is how
   many of its shingles a set may miss. These prefixes, with m about d, are dealt out by shingle, and only shingles that two classes
   share stay. Of shingles that the same classes have, one stays and counts for all. A class with fewer shared ones than any link needs
   goes, which takes the others down with it; it is done twice.
3. What is left shares much of its prefixes with something. Only these texts are read again, for whole sets and for bitmaps with
   several bits to a shingle.
4. In blocks of bounded size, candidates that share one of the first ``d + 1`` shingles stand in a signature tree whose nodes hold the
   OR of the bitmaps and the range of sizes; a traversal of node pairs drops those whose largest possible overlap can't reach the
   threshold, and those that lie in one component already. The first round puts each class in its largest group only and proposes
   a spanning forest of each block, so that most groups of near copies become one component; a second does the same for one member
   of each component of groups over one block; the last proposes every remaining pair of different components, with the
   pairs of blocks of a large group that sizes let link.
5. Proposed pairs are verified on the whole sets, and components are built from the links.

So each link is either verified or lies inside a component that verified links already join: components are exact, but for
collisions of 64-bit hashes (about N * N / 2**65 for N classes or for the shingles of two sets).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm.common import bounded, components, delete, read, settled, stored

#: Words in a shingle and least similarity in percent of op7_signature_trees; stages use 5 and 80.
SHINGLE, PERCENT = 4, 85
SKETCH_BITS, SLICE = 18, 4096
#: Members of a block, rows of a leaf page of a tree, children of a node.
BLOCK, PAGE, FAN = 512, 8, 4
#: Postings of a shingle that a task holds to tell whether another shingle has the same.
FOLD = 4096
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Hashes(dict):
    """Word -> 64-bit hash, forgetting all when it holds half a million."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str], k: int, known: Hashes) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending: of k words, or of the whole sequence where it has fewer.

    In UTF-8, lower() of bytes changes A-Z alone and split() parts at the six ASCII white-space characters alone.
    """
    lists = [s.encode().lower().split() for s in texts]
    n = [len(x) for x in lists]
    h = np.fromiter((known[w] for x in lists for w in x), dtype=np.uint64, count=sum(n))
    runs = max(0, len(h) - k + 1)
    acc = h[:runs].copy()
    for j in range(1, k):
        acc = mixed(acc * _A + h[j : runs + j])
    out, at = [], 0
    for m in n:
        if m >= k:
            x = np.sort(acc[at : at + m - k + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif m:
            v = np.full(1, m, dtype=np.uint64)
            for w in h[at : at + m]:
                v = mixed(v * _A + w)
            out.append(v)
        else:
            out.append(np.empty(0, dtype=np.uint64))
        at += m
    return out


def digest(s: np.ndarray) -> int:
    """Class of a set: 64 bits, as a signed long."""
    return int(mixed(np.array([mixed(s ^ _A).sum() + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def profile(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text) -> a row (doc_id, n, cls) per document, and per task the sketch in slices (slice, counters)."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Hashes(), np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        ids = None
        for batch in batches:
            ids = batch.column(0)
            for j in range(0, batch.num_rows, 512):
                part = batch.slice(j, 512)
                sets = shingles([x or "" for x in part.column(1).to_pylist()], k, known)
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                m = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], type=pa.int64()), pa.array(map(digest, sets), type=pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=["doc_id", "n", "cls", "slice", "counters"])
        if ids is not None and total.any():
            cut = np.minimum(total, 2**31 - 1).astype(np.int32).reshape(-1, SLICE)
            m = len(cut)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, ids.type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(range(m), type=pa.int32()), pa.array([c.tobytes() for c in cut], type=pa.binary())], names=["doc_id", "n", "cls", "slice", "counters"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, n long, cls long, slice int, counters binary")


def levels(parts: DataFrame) -> np.ndarray:
    """The place of each sketch cell in the global order: the binary logarithm of its count. Cells come to the driver: a fixed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got[k] = got.get(k, 0) + np.frombuffer(c, dtype=np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(got), type=pa.int32()), pa.array([np.log2(1 + v).astype(np.uint8).tobytes() for v in got.values()], type=pa.binary())], names=["slice", "level"])

    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    for k, v in parts.repartition((1 << SKETCH_BITS) // SLICE, "slice").mapInArrow(run, "slice int, level binary").collect():
        out[k * SLICE : (k + 1) * SLICE] = np.frombuffer(v, dtype=np.uint8)
    return out


def missable(n: int, percent: int) -> int:
    """How many of its n shingles a set may miss in one that it links with."""
    return n - -(-percent * n // 100)


def wanted(n: int, percent: int) -> int:
    """How many shingles of its prefix a set of n shares at least with any that it links with (which has percent of its size or more)."""
    return max(1, missable(-(-percent * n // 100), percent))


def prefixes(docs: DataFrame, k: int, percent: int, level: np.ndarray) -> DataFrame:
    """(h, cls, v): the prefix of every class that can link to another one; v is 2 * ``wanted``, plus 1 for the first d + 1 shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Hashes = Hashes()
        seen: set[int] = set()
        for batch in batches:
            for j in range(0, batch.num_rows, 512):
                hs, cs, vs = [], [], []
                for s in shingles([x or "" for x in batch.column(0).slice(j, 512).to_pylist()], k, known):
                    n = len(s)
                    if 100 * n < percent * (n + 1) or (c := digest(s)) in seen:
                        continue
                    seen.add(c)
                    d = missable(n, percent)
                    first = np.lexsort((s, level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))[: d + max(1, d)]
                    v = np.full(len(first), 2 * wanted(n, percent), dtype=np.int32)
                    v[: d + 1] += 1
                    hs.append(s[first])
                    vs.append(v)
                    cs.append(np.full(len(first), c, dtype=np.int64))
                if len(seen) > 1_000_000:
                    seen.clear()
                if hs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(cs)), pa.array(np.concatenate(vs))], names=["h", "cls", "v"])

    return docs.select("text").mapInArrow(run, "h long, cls long, v int")


def shared(rows: DataFrame) -> DataFrame:
    """(h, cls, v) -> (h, cls, v, g, lead) of the h that at least two classes have, each row once.

    g is a hash of all members and flags of h's group, and ``lead`` marks its first row, so that groups with the same members can be
    told by (g, cls) of their leads. One exchange by h; a partition is read as a stream, of which a group of up to FOLD rows is held:
    a longer one goes on with a g of its own.
    """

    def rows_of(h: np.ndarray, c: np.ndarray, v: np.ndarray, g: np.ndarray, lead: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(v), pa.array(g.view(np.int64)), pa.array(lead)], names=["h", "cls", "v", "g", "lead"])

    def groups(h: np.ndarray, c: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        """Whole groups."""
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count = np.diff(np.append(starts, len(h)))
        g = mixed(np.add.reduceat(mixed(c.view(np.uint64) * _A + (v & 1).astype(np.uint64) + np.uint64(1)), starts) + count.astype(np.uint64))
        lead = np.zeros(len(h), dtype=bool)
        lead[starts] = True
        keep = np.repeat(count > 1, count)
        return rows_of(h[keep], c[keep], v[keep], np.repeat(g, count)[keep], lead[keep])

    def own(h: np.ndarray) -> np.ndarray:
        return mixed(h.view(np.uint64) ^ _C)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)]  # the last group, until it is whole
        long = None  # (h, last class) of a group over FOLD that goes on
        for batch in batches:
            h, c, v = (np.concatenate([x, batch.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate(held))
            if not len(h):
                continue
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            if long is not None:
                new &= (h != long[0]) | (c != long[1])
            h, c, v = h[new], c[new], v[new]
            if long is not None:
                n = int(np.searchsorted(h != long[0], True)) if len(h) else 0
                if n:
                    yield rows_of(h[:n], c[:n], v[:n], own(h[:n]), np.zeros(n, dtype=bool))
                    long = (long[0], c[n - 1])
                h, c, v = h[n:], c[n:], v[n:]
                if len(h):
                    long = None
            if not len(h):
                held = [h, c, v]
                continue
            cut = int(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))[-1])
            if cut:
                yield groups(h[:cut], c[:cut], v[:cut])
            held = [h[cut:], c[cut:], v[cut:]]
            if len(held[0]) > FOLD:
                h, c, v = held
                lead = np.zeros(len(h), dtype=bool)
                lead[0] = True
                yield rows_of(h, c, v, own(h), lead)
                long, held = (h[-1], c[-1]), [x[:0] for x in held]
        if len(held[0]) > 1:
            yield groups(*held)

    return rows.repartition("h").sortWithinPartitions("h", "cls").mapInArrow(run, "h long, cls long, v int, g long, lead boolean")


def folded_groups(t: DataFrame) -> DataFrame:
    """What ``shared`` gives -> (h, cls, v, w): of groups with the same members and flags one, w: how many there are."""
    one = t.filter("lead").groupBy("g", "cls").agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("w")).select("h", "w")
    return t.select("h", "cls", "v").join(one, "h")


def pruned(post: DataFrame) -> DataFrame:
    """``post`` without the classes that share fewer shingles than any link needs, and then without shingles of one class."""
    enough = post.groupBy("cls").agg(F.sum("w").alias("n"), F.max(F.shiftright("v", 1)).alias("least")).filter("n >= least").select("cls")
    t = stored(post.join(enough, "cls", "left_semi"), "postings")[0]
    live = t.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    return t.join(live, "h", "left_semi")


def told_apart(post: DataFrame) -> DataFrame:
    """(h, cls) -> the same, of groups with two members or more, and one of those with the same members."""
    x, y = F.xxhash64("cls"), F.xxhash64("cls", F.lit(1))
    of = post.groupBy("h").agg(F.bit_xor(x).alias("x"), F.bit_xor(y).alias("y"), F.min("cls").alias("least"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    return post.join(of.groupBy("x", "y", "least", "size").agg(F.min("h").alias("h")).select("h", "size"), "h")


def bitmap(s: np.ndarray) -> bytes:
    """Shingles by their low bits, in a power of two of bits that is at least 4 to a shingle; halves can be folded together."""
    width = max(64, 1 << (4 * len(s) - 1).bit_length())
    bits = np.zeros(width, dtype=bool)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def whole(docs: DataFrame, k: int) -> DataFrame:
    """(text) -> (cls, n, bits, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Hashes = Hashes()
        for batch in batches:
            for j in range(0, batch.num_rows, 256):
                sets = [s for s in shingles([x or "" for x in batch.column(0).slice(j, 256).to_pylist()], k, known) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array(map(digest, sets), type=pa.int64()), pa.array([len(s) for s in sets], type=pa.int32()), pa.array(map(bitmap, sets), type=pa.binary()), pa.array([s.tobytes() for s in sets], type=pa.binary())], names=["cls", "n", "bits", "hashes"])

    return docs.select("text").mapInArrow(run, "cls long, n int, bits binary, hashes binary")


class Tree:
    """Signature tree over rows sorted by size: nodes (first, last, OR bitmap, least and largest size, most shingles beyond bits, component)."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, comp: np.ndarray):
        self.bits, self.n, self.comp = bits, n, comp
        self.over = n - np.bitwise_count(bits).sum(axis=1)
        level = [self.node(i, min(i + PAGE, len(n)), []) for i in range(0, len(n), PAGE)]
        while len(level) > 1:
            level = [self.node(level[i][0], level[min(i + FAN, len(level)) - 1][1], level[i : i + FAN]) for i in range(0, len(level), FAN)]
        self.root = level[0]

    def node(self, a: int, b: int, kids: list) -> tuple:
        c = self.comp[a:b]
        return a, b, np.bitwise_or.reduce(self.bits[a:b]), int(self.n[a]), int(self.n[b - 1]), int(self.over[a:b].max()), int(c[0]) if (c == c[0]).all() else None, kids

    def pairs(self, percent: int, allowed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row pairs i < j that may reach ``percent``, with their bound; ``allowed``(i, j) masks pairs by arrays of rows.

        |A & B| <= bits that both may have + shingles of either beyond its own bits; a link needs percent * (|A| + |B|) / (100 + percent).
        """
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        todo = [(self.root, self.root)]
        while todo:
            p, q = todo.pop()
            if 100 * p[4] < percent * q[3] or 100 * q[4] < percent * p[3] or p[6] is not None and p[6] == q[6]:
                continue
            if p is not q and int(np.bitwise_count(p[2] & q[2]).sum()) + min(p[5], q[5]) < -(-percent * (p[3] + q[3]) // (100 + percent)):
                continue
            if p[7] or q[7]:
                if p is q:
                    todo += [(x, y) for i, x in enumerate(p[7]) for y in p[7][i:]]
                elif not q[7] or p[7] and p[1] - p[0] >= q[1] - q[0]:
                    todo += [(x, q) for x in p[7]]
                else:
                    todo += [(p, y) for y in q[7]]
                continue
            i, j = np.arange(p[0], p[1])[:, None], np.arange(q[0], q[1])[None, :]
            bound = np.bitwise_count(self.bits[p[0] : p[1], None, :] & self.bits[None, q[0] : q[1], :]).sum(axis=2, dtype=np.int64) + np.minimum(self.over[i], self.over[j])
            ok = (bound * (100 + percent) >= percent * (self.n[i] + self.n[j])) & (100 * np.minimum(self.n[i], self.n[j]) >= percent * np.maximum(self.n[i], self.n[j])) & (self.comp[i] != self.comp[j]) & (i < j)
            x, y = np.nonzero(ok)
            if len(x):
                x, y, b = x + p[0], y + q[0], bound[x, y]
                keep = allowed(x, y)
                out.append((x[keep], y[keep], b[keep]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, dtype=np.int64),) * 3


def folded(bits: list[bytes], rows: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of the rows as a table of ``words`` 64-bit words, those of twice the width folded."""
    out = np.empty((len(rows), words), dtype=np.uint64)
    for k, r in enumerate(rows):
        x = np.frombuffer(bits[r], dtype=np.uint64)
        out[k] = x if len(x) == words else x[:words] | x[words:]
    return out


def near_rows(gid: np.ndarray, n: np.ndarray, bits: list[bytes], comp: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``Tree.pairs`` gives, for many groups of one leaf page at most at once: every node pair of theirs is a row pair."""
    i, j = [], []
    for d in range(1, len(gid)):
        x = np.flatnonzero(gid[:-d] == gid[d:])
        if not len(x):
            break
        i.append(x)
        j.append(x + d)
    if not i:
        return (np.empty(0, dtype=np.int64),) * 3
    i, j = np.concatenate(i), np.concatenate(j)
    ok = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((side[i] < 0) | (side[i] != side[j]))
    i, j = i[ok], j[ok]
    width = np.array([len(b) // 8 for b in bits], dtype=np.int64)
    w = np.minimum(width[i], width[j])
    got = []
    for words in np.unique(w):
        at = np.flatnonzero((w == words) & (width[i] <= 2 * words) & (width[j] <= 2 * words))
        for k in range(0, len(at), step := max(64, 4_000_000 // int(words))):
            x, y = i[at[k : k + step]], j[at[k : k + step]]
            rows, place = np.unique(np.concatenate([x, y]), return_inverse=True)
            table = folded(bits, rows, int(words))
            over = n[rows] - np.bitwise_count(table).sum(axis=1)
            px, py = place[: len(x)], place[len(x) :]
            bound = np.bitwise_count(table[px] & table[py]).sum(axis=1, dtype=np.int64) + np.minimum(over[px], over[py])
            keep = bound * (100 + percent) >= percent * (n[x] + n[y])
            got.append((x[keep], y[keep], bound[keep]))
    return tuple(np.concatenate(c) for c in zip(*got, strict=True)) if got else (np.empty(0, dtype=np.int64),) * 3


def near_in_tree(cls: np.ndarray, n: np.ndarray, bits: list[bytes], comp: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs of one group that may link, by a tree per bitmap width over the rows of that width and the next (folded)."""
    width = np.array([len(b) // 8 for b in bits], dtype=np.int64)
    got = []
    for w in np.unique(width):
        rows = np.flatnonzero((width == w) | (width == 2 * w))
        rows = rows[np.lexsort((cls[rows], n[rows]))]
        if len(rows) > 1:
            own, s = width[rows] == w, side[rows]
            i, j, b = Tree(folded(bits, rows, int(w)), n[rows], comp[rows]).pairs(percent, lambda x, y, own=own, s=s: (own[x] | own[y]) & ((s[x] < 0) | (s[x] != s[y])))
            got.append((rows[i], rows[j], b))
    return tuple(np.concatenate(c) for c in zip(*got, strict=True)) if got else (np.empty(0, dtype=np.int64),) * 3


def forest(group: np.ndarray, a: np.ndarray, b: np.ndarray, score: np.ndarray) -> list[int]:
    """Places of the pairs (a, b) that make a spanning forest of each group, of highest scores."""
    root: dict[tuple[int, int], tuple[int, int]] = {}

    def find(x: tuple[int, int]) -> tuple[int, int]:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    keep = []
    for k in np.lexsort((b, a, -score, group)).tolist():
        x, y = find((group[k], a[k])), find((group[k], b[k]))
        if x != y:
            root[x] = y
            keep.append(k)
    return keep


def propose(members: DataFrame, sets: DataFrame, percent: int, spanning: bool) -> DataFrame:
    """(h, i, j, side, cls, comp) in blocks (h, i, j) -> distinct pairs (a, b) that may link; with ``spanning``, a forest of each block only.

    A block of two sides (side >= 0) pairs across them, any other (side -1) within.
    """

    def pairs(h, i, j, side, cls, comp, n, bits) -> pa.RecordBatch:
        gid = np.cumsum(np.concatenate([[0], (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        size = np.bincount(gid)
        got = []
        small = np.flatnonzero(size[gid] <= PAGE)
        if len(small):
            x, y, b = near_rows(gid[small], n[small], [bits[r] for r in small], comp[small], side[small], percent)
            got.append((small[x], small[y], b))
        for g in np.flatnonzero(size > PAGE):
            rows = np.flatnonzero(gid == g)
            x, y, b = near_in_tree(cls[rows], n[rows], [bits[r] for r in rows], comp[rows], side[rows], percent)
            got.append((rows[x], rows[y], b))
        x, y, b = (np.concatenate(c) for c in zip(*got, strict=True))
        if spanning:
            keep = forest(gid[x], comp[x], comp[y], b / (n[x] + n[y]))
            x, y = x[keep], y[keep]
        out = np.unique(np.stack([np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y])], axis=1), axis=0) if len(x) else np.empty((0, 2), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, 0])), pa.array(np.ascontiguousarray(out[:, 1]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the group at the end, until it is known to be whole
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            h, i, j = (t.column(c).to_numpy() for c in ("h", "i", "j"))
            whole_ = np.flatnonzero((h != h[-1]) | (i != i[-1]) | (j != j[-1]))
            cut = int(whole_[-1]) + 1 if len(whole_) else 0
            if cut:
                yield pairs(h[:cut], i[:cut], j[:cut], *(t.column(c).slice(0, cut).to_numpy() for c in ("side", "cls", "comp", "n")), t.column("bits").slice(0, cut).to_pylist())
            held = [t.slice(cut)]
        if held:
            t = held[0]
            yield pairs(*(t.column(c).to_numpy() for c in ("h", "i", "j", "side", "cls", "comp", "n")), t.column("bits").to_pylist())

    t = members.join(sets.select("cls", F.col("n").cast("long").alias("n"), "bits"), "cls").select("h", "i", "j", "side", "cls", "comp", "n", "bits")
    return t.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "cls").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), dtype=np.uint64) for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, type=pa.int64()))

    s = sets.select("cls", "hashes")
    t = pairs.join(s.toDF("a", "ha"), "a").join(s.toDF("b", "hb"), "b").select("a", "b", "ha", "hb")
    return t.mapInArrow(run, "a long, b long")


def linked(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id: the smallest doc_id reachable by links, itself included.

    A row per row of ``docs``. Null or empty text and texts without words: 0 and the row's own doc_id. Null ids take part and get the
    smallest id of their component, if it has one. Copies cost one row each and are never paired. Empty table: empty result.
    Other columns of ``docs`` don't matter. The result is stored; all other tables are deleted.
    """
    return settled(docs.sparkSession, lambda: _linked(docs.select("doc_id", "text"), k, percent), "components")


def _linked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    got, _ = stored(profile(docs, k), "profile")
    rows = got.filter("slice is null").select("doc_id", "n", "cls")
    classes, _ = stored(rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.first("n").alias("n")), "classes")

    def grouped() -> DataFrame:
        level = levels(got.filter("slice is not null").select("slice", "counters"))
        raw, path = stored(shared(prefixes(docs, k, percent, level)), "postings")
        post, _ = stored(folded_groups(raw), "postings")
        delete(spark, path)
        post = pruned(pruned(post)).filter("v % 2 = 1").select("h", "cls")
        return told_apart(stored(post, "postings")[0])

    post = settled(spark, grouped, "groups")
    left, left_path = stored(classes.join(post.select("cls").distinct(), "cls"), "candidates")
    ids = bounded(left.filter("least is not null").select(F.col("least").alias("doc_id")).distinct(), 1_000_000)
    texts = docs.join(ids, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))
    read_again = rows.join(ids, "doc_id", "left_semi").count() + rows.filter("doc_id is null").count()
    sets = whole(texts, k).join(bounded(left.select("cls"), 1_000_000), "cls", "left_semi")
    # ids are as a rule unique, so that each class is read once
    sets, sets_path = stored(sets if read_again == left.count() else sets.dropDuplicates(["cls"]), "sets")

    def found(members: DataFrame, spanning: bool) -> DataFrame:
        return settled(spark, lambda: verified(stored(propose(members, sets, percent, spanning), "pairs")[0], sets, percent), "links")

    def salted(t: DataFrame) -> DataFrame:
        """Blocks within h, of about BLOCK members."""
        s = F.pmod(F.xxhash64("cls", "h"), F.ceil(F.col("size") / BLOCK)).cast("long")
        return t.withColumn("i", s).withColumn("j", s).withColumn("side", F.lit(-1)).select("h", "i", "j", "side", "cls", "comp")

    def split_groups(labels: DataFrame) -> DataFrame:
        """Members of groups that lie in more than one component, with their component and their group's size."""
        t, _ = stored(post.join(labels.toDF("cls", "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "members")
        live = t.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("h")
        return t.join(live, "h", "left_semi")

    # first: each class in the largest group that it is in
    chosen = post.groupBy("cls").agg(F.max(F.struct("size", "h")).alias("m")).select("cls", "m.h", "m.size", F.col("cls").alias("comp"))
    links = found(salted(chosen), True)
    labels = components(links)
    t = split_groups(labels)

    # then: one member of each component of a group of several blocks
    big = t.filter(F.col("size") > BLOCK)
    if not big.isEmpty():
        one, _ = stored(big.groupBy("h", "comp").agg(F.min_by("cls", F.xxhash64("cls")).alias("cls")), "one-each")
        more = found(salted(one.join(one.groupBy("h").agg(F.count(F.lit(1)).alias("size")), "h")), True)
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
            t = split_groups(labels)

    # last: every pair of different components that share a prefix shingle
    more = found(blocks(t.join(left.select("cls", "n"), "cls"), percent), False)
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    for path in (sets_path, left_path):
        delete(spark, path)

    of, _ = stored(classes.join(labels.toDF("cls", "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "class-components")
    least, _ = stored(of.groupBy("comp").agg(F.min("least").alias("component_id")), "least")
    of, _ = stored(of.join(least, "comp").select("cls", "component_id"), "class-ids")
    with_words = rows.filter("n > 0").join(of, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return with_words.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def blocks(t: DataFrame, percent: int) -> DataFrame:
    """(h, size, cls, comp, n) -> (h, i, j, side, cls, comp): blocks that hold each pair of a group that lies in two components and that sizes let
    link in one of them.

    A group of at most BLOCK members is one block. A larger one is cut into bands of sizes, so that what links lies in one band or in
    two neighbouring ones, and a band into cells of about BLOCK by hash, those of the group's largest component apart from the others. Cells
    of others are paired with all cells of their band and the next; cells of the largest component only with those of others, so that
    a group of near copies that is one component but for a few members costs a row per member and few more. Members go to blocks
    without their bitmaps, which are joined to the blocks' rows.
    """
    band = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.lit(1.0001 * math.log(100 / min(percent, 99)))).cast("long")
    large = F.col("size") > BLOCK
    major = t.filter(large).groupBy("h", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("h").agg(F.max_by("comp", F.struct("k", "comp")).alias("major"))
    t = t.withColumn("band", F.when(large, band).otherwise(F.lit(0).cast("long"))).join(major, "h", "left")
    t, _ = stored(t.withColumn("main", F.coalesce(F.col("comp") == F.col("major"), F.lit(False))).drop("major"), "banded")
    count = lambda of: F.ceil(F.count_if(of) / BLOCK).cast("long")
    cells, _ = stored(t.groupBy("h", "band").agg(count(~F.col("main")).alias("others"), count(F.col("main")).alias("mains")), "cells")
    near = [cells.select("h", (F.col("band") - off).alias("band"), F.col("others").alias(f"others{off}"), F.col("mains").alias(f"mains{off}")) for off in (-1, 1)]
    t = t.join(cells.join(near[0], ["h", "band"], "left").join(near[1], ["h", "band"], "left").fillna(0), ["h", "band"])
    step, half = 1 << 40, 1 << 39

    def partners(kind: str) -> list[Column]:
        """Cells of this and the neighbouring bands, as band * step + cell, those of the largest component from ``half`` on."""

        def cells_of(off: int, number: Column) -> Column:
            first = (F.col("band") + off) * step + (half if kind == "mains" else 0)
            some = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(number - 1, F.lit(0).cast("long"))), lambda x: first + x)
            return F.when(number > 0, some).otherwise(F.array().cast("array<long>"))

        return [cells_of(off, F.col(f"`{kind}{off or ''}`")) for off in (0, -1, 1)]

    s = F.pmod(F.xxhash64("cls", "h"), F.greatest(F.when(F.col("main"), F.col("mains")).otherwise(F.col("others")), F.lit(1).cast("long")))
    t = t.withColumn("me", F.col("band") * step + F.when(F.col("main"), half).otherwise(0) + s)
    t = t.withColumn("o", F.explode(F.when(F.col("main"), F.concat(*partners("others"))).otherwise(F.concat(*partners("others"), *partners("mains")))))
    side = F.when(F.col("me") == F.col("o"), -1).when(F.col("me") < F.col("o"), 0).otherwise(1)
    return t.select("h", F.least("me", "o").alias("i"), F.greatest("me", "o").alias("j"), side.alias("side"), "cls", "comp")


def op7_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of all documents, on 4-word shingles at 85 %."""
    return linked(read(spark, sf_dir, "documents"))
