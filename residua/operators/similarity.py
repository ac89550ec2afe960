"""Sequence similarity, clusters, splits and leakage.

The native engine scores word or letter k-gram sets by Jaccard similarity, exactly, by an inverted index; it stands in for an external
alignment search, whose result files can be read by ``sources.sequences`` and enter at ``best_hits``.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.functions import scalars as S
from residua.operators.ranking import numbered, stored

SPLITS = ("train", "val", "test")
TOLERANCE = 0.001


def grams(items: DataFrame, k: int = 3, words: bool = True) -> DataFrame:
    """(item_id, sequence) -> distinct (item_id, gram): 64-bit hashes of runs of ``k`` words (or letters); a shorter sequence is one gram."""
    w = F.split(F.col("sequence"), " ") if words else F.filter(F.split(F.col("sequence"), ""), lambda x: x != "")
    t = items.filter("sequence is not null").select("item_id", w.alias("w"))
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (k - 1))))
    return t.select("item_id", "w", at.alias("i")).select("item_id", F.xxhash64(F.array_join(F.slice("w", F.col("i"), F.lit(k)), " " if words else "")).alias("gram")).distinct()


def jaccard_classes(items: DataFrame, percent: int | str | Fraction = 50, k: int = 3, words: bool = True) -> tuple[DataFrame, DataFrame]:
    """((item_id, rep, n), (source_id, target_id, shared, size_a, size_b)): items with equal grams have one representative, the least of them, and
    pairs of representatives with Jaccard similarity >= percent / 100, each unordered pair once.

    ``percent`` may be a decimal or a fraction as text; it is compared as a rational. Copies cost one row each and are never paired here.
    Only the prefix of each representative's grams, rarest first, meets others: two sets that reach the threshold share a gram among the
    first ``n - ceil(t n) + 1`` of either. The full sets are then compared.
    """
    t = Fraction(percent) / 100
    p, q = t.numerator, t.denominator
    g = stored(grams(items, k, words), "grams")
    alike = g.groupBy("item_id").agg(F.bit_xor(F.xxhash64("gram")).alias("x"), F.bit_xor(F.xxhash64("gram", F.lit(1))).alias("y"), F.count(F.lit(1)).alias("n"))
    alike = stored(alike, "digests")
    reps = alike.groupBy("x", "y", "n").agg(F.min("item_id").alias("rep"))
    members = stored(alike.join(reps, ["x", "y", "n"]).select("item_id", "rep", "n"), "members")
    one = g.join(members.filter("item_id = rep").select("item_id", "n"), "item_id")
    df = one.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    sets = stored(one.join(df, "gram").groupBy("item_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("s")), "sets")
    keep = F.col("n") - F.expr(f"(n * {p} + {q - 1}) div {q}") + 1
    pre = sets.select("item_id", "n", F.explode(F.slice("s", F.lit(1), keep.cast("int"))).alias("x")).filter("x.df > 1").select("item_id", "n", "x.gram")
    a, b = pre.toDF("source_id", "size_a", "gram"), pre.toDF("target_id", "size_b", "gram")
    close = (F.col("source_id") < F.col("target_id")) & (q * F.least("size_a", "size_b") >= p * F.greatest("size_a", "size_b"))
    pairs = a.join(b, "gram").filter(close).select("source_id", "target_id", "size_a", "size_b").distinct()
    hs = sets.select("item_id", F.transform("s", lambda x: x["gram"]).alias("grams"))
    t = pairs.join(hs.toDF("source_id", "ga"), "source_id").join(hs.toDF("target_id", "gb"), "target_id")
    t = t.withColumn("shared", F.size(F.array_intersect("ga", "gb")).cast("bigint")).drop("ga", "gb")
    links = t.filter(q * F.col("shared") >= p * (F.col("size_a") + F.col("size_b") - F.col("shared")))
    return members, links.select("source_id", "target_id", "shared", "size_a", "size_b")


def jaccard_pairs(items: DataFrame, percent: int | str | Fraction = 50, k: int = 3, words: bool = True) -> DataFrame:
    """(source_id, target_id, shared, size_a, size_b) of all pairs of items with Jaccard similarity >= percent / 100, those of copies as well.

    The result has every pair, so its size is that of the answer; ``jaccard_edges`` is enough for components.
    """
    members, links = jaccard_classes(items, percent, k, words)
    m = members.select("item_id", "rep")
    a, b = m.toDF("ia", "source_id"), m.toDF("ib", "target_id")
    across = stored(links, "links").join(a, "source_id").join(b, "target_id")
    flip = F.col("ia") > F.col("ib")
    pick = lambda x, y, name: F.when(flip, F.col(y)).otherwise(F.col(x)).alias(name)
    across = across.select(F.least("ia", "ib").alias("source_id"), F.greatest("ia", "ib").alias("target_id"), "shared", pick("size_a", "size_b", "size_a"), pick("size_b", "size_a", "size_b"))
    own = members.toDF("source_id", "rep", "n").join(m.toDF("target_id", "rep"), "rep").filter("source_id < target_id")
    return across.unionByName(own.select("source_id", "target_id", F.col("n").alias("shared"), F.col("n").alias("size_a"), F.col("n").alias("size_b")))


def jaccard_edges(items: DataFrame, percent: int | str | Fraction = 50, k: int = 3, words: bool = True) -> DataFrame:
    """(source_id, target_id) with the components of ``jaccard_pairs``: pairs of representatives, and each copy with its representative."""
    members, links = jaccard_classes(items, percent, k, words)
    return links.select("source_id", "target_id").unionByName(members.filter("item_id <> rep").select(F.col("rep").alias("source_id"), F.col("item_id").alias("target_id")))


def best_hits(hits: DataFrame, order: str = "line_no") -> DataFrame:
    """(query, target, score, coverage, line_no) -> per unordered pair the greatest score, and the coverage of the first row with it; self hits go."""
    t = hits.filter("query <> target").select(F.least("query", "target").alias("source_id"), F.greatest("query", "target").alias("target_id"), "score", "coverage", F.col(order).alias("_o"))
    best = t.groupBy("source_id", "target_id").agg(F.max_by(F.struct("score", "coverage"), F.struct("score", -F.col("_o"))).alias("b"))
    return best.select("source_id", "target_id", "b.score", "b.coverage")


def relationships(pairs: DataFrame, score: Column, coverage: Column, kind: str = "sequence_similarity", engine: str = "jaccard", version: str = "1", identity: Column | None = None, **parameters: str) -> DataFrame:
    """Relationships sorted by pair. ``identity`` is that of an alignment; the native engine has none, so it is NULL there."""
    method = F.struct(F.lit(engine).alias("engine"), F.lit(version).alias("version"), (F.create_map(*[F.lit(x) for kv in parameters.items() for x in kv]) if parameters else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("parameters"))
    return pairs.select("source_id", "target_id", F.lit(kind).alias("similarity_type"), score.cast("double").alias("score"), coverage.cast("double").alias("coverage"), (F.lit(None) if identity is None else identity).cast("double").alias("identity"), method.alias("method")).orderBy("source_id", "target_id")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.withColumn("_a", F.least("source_id", "target_id")).withColumn("target_id", F.greatest("source_id", "target_id")).withColumn("source_id", F.col("_a")).drop("_a")


def merge_relationships(*tables: DataFrame) -> DataFrame:
    """Tables of several kinds as one, pairs in one direction."""
    out = undirected(tables[0])
    for t in tables[1:]:
        out = out.unionByName(undirected(t), allowMissingColumns=True)
    return out


def network(edges: DataFrame, thresholds: dict[str, float | None] | None = None, min_coverage: float | None = None) -> DataFrame:
    """Edges whose score reaches the threshold of their type (none: all), and whose coverage reaches the least one."""
    t = edges
    for kind, least in (thresholds or {}).items():
        if least is not None:
            t = t.filter((F.col("similarity_type") != kind) | (F.col("score") >= least))
    return t if min_coverage is None else t.filter(F.col("coverage") >= min_coverage)


def connected(items: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(item_id, root): the least item of each component. ``edges`` (source_id, target_id) with unknown ends are ignored.

    Each round hooks every component to the least neighbouring one, then halves the paths between labels, so rounds grow with the
    logarithm of the diameter. State is in written tables.
    """
    known = items.select("item_id").distinct()
    e = edges.join(known.withColumnRenamed("item_id", "source_id"), "source_id", "left_semi").join(known.withColumnRenamed("item_id", "target_id"), "target_id", "left_semi").filter("source_id <> target_id")
    e = stored(e.select(F.col("source_id").alias("u"), F.col("target_id").alias("v")).unionByName(e.select(F.col("target_id").alias("u"), F.col("source_id").alias("v"))).distinct(), "edges")
    labels = stored(e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("root")), "labels")
    for _ in range(most_rounds):
        near = e.join(labels.toDF("u", "ru"), "u").join(labels.toDF("v", "rv"), "v").filter("rv < ru").groupBy("ru").agg(F.min("rv").alias("to"))
        near = stored(near, "hooks")
        if near.isEmpty():
            break
        while True:
            nxt = near.toDF("to", "then")
            jumped = stored(near.join(nxt, "to", "left").select("ru", F.coalesce("then", "to").alias("to"), F.col("then").isNotNull().alias("moved")), "jumps")
            done = jumped.filter("moved").isEmpty()
            near = jumped.select("ru", "to")
            if done:
                break
        labels = stored(labels.join(near.toDF("root", "to"), "root", "left").select("u", F.coalesce("to", "root").alias("root")), "labels")
    return items.join(labels.toDF("item_id", "root"), "item_id", "left").withColumn("root", F.coalesce("root", "item_id"))


def clusters(items: DataFrame, edges: DataFrame, threshold: float | None = None, enabled: bool = True) -> DataFrame:
    """(item_id, item_ord) and edges with scores -> (cluster_ord, components sorted, n_components), clusters by their first item.

    Items listed twice count twice. ``enabled=False``: every item alone.
    """
    e = edges if threshold is None else edges.filter(F.col("score") >= threshold)
    e = e.select("source_id", "target_id")
    t = connected(items, e if enabled else e.limit(0))
    g = t.groupBy("root").agg(F.sort_array(F.collect_list("item_id")).alias("components"), F.count(F.lit(1)).alias("n_components"), F.min_by("item_id", "item_ord").alias("_first"))
    return numbered(g, "_n", [F.col("_first").asc()]).select((F.col("_n") + 1).cast("int").alias("cluster_ord"), "components", "n_components")


def cluster_summary(c: DataFrame) -> DataFrame:
    return c.agg(F.count(F.lit(1)).alias("total_clusters"), F.count_if(F.col("n_components") == 1).alias("singletons"), F.max("n_components").alias("largest"), F.sum("n_components").alias("items"), (F.sum("n_components") / F.count(F.lit(1))).alias("mean_size"))


def graph_statistics(items: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges (both ends known, each unordered pair once), connected components and the size of the largest."""
    nodes = items.select("item_id").distinct()
    e = undirected(edges.select("source_id", "target_id")).filter("source_id <> target_id").distinct()
    e = stored(e.join(nodes.toDF("source_id"), "source_id", "left_semi").join(nodes.toDF("target_id"), "target_id", "left_semi"), "edges")
    sizes = connected(nodes, e).groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    t = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("node_count"), F.count(F.lit(1)).alias("connected_components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_component_size"))
    return t.crossJoin(F.broadcast(e.agg(F.count(F.lit(1)).alias("edge_count"))))  # one row by one row


def merge_small(c: DataFrame, least: int) -> DataFrame:
    """Clusters under ``least`` members become one residual cluster, the last."""
    key = F.when(F.col("n_components") < least, F.lit(2**31 - 1)).otherwise(F.col("cluster_ord"))
    g = c.groupBy(key.alias("cluster_ord")).agg(F.sort_array(F.flatten(F.collect_list("components"))).alias("components"), F.sum("n_components").alias("n_components"))
    return numbered(g, "_n", [F.col("cluster_ord").asc()]).select((F.col("_n") + 1).cast("int").alias("cluster_ord"), "components", "n_components")


def representatives(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster_ord, representative_id): the member with the highest mean score to others of its cluster, least id of equals; NULL if alone."""
    both = edges.select("source_id", "target_id", "score").unionByName(edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "score"))
    m = members.select("cluster_ord", "item_id")
    t = both.join(m.toDF("ca", "source_id"), "source_id").join(m.toDF("cb", "target_id"), "target_id").filter("ca = cb").groupBy(F.col("ca").alias("cluster_ord"), F.col("source_id").alias("item_id")).agg(F.avg(F.col("score").cast("decimal(18,9)")).alias("mean"))
    best = t.withColumn("_n", F.row_number().over(Window.partitionBy("cluster_ord").orderBy(F.desc("mean"), "item_id"))).filter("_n = 1").select("cluster_ord", F.col("item_id").alias("representative_id"))
    return m.select("cluster_ord").distinct().join(best, "cluster_ord", "left")


def check_fractions(fractions: Sequence[float]) -> None:
    if abs(sum(fractions) - 1) > TOLERANCE:
        raise ValueError("split fractions must sum to 1")


def fold_steps(sizes: Sequence[tuple[int, int]], fractions: Sequence[float]) -> list[tuple[int, int, int, str]]:
    """(size, number of clusters), largest first -> (size, from, to, splits in turn): what the greedy fold does, in few steps a size.

    While one split lacks most by a cluster or more, it takes a run; when two lack about the same, they take turns until they are down to the
    third; when all three do, they take turns for good, as a round leaves what they lack relative to each other as it was.
    """
    total = sum(n * k for n, k in sizes)
    goal = [round(total * fractions[0]), round(total * fractions[1])]
    lack, rows = [*goal, total - sum(goal)], []
    for n, k in sizes:
        at = 0
        while at < k:
            trial, turn = list(lack), []
            for _ in range(3):
                turn.append(max(range(3), key=lambda i: (trial[i], -i)))
                trial[turn[-1]] -= n
            a, b = turn[:2]
            rest = 3 - a - b if a != b else -1
            if len(set(turn)) == 3:
                pattern, rounds = turn, (k - at) // 3
            elif a != b and turn[2] == a:
                pattern, rounds = turn[:2], min((k - at) // 2, (min(lack[a], lack[b]) - lack[rest] - 1) // n + 1)
            else:
                pattern, rounds = [a], min(k - at, (lack[a] - max(lack[i] for i in range(3) if i != a)) // n)
            if rounds < 1:
                pattern, rounds = [a], 1
            rows.append((n, at, at + rounds * len(pattern), ",".join(SPLITS[i] for i in pattern)))
            for i in pattern:
                lack[i] -= n * rounds
            at += rounds * len(pattern)
    return rows


def partition_keep(c: DataFrame, fractions: Sequence[float] = (0.6, 0.2, 0.2)) -> DataFrame:
    """(cluster_ord, n_components) -> with ``split``: clusters by size, largest first, each to the split that lacks most; ties train, val, test.

    The driver sees distinct sizes and their counts only and folds over them; clusters of a size are numbered by cluster_ord over many
    tasks and find their split by a broadcast of a few steps a size.
    """
    check_fractions(fractions)
    sizes = sorted(((int(r[0]), int(r[1])) for r in c.groupBy("n_components").count().collect()), reverse=True)
    steps = c.sparkSession.createDataFrame(fold_steps(sizes, fractions) or [(0, 0, 0, "train")], "n bigint, lo bigint, hi bigint, turn string")
    ranked = numbered(c, "_r", [F.col("cluster_ord").asc()], ["n_components"])
    on = (F.col("n_components") == F.col("n")) & (F.col("_r") >= F.col("lo")) & (F.col("_r") < F.col("hi"))
    turn = F.split("turn", ",")
    split = F.element_at(turn, ((F.col("_r") - F.col("lo")) % F.size(turn) + 1).cast("int"))
    return ranked.join(F.broadcast(steps), on).withColumn("split", split).drop("n", "lo", "hi", "turn", "_r")


partition_keep_large = partition_keep


def partition_proportional(c: DataFrame, fractions: Sequence[float] = (0.6, 0.2, 0.2)) -> DataFrame:
    """(cluster_ord, components) -> (cluster_ord, item_id, split): each cluster's sorted members cut at rounded shares."""
    check_fractions(fractions)
    t = c.select("cluster_ord", F.size("components").alias("n"), F.posexplode("components").alias("i", "item_id"))
    a, b = (F.bround(F.col("n") * F.lit(f)).cast("int") for f in fractions[:2])
    return t.select("cluster_ord", "item_id", F.when(F.col("i") < a, "train").when(F.col("i") < a + b, "val").otherwise("test").alias("split"))


def members_of(c: DataFrame, *extra: str) -> DataFrame:
    return c.select("cluster_ord", *extra, F.explode("components").alias("item_id"))


def partition_summary(splits: DataFrame) -> DataFrame:
    """(split, n, fraction) for all three; 0 where empty."""
    base = splits.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    n = splits.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    t = base.join(n, "split", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy())
    return t.withColumn("fraction", F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)))


def cross_split(edges: DataFrame, splits: DataFrame) -> DataFrame:
    """Edges whose ends lie in different splits."""
    s = splits.select("item_id", "split")
    return edges.join(s.toDF("source_id", "source_split"), "source_id").join(s.toDF("target_id", "target_split"), "target_id").filter("source_split <> target_split")


def leakage(edges: DataFrame, splits: DataFrame, fractions: Sequence[float] = (0.6, 0.2, 0.2), threshold: float | None = None) -> DataFrame:
    """(code, severity, n): findings over splits (item_id, cluster_ord, split)."""
    x = cross_split(edges, splits)
    found = x.agg(F.count(F.lit(1)).alias("n")).select(F.lit("FORBIDDEN_CROSS_SPLIT_SIMILARITY").alias("code"), F.lit("error").alias("severity"), "n")
    torn = splits.groupBy("cluster_ord").agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n"))
    found = found.unionByName(torn.select(F.lit("CLUSTER_ISOLATION_VIOLATED").alias("code"), F.lit("error").alias("severity"), "n"))
    if threshold is not None:
        found = found.unionByName(x.filter(F.col("score") >= threshold).agg(F.count(F.lit(1)).alias("n")).select(F.lit("CROSS_SPLIT_SIMILARITY_ABOVE_THRESHOLD").alias("code"), F.lit("warning").alias("severity"), "n"))
    goal = F.create_map(*[y for s, f in zip(SPLITS, fractions, strict=True) for y in (F.lit(s), F.lit(float(f)))])
    off = partition_summary(splits).agg(F.count_if(F.abs(F.col("fraction") - F.element_at(goal, F.col("split"))) > 0.05).alias("n"))
    sizes = splits.groupBy("cluster_ord").agg(F.count(F.lit(1)).alias("k"))
    total = sizes.agg(F.sum("k").alias("t"), F.count(F.lit(1)).alias("c"), F.count_if(F.col("k") == 1).alias("s"), F.max("k").alias("m"))
    big = total.select(F.when(F.col("m") > 0.1 * F.col("t"), 1).otherwise(0).cast("bigint").alias("n"))
    alone = total.select(F.when(F.col("s") > 0.8 * F.col("c"), 1).otherwise(0).cast("bigint").alias("n"))
    for code, t in (("UNBALANCED_PARTITION", off), ("LARGE_CLUSTER", big), ("SINGLETON_DOMINATED", alone)):
        found = found.unionByName(t.select(F.lit(code).alias("code"), F.lit("warning").alias("severity"), "n"))
    return found.filter("n > 0")


def split_checksum(splits: DataFrame) -> DataFrame:
    """SHA-256 over the three sorted lists of ids."""
    lists = [F.sort_array(F.collect_list(F.when(F.col("split") == s, F.col("item_id")))) for s in SPLITS]
    return splits.agg(*[x.alias(s) for x, s in zip(lists, SPLITS, strict=True)]).select(S.checksum(*[F.col(s) for s in SPLITS]).alias("checksum"))


