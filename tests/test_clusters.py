"""Clusters and splits on worked examples."""

import pytest
from pyspark.sql import functions as F

from residua import queries as Q
from residua.operators import similarity as X


@pytest.fixture(scope="module")
def graph(spark):
    items = spark.createDataFrame([(x, i) for i, x in enumerate("abcde")], "item_id string, item_ord int")
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9), ("d", "e", 0.1), ("a", "zz", 1.0)], "source_id string, target_id string, score double")
    return items, edges


def test_transitive_merge_and_isolates(graph):
    got = [r["components"] for r in X.clusters(*graph, 0.5).orderBy("cluster_ord").collect()]
    assert got == [["a", "b", "c"], ["d"], ["e"]]


def test_high_threshold_splits_everything(graph):
    assert [r["n_components"] for r in X.clusters(*graph, 0.95).collect()] == [1] * 5


def test_disabled_clustering_gives_singletons(graph):
    assert X.clusters(*graph, 0.0, enabled=False).count() == 5


def test_long_chain_is_one_component(spark):
    n = 200
    items = spark.range(n).select(F.col("id").alias("item_id"), F.col("id").alias("item_ord"))
    edges = spark.range(n - 1).select(F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"), F.lit(1.0).alias("score"))
    assert X.clusters(items, edges, 0.5).select("n_components").collect()[0][0] == n


def worked(spark):
    rows = [(i + 1, [f"{c}{k}" for k in range(n)], n) for i, (c, n) in enumerate(zip("abcde", (10, 8, 6, 4, 2), strict=True))]
    return spark.createDataFrame(rows, "cluster_ord int, components array<string>, n_components bigint")


@pytest.mark.parametrize("f", [X.partition_keep, X.partition_keep_large])
def test_keep_places_whole_clusters(spark, f):
    t = f(worked(spark))
    assert {r["cluster_ord"]: r["split"] for r in t.collect()} == {1: "train", 2: "train", 3: "val", 4: "test", 5: "test"}
    n = {r["split"]: r["n"] for r in X.partition_summary(X.members_of(t, "split")).collect()}
    assert n == {"train": 18, "val": 6, "test": 6}


def test_proportional_conserves_items(spark):
    t = X.partition_proportional(worked(spark))
    assert t.count() == 30 and t.select("item_id").distinct().count() == 30


def test_fractions_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        X.partition_keep(worked(spark), (0.6, 0.2, 0.3))


def test_large_fold_equals_fold(spark):
    import random

    r = random.Random(5)
    rows = [(i + 1, r.choice([1, 1, 1, 2, 3, 5, 9, 30])) for i in range(400)]
    c = spark.createDataFrame(rows, "cluster_ord int, n_components bigint")
    a, b = ({x["cluster_ord"]: x["split"] for x in f(c).collect()} for f in (X.partition_keep, X.partition_keep_large))
    assert a == b


def test_fold_steps_are_the_greedy_fold():
    import random

    r = random.Random(2)
    for _ in range(400):
        sizes = sorted(((n, r.choice([1, 2, 3, 7, 50])) for n in r.sample(range(1, 40), r.randrange(1, 6))), reverse=True)
        f = r.choice([(0.6, 0.2, 0.2), (0.8, 0.1, 0.1), (1 / 3, 1 / 3, 1 / 3), (0.5, 0.5, 0.0)])
        total = sum(n * k for n, k in sizes)
        lack = [round(total * f[0]), round(total * f[1])]
        lack.append(total - sum(lack))
        want = []
        for n, k in sizes:
            for _ in range(k):
                i = max(range(3), key=lambda i: (lack[i], -i))
                lack[i] -= n
                want.append((n, X.SPLITS[i]))
        steps = X.fold_steps(sizes, f)
        got = [(n, turn.split(",")[j % len(turn.split(","))]) for n, lo, hi, turn in steps for j in range(hi - lo)]
        assert got == want
    assert len(X.fold_steps([(9, 5), (1, 10**12)], (0.6, 0.2, 0.2))) < 20


def test_best_hits_and_representative(spark):
    hits = spark.createDataFrame([("a", "b", 0.5, 0.9, 0), ("b", "a", 0.7, 0.1, 1), ("a", "b", 0.7, 0.3, 2), ("a", "a", 1.0, 1.0, 3)], "query string, target string, score double, coverage double, line_no int")
    assert [tuple(r) for r in X.best_hits(hits).collect()] == [("a", "b", 0.7, 0.1)]
    m = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "d")], "cluster_ord int, item_id string")
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8)], "source_id string, target_id string, score double")
    assert {r[0]: r[1] for r in X.representatives(m, e).collect()} == {1: "a", 2: None}


def test_leakage_findings(spark):
    splits = spark.createDataFrame([("a", 1, "train"), ("b", 1, "test"), ("c", 2, "val")], "item_id string, cluster_ord int, split string")
    e = spark.createDataFrame([("a", "b", 0.9)], "source_id string, target_id string, score double")
    codes = {r["code"] for r in X.leakage(e, splits, threshold=0.5).collect()}
    assert {"FORBIDDEN_CROSS_SPLIT_SIMILARITY", "CLUSTER_ISOLATION_VIOLATED", "CROSS_SPLIT_SIMILARITY_ABOVE_THRESHOLD"} <= codes


def test_all_pairs_at_the_threshold_are_found(spark, tmp_path):
    rows = []
    for i in range(0, 800, 2):  # 30 grams in common, 15 of either alone: Jaccard 0.5
        shared = [f"s{i}_{k}" for k in range(32)]
        for j in (i, i + 1):
            rows.append((j, " ".join([*shared, *(f"u{j}_{k}" for k in range(15))]), "en", "a", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.similarity_pairs(spark, str(tmp_path)).collect()
    assert sorted(tuple(x) for x in got) == [(i, i + 1, 30, 45, 45) for i in range(0, 800, 2)]


def test_own_clustering(spark):
    from residua.plans import datasets

    items = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "item_id string, item_ord int")
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.1)], "source_id string, target_id string, score double")

    def all_as_one(items, strong):
        assert strong.count() == 1
        return items.selectExpr("1 as g", "item_id").groupBy("g").agg(F.sort_array(F.collect_list("item_id")).alias("components"), F.count("item_id").alias("n_components")).selectExpr("1 as cluster_ord", "components", "n_components")

    got = datasets.build_leakage_safe(items, e, 0.5, clustering=all_as_one)
    assert got.splits.select("split").distinct().count() == 1 and got.clusters.count() == 1
