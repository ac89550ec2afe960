"""The pipeline on a small corpus with planted cases, odd rows and extra columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, kept int, _size string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(1)
    tmp = str(tmp_path_factory.mktemp("pipe"))
    words = [f"word{i}" for i in range(40)]
    text = lambda: " ".join(r.choice(words) for _ in range(120)) + "."
    good = [text() for _ in range(120)]
    rows = [(i, t, "en", r.choice(["a", "b", None]), len(t)) for i, t in enumerate(good)]
    rows += [(200 + i, good[i], "en", "a", 0) for i in range(10)]
    rows += [(300 + i, good[20 + i].replace("word1 ", "other ", 1) + " more", "en", "a", 0) for i in range(10)]
    rows += [(400 + i, "junk%%% " * 80 + text().replace(" ", "### "), "en", "b", 0) for i in range(30)]
    rows += [(500, None, None, None, None), (501, "", "en", "a", 0), (0, good[0], "en", "a", 0), (None, good[5], "en", "a", 0)]
    spark.createDataFrame([(*x, "r", 1, "s") for x in rows], SCHEMA).write.parquet(f"{tmp}/documents.parquet")
    lab = [(i, 1, 0) for i in range(0, 120, 2)] + [(400 + i, 0, 0) for i in range(0, 30, 2)]
    spark.createDataFrame(lab, "doc_id long, quality long, toxic long").write.parquet(f"{tmp}/labels.parquet")
    return tmp


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(P.STAGES):
        before = docs
        docs = stage(spark, docs, folder)
        if k < 4:
            assert docs.schema == before.schema
        docs, _ = P.stored(docs, "test")
        seen.append([x["doc_id"] for x in docs.collect()])
    junk = {400 + i for i in range(30)}
    assert not junk & set(seen[0]) and set(range(120)) <= set(seen[0]) and not {500, 501} & set(seen[0])
    assert set(range(120)) <= set(seen[1])
    assert sorted(seen[2], key=str) == sorted(set(seen[2]), key=str) and len(seen[2]) == 120
    assert set(seen[4]) == set(seen[3]) and len(seen[4]) == len(seen[3])


def test_mixing_is_the_same_by_ids_and_by_rows(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id between 1 and 119")
    by_ids, by_rows = [], []
    for out, plain in ((by_ids, True), (by_rows, False)):
        monkeypatch.setattr(P, "_ids_will_do", lambda _, plain=plain: plain)
        out += sorted(r["doc_id"] for r in P.mix_sources(spark, docs, folder).collect())
    assert by_ids == by_rows and len(by_ids) > 0


def test_run_equals_the_stages(spark, folder):
    assert P.run(spark, folder).columns == ["doc_id", "n_tokens", "bucket", "bucket_len", "batch", "place"]


def test_empty(spark, folder, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").filter(F.lit(False)).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
