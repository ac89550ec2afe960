import pytest

from residua import api, cli
from tests.test_sources import CIF


@pytest.fixture(scope="module")
def structures(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("api")
    for n in ("1ABC", "2ABC"):
        (d / f"{n}.cif").write_text(CIF.replace("1ABC", n))
    return api.mmcif_to_structure(spark, str(d)), d


def test_from_files_to_splits(spark, structures):
    (s, notes, status), _ = structures
    assert status.filter("status = 'success'").count() == 2 and notes.count() == 0
    out, mappings, report = api.canonicalise_structure(s, api.policy({"identifier_rules": {"chain_id": {"strategy": "remap"}}}))
    assert "chain_id" in mappings and report.status.count() == 2
    md = api.collect_metadata(out)
    assert {r["title"] for r in md["entry"].collect()} == {'A small "test" entry'}
    assert md["entity"].count() == 4 and md["ligand"].count() == 2
    assert api.extract_metadata(s, "struct", ["title"]).count() == 2
    chains = api.extract_chain_records(out)
    assert {r["sequence"] for r in chains.collect()} == {"MKTA"}
    assert api.extract_residue_records(out).count() == 4 and api.extract_interface_records(out).count() == 0
    assert api.annotate_ligand_contacts(out).count() == 2 and api.annotate_structure_counts(out).count() == 2
    pairs, best = api.annotate_pairwise_sequence_identity(out.entry("1ABC"), out.entry("2ABC"))
    assert pairs.count() == 1 and best.first()["identity"] == 1.0
    rel = api.compute_sequence_similarity(spark, chains)
    assert [(r["source_id"], r["target_id"], r["score"]) for r in rel.collect()] == [("1ABC_A", "2ABC_A", 1.0)]
    items = spark.createDataFrame([("1ABC_A", 1), ("2ABC_A", 2)], "item_id string, item_ord int")
    parts = api.partition_dataset(api.cluster_similar_items(items, rel, 0.5))
    assert {r["split"] for r in parts.collect()} == {"train"}


def test_later_stages_take_own_tables(spark, structures):
    (s, _, _), _ = structures
    again, came, status = api.from_parsed_structure(s.tables, "mine")
    assert {(r["provider"], r["from_cache"]) for r in came.collect()} == {("mine", False)} and status.filter("status = 'success'").count() == 2
    done, mappings, out = api.from_canonical_structures(again.tables)
    assert not mappings and out.status.count() == 2
    counts = api.annotate_structure_counts(done)
    _, layers = api.from_annotated_structures(done.tables, {"counts": counts})
    assert {r["layer_type"] for r in layers["counts"].collect()} == {"counts"}
    with pytest.raises(ValueError, match="entry_id"):
        api.from_annotated_structures(done.tables, {"x": counts.drop("entry_id")})
    more, notes = api.retrieve(done, spark.createDataFrame([("1ABC", "x")], "entry_id string, y string"))
    assert more.count() == 2 and [(r["entry_id"], r["code"]) for r in notes.collect()] == [("2ABC", "MISSING_METADATA")]


def test_lines_of_descent(spark):
    taxa = spark.createDataFrame([(1, 1, "root"), (2, 1, "b"), (3, 2, "c"), (4, 3, "d"), (5, 4, "e"), (9, 8, "lost")], "taxon_id long, parent_id long, name string")
    got = {r["taxon_id"]: r["lineage"] for r in api.retrieve_lineages(taxa).collect()}
    assert got == {1: ["root"], 2: ["root", "b"], 3: ["root", "b", "c"], 4: ["root", "b", "c", "d"], 5: ["root", "b", "c", "d", "e"], 9: ["lost"]}
    with pytest.raises(ValueError):
        api.retrieve_lineages(spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], "taxon_id long, parent_id long, name string"))


def test_own_engine_and_inputs(spark):
    def engine(t):
        return t.crossJoin(t.toDF("b", "s")).selectExpr("item_id as query", "b as target", "0.5 as score", "0.4 as coverage", "0L as line_no")

    got = api.compute_sequence_similarity(spark, {"a": "MK", "b": "MK", "c": None}, engine=engine).collect()
    assert [(r["source_id"], r["target_id"], r["method"]["engine"]) for r in got] == [("a", "b", "engine")]


def test_own_tables_are_checked(spark):
    with pytest.raises(ValueError, match="missing"):
        api.from_tables({})


def test_command_line(spark, structures, tmp_path):
    _, d = structures
    (tmp_path / "p.yaml").write_text("ligand_rules:\n  strategy: filter\n  keep_ions: false\n")
    assert cli.main(["canonicalise", str(d), str(tmp_path / "p.yaml"), str(tmp_path / "out")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out" / "atoms.parquet")).count() == 4
