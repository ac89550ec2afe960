"""Canonicalisation, annotations and records on small structures."""

import pytest
from pyspark.sql import functions as F

from residua.functions import scalars as S
from residua.operators import canonical as C
from residua.operators import curate, metadata, records, spatial
from residua.plans.canonicalise import canonicalise
from residua.plans.policy import policy

COLS = "entry_id string, atom_ord long, group_pdb string, label_asym_id string, label_entity_id string, label_seq_id int, auth_seq_id string, ins_code string, label_comp_id string, label_atom_id string, label_alt_id string, x double, y double, z double, occupancy double, b_iso double"


def atom(k, chain, seq, comp, name, alt=None, xyz=(0, 0, 0), occ=1.0, b=1.0, group="ATOM", entity="1", auth=None, ins=None):
    return ("e", k, group, chain, entity, seq, auth or str(seq), ins, comp, name, alt, *map(float, xyz), occ, b)


@pytest.fixture(scope="module")
def atoms(spark):
    rows = [atom(i + 1, "A", 1, "ALA", n) for i, n in enumerate(("N", "CA", "C", "O"))]
    rows += [atom(5, "A", 2, "GLY", "N"), atom(6, "A", 2, "GLY", "CA")]
    rows += [atom(7, "A", 5, "SER", "CA", "B", occ=0.6, b=3.0), atom(8, "A", 5, "SER", "CA", "A", occ=0.6, b=9.0)]
    rows += [atom(9, "C", None, "HOH", "O", group="HETATM", entity="2", auth="301"), atom(10, "D", None, "ZN", "ZN", xyz=(3, 0, 0), group="HETATM", entity="3", auth="401")]
    return spark.createDataFrame(rows, COLS)


@pytest.fixture(scope="module")
def tables(spark, atoms):
    asym = spark.createDataFrame([("e", 1, "A", "1", "X"), ("e", 2, "C", "2", "X"), ("e", 3, "D", "3", "")], "entry_id string, asym_ord int, id string, entity_id string, auth_id string")
    entities = spark.createDataFrame([("e", 1, "1", "polymer", "chain", "AGS"), ("e", 2, "2", "water", "water", None), ("e", 3, "3", "non-polymer", "ZINC ION", None)], "entry_id string, entity_ord int, id string, type string, pdbx_description string, seq_can string")
    return {"atoms": atoms, "asym_units": asym, "entities": entities, "entries": spark.createDataFrame([("e", "t")], "entry_id string, title string")}


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_gaps_and_regions(atoms):
    assert rows(C.sequence_gaps(atoms), "label_asym_id", "after_seq", "before_seq") == [("A", 2, 5)]
    assert rows(C.longest_regions(atoms), "label_asym_id", "run_start", "run_end", "run_len") == [("A", 1, 2, 2)]
    assert rows(C.incomplete_chains(atoms), "label_asym_id", "span", "present") == [("A", 5, 3)]


def test_missing_backbone_and_drop(atoms):
    got = {r["label_seq_id"]: r["missing"] for r in C.missing_backbone(atoms).collect()}
    assert got == {2: ["C", "O"], 5: ["C", "N", "O"]}
    assert [r[0] for r in C.drop_partial_residues(atoms).orderBy("atom_ord").select("label_comp_id").collect()] == ["ALA"] * 4 + ["HOH", "ZN"]


@pytest.mark.parametrize(("tie", "want"), [("alphabetical_first", "A"), ("alphabetical_last", "B"), ("lowest_b_factor", "B"), ("highest_b_factor", "A")])
def test_altloc_ties(atoms, tie, want):
    out, mapping = C.pick_altlocs(atoms, "select_best_occupancy", tie)
    assert out.count() == 9 and out.filter("label_alt_id is not null").count() == 0
    assert rows(mapping, "residue_id", "selected", "n_altlocs") == [("5:SER", want, 2)]


def test_altloc_other_strategies(atoms):
    assert C.pick_altlocs(atoms, "preserve")[0] is atoms
    assert rows(C.pick_altlocs(atoms, "select_first")[1], "selected") == [("A",)]
    assert rows(C.pick_altlocs(atoms, "select_user_defined", label="A")[1], "selected") == [("A",)]
    assert rows(C.pick_altlocs(atoms, "select_user_defined", label="Z")[1], "selected") == [("A",)]


def test_renumber_is_dense(atoms):
    out, mapping = C.number_residues(atoms, "renumber")
    assert sorted({(r[0], r[1]) for r in rows(out, "label_asym_id", "label_seq_id")}) == [("A", 1), ("A", 2), ("A", 3), ("C", 1), ("D", 1)]
    assert mapping.filter("chain_id = 'A' and original_seq_id = 5").first()["canonical_seq_id"] == 3


def test_auth_numbers(spark):
    t = spark.createDataFrame([("-12A", 3), ("x", 4)], "a string, l int").select(S.author_number(F.col("a"), F.col("l")))
    assert [r[0] for r in t.collect()] == [-12, 4]


def test_chain_labels(spark):
    t = spark.range(1, 703).select(S.chain_label(F.col("id")).alias("c"))
    got = [r[0] for r in t.collect()]
    assert got[0] == "A" and got[25] == "Z" and got[26] == "AA" and got[701] == "ZZ" and len(set(got)) == 702
    with pytest.raises(Exception, match="702"):
        spark.range(703, 704).select(S.chain_label(F.col("id"))).collect()


def test_whole_plan(tables):
    p = policy({"identifier_rules": {"chain_id": {"strategy": "remap"}, "residue_numbering": {"strategy": "renumber"}}, "ligand_rules": {"strategy": "filter", "keep_waters": False}, "provenance_rules": {"emit_canonicalisation_report": True}})
    out = canonicalise(tables, p)
    assert out.transforms == ["chain_id:remap", "residue_numbering:renumber", "missing_atoms:annotate", "missing_residues:annotate", "altloc:select_best_occupancy", "ligands:filter"]
    assert rows(out.tables["asym_units"], "id") == [("A",), ("C",)]
    assert {r["code"] for r in out.diagnostics.collect()} >= {"MISSING_ATOMS"}
    assert out.status.first()["status"] == "failed" and out.report.count() == 1


def test_preserve_changes_nothing(tables):
    p = policy({"altloc_rules": {"strategy": "preserve"}, "missing_data_rules": {"missing_atoms": {"strategy": "preserve"}, "missing_residues": {"strategy": "preserve"}}})
    out = canonicalise(tables, p)
    assert out.tables["atoms"] is tables["atoms"] and out.transforms == []
    assert {r["code"] for r in out.diagnostics.collect()} >= {"SEQUENCE_GAP"}


def test_ligand_strategies(tables):
    a, _, notes = C.filter_ligands(tables["asym_units"], tables["atoms"], tables["entities"], "annotate_only")
    assert rows(a, "id") == [("A",)] and rows(notes, "field") == [("C",), ("D",)]
    a, _, _ = C.filter_ligands(tables["asym_units"], tables["atoms"], tables["entities"], "filter", ions=False)
    assert rows(a, "id") == [("A",), ("C",)]


def test_contacts_and_counts(tables):
    polymers = spatial.polymer_chains(tables["asym_units"], tables["entities"])
    layers = spatial.contact_layers(tables["atoms"], polymers, 3.0)
    assert layers.count() == 1 and [c["distance"] for c in layers.first()["contacts"]] == [3.0] * 3
    assert spatial.contact_layers(tables["atoms"], polymers, 2.9).first()["contacts"] == []
    r = spatial.structure_counts(tables["atoms"], tables["asym_units"], tables["entities"]).first()
    assert (r["atom_count"], r["residue_count"], r["altloc_atom_count"], r["chain_count"], r["entity_count"]) == (10, 5, 2, 3, 3)


def test_grid_join_equals_nested_loop(spark):
    import random

    r = random.Random(3)
    pts = [(i, "k", r.uniform(-3, 3), r.uniform(-3, 3), r.uniform(-3, 3)) for i in range(150)]
    t = spark.createDataFrame(pts, "i int, entry_id string, x double, y double, z double")
    got = {(a["a_i"], a["b_i"]) for a in spatial.grid_join(t, t, 1.0, condition=F.col("a_i") < F.col("b_i")).collect()}
    want = {(p[0], q[0]) for p in pts for q in pts if p[0] < q[0] and sum((u - v) ** 2 for u, v in zip(p[2:], q[2:], strict=True)) <= 1.0}
    assert got == want


def test_records(tables):
    c = records.chain_records(tables["atoms"], tables["asym_units"], tables["entities"]).first()
    assert (c["chain_id"], c["sequence"], c["residue_count"], c["atom_count"]) == ("A", "AGS", 3, 8)
    res = records.residue_records(tables["atoms"], spatial.polymer_chains(tables["asym_units"], tables["entities"]))
    assert [(r["seq_id"], r["atom_count"]) for r in res.orderBy("residue_ord").collect()] == [(1, 4), (2, 2), (5, 2)]
    assert records.filter_residues(res, ["amino_acid"], True).count() == 1


def test_identity(spark):
    t = spark.createDataFrame([("ACDE", "ACDF"), ("AC", ""), ("AAA", "AAAAAA")], "a string, b string").select(S.ungapped(F.col("a"), F.col("b")).alias("m")).select("m.*")
    assert [tuple(r) for r in t.collect()] == [(3, 0.75, 4, 1.0), (0, 0.0, 0, 0.0), (3, 0.5, 3, 0.5)]


def test_scalars(spark):
    t = spark.createDataFrame([(" a\n",), (".",), ("?",), ("",), ("12.5",), ("7",), ("1.5d",)], "v string")
    got = [tuple(r) for r in t.select(S.clean(F.col("v")), S.as_int(F.col("v")), S.as_float(F.col("v"))).collect()]
    assert got == [("a", None, None), (None,) * 3, (None,) * 3, (None,) * 3, ("12.5", None, 12.5), ("7", 7, 7.0), ("1.5d", None, None)]


def test_metadata_from_raw(spark):
    raw = spark.createDataFrame([("e", "_exptl", 0, {"method": "X-RAY"}), ("e", "_exptl", 1, {"method": "?"}), ("e", "_refine", 0, {"ls_d_res_high": "1.8"}), ("e", "_struct_ref", 0, {"id": "1", "db_name": "UNP", "pdbx_db_accession": "P1"}), ("e", "_struct_ref_seq", 0, {"ref_id": "1", "pdbx_strand_id": "A", "seq_align_beg": "1", "seq_align_end": "9"}), ("e", "_struct_ref_seq", 1, {"ref_id": "1", "pdbx_strand_id": "A", "seq_align_beg": "1", "seq_align_end": "9"}), ("e", "_struct_ref_seq", 2, {"ref_id": "7"})], "entry_id string, category string, row_ord int, cols map<string,string>")
    q = metadata.quality(raw).first()
    assert (q["experimental_method"], q["resolution"], q["r_free"]) == ("X-RAY", 1.8, None)
    assert metadata.uniprot_mappings(raw).count() == 1
    assert rows(metadata.category(raw, "exptl", ["method", "none"]), "method", "none") == [("?", None), ("X-RAY", None)]


def test_curation(spark):
    t = spark.createDataFrame([("a", 1.5, "X-RAY"), ("b", 9.0, "x-ray"), ("c", None, "NMR"), ("a", 1.0, "X-RAY")], "entry_id string, resolution double, method string")
    kept, gone = curate.apply_rules(t, [*curate.resolution(3.0), *curate.method(include=["x-ray"])])
    assert rows(kept, "entry_id") == [("a",), ("a",)] and rows(gone, "unit_id", "reason_code") == [("b", "RESOLUTION_THRESHOLD"), ("c", "NULL_RESOLUTION")]
    once, twice = curate.deduplicate(kept, "entry_id", ["resolution"])
    assert rows(once, "resolution") == [(1.0,)] and rows(twice, "reason_code") == [("DUPLICATE",)]
    assert rows(curate.validate(curate.counts(4, once, gone.unionByName(twice))), "code") == []
