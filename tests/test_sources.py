import gzip
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from residua.sources import cif, fetch, sequences, store

CIF = """data_1ABC
#
_entry.id 1ABC
_struct.title 'A small "test" entry'
loop_
_entity.id
_entity.type
_entity.pdbx_description
_entity.formula_weight
_entity.src_method
1 polymer chain ? man
2 non-polymer 'ZINC ION' 65.4 syn
loop_
_entity_poly.entity_id
_entity_poly.type
_entity_poly.pdbx_seq_one_letter_code
_entity_poly.pdbx_seq_one_letter_code_can
_entity_poly.pdbx_strand_id
1 polypeptide(L) ?
;MK
TA
;
A
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_entity_id
_atom_site.label_seq_id
_atom_site.pdbx_PDB_ins_code
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
_atom_site.B_iso_or_equiv
_atom_site.auth_seq_id
_atom_site.auth_asym_id
_atom_site.pdbx_PDB_model_num
ATOM 1 N . MET A 1 1 ? 1.0 2.0 3.0 1.00 10.0 11 A 1
ATOM 2 CA A MET A 1 1 B 1.0 2.0 3.5 0.50 10.0 11 A 1
HETATM 0 ZN . ZN B 2 . ? 4.0 2.0 3.5 0.50 10.0 301 A 1
ATOM 9 N . MET A 1 1 ? 9.0 2.0 3.0 1.00 10.0 11 A 2
loop_
_pdbx_struct_assembly.id
_pdbx_struct_assembly.details
1 author
loop_
_pdbx_struct_assembly_gen.assembly_id
_pdbx_struct_assembly_gen.oper_expression
_pdbx_struct_assembly_gen.asym_id_list
1 (1-2) A,B
loop_
_pdbx_struct_oper_list.id
_pdbx_struct_oper_list.type
_pdbx_struct_oper_list.matrix[1][1]
1 identity 1.0
2 rotation -1.0
"""


def test_tokens_and_errors():
    name, rows = cif.parse(CIF)
    d = {(c, k): r for c, k, r in rows}
    assert name == "1ABC" and d["_struct", 0]["title"] == 'A small "test" entry' and d["_entity_poly", 0]["pdbx_seq_one_letter_code_can"] == "MK\nTA"
    assert cif.parse(CIF, raw_tokens=True)[1]
    for bad in ("", "data_a\n_x.y", "data_a\nloop_\n_x.a\n_x.b\n1 2 3\n", "data_a\ndata_b\n", "plain text"):
        with pytest.raises(cif.CifError):
            cif.parse(bad)


def test_tables(spark, tmp_path):
    (tmp_path / "1abc.cif").write_text(CIF)
    (tmp_path / "2abc.cif.gz").write_bytes(gzip.compress(CIF.replace("1ABC", "2ABC").encode()))
    (tmp_path / "bad.cif").write_text("data_bad\nloop_\n_a.b\n_a.c\n1\n")
    (tmp_path / "none.cif").write_text("\n")
    (tmp_path / "empty.cif").write_text("data_EMPTY\n_struct.title x\n")
    t = cif.read(spark, str(tmp_path))
    assert {(r["entry_id"], r["status"]) for r in t["status"].collect()} == {("1ABC", "success"), ("2ABC", "success"), ("bad", "failed"), ("none", "failed"), ("EMPTY", "failed")}
    assert {(r["entry_id"], r["code"], r["severity"]) for r in t["diagnostics"].collect()} == {("bad", "CIF_PARSE_ERROR", "error"), ("none", "EMPTY_CONTENT", "error"), ("EMPTY", "NO_MODEL", "error")}
    assert {r["entry_id"] for r in t["entries"].collect()} == {"1ABC", "2ABC"}
    a = t["atoms"].filter("entry_id = '1ABC'").orderBy("atom_ord").collect()
    assert [(r["group_pdb"], r["id"], r["label_seq_id"], r["auth_seq_id"], r["label_alt_id"]) for r in a] == [("ATOM", 1, 11, "11", None), ("ATOM", 2, 11, "11B", "A"), ("HETATM", 3, None, "301", None)]
    assert [(r["id"], r["entity_id"]) for r in t["asym_units"].filter("entry_id = '2ABC'").orderBy("asym_ord").collect()] == [("A", "1"), ("B", "2")]
    assert t["entities"].filter("entry_id = '1ABC' and id = '1'").first()["seq_can"] == "MKTA"
    asm = t["assemblies"].filter("entry_id = '1ABC'").first()
    assert [o["id"] for o in asm["operators"]] == ["1", "2"] and asm["generators"][0]["asym_id_list"] == ["A", "B"]
    assert t["raw"].filter("category = '_atom_site'").count() == 0
    assert cif.read(spark, str(tmp_path / "1abc.cif"), model_num=7)["diagnostics"].first()["code"] == "MODEL_NOT_FOUND"


def test_optional_categories_need_all_their_items(spark, tmp_path):
    sides = [f"ptnr{k}_{x}" for k in (1, 2) for x in ("label_asym_id", "label_comp_id", "label_seq_id", "label_atom_id", "auth_asym_id", "auth_seq_id", "PDB_ins_code", "symmetry")]
    names = ["id", "conn_type_id", *sides, "pdbx_dist_value", "details"]
    loop = "loop_\n" + "".join(f"_struct_conn.{n}\n" for n in names) + " ".join(["c1", "?", *["A", "CYS", "7", "SG", "A", "9", "B", "."] * 2, "2.0", "x"]) + "\n"
    extra = "_atom_site_anisotrop.id 1\n"
    (tmp_path / "full.cif").write_text(CIF.replace("1ABC", "FULL") + loop + extra)
    (tmp_path / "part.cif").write_text(CIF.replace("1ABC", "PART").replace("_entity.formula_weight\n", "").replace("chain ?", "chain").replace("ION' 65.4", "ION'") + loop.replace("_struct_conn.details\n", "").replace(" x\n", "\n"))
    t = cif.read(spark, str(tmp_path))
    conn = t["connections"].collect()
    assert [(r["entry_id"], r["conn_type_id"], r["ptnr1"]["ins_code"], r["ptnr2"]["label_seq_id"], r["dist"]) for r in conn] == [("FULL", "covale", "B", 7, 2.0)]
    assert {(r["entry_id"], r["pdbx_description"], r["src_method"]) for r in t["entities"].filter("id = '2'").collect()} == {("FULL", "ZINC ION", "syn"), ("PART", None, None)}
    asm = t["assemblies"].filter("entry_id = 'FULL'").first()
    assert asm["details"] is None and asm["generators"][0]["oper_expression"] == "1,2"
    assert t["raw"].filter("category = '_atom_site_anisotrop'").count() == 1


def test_operator_expressions(spark):
    t = spark.createDataFrame([("1",), ("1,2",), ("(1-3)",), ("(1-2)(3,P)",)], "e string").select(cif.operators(F.col("e")))
    assert [r[0] for r in t.collect()] == [["1"], ["1", "2"], ["1", "2", "3"], ["1x3", "1xP", "2x3", "2xP"]]


def test_fasta_and_hits(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one first\nMK\nTA\n>two\nGG\n")
    (tmp_path / "b.fa").write_text(">three\nAA\n")
    got = {r["item_id"]: r["sequence"] for r in sequences.read_fasta(spark, str(tmp_path)).collect()}
    assert got == {"one": "MKTA", "two": "GG", "three": "AA"}
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        sequences.read_fasta(spark, str(tmp_path / "empty"))
    (tmp_path / "hits.m8").write_text("a\tb\t0.5\t10\t0.9\t0.8\n")
    assert sequences.read_hits(spark, str(tmp_path / "hits.m8")).first()["coverage"] == 0.8


def test_fetch_and_cache(spark, tmp_path):
    to, calls = str(tmp_path / "cache"), tmp_path / "calls"
    calls.mkdir()

    def fake(url):
        if "bad" in url.lower():
            raise RuntimeError("no such entry")
        return gzip.compress(b"data_x\n")

    first = fetch.fetch_many(spark, ["1ABC", "bad"], to, "pdbe", options=fetch.FetchOptions(allow_partial=True), fetcher=fake).collect()
    assert [(r["entry_id"], r["status"], r["from_cache"]) for r in first] == [("1ABC", "success", False), ("bad", "failed", False)]
    assert fetch.fetch_many(spark, ["1ABC"], to, "pdbe", fetcher=fake).first()["from_cache"] is True
    with pytest.raises(RuntimeError):
        fetch.fetch_many(spark, ["bad"], to, "pdb", fetcher=fake)
    with pytest.raises(ValueError):
        fetch.fetch_many(spark, ["1ABC"], to, "elsewhere", fetcher=fake)
    late = lambda: datetime(2999, 1, 1, tzinfo=UTC)
    assert fetch.fetch_many(spark, ["1ABC"], to, "pdbe", options=fetch.FetchOptions(max_age_seconds=1, stale_behavior="warn"), fetcher=fake, clock=late).first()["from_cache"] is False
    with pytest.raises(Exception, match="CacheStale|1abc"):
        fetch.fetch_many(spark, ["1ABC"], to, "pdbe", options=fetch.FetchOptions(max_age_seconds=1, stale_behavior="fail"), fetcher=fake, clock=late)
    with pytest.raises(NotImplementedError):
        fetch.fetch_pdb()


def test_stratified(spark):
    c = spark.createDataFrame([(b, o, f"e{i}") for b, o, ids in (("x", 1, range(5)), ("y", 2, range(3, 9))) for i in ids], "bucket string, bucket_ord int, entry_id string")
    n = spark.createDataFrame([("x", 3), ("y", 3)], "bucket string, count int")
    got = fetch.stratified(c, n, 1).collect()
    assert len(got) == 6 and len({r["entry_id"] for r in got}) == 6


def test_artifact(spark, tmp_path):
    from residua.plans import datasets

    splits = spark.createDataFrame([("a", "train"), ("b", "val"), ("c", "test")], "item_id string, split string")
    one, two = (datasets.build_artifact(str(tmp_path / str(k)), splits, {"providers": ["pdbe"]}, ["p"], {"engine": "1"}, 3) for k in (1, 2))
    assert one == two and spark.read.parquet(str(tmp_path / "1" / "splits")).count() == 3
    assert store.digest({"b": 1, "a": 2}) == store.digest({"a": 2, "b": 1})


def test_atoms_move_once(spark, tmp_path):
    """Atoms are moved by entry as typed columns, once; kinds once too. Items that the table lacks stay in ``cols``."""
    for i in range(3):
        (tmp_path / f"{i}.cif").write_text(CIF.replace("1ABC", f"E{i}"))
    rows = cif.read_rows(spark.read.format("binaryFile").load(str(tmp_path)))
    atoms = cif.tables(rows)["atoms"]
    assert atoms._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert [(r["id"], r["x"], r["label_alt_id"], r["model_num"]) for r in atoms.filter("entry_id = 'E2'").orderBy("atom_ord").collect()] == [(1, 1.0, None, 1), (2, 1.0, "A", 1), (3, 4.0, None, 1)]
    got = rows.filter("category = '_atom_site' and entry_id = 'E0'").orderBy("row_ord").select("cols", "site.label_alt_id", "site.label_seq_id").collect()
    assert [tuple(r) for r in got] == [({"group_PDB": g}, alt, seq) for g, alt, seq in (("ATOM", None, "1"), ("ATOM", "A", "1"), ("HETATM", None, None), ("ATOM", None, "1"))]
