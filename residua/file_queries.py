"""Registered queries of the file readers: mmCIF texts are made from the driver tables, read back, and held against the tables in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua import api
from residua.fixtures import ctes, frame
from residua.queries import query

#: Text of an entry with one atom, for entries whose atoms don't matter.
ONE_ATOM = "_atom_site.id 1\n_atom_site.label_asym_id A\n"


def _loop(t: DataFrame, entry: str, order: str, name: str, items: dict[str, str], rename: str = "") -> DataFrame:
    """(entry_id, text): a loop per entry; ``items`` are SQL texts of tokens; ``rename`` is SQL over ``entry_id`` and ``head`` for the tags."""
    head = "".join(f"{name}.{k}\n" for k in items)
    line = "concat_ws(' ', " + ", ".join(f"CAST({v} AS STRING)" for v in items.values()) + ") AS line"
    g = t.selectExpr(f"CAST({entry} AS STRING) AS entry_id", f"{order} AS o", line).groupBy("entry_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("o", "line")))["line"], "\n").alias("lines"))
    tags = g.withColumn("head", F.lit(head)).withColumn("head", F.expr(rename or "head"))
    return tags.select("entry_id", F.concat(F.lit("loop_\n"), "head", "lines", F.lit("\n")).alias("text"))


def _files(*loops: DataFrame, more: str = "") -> DataFrame:
    """(path, content) of an entry's loops, one file each."""
    t = loops[0]
    for i, x in enumerate(loops[1:]):
        t = t.join(x.withColumnRenamed("text", f"t{i}"), "entry_id", "left")
    parts = [F.coalesce(F.col(c), F.lit("")) for c in t.columns if c != "entry_id"]
    whole = F.concat(F.lit("data_"), "entry_id", F.lit("\n" + more), *parts)
    return t.select(F.concat("entry_id", F.lit(".cif")).alias("path"), F.encode(whole, "UTF-8").alias("content"))


_MODEL = "CASE WHEN CAST(entry_id AS BIGINT) % 7 = 0 THEN 2 WHEN CAST(entry_id AS BIGINT) % 5 = 0 AND atom_ord % 2 = 0 THEN 2 ELSE 1 END"


@query(ctes("fx_atoms") + f""" SELECT entry_id, row_number() OVER (PARTITION BY entry_id ORDER BY atom_ord) AS atom_ord, atom_ord AS id, group_pdb, label_atom_id, label_alt_id, label_comp_id, label_asym_id, label_entity_id, label_seq_id,
 CASE WHEN atom_ord = 3 THEN 'B' END AS ins_code, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, CAST(occupancy AS DOUBLE) AS occupancy, auth_seq_id || CASE WHEN atom_ord = 3 THEN 'B' ELSE '' END AS auth_seq_id, m AS model_num
 FROM (SELECT *, CAST({_MODEL} AS INT) AS m FROM fx_atoms) WHERE m = 1 OR CAST(entry_id AS BIGINT) % 7 = 0""")
def cif_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Atoms of the first model, or of the one that is there where there is no first."""
    atoms = {"id": "atom_ord", "label_atom_id": "label_atom_id", "label_alt_id": "coalesce(label_alt_id, '.')", "label_comp_id": "label_comp_id", "label_asym_id": "label_asym_id", "label_entity_id": "label_entity_id", "pdbx_PDB_ins_code": "CASE WHEN atom_ord = 3 THEN 'B' ELSE '?' END", "Cartn_x": "x", "Cartn_y": "y", "Cartn_z": "z", "occupancy": "occupancy", "auth_seq_id": "auth_seq_id", "pdbx_PDB_model_num": _MODEL}
    files = _files(_loop(frame(spark, d, "fx_atoms"), "entry_id", "atom_ord", "_atom_site", atoms), _loop(frame(spark, d, "fx_types"), "entry_id", "entity_ord", "_entity", {"id": "id", "type": "type"}))
    return api.from_raw_bytes(files)[0]["atoms"].select("entry_id", "atom_ord", "id", "group_pdb", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "label_entity_id", "label_seq_id", "ins_code", "x", "y", "z", "occupancy", "auth_seq_id", "model_num")


@query("""SELECT replace(p_brand, '#', '') AS entry_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS entity_ord, CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size % 3 = 0 THEN 'non-polymer' ELSE 'polymer' END AS type,
 CASE WHEN p_brand NOT LIKE '%3' THEN p_name END AS description, CASE WHEN p_brand NOT LIKE '%3' AND p_size % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS formula_weight, CASE WHEN p_brand NOT LIKE '%3' THEN 'man' END AS src_method,
 CASE WHEN p_size % 3 <> 0 THEN replace(upper(p_name), ' ', '') END AS seq, CASE WHEN p_size % 3 = 1 THEN upper(p_type) WHEN p_size % 3 = 2 THEN replace(upper(p_name), ' ', '') END AS seq_can, CASE WHEN p_size % 3 <> 0 AND p_size % 2 = 0 THEN 'A,B' END AS strand_id FROM part""")
def cif_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities with their polymers; entries whose entities lack one of the described items have none of these."""
    p = frame(spark, d, "part").withColumn("p_brand", F.regexp_replace("p_brand", "#", ""))
    ent = {"id": "p_partkey", "type": "CASE WHEN p_size % 3 = 0 THEN 'non-polymer' ELSE 'polymer' END", "pdbx_description": r"concat('\'', p_name, '\'')", "formula_weight": "CASE WHEN p_size % 5 = 0 THEN '?' ELSE CAST(p_size AS STRING) END", "src_method": "'man'"}
    poly = {"entity_id": "p_partkey", "type": "'polypeptide(L)'", "pdbx_seq_one_letter_code": r"concat('\n;', upper(replace(p_name, ' ', '\n')), '\n;\n')", "pdbx_seq_one_letter_code_can": "CASE WHEN p_size % 3 = 1 THEN upper(p_type) ELSE '.' END", "pdbx_strand_id": "CASE WHEN p_size % 2 = 0 THEN 'A,B' ELSE '?' END"}
    files = _files(_loop(p, "p_brand", "p_partkey", "_entity", ent, "CASE WHEN entry_id LIKE '%3' THEN replace(head, 'src_method', 'other') ELSE head END"), _loop(p.filter("p_size % 3 <> 0"), "p_brand", "p_partkey", "_entity_poly", poly), more=ONE_ATOM)
    return api.from_raw_bytes(files)[0]["entities"].select("entry_id", "entity_ord", "id", "type", F.col("pdbx_description").alias("description"), "formula_weight", "src_method", F.col("poly.seq").alias("seq"), "seq_can", F.col("poly.strand_id").alias("strand_id"))


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS entry_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY min(c_custkey)) AS INT) AS asym_ord, c_mktsegment AS id, c_mktsegment AS entity_id, arg_min(CASE WHEN c_custkey % 2 = 0 THEN 'X' ELSE 'Y' END, c_custkey) AS auth_id FROM customer GROUP BY c_nationkey, c_mktsegment""")
def cif_asym_units(spark: SparkSession, d: str) -> DataFrame:
    """Chains in the order of their entities, each with the author's id of its first atom."""
    c = frame(spark, d, "customer")
    e = c.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("o"))
    files = _files(_loop(c, "c_nationkey", "c_custkey", "_atom_site", {"id": "c_custkey", "label_asym_id": "c_mktsegment", "label_entity_id": "c_mktsegment", "auth_asym_id": "CASE WHEN c_custkey % 2 = 0 THEN 'X' ELSE 'Y' END"}), _loop(e, "c_nationkey", "o", "_entity", {"id": "c_mktsegment", "type": "'polymer'"}))
    return api.from_raw_bytes(files)[0]["asym_units"].select("entry_id", "asym_ord", "id", "entity_id", "auth_id")


_CONN = {"id": "s_suppkey", "conn_type_id": "CASE WHEN s_suppkey % 3 = 0 THEN '?' ELSE 'disulf' END"} | {f"ptnr{k}_{n}": v for k in (1, 2) for n, v in (("label_asym_id", f"CASE WHEN s_suppkey % 4 = {k} THEN '.' ELSE 'A' END"), ("label_comp_id", "'CYS'"), ("label_seq_id", f"CASE WHEN s_suppkey % 5 = 0 THEN '.' ELSE CAST(s_suppkey + {k} AS STRING) END"), ("label_atom_id", "'SG'"), ("auth_asym_id", "'B'"), ("auth_seq_id", "'?'"), ("PDB_ins_code", f"CASE WHEN s_suppkey % 2 = {k % 2} THEN 'C' ELSE '?' END"), ("symmetry", "'1_555'"))} | {"pdbx_dist_value": "CASE WHEN s_suppkey % 6 = 0 THEN 'far' ELSE '2.04' END", "details": "'?'"}


@query("SELECT CAST(s_nationkey AS VARCHAR) AS entry_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT) AS conn_ord, CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'covale' ELSE 'disulf' END AS conn_type_id, "
    + ", ".join(f"CASE WHEN s_suppkey % 4 = {k} THEN '' ELSE 'A' END AS asym_{k}, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey + {k} AS INT) END AS seq_{k}, CASE WHEN s_suppkey % 2 = {k % 2} THEN 'C' END AS ins_{k}" for k in (1, 2))
    + ", CASE WHEN s_suppkey % 6 <> 0 THEN 2.04::DOUBLE END AS dist FROM supplier WHERE s_nationkey % 4 <> 0")
def cif_connections(spark: SparkSession, d: str) -> DataFrame:
    """Connections with both partners; entries whose loop lacks an item have none."""
    t = _loop(frame(spark, d, "supplier"), "s_nationkey", "s_suppkey", "_struct_conn", _CONN, "CASE WHEN CAST(entry_id AS INT) % 4 = 0 THEN replace(head, 'ptnr2_symmetry', 'ptnr2_symm') ELSE head END")
    c = api.from_raw_bytes(_files(t, more=ONE_ATOM))[0]["connections"]
    sides = [F.col(f"ptnr{k}.{n}").alias(f"{to}_{k}") for k in (1, 2) for n, to in (("label_asym_id", "asym"), ("label_seq_id", "seq"), ("ins_code", "ins"))]
    return c.select("entry_id", "conn_ord", "id", "conn_type_id", *sides, "dist")


_EXPRESSION = "CASE n_nationkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '1,2' WHEN 2 THEN '(1-3)' ELSE '(1-2)(3)' END"


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS entry_id, CAST(n_nationkey AS VARCHAR) AS id, 'author' AS details, CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_nationkey AS INT) END AS oligomeric_count,
 CASE n_nationkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '1,2' WHEN 2 THEN '1,2,3' ELSE '1x3,2x3' END AS expressions, 'A,B' AS chains, CASE n_nationkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '1,2' WHEN 2 THEN '1,2,3' END AS operators, CASE WHEN n_nationkey % 4 <> 3 THEN 1.5::DOUBLE END AS m22 FROM nation""")
def cif_assemblies(spark: SparkSession, d: str) -> DataFrame:
    """Assemblies, their generators with expanded operator names, and the operators that are listed, in order of use."""
    n = frame(spark, d, "nation")
    ops = n.select("n_regionkey").distinct().withColumn("k", F.explode(F.array(*[F.lit(i) for i in (3, 1, 2)])))
    cell = {f"matrix[{i}][{j}]": "1.5" if i == j else "0.0" for i in (1, 2, 3) for j in (1, 2, 3)} | {f"vector[{i}]": "0.25" for i in (1, 2, 3)}
    files = _files(
        _loop(n, "n_regionkey", "n_nationkey", "_pdbx_struct_assembly", {"id": "n_nationkey", "details": "'author'", "method_details": "'?'", "oligomeric_details": "'x'", "oligomeric_count": "CASE WHEN n_nationkey % 3 = 0 THEN '?' ELSE CAST(n_nationkey AS STRING) END"}),
        _loop(n, "n_regionkey", "n_nationkey", "_pdbx_struct_assembly_gen", {"assembly_id": "n_nationkey", "oper_expression": _EXPRESSION, "asym_id_list": "'A,B'"}),
        _loop(ops, "n_regionkey", "-k", "_pdbx_struct_oper_list", {"id": "k", "type": "'identity'", **cell}), more=ONE_ATOM)
    a = api.from_raw_bytes(files)[0]["assemblies"]
    return a.select("entry_id", "id", "details", "oligomeric_count", F.array_join("generators.oper_expression", ";").alias("expressions"), F.array_join(F.flatten("generators.asym_id_list"), ",").alias("chains"), F.array_join("operators.id", ",").alias("operators"), F.col("operators")[0]["matrix"][1][1].alias("m22"))


_ENDS = {f"{e}_{n}": v for e in ("beg", "end") for n, v in (("label_asym_id", "CASE WHEN c_custkey % 3 = 0 THEN '?' ELSE 'A' END"), ("label_seq_id", "CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE CAST(c_custkey AS STRING) END"), ("auth_asym_id", "c_mktsegment"), ("auth_seq_id", "'.'"))}


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS entry_id, kind, CAST(row_number() OVER (PARTITION BY kind, c_nationkey ORDER BY c_custkey) - 1 AS INT) AS ord, CAST(c_custkey AS VARCHAR) AS id, CASE WHEN kind = 'strand' THEN 'S' WHEN c_custkey % 5 = 0 THEN '' ELSE 'HELX_P' END AS sort,
 CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'A' END AS beg_asym, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey AS INT) END AS end_seq, c_mktsegment AS end_auth, CAST(NULL AS VARCHAR) AS beg_auth_seq FROM customer, (VALUES ('conf'), ('strand')) AS k(kind) WHERE kind = 'conf' OR c_nationkey % 2 = 0""")
def cif_secondary_structure(spark: SparkSession, d: str) -> DataFrame:
    """Helices and strands; where a needed item is missing, none."""
    c = frame(spark, d, "customer")
    files = _files(
        _loop(c, "c_nationkey", "c_custkey", "_struct_conf", {"id": "c_custkey", "conf_type_id": "CASE WHEN c_custkey % 5 = 0 THEN '?' ELSE 'HELX_P' END", **_ENDS}),
        _loop(c, "c_nationkey", "c_custkey", "_struct_sheet_range", {"sheet_id": "'S'", "id": "c_custkey", **_ENDS}, "CASE WHEN CAST(entry_id AS INT) % 2 = 1 THEN replace(head, 'end_auth_seq_id', 'end_auth_seq') ELSE head END"), more=ONE_ATOM)
    s = api.from_raw_bytes(files)[0]
    parts = [s[t].select("entry_id", F.lit(kind).alias("kind"), "ord", "id", F.col(sort).alias("sort"), F.col("beg_label_asym_id").alias("beg_asym"), F.col("end_label_seq_id").alias("end_seq"), F.col("end_auth_asym_id").alias("end_auth"), F.col("beg_auth_seq_id").alias("beg_auth_seq")) for t, kind, sort in (("conf_records", "conf", "conf_type_id"), ("sheet_strands", "strand", "sheet_id"))]
    return parts[0].unionByName(parts[1])


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS entry_id, '_ext' AS category, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT) AS row_ord, item, CASE item WHEN 'id' THEN CAST(c_custkey AS VARCHAR) WHEN 'name' THEN c_name || ' ''s' ELSE '?' END AS value FROM customer, (VALUES ('id'), ('name'), ('note')) AS i(item)
 UNION ALL SELECT DISTINCT CAST(c_nationkey AS VARCHAR), '_struct', 0, 'title', 'a "quoted" title' FROM customer""")
def cif_raw(spark: SparkSession, d: str) -> DataFrame:
    """Raw rows of other categories, item by item, quotes resolved; atoms aren't among them."""
    t = _loop(frame(spark, d, "customer"), "c_nationkey", "c_custkey", "_ext", {"id": "c_custkey", "name": "concat('\"', c_name, ' \\'s\"')", "note": "'?'"})
    raw = api.from_raw_bytes(_files(t, more=ONE_ATOM + "_struct.title 'a \"quoted\" title'\n"))[0]["raw"]
    return raw.select("entry_id", "category", "row_ord", F.explode("cols").alias("item", "value"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS entry_id, CASE o_orderkey % 8 WHEN 0 THEN 'EMPTY_CONTENT' WHEN 1 THEN 'EMPTY_CONTENT' WHEN 2 THEN 'CIF_PARSE_ERROR' WHEN 3 THEN 'PARSE_ERROR' WHEN 4 THEN 'NO_MODEL' WHEN 5 THEN 'MODEL_NOT_FOUND' END AS code,
 CASE WHEN o_orderkey % 8 < 5 THEN 'error' WHEN o_orderkey % 8 = 5 THEN 'warning' END AS severity, CASE WHEN o_orderkey % 8 < 5 THEN 'failed' WHEN o_orderkey % 8 = 5 THEN 'warning' ELSE 'success' END AS status, CASE WHEN o_orderkey % 8 > 4 THEN o_orderpriority END AS title FROM orders""")
def cif_status(spark: SparkSession, d: str) -> DataFrame:
    """What unreadable, empty and odd files come to: a diagnostic and a status, and no entry for failed ones."""
    good = r"""concat('data_', o_orderkey, '\n_struct.title "', o_orderpriority, '"\n_atom_site.id 1\n')"""
    text = f"CASE o_orderkey % 8 WHEN 0 THEN encode('', 'UTF-8') WHEN 1 THEN encode(' \\n', 'UTF-8') WHEN 2 THEN encode(concat({good}, 'loop_\\n_a.b\\n_a.c\\n1\\n'), 'UTF-8') WHEN 3 THEN unhex('64FF') WHEN 4 THEN encode(concat('data_', o_orderkey, '\\n_struct.title x\\n'), 'UTF-8') WHEN 5 THEN encode(concat({good}, '_atom_site.pdbx_PDB_model_num 4\\n'), 'UTF-8') ELSE encode({good}, 'UTF-8') END AS content"
    s, notes, status = api.from_raw_bytes(frame(spark, d, "orders").selectExpr("concat('dir/', o_orderkey, '.cif') AS path", text))
    return status.join(notes.select("entry_id", "code", "severity"), "entry_id", "left").join(s["entries"], "entry_id", "left").select("entry_id", "code", "severity", "status", "title")
