"""Registered queries of the structure operators over the driver tables, each with the same in SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.fixtures import ctes, frame
from residua.functions import scalars as S
from residua.operators import canonical as C
from residua.operators import checks, curate, metadata, records, similarity, spatial

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


ATOMS, ASYM, TYPES, ENTITIES = ctes("fx_atoms"), ctes("fx_asym"), ctes("fx_asym", "fx_types"), ctes("fx_entities")
#: Distinct numbers of a chain, as a clause after fx_atoms.
SEEN = ", seen AS (SELECT DISTINCT entry_id, label_asym_id, label_seq_id FROM fx_atoms WHERE group_pdb = 'ATOM' AND label_seq_id IS NOT NULL)"
GAPS = SEEN + ", gaps AS (SELECT * FROM (SELECT *, lead(label_seq_id) OVER (PARTITION BY entry_id, label_asym_id ORDER BY label_seq_id) AS before_seq FROM seen) WHERE before_seq - label_seq_id > 1)"
RUNS = SEEN + """, isl AS (SELECT *, label_seq_id - row_number() OVER (PARTITION BY entry_id, label_asym_id ORDER BY label_seq_id) AS g FROM seen),
runs AS (SELECT entry_id, label_asym_id, min(label_seq_id) AS run_start, max(label_seq_id) AS run_end, count(*) AS run_len FROM isl GROUP BY entry_id, label_asym_id, g),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id, label_asym_id ORDER BY run_len DESC, run_start) AS r FROM runs) WHERE r = 1)"""
INCOMPLETE = ", bad AS (SELECT entry_id, label_asym_id, CAST(max(label_seq_id) - min(label_seq_id) + 1 AS BIGINT) AS span, count(DISTINCT label_seq_id) AS present FROM fx_atoms WHERE group_pdb = 'ATOM' AND label_seq_id IS NOT NULL GROUP BY entry_id, label_asym_id HAVING max(label_seq_id) - min(label_seq_id) + 1 > count(DISTINCT label_seq_id))"


def _atoms(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "fx_atoms")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Gaps and the longest complete region of each incomplete chain."""
    atoms = _atoms(spark, d)
    gaps = C.sequence_gaps(atoms).groupBy("entry_id", "label_asym_id").agg(F.count(F.lit(1)).alias("n_gaps"))
    return C.longest_regions(atoms).join(gaps, ["entry_id", "label_asym_id"]).select("entry_id", F.col("label_asym_id").alias("chain_id"), "n_gaps", "run_start", "run_end", "run_len")


@query(ATOMS + RUNS + GAPS.removeprefix(SEEN) + " SELECT entry_id, label_asym_id AS chain_id, n AS n_gaps, run_start, run_end, run_len FROM best JOIN (SELECT entry_id, label_asym_id, count(*) AS n FROM gaps GROUP BY ALL) USING (entry_id, label_asym_id)")
def gaps_and_regions(spark: SparkSession, d: str) -> DataFrame:
    return flagship(spark, d)


@query(ATOMS + GAPS + " SELECT entry_id, label_asym_id, label_seq_id AS after_seq, before_seq FROM gaps")
def gap_report(spark: SparkSession, d: str) -> DataFrame:
    return C.sequence_gaps(_atoms(spark, d))


@query(ATOMS + RUNS + " SELECT entry_id, label_asym_id, run_start, run_end, run_len FROM best")
def longest_region(spark: SparkSession, d: str) -> DataFrame:
    return C.longest_regions(_atoms(spark, d))


@query(ATOMS + RUNS + INCOMPLETE + " SELECT a.entry_id, a.atom_ord, a.label_asym_id, a.label_seq_id FROM fx_atoms a LEFT JOIN bad USING (entry_id, label_asym_id) LEFT JOIN best b USING (entry_id, label_asym_id) WHERE bad.span IS NULL OR a.label_seq_id BETWEEN b.run_start AND b.run_end")
def truncate_regions(spark: SparkSession, d: str) -> DataFrame:
    return C.truncate_to_regions(_atoms(spark, d)).select("entry_id", "atom_ord", "label_asym_id", "label_seq_id")


@query(ATOMS + GAPS + " SELECT entry_id, atom_ord, label_asym_id FROM fx_atoms a WHERE NOT EXISTS (SELECT 1 FROM gaps g WHERE g.entry_id = a.entry_id AND g.label_asym_id = a.label_asym_id)")
def drop_chain_segment(spark: SparkSession, d: str) -> DataFrame:
    return C.drop_gapped_chains(_atoms(spark, d)).select("entry_id", "atom_ord", "label_asym_id")


@query(ATOMS + INCOMPLETE + " SELECT * FROM bad")
def incomplete_chain_report(spark: SparkSession, d: str) -> DataFrame:
    return C.incomplete_chains(_atoms(spark, d))


@query(ASYM + INCOMPLETE + " SELECT a.entry_id, a.atom_ord, a.label_asym_id FROM fx_atoms a JOIN fx_asym s ON s.entry_id = a.entry_id AND s.id = a.label_asym_id WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.entry_id = a.entry_id AND b.label_asym_id = a.label_asym_id)")
def incomplete_exclude(spark: SparkSession, d: str) -> DataFrame:
    return C.exclude_incomplete(_atoms(spark, d), frame(spark, d, "fx_asym"))[0].select("entry_id", "atom_ord", "label_asym_id")


@query(ATOMS + " SELECT entry_id, atom_ord, label_asym_id, CAST(dense_rank() OVER (PARTITION BY entry_id, label_asym_id ORDER BY f) AS INT) AS label_seq_id FROM (SELECT *, min(atom_ord) OVER (PARTITION BY entry_id, label_asym_id, label_seq_id, label_comp_id, ins_code) AS f FROM fx_atoms)")
def renumber_residues(spark: SparkSession, d: str) -> DataFrame:
    return C.number_residues(_atoms(spark, d), "renumber")[0].select("entry_id", "atom_ord", "label_asym_id", "label_seq_id")


@query(ATOMS + " SELECT entry_id, chain_id, original_seq_id, original_auth_seq_id, canonical_seq_id, atom_ord FROM (SELECT entry_id, label_asym_id AS chain_id, label_seq_id AS original_seq_id, auth_seq_id AS original_auth_seq_id, CAST(dense_rank() OVER (PARTITION BY entry_id, label_asym_id ORDER BY f) AS INT) AS canonical_seq_id, atom_ord, row_number() OVER (PARTITION BY entry_id, label_asym_id, label_seq_id, auth_seq_id ORDER BY atom_ord) AS r FROM (SELECT *, min(atom_ord) OVER (PARTITION BY entry_id, label_asym_id, label_seq_id, label_comp_id, ins_code) AS f FROM fx_atoms)) WHERE r = 1")
def renumber_mapping(spark: SparkSession, d: str) -> DataFrame:
    return C.number_residues(_atoms(spark, d), "renumber")[1]


@query(ATOMS + " SELECT entry_id, atom_ord, CAST(auth_seq_id AS INT) AS label_seq_id FROM fx_atoms")
def use_auth_seq(spark: SparkSession, d: str) -> DataFrame:
    return C.number_residues(_atoms(spark, d), "use_auth_seq")[0].select("entry_id", "atom_ord", "label_seq_id")


@query(ASYM + " SELECT entry_id, id AS original_chain_id, chr(CAST(64 + row_number() OVER (PARTITION BY entry_id ORDER BY asym_ord) AS INT)) AS canonical_chain_id, asym_ord FROM fx_asym")
def remap_chain_ids(spark: SparkSession, d: str) -> DataFrame:
    return C.chain_map(frame(spark, d, "fx_asym"), "remap")


@query(ASYM + " SELECT a.entry_id, a.atom_ord, s.auth_id AS label_asym_id FROM fx_atoms a JOIN fx_asym s ON s.entry_id = a.entry_id AND s.id = a.label_asym_id")
def use_auth_chain(spark: SparkSession, d: str) -> DataFrame:
    mapping = C.chain_map(frame(spark, d, "fx_asym"), "use_auth_chain_id")
    return C.rename_chains(_atoms(spark, d), mapping, "label_asym_id").select("entry_id", "atom_ord", "label_asym_id")


def _altloc(order: str) -> str:
    return ATOMS + f""", e AS (SELECT entry_id, label_asym_id, label_seq_id, label_comp_id, label_alt_id, sum(CAST(occupancy AS DECIMAL(18,6))) AS so, sum(CAST(b_iso AS DECIMAL(18,6))) AS sb, count(*) AS n, min(atom_ord) AS f FROM fx_atoms WHERE label_alt_id <> '' GROUP BY ALL),
m AS (SELECT *, CAST(so AS DOUBLE) / n AS occ, CAST(sb AS DOUBLE) / n AS b FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY entry_id, label_asym_id, label_seq_id, label_comp_id ORDER BY {order}) AS r, count(*) OVER (PARTITION BY entry_id, label_asym_id, label_seq_id, label_comp_id) AS k FROM m),
w AS (SELECT * FROM p WHERE r = 1)"""


_KEPT = " SELECT a.entry_id, a.label_asym_id, a.label_comp_id, a.label_atom_id, a.x, a.y, a.z FROM fx_atoms a LEFT JOIN w ON w.entry_id = a.entry_id AND w.label_asym_id = a.label_asym_id AND w.label_seq_id IS NOT DISTINCT FROM a.label_seq_id AND w.label_comp_id = a.label_comp_id WHERE a.label_alt_id IS NULL OR a.label_alt_id = w.label_alt_id"
_ALT_COLS = ("entry_id", "label_asym_id", "label_comp_id", "label_atom_id", "x", "y", "z")
for _tie, _order in (("alphabetical_first", "occ DESC, label_alt_id"), ("alphabetical_last", "occ DESC, label_alt_id DESC"), ("lowest_b_factor", "occ DESC, b, label_alt_id"), ("highest_b_factor", "occ DESC, b DESC, label_alt_id")):
    _name = {"alphabetical_first": "first", "alphabetical_last": "last", "lowest_b_factor": "low_b", "highest_b_factor": "high_b"}[_tie]
    QUERIES[f"altloc_best_occ_{_name}"] = lambda spark, d, tie=_tie: C.pick_altlocs(_atoms(spark, d), "select_best_occupancy", tie)[0].select(*_ALT_COLS)
    ORACLES[f"altloc_best_occ_{_name}"] = _altloc(_order) + _KEPT


@query(_altloc("label_alt_id") + _KEPT)
def altloc_first(spark: SparkSession, d: str) -> DataFrame:
    return C.pick_altlocs(_atoms(spark, d), "select_first")[0].select(*_ALT_COLS)


@query(_altloc("(label_alt_id = 'O') DESC, label_alt_id") + _KEPT)
def altloc_user(spark: SparkSession, d: str) -> DataFrame:
    return C.pick_altlocs(_atoms(spark, d), "select_user_defined", label="O")[0].select(*_ALT_COLS)


@query(_altloc("occ DESC, b, label_alt_id") + " SELECT entry_id, label_asym_id, coalesce(CAST(label_seq_id AS VARCHAR), 'None') || ':' || label_comp_id AS residue_id, label_alt_id AS selected, k AS n_altlocs, (SELECT string_agg(m.label_alt_id, ',' ORDER BY m.label_alt_id) FROM m WHERE m.entry_id = w.entry_id AND m.label_asym_id = w.label_asym_id AND m.label_seq_id IS NOT DISTINCT FROM w.label_seq_id AND m.label_comp_id = w.label_comp_id) AS available_altlocs, 'best_occupancy' AS selection_reason FROM w WHERE k > 1")
def altloc_mapping(spark: SparkSession, d: str) -> DataFrame:
    return C.pick_altlocs(_atoms(spark, d), "select_best_occupancy", "lowest_b_factor")[1].withColumn("available_altlocs", F.array_join("available_altlocs", ","))


_HAS = ", h AS (SELECT entry_id, label_asym_id, label_seq_id, label_comp_id, min(atom_ord) AS first_ord, " + ", ".join(f"bool_or(label_atom_id = '{x}') AS h_{x}" for x in C.BACKBONE) + " FROM fx_atoms WHERE group_pdb = 'ATOM' GROUP BY ALL)"


@query(ATOMS + _HAS + " SELECT entry_id, label_asym_id, label_seq_id, label_comp_id, first_ord, concat_ws(',', CASE WHEN NOT h_C THEN 'C' END, CASE WHEN NOT h_CA THEN 'CA' END, CASE WHEN NOT h_N THEN 'N' END, CASE WHEN NOT h_O THEN 'O' END) AS missing FROM h WHERE NOT (h_C AND h_CA AND h_N AND h_O)")
def missing_backbone(spark: SparkSession, d: str) -> DataFrame:
    return C.missing_backbone(_atoms(spark, d)).withColumn("missing", F.array_join("missing", ","))


@query(ATOMS + _HAS + " SELECT a.entry_id, a.label_asym_id, a.label_atom_id, CAST(row_number() OVER (PARTITION BY a.entry_id ORDER BY h.first_ord NULLS LAST, a.atom_ord) AS BIGINT) AS atom_ord FROM fx_atoms a LEFT JOIN h ON a.group_pdb = 'ATOM' AND h.entry_id = a.entry_id AND h.label_asym_id = a.label_asym_id AND h.label_seq_id IS NOT DISTINCT FROM a.label_seq_id AND h.label_comp_id = a.label_comp_id WHERE a.group_pdb <> 'ATOM' OR (h_C AND h_CA AND h_N AND h_O)")
def drop_partial_residue(spark: SparkSession, d: str) -> DataFrame:
    return C.drop_partial_residues(_atoms(spark, d)).select("entry_id", "label_asym_id", "label_atom_id", "atom_ord")


@query(ENTITIES + " SELECT entry_id, id AS original_entity_id, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY entity_ord) AS VARCHAR) AS canonical_entity_id FROM fx_entities")
def entity_standardize(spark: SparkSession, d: str) -> DataFrame:
    return C.map_entities(frame(spark, d, "fx_entities"), "standardize").select("entry_id", "original_entity_id", "canonical_entity_id")


_MERGED = ENTITIES + ", f AS (SELECT *, CASE WHEN type = 'polymer' AND seq_can <> '' THEN min(entity_ord) OVER (PARTITION BY entry_id, seq_can, type = 'polymer') ELSE entity_ord END AS f FROM fx_entities), m AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY entry_id ORDER BY f) AS VARCHAR) AS c FROM f)"


@query(_MERGED + " SELECT entry_id, id AS original_entity_id, c AS canonical_entity_id, f = entity_ord AS kept FROM m")
def entity_merge(spark: SparkSession, d: str) -> DataFrame:
    return C.map_entities(frame(spark, d, "fx_entities"), "merge_equivalent_entities").select("entry_id", "original_entity_id", "canonical_entity_id", "kept")


@query(_MERGED + " SELECT entry_id, c AS canonical_entity_id, string_agg(id, ',' ORDER BY entity_ord) AS original_entity_ids FROM m GROUP BY entry_id, c")
def entity_merge_groups(spark: SparkSession, d: str) -> DataFrame:
    m = C.map_entities(frame(spark, d, "fx_entities"), "merge_equivalent_entities")
    return C.entity_groups(m).withColumn("original_entity_ids", F.array_join("original_entity_ids", ","))


def _assemblies(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("entry_id"), F.col("s_suppkey").alias("assembly_ord"), F.col("s_name").alias("id"))


@query("SELECT CAST(s_nationkey AS VARCHAR) AS entry_id, arg_min(s_name, s_suppkey) AS id FROM supplier GROUP BY 1")
def assembly_first(spark: SparkSession, d: str) -> DataFrame:
    return C.number_assemblies(_assemblies(spark, d), "preserve", "select_first_assembly")[0].select("entry_id", "id")


@query("SELECT CAST(s_nationkey AS VARCHAR) AS entry_id, s_name AS original_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS VARCHAR) AS canonical_id FROM supplier")
def assembly_remap(spark: SparkSession, d: str) -> DataFrame:
    return C.number_assemblies(_assemblies(spark, d), "remap")[1]


_ION = " OR ".join(f"upper(pdbx_description) LIKE '%{w}%'" for w in C.ION_WORDS)


@query(TYPES + f" SELECT a.entry_id, a.atom_ord, a.label_asym_id FROM fx_atoms a JOIN fx_asym s ON s.entry_id = a.entry_id AND s.id = a.label_asym_id LEFT JOIN fx_types t ON t.entry_id = s.entry_id AND t.id = s.entity_id WHERE t.type IS NULL OR t.type = 'polymer' OR (t.type <> 'water' AND NOT ({_ION}))")
def ligand_filter(spark: SparkSession, d: str) -> DataFrame:
    return C.filter_ligands(frame(spark, d, "fx_asym"), _atoms(spark, d), frame(spark, d, "fx_types"), "filter", waters=False, ions=False)[1].select("entry_id", "atom_ord", "label_asym_id")


@query(TYPES + " SELECT s.entry_id, 'LIGAND_ANNOTATED_ONLY' AS code, s.id AS field FROM fx_asym s JOIN fx_types t ON t.entry_id = s.entry_id AND t.id = s.entity_id WHERE t.type <> 'polymer'")
def ligand_annotate_only(spark: SparkSession, d: str) -> DataFrame:
    return C.filter_ligands(frame(spark, d, "fx_asym"), _atoms(spark, d), frame(spark, d, "fx_types"), "annotate_only")[2].select("entry_id", "code", "field")


@query(TYPES + f" SELECT a.entry_id, a.atom_ord, a.label_asym_id FROM fx_atoms a JOIN fx_asym s ON s.entry_id = a.entry_id AND s.id = a.label_asym_id LEFT JOIN fx_types t ON t.entry_id = s.entry_id AND t.id = s.entity_id WHERE t.type IS NULL OR t.type IN ('polymer', 'water') OR ({_ION})")
def content_filter(spark: SparkSession, d: str) -> DataFrame:
    """Entries without their ligands, with waters and ions."""
    return C.strip_content(frame(spark, d, "fx_asym"), _atoms(spark, d), frame(spark, d, "fx_types"), ligands=False)[1].select("entry_id", "atom_ord", "label_asym_id")


_AUTH = TYPES + """, s2 AS (SELECT *, auth_id AS aid, arg_max(entity_id, asym_ord) OVER (PARTITION BY entry_id, auth_id) AS e FROM fx_asym),
k2 AS (SELECT s2.*, t.type, t.pdbx_description FROM s2 LEFT JOIN fx_types t ON t.entry_id = s2.entry_id AND t.id = s2.e),
b2 AS (SELECT a.*, s.auth_id AS aid FROM fx_atoms a JOIN fx_asym s ON s.entry_id = a.entry_id AND s.id = a.label_asym_id)"""


@query(_AUTH + f" SELECT entry_id, atom_ord, aid AS label_asym_id FROM b2 WHERE EXISTS (SELECT 1 FROM k2 WHERE k2.entry_id = b2.entry_id AND k2.aid = b2.aid AND (k2.type IS NULL OR k2.type = 'polymer' OR (k2.type <> 'water' AND NOT ({_ION}))))")
def ligand_filter_auth(spark: SparkSession, d: str) -> DataFrame:
    """Waters and ions go where author chain ids have merged units: an id is judged by its last unit."""
    asym = frame(spark, d, "fx_asym")
    atoms = C.rename_chains(_atoms(spark, d), C.chain_map(asym, "use_auth_chain_id"), "label_asym_id")
    return C.filter_ligands(asym.withColumn("id", F.col("auth_id")), atoms, frame(spark, d, "fx_types"), "filter", waters=False, ions=False)[1].select("entry_id", "atom_ord", "label_asym_id")


_STATUS = _AUTH + """, seen AS (SELECT DISTINCT entry_id, aid, label_seq_id FROM b2 WHERE group_pdb = 'ATOM' AND label_seq_id IS NOT NULL),
gaps AS (SELECT entry_id, count(*) AS n FROM (SELECT entry_id, label_seq_id, lead(label_seq_id) OVER (PARTITION BY entry_id, aid ORDER BY label_seq_id) AS nx FROM seen) WHERE nx - label_seq_id > 1 GROUP BY 1),
gone AS (SELECT entry_id, count(*) AS n FROM k2 WHERE type IS NOT NULL AND type <> 'polymer' GROUP BY 1),
kept AS (SELECT * FROM k2 WHERE type IS NULL OR type = 'polymer'),
twice AS (SELECT entry_id, 1 AS n FROM kept GROUP BY 1 HAVING count(*) > count(DISTINCT aid)),
res AS (SELECT entry_id, count(*) - count(DISTINCT (aid, label_seq_id)) AS n FROM b2 WHERE group_pdb = 'ATOM' AND label_seq_id IS NOT NULL AND EXISTS (SELECT 1 FROM kept WHERE kept.entry_id = b2.entry_id AND kept.aid = b2.aid) GROUP BY 1),
c AS (SELECT e.entry_id, coalesce(g.n, 0) + coalesce(o.n, 0) AS n_warnings, coalesce(t.n, 0) + coalesce(r.n, 0) AS n_errors FROM (SELECT DISTINCT entry_id FROM fx_atoms) e LEFT JOIN gaps g USING (entry_id) LEFT JOIN gone o USING (entry_id) LEFT JOIN twice t USING (entry_id) LEFT JOIN res r USING (entry_id))
"""


def _status(spark: SparkSession, d: str, **rules) -> DataFrame:
    from residua.plans.canonicalise import canonicalise
    from residua.plans.policy import policy

    tables = {"atoms": _atoms(spark, d), "asym_units": frame(spark, d, "fx_asym"), "entities": frame(spark, d, "fx_types")}
    tables["entries"] = tables["atoms"].select("entry_id").distinct()
    p = policy({"identifier_rules": {"chain_id": {"strategy": "use_auth_chain_id"}}, "altloc_rules": {"strategy": "preserve"}, "missing_data_rules": {"missing_atoms": {"strategy": "preserve"}}, "ligand_rules": {"strategy": "annotate_only"}, "validation_rules": rules})
    return canonicalise(tables, p).status


@query(_STATUS + "SELECT *, CASE WHEN n_errors > 0 THEN 'failed' WHEN n_warnings > 0 THEN 'warning' ELSE 'success' END AS status FROM c")
def canonical_status(spark: SparkSession, d: str) -> DataFrame:
    """Status of every entry from all its errors and warnings: merged author chains, gaps, ligands kept as annotations."""
    return _status(spark, d)


@query(_STATUS + "SELECT entry_id, n_warnings, n_errors + n_warnings AS n_errors, CASE WHEN n_warnings > 0 THEN 'failed' WHEN n_errors > 0 THEN 'warning' ELSE 'success' END AS status FROM c")
def canonical_status_strict(spark: SparkSession, d: str) -> DataFrame:
    """The same where warnings count as errors, and only warnings fail an entry."""
    return _status(spark, d, strictness="strict", fail_on_unresolved_issues=False, warnings_as_errors=True)


@query(ASYM + " SELECT entry_id, 'CANONICAL_CHAIN_ID_COLLISION' AS code, auth_id AS chain_id, count(*) - 1 AS n FROM fx_asym GROUP BY entry_id, auth_id HAVING count(*) > 1 UNION ALL SELECT entry_id, 'RESIDUE_NUMBER_COLLISION', label_asym_id, count(*) - count(DISTINCT label_seq_id) FROM fx_atoms WHERE group_pdb = 'ATOM' AND label_seq_id IS NOT NULL GROUP BY entry_id, label_asym_id HAVING count(*) > count(DISTINCT label_seq_id)")
def validate_collisions(spark: SparkSession, d: str) -> DataFrame:
    asym = frame(spark, d, "fx_asym").withColumn("id", F.col("auth_id"))
    return C.collisions(asym, _atoms(spark, d)).select("entry_id", "code", "chain_id", "n")


@query(TYPES + ", a AS (SELECT entry_id, count(*) AS atom_count, count(DISTINCT (label_asym_id, label_seq_id, auth_seq_id, label_comp_id)) AS residue_count, count(*) FILTER (label_alt_id <> '') AS altloc_atom_count, count(*) FILTER (group_pdb = 'ATOM') AS atom_rows, count(*) FILTER (group_pdb = 'HETATM') AS hetatm_rows FROM fx_atoms GROUP BY 1) SELECT a.*, (SELECT count(*) FROM fx_asym s WHERE s.entry_id = a.entry_id) AS chain_count, (SELECT count(*) FROM fx_types t WHERE t.entry_id = a.entry_id) AS entity_count FROM a")
def structure_counts(spark: SparkSession, d: str) -> DataFrame:
    return spatial.structure_counts(_atoms(spark, d), frame(spark, d, "fx_asym"), frame(spark, d, "fx_types"))


@query(ENTITIES + " SELECT entry_id, type AS value, count(*) AS n FROM fx_entities GROUP BY ALL")
def entity_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return spatial.counts_by(frame(spark, d, "fx_entities"), "type")


@query(ctes("fx_quality") + " SELECT entry_id, CAST(resolution AS DOUBLE) AS resolution FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY row_ord) AS r FROM fx_quality) WHERE r = 1")
def quality_first_row(spark: SparkSession, d: str) -> DataFrame:
    return metadata.first_by(frame(spark, d, "fx_quality"), ["entry_id"], ["row_ord"]).select("entry_id", F.col("resolution").cast("double").alias("resolution"))


@query(ctes("fx_quality") + " SELECT entry_id, string_agg(method, '; ' ORDER BY row_ord) AS methods FROM fx_quality GROUP BY 1")
def methods_joined(spark: SparkSession, d: str) -> DataFrame:
    return metadata.joined_methods(frame(spark, d, "fx_quality"))


@query(ctes("fx_taxonomy") + " SELECT src_ord, row_ord, entity_id, organism FROM fx_taxonomy")
def taxonomy_union(spark: SparkSession, d: str) -> DataFrame:
    take = lambda t, a, b, c: frame(spark, d, t).select(F.col(a).cast("bigint").alias("row_ord"), F.col(b).cast("string").alias("entity_id"), F.col(c).alias("organism"))
    return metadata.union_sources(take("customer", "c_custkey", "c_nationkey", "c_name"), take("supplier", "s_suppkey", "s_nationkey", "s_name"), take("nation", "n_nationkey", "n_regionkey", "n_name")).select("src_ord", "row_ord", "entity_id", "organism")


@query(ctes("fx_taxonomy") + " SELECT entity_id, organism FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY src_ord, row_ord) AS r FROM fx_taxonomy) WHERE r = 1")
def taxonomy_first(spark: SparkSession, d: str) -> DataFrame:
    return metadata.first_taxonomy(frame(spark, d, "fx_taxonomy"), ["entity_id"]).select("entity_id", "organism")


@query(TYPES + " SELECT t.entry_id, t.id, t.type, coalesce(string_agg(s.id, ',' ORDER BY s.asym_ord), '') AS chain_ids FROM fx_types t LEFT JOIN fx_asym s ON s.entry_id = t.entry_id AND s.entity_id = t.id GROUP BY ALL")
def entity_metadata(spark: SparkSession, d: str) -> DataFrame:
    return metadata.entity_metadata(frame(spark, d, "fx_types"), frame(spark, d, "fx_asym")).select("entry_id", "id", "type", F.array_join("chain_ids", ",").alias("chain_ids"))


@query(ATOMS + " SELECT entry_id, label_entity_id AS entity_id, label_comp_id AS comp_id, string_agg(DISTINCT label_asym_id, ',' ORDER BY label_asym_id) AS chain_ids FROM fx_atoms WHERE group_pdb = 'HETATM' AND label_comp_id NOT IN ('HOH', 'WAT', 'DOD') GROUP BY ALL")
def ligand_metadata(spark: SparkSession, d: str) -> DataFrame:
    return metadata.ligands_from_atoms(_atoms(spark, d)).withColumn("chain_ids", F.array_join("chain_ids", ","))


@query(ATOMS + ", l AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS entry_id, o_orderpriority AS comp_id FROM orders WHERE o_orderstatus = 'F'), f AS (SELECT DISTINCT entry_id, label_comp_id AS comp_id FROM fx_atoms WHERE group_pdb = 'HETATM' AND label_comp_id NOT IN ('HOH', 'WAT', 'DOD')) SELECT * FROM l UNION ALL SELECT * FROM f WHERE entry_id NOT IN (SELECT entry_id FROM l)")
def ligand_fallback(spark: SparkSession, d: str) -> DataFrame:
    listed = frame(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("entry_id"), F.col("o_orderpriority").alias("comp_id")).distinct()
    return metadata.with_fallback(listed, metadata.ligands_from_atoms(_atoms(spark, d)).select("entry_id", "comp_id"))


@query(ctes("fx_refseq") + " SELECT ref_id, asym_id, seq_id_start, seq_id_end, row_ord, tie FROM (SELECT *, row_number() OVER (PARTITION BY ref_id, asym_id, seq_id_start, seq_id_end ORDER BY row_ord, tie) AS r FROM fx_refseq) WHERE r = 1")
def uniprot_dedup(spark: SparkSession, d: str) -> DataFrame:
    t = metadata.first_by(frame(spark, d, "fx_refseq"), ["ref_id", "asym_id", "seq_id_start", "seq_id_end"], ["row_ord", "tie"])
    return t.select("ref_id", "asym_id", "seq_id_start", "seq_id_end", "row_ord", "tie")


def _raw(spark: SparkSession, d: str, **categories: tuple[str, str, str, dict[str, str]]) -> DataFrame:
    """Raw rows: category=(table, entry_id, row_ord, {item: SQL of its text})."""
    out = None
    for name, (table, entry, order, items) in categories.items():
        pairs = ", ".join(f"'{k}', CAST({v} AS STRING)" for k, v in items.items())
        t = frame(spark, d, table).selectExpr(f"CAST({entry} AS STRING) AS entry_id", f"'{name}' AS category", f"CAST({order} AS INT) AS row_ord", f"map({pairs}) AS cols")
        out = t if out is None else out.unionByName(t)
    return out


#: An item that is a null token for some keys and missing text for others.
_HOLEY = "CASE {k} % 4 WHEN 0 THEN '?' WHEN 1 THEN ' . ' WHEN 2 THEN {v} ELSE concat('  ', {v}, ' ') END"
_FIX = "CASE WHEN {k} % 4 IN (0, 1) THEN NULL ELSE {v} END"


def _holey(k: str, v: str) -> str:
    return _HOLEY.format(k=k, v=v)


def _fix(k: str, v: str) -> str:
    return _FIX.format(k=k, v=v)


@query("SELECT src_ord, entry_id, row_ord, entity_id, ncbi_taxon_id, organism_scientific, organism_common, host_ncbi_taxon_id, host_scientific, host_common, expression_system FROM ("
    "SELECT 1 AS src_ord, CAST(c_nationkey AS VARCHAR) AS entry_id, CAST(c_custkey AS INT) AS row_ord, c_mktsegment AS entity_id, CAST(c_custkey AS BIGINT) AS ncbi_taxon_id, coalesce(" + _fix("c_custkey", "c_name") + ", c_mktsegment) AS organism_scientific, " + _fix("c_custkey", "c_mktsegment") + " AS organism_common, CAST(c_nationkey AS BIGINT) AS host_ncbi_taxon_id, c_name AS host_scientific, c_mktsegment AS host_common, coalesce(" + _fix("c_custkey", "'E'") + ", c_name) AS expression_system FROM customer "
    "UNION ALL SELECT 2, CAST(s_nationkey AS VARCHAR), CAST(s_suppkey AS INT), NULL, CASE WHEN s_suppkey % 4 IN (2, 3) THEN 7 ELSE CAST(s_suppkey AS BIGINT) END, coalesce(" + _fix("s_suppkey", "s_name") + ", 'other'), coalesce(" + _fix("s_suppkey", "'common'") + ", s_name), NULL, NULL, NULL, NULL FROM supplier "
    "UNION ALL SELECT 3, CAST(n_nationkey AS VARCHAR), CAST(n_nationkey AS INT), CAST(n_regionkey AS VARCHAR), NULL, " + _fix("n_nationkey", "n_name") + ", n_name, NULL, NULL, NULL, NULL FROM nation)")  # fmt: skip
def taxonomies_raw(spark: SparkSession, d: str) -> DataFrame:
    """Organisms from raw categories, with values that only a fallback item has."""
    raw = _raw(spark, d,
        _entity_src_gen=("customer", "c_nationkey", "c_custkey", {"entity_id": "c_mktsegment", "pdbx_gene_src_ncbi_taxonomy_id": "c_custkey", "pdbx_gene_src_scientific_name": _holey("c_custkey", "c_name"), "gene_src_scientific_name": "c_mktsegment", "gene_src_common_name": _holey("c_custkey", "c_mktsegment"), "pdbx_host_org_ncbi_taxonomy_id": "c_nationkey", "pdbx_host_org_scientific_name": "c_name", "host_org_common_name": "c_mktsegment", "expression_system_id": _holey("c_custkey", "'E'"), "plasmid_name": "c_name"}),
        _entity_src_nat=("supplier", "s_nationkey", "s_suppkey", {"pdbx_ncbi_taxonomy_id": _holey("s_suppkey", "'7'"), "ncbi_taxonomy_id": "s_suppkey", "pdbx_organism_scientific": _holey("s_suppkey", "s_name"), "organism_scientific": "'other'", "common_name": _holey("s_suppkey", "'common'"), "organism_common_name": "s_name"}),
        _pdbx_entity_src_syn=("nation", "n_nationkey", "n_nationkey", {"entity_id": "n_regionkey", "ncbi_taxonomy_id": "'1.5'", "organism_scientific": _holey("n_nationkey", "n_name"), "organism_common_name": "n_name"}),
    )
    return metadata.taxonomies(raw).drop("provenance")


@query("WITH r AS (SELECT p_brand AS entry_id, CAST(p_partkey AS VARCHAR) AS id, " + _fix("p_partkey", "p_name") + " AS acc, p_type AS db_name, p_name AS db_code, CAST(p_size AS VARCHAR) AS entity_id FROM part), "
    "l AS (SELECT p_brand AS entry_id, CAST(l_orderkey AS INT) AS row_ord, CAST(l_partkey AS VARCHAR) AS ref_id, l_returnflag AS asym_id, " + _fix("l_orderkey", "l_linestatus") + " AS acc, CAST(l_linenumber AS BIGINT) AS a, CAST(l_linenumber + 5 AS BIGINT) AS b FROM lineitem JOIN part ON p_partkey = l_partkey), "
    "u AS (SELECT 1 AS src_ord, l.entry_id, l.row_ord, r.entity_id, l.asym_id, coalesce(l.acc, r.acc) AS accession, r.db_name, r.db_code, l.a AS seq_id_start, l.b AS seq_id_end, l.a AS uniprot_start, CAST(NULL AS BIGINT) AS uniprot_end, CAST(NULL AS DOUBLE) AS identity FROM l JOIN r ON r.entry_id = l.entry_id AND r.id = l.ref_id "
    "UNION ALL SELECT 2, CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS INT), o_orderstatus, NULL, " + _fix("o_orderkey", "o_orderpriority") + ", 'UNP', NULL, 1, 9, 3, 4, 0.5 FROM orders) "
    "SELECT entry_id, entity_id, asym_id, accession, seq_id_start, seq_id_end, uniprot_start, uniprot_end, min(row_ord) AS row_ord, arg_min(db_name, row_ord) AS db_name, max(identity) AS identity FROM u WHERE accession IS NOT NULL GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5, 6, 7, 8"))  # fmt: skip
def uniprot_raw(spark: SparkSession, d: str) -> DataFrame:
    """Reference sequences with accessions of their own or of their reference, and segments; each mapping once."""
    lines = frame(spark, d, "lineitem").join(frame(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    one = lambda **items: F.create_map(*[x for k, v in items.items() for x in (F.lit(k), F.expr(f"CAST({v} AS STRING)"))])
    seq = lines.select(F.col("p_brand").alias("entry_id"), F.lit("_struct_ref_seq").alias("category"), F.col("l_orderkey").cast("int").alias("row_ord"), one(ref_id="l_partkey", pdbx_strand_id="l_returnflag", pdbx_db_accession=_holey("l_orderkey", "l_linestatus"), seq_align_beg="l_linenumber", seq_align_end="l_linenumber + 5", db_align_beg="l_linenumber", db_align_end="'x'").alias("cols"))
    raw = _raw(spark, d,
        _struct_ref=("part", "p_brand", "p_partkey", {"id": "p_partkey", "pdbx_db_accession": _holey("p_partkey", "p_name"), "db_name": "p_type", "db_code": "p_name", "entity_id": "p_size"}),
        _pdbx_sifts_unp_segments=("orders", "o_custkey", "o_orderkey", {"unp_acc": _holey("o_orderkey", "o_orderpriority"), "entity_id": "o_orderstatus", "asym_id": "'?'", "seq_id_start": "1", "seq_id_end": "9", "unp_start": "3", "unp_end": "4", "identity": "'0.5'"}),
    ).unionByName(seq)
    names = ["entry_id", "entity_id", "asym_id", "accession", "seq_id_start", "seq_id_end", "uniprot_start", "uniprot_end"]
    t = metadata.uniprot_mappings(raw)
    return t.groupBy(*names).agg(F.min("row_ord").alias("row_ord"), F.first("db_name").alias("db_name"), F.max("identity").alias("identity"))


@query("WITH n AS (SELECT p_brand AS entry_id, CAST(p_size AS VARCHAR) AS entity_id, p_type AS comp_id, arg_min(" + _fix("p_partkey", "p_name") + ", p_partkey) FILTER (true) AS x, min(p_partkey) AS k FROM part WHERE p_brand <> 'Brand#2' GROUP BY 1, 2, 3), "
    "f AS (SELECT n.entry_id, n.entity_id, n.comp_id, coalesce(CASE WHEN n.k % 4 IN (2, 3) THEN p.p_name END, n.entry_id) AS name, p.p_brand AS formula FROM n JOIN part p ON p.p_partkey = n.k) "
    "SELECT entry_id, entity_id, comp_id, name, formula, CAST(1.5 AS DOUBLE) AS formula_weight, '' AS chain_ids FROM f "
    "UNION ALL SELECT 'Brand#2', 'e', 'GOL', NULL, NULL, NULL, 'A,B'")  # fmt: skip
def ligands_raw(spark: SparkSession, d: str) -> DataFrame:
    """Listed non-polymers, named by themselves or by their components; an entry without a list gets what its atoms show."""
    raw = _raw(spark, d, _pdbx_entity_nonpoly=("part", "p_brand", "p_partkey", {"entity_id": "p_size", "comp_id": "p_type", "name": _holey("p_partkey", "p_name")}), _chem_comp=("part", "p_brand", "p_partkey", {"id": "p_type", "name": "p_brand", "formula": "p_brand", "formula_weight": "'1.5'"})).filter("entry_id <> 'Brand#2'")
    atoms = spark.sql("SELECT * FROM VALUES ('Brand#2', 'HETATM', 'e', 'GOL', 'B'), ('Brand#2', 'HETATM', 'e', 'GOL', 'A'), ('Brand#2', 'HETATM', 'e', 'HOH', 'W'), ('Brand#1', 'HETATM', 'e', 'GOL', 'Z') AS t(entry_id, group_pdb, label_entity_id, label_comp_id, label_asym_id)")
    asym = spark.sql("SELECT 'none' AS entry_id, 'A' AS id, '1' AS entity_id, 1 AS asym_ord")
    t = metadata.ligand_metadata(raw, asym, atoms)
    return t.select("entry_id", "entity_id", "comp_id", "name", "formula", "formula_weight", F.array_join("chain_ids", ",").alias("chain_ids"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS entry_id, string_agg(" + _fix("o_orderkey", "o_orderpriority") + ", '; ' ORDER BY o_orderkey) AS experimental_method, arg_min(o_orderkey / 10.0, o_orderkey) AS resolution, CAST(NULL AS DOUBLE) AS r_work, min(o_orderkey) AS observed_reflections FROM orders GROUP BY 1")
def quality_raw(spark: SparkSession, d: str) -> DataFrame:
    """Methods of all rows, figures of the first rows."""
    raw = _raw(spark, d, _exptl=("orders", "o_custkey", "o_orderkey", {"method": _holey("o_orderkey", "o_orderpriority")}), _refine=("orders", "o_custkey", "o_orderkey", {"ls_d_res_high": "CAST(o_orderkey / 10.0 AS DECIMAL(18,1))", "ls_R_factor_R_work": "'n/a'"}), _reflns=("orders", "o_custkey", "o_orderkey", {"number_obs": "o_orderkey"}))
    return metadata.quality(raw).select("entry_id", "experimental_method", "resolution", "r_work", "observed_reflections")


@query("WITH e AS (SELECT CAST(p_partkey AS VARCHAR) AS entry_id, p_name, p_type, p_size FROM part) SELECT entry_id, p_name AS title, coalesce(" + _fix("p_size", "p_type") + ", p_name) AS keywords, p_type AS citation_title, " + _fix("p_size", "p_name") + " AS doi, NULL::VARCHAR AS pubmed_id FROM e")
def entry_raw(spark: SparkSession, d: str) -> DataFrame:
    """Entry metadata with keywords of two items."""
    e = frame(spark, d, "part").select(F.col("p_partkey").cast("string").alias("entry_id"), F.col("p_name").alias("title"))
    raw = _raw(spark, d, _struct_keywords=("part", "p_partkey", "0", {"text": _holey("p_size", "p_type"), "pdbx_keywords": "p_name"}), _citation=("part", "p_partkey", "0", {"title": "p_type", "pdbx_database_id_DOI": _holey("p_size", "p_name")}))
    return metadata.entry_metadata(e, raw).drop("provenance")


@query("SELECT CAST(p_partkey AS VARCHAR) AS entry_id, '1' AS id, " + _fix("p_partkey", "p_type") + " AS ec_number, p_name AS mutation, CAST(NULL AS VARCHAR) AS fragment, 'A,B' AS chain_ids FROM part")
def entity_raw(spark: SparkSession, d: str) -> DataFrame:
    """Entities with what raw rows say of them, and their chains."""
    part = frame(spark, d, "part").select(F.col("p_partkey").cast("string").alias("entry_id"))
    asym = part.withColumn("x", F.explode(F.array(F.struct(F.lit("B").alias("id"), F.lit(2).alias("o")), F.struct(F.lit("A").alias("id"), F.lit(1).alias("o"))))).select("entry_id", "x.id", F.lit("1").alias("entity_id"), F.col("x.o").alias("asym_ord"))
    raw = _raw(spark, d, _entity=("part", "p_partkey", "0", {"id": "1", "pdbx_ec": _holey("p_partkey", "p_type"), "pdbx_mutation": "p_name"}))
    t = metadata.entity_metadata(part.withColumn("id", F.lit("1")), asym, raw)
    return t.select("entry_id", "id", "ec_number", "mutation", "fragment", F.array_join("chain_ids", ",").alias("chain_ids"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS entry_id, CAST(0 AS INT) AS row_ord, p_name AS name, CAST(NULL AS VARCHAR) AS absent, p_brand AS brand FROM part WHERE p_type = 'SMALL'")
def metadata_category(spark: SparkSession, d: str) -> DataFrame:
    p = frame(spark, d, "part")
    raw = p.select(F.col("p_partkey").cast("string").alias("entry_id"), F.concat(F.lit("_"), "p_type").alias("category"), F.lit(0).alias("row_ord"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("name"), F.col("p_name")).alias("cols"))
    return metadata.category(raw, "SMALL", ["name", "absent", "brand"])


def _float_atoms(spark: SparkSession, d: str) -> DataFrame:
    return _atoms(spark, d).withColumns({c: F.col(c).cast("double") for c in "xyz"})


_POLY = ", poly AS (SELECT s.entry_id, s.id FROM fx_asym s JOIN fx_types t ON t.entry_id = s.entry_id AND t.id = s.entity_id WHERE t.type = 'polymer')"


@query(TYPES + _POLY + " SELECT l.entry_id, l.label_asym_id AS ligand_asym_id, l.auth_seq_id AS ligand_seq_id, l.label_comp_id AS ligand_comp_id, p.label_asym_id AS asym_id, p.label_seq_id AS seq_id, p.label_comp_id AS comp_id, CAST(min((l.x-p.x)*(l.x-p.x) + (l.y-p.y)*(l.y-p.y) + (l.z-p.z)*(l.z-p.z)) AS DOUBLE) AS min_d2 FROM fx_atoms l JOIN fx_atoms p ON p.entry_id = l.entry_id JOIN poly ON poly.entry_id = p.entry_id AND poly.id = p.label_asym_id WHERE l.group_pdb = 'HETATM' AND l.label_comp_id NOT IN ('HOH', 'WAT', 'DOD') AND (l.x-p.x)*(l.x-p.x) + (l.y-p.y)*(l.y-p.y) + (l.z-p.z)*(l.z-p.z) <= 16 GROUP BY ALL")
def ligand_contacts(spark: SparkSession, d: str) -> DataFrame:
    polymers = spatial.polymer_chains(frame(spark, d, "fx_asym"), frame(spark, d, "fx_types"))
    return spatial.ligand_contacts(_float_atoms(spark, d), polymers, 4.0)


@query(ctes("fx_points") + ", p AS (SELECT a.label_asym_id AS chain_a, b.label_asym_id AS chain_b, a.vec_id AS va, b.vec_id AS vb FROM fx_points a JOIN fx_points b ON a.label_asym_id < b.label_asym_id AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 0.05::DOUBLE * 0.05::DOUBLE) SELECT chain_a, chain_b, count(DISTINCT va) + count(DISTINCT vb) AS contact_count FROM p GROUP BY ALL")
def chain_interfaces(spark: SparkSession, d: str) -> DataFrame:
    t = frame(spark, d, "fx_points").withColumn("label_seq_id", F.col("vec_id")).withColumn("entry_id", F.lit("all"))
    return spatial.chain_interfaces(t, None, 0.05).select("chain_a", "chain_b", "contact_count")


@query(ctes("fx_points") + ", p AS (SELECT DISTINCT a.label_asym_id AS chain_a, b.label_asym_id AS chain_b FROM fx_points a JOIN fx_points b ON a.label_asym_id < b.label_asym_id AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 0.05::DOUBLE * 0.05::DOUBLE) SELECT 'all_' || chain_a || '_' || chain_b AS interface_id, chain_a, chain_b FROM p")
def interface_records(spark: SparkSession, d: str) -> DataFrame:
    t = frame(spark, d, "fx_points").withColumn("label_seq_id", F.col("vec_id")).withColumn("entry_id", F.lit("all"))
    return records.interface_records(spatial.chain_interfaces(t, None, 0.05)).select("interface_id", "chain_a", "chain_b")


def _names(spark: SparkSession, d: str, table: str, name: str, key: str) -> DataFrame:
    return frame(spark, d, table).select(F.col(key).cast("bigint").alias("ord"), F.col(key).cast("string").alias("id"), F.upper(name).alias("sequence"))


_PAIRS = "SELECT CAST(n.n_nationkey AS VARCHAR) AS left_id, CAST(r.r_regionkey AS VARCHAR) AS right_id, n.n_nationkey AS lo, r.r_regionkey AS ro, (SELECT count(*) FROM range(1, 1 + least(len(n_name), len(r_name))) t(i) WHERE upper(n_name)[i] = upper(r_name)[i]) AS matches, least(len(n_name), len(r_name)) AS aligned, greatest(len(n_name), len(r_name)) AS longer FROM nation n, region r"


@query(f"SELECT left_id, right_id, CAST(matches AS BIGINT) AS matches, matches / longer::DOUBLE AS identity, CAST(aligned AS BIGINT) AS aligned, aligned / longer::DOUBLE AS coverage FROM ({_PAIRS})")
def pairwise_identity(spark: SparkSession, d: str) -> DataFrame:
    t = spatial.pairwise_identity(_names(spark, d, "nation", "n_name", "n_nationkey"), _names(spark, d, "region", "r_name", "r_regionkey"))
    return t.select("left_id", "right_id", "matches", "identity", "aligned", "coverage")


@query(f"SELECT left_id, right_id, matches / longer::DOUBLE AS identity, CAST(aligned AS BIGINT) AS aligned, aligned / longer::DOUBLE AS coverage FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY matches / longer::DOUBLE DESC, lo, ro) AS r FROM ({_PAIRS})) WHERE r = 1")
def best_identity(spark: SparkSession, d: str) -> DataFrame:
    t = spatial.pairwise_identity(_names(spark, d, "nation", "n_name", "n_nationkey"), _names(spark, d, "region", "r_name", "r_regionkey"))
    return spatial.best_identity(t.withColumn("k", F.col("left_id")), ["k"]).drop("k")


@query(TYPES + _POLY + " SELECT s.entry_id, s.id AS chain_id, s.entity_id, t.seq_can AS sequence, count(DISTINCT (a.label_seq_id, a.auth_seq_id)) AS residue_count, count(*) AS atom_count FROM fx_asym s JOIN fx_types t ON t.entry_id = s.entry_id AND t.id = s.entity_id AND t.type = 'polymer' JOIN fx_atoms a ON a.entry_id = s.entry_id AND a.label_asym_id = s.id GROUP BY ALL")
def chain_records(spark: SparkSession, d: str) -> DataFrame:
    return records.chain_records(_atoms(spark, d), frame(spark, d, "fx_asym"), frame(spark, d, "fx_types"))


@query(TYPES + _POLY + ", g AS (SELECT a.entry_id, a.label_asym_id AS chain_id, a.label_seq_id AS seq_id, a.auth_seq_id, a.label_comp_id AS comp_id, min(a.atom_ord) AS f, count(*) AS atom_count, string_agg(a.label_atom_id, ',' ORDER BY a.atom_ord) AS atom_names FROM fx_atoms a JOIN poly ON poly.entry_id = a.entry_id AND poly.id = a.label_asym_id GROUP BY ALL) SELECT entry_id, chain_id, seq_id, auth_seq_id, comp_id, atom_count, atom_names, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY chain_id, coalesce(seq_id, 0), f) AS INT) AS residue_ord FROM g")
def residue_records(spark: SparkSession, d: str) -> DataFrame:
    polymers = spatial.polymer_chains(frame(spark, d, "fx_asym"), frame(spark, d, "fx_types"))
    t = records.residue_records(_atoms(spark, d), polymers)
    return t.select("entry_id", "chain_id", "seq_id", "auth_seq_id", "comp_id", "atom_count", F.array_join(F.transform("atoms", lambda a: a["label_atom_id"]), ",").alias("atom_names"), "residue_ord")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("item_ord"), F.col("text").alias("sequence"))


_GRAMS = """WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
k AS (SELECT a.doc_id AS s, b.doc_id AS t, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT s AS source_id, t AS target_id, k AS shared, x.n AS size_a, y.n AS size_b FROM k JOIN n x ON x.doc_id = s JOIN n y ON y.doc_id = t WHERE 2 * k >= x.n + y.n - k)"""


@query(_GRAMS + " SELECT * FROM e")
def similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.jaccard_pairs(_documents(spark, d)).select("source_id", "target_id", "shared", "size_a", "size_b")


@query("SELECT least(l_partkey, l_suppkey) AS source_id, greatest(l_partkey, l_suppkey) AS target_id, arg_max(q, (q, -o)) AS score, arg_max(c, (q, -o)) AS coverage FROM (SELECT l_partkey, l_suppkey, CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) AS c, l_orderkey * 10 + l_linenumber AS o FROM lineitem WHERE l_partkey <> l_suppkey) GROUP BY 1, 2")
def best_hits(spark: SparkSession, d: str) -> DataFrame:
    t = frame(spark, d, "lineitem").select(F.col("l_partkey").alias("query"), F.col("l_suppkey").alias("target"), F.col("l_quantity").cast("double").alias("score"), F.col("l_discount").cast("double").alias("coverage"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"))
    return similarity.best_hits(t)


_COMPONENTS = _GRAMS.replace("WITH w", "WITH RECURSIVE w", 1) + """, both_ AS (SELECT source_id AS a, target_id AS b FROM e UNION ALL SELECT target_id, source_id FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, both_.b FROM r JOIN both_ ON both_.a = r.y),
c AS (SELECT x AS item_id, min(y) AS root FROM r GROUP BY 1),
q AS (SELECT root, count(*) AS n_components, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS components, CAST(row_number() OVER (ORDER BY root) AS INT) AS cluster_ord FROM c GROUP BY root)"""


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    items = _documents(spark, d).drop("sequence")
    return similarity.clusters(items, similarity.stored(similarity.jaccard_edges(_documents(spark, d)), "edges"))


@query(_COMPONENTS + " SELECT cluster_ord, components, n_components FROM q")
def clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).select("cluster_ord", F.array_join(F.transform("components", lambda x: x.cast("string")), ",").alias("components"), "n_components")


@query(_COMPONENTS + " SELECT count(*) AS total_clusters, count(*) FILTER (n_components = 1) AS singletons, max(n_components) AS largest, CAST(sum(n_components) AS BIGINT) AS items, sum(n_components) / count(*)::DOUBLE AS mean_size FROM q")
def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    return similarity.cluster_summary(_clusters(spark, d))


@query(_COMPONENTS + " SELECT CAST(sum(n_components) AS BIGINT) AS node_count, (SELECT count(*) FROM e) AS edge_count, count(*) AS connected_components, max(n_components) AS largest_component_size FROM q")
def graph_statistics(spark: SparkSession, d: str) -> DataFrame:
    items = _documents(spark, d)
    return similarity.graph_statistics(items.select("item_id"), similarity.jaccard_pairs(items))


_SIZES = """WITH RECURSIVE c AS (SELECT CAST(row_number() OVER (ORDER BY min(p_partkey)) AS INT) AS cluster_ord, count(*) AS n_components FROM part GROUP BY p_name, p_type),
o AS (SELECT *, row_number() OVER (ORDER BY n_components DESC, cluster_ord) AS rn FROM c),
g AS (SELECT CAST(round_even(sum(n_components) * 0.6::DOUBLE, 0) AS BIGINT) AS gt, CAST(round_even(sum(n_components) * 0.2::DOUBLE, 0) AS BIGINT) AS gv, CAST(sum(n_components) AS BIGINT) AS total FROM c),
f AS (SELECT CAST(0 AS BIGINT) AS rn, CAST('' AS VARCHAR) AS split, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c, CAST(0 AS INT) AS cluster_ord, CAST(0 AS BIGINT) AS n_components
 UNION ALL SELECT o.rn, CASE WHEN gt - a >= gv - b AND gt - a >= total - gt - gv - c THEN 'train' WHEN gv - b >= total - gt - gv - c THEN 'val' ELSE 'test' END AS s,
  a + CASE WHEN gt - a >= gv - b AND gt - a >= total - gt - gv - c THEN o.n_components ELSE 0 END,
  b + CASE WHEN NOT (gt - a >= gv - b AND gt - a >= total - gt - gv - c) AND gv - b >= total - gt - gv - c THEN o.n_components ELSE 0 END,
  f.c + CASE WHEN NOT (gt - a >= gv - b AND gt - a >= total - gt - gv - c) AND NOT gv - b >= total - gt - gv - c THEN o.n_components ELSE 0 END,
  o.cluster_ord, o.n_components FROM f JOIN o ON o.rn = f.rn + 1, g)"""


def _part_clusters(spark: SparkSession, d: str) -> DataFrame:
    c = frame(spark, d, "part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("m"), F.count(F.lit(1)).alias("n_components"), F.sort_array(F.collect_list("p_partkey")).alias("components"))
    return similarity.numbered(c, "_n", [F.col("m").asc()]).select((F.col("_n") + 1).cast("int").alias("cluster_ord"), "components", "n_components")


@query(_SIZES + " SELECT cluster_ord, n_components, split FROM f WHERE rn > 0")
def partition_keep(spark: SparkSession, d: str) -> DataFrame:
    return similarity.partition_keep(_part_clusters(spark, d)).select("cluster_ord", "n_components", "split")


@query(_SIZES + " SELECT cluster_ord, n_components, split FROM f WHERE rn > 0")
def partition_keep_large(spark: SparkSession, d: str) -> DataFrame:
    return similarity.partition_keep_large(_part_clusters(spark, d)).select("cluster_ord", "n_components", "split")


@query("WITH c AS (SELECT CAST(dense_rank() OVER (ORDER BY m) AS INT) AS cluster_ord, n, p_partkey, row_number() OVER (PARTITION BY m ORDER BY p_partkey) - 1 AS i FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_type) AS m, count(*) OVER (PARTITION BY p_name, p_type) AS n FROM part)) SELECT cluster_ord, p_partkey AS item_id, CASE WHEN i < round_even(n * 0.6::DOUBLE, 0) THEN 'train' WHEN i < round_even(n * 0.6::DOUBLE, 0) + round_even(n * 0.2::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM c")
def partition_proportional(spark: SparkSession, d: str) -> DataFrame:
    return similarity.partition_proportional(_part_clusters(spark, d))


def _halves(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("item_id", F.when(F.col("item_id") % 5 < 3, "train").when(F.col("item_id") % 5 == 3, "val").otherwise("test").alias("split"), F.col("item_id").alias("cluster_ord"))


@query(_GRAMS + ", s AS (SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN 'train' WHEN doc_id % 5 = 3 THEN 'val' ELSE 'test' END AS split FROM documents) SELECT source_id, target_id, a.split AS source_split, b.split AS target_split FROM e JOIN s a ON a.doc_id = source_id JOIN s b ON b.doc_id = target_id WHERE a.split <> b.split")
def leakage_cross_split(spark: SparkSession, d: str) -> DataFrame:
    e = similarity.jaccard_pairs(_documents(spark, d)).select("source_id", "target_id")
    return similarity.cross_split(e, _halves(spark, d)).select("source_id", "target_id", "source_split", "target_split")


@query("SELECT split, n, n / sum(n) OVER ()::DOUBLE AS fraction FROM (SELECT CASE WHEN doc_id % 5 < 3 THEN 'train' WHEN doc_id % 5 = 3 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM documents GROUP BY 1)")
def partition_summary(spark: SparkSession, d: str) -> DataFrame:
    return similarity.partition_summary(_halves(spark, d))


@query("WITH s AS (SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN 'train' WHEN doc_id % 5 = 3 THEN 'val' ELSE 'test' END AS split FROM documents) SELECT sha256('[[' || string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (split = 'train') || '],[' || string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (split = 'val') || '],[' || string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (split = 'test') || ']]') AS checksum FROM s")
def split_checksum(spark: SparkSession, d: str) -> DataFrame:
    return similarity.split_checksum(_halves(spark, d))


_CURATE = ctes("fx_quality") + ", q AS (SELECT entry_id, row_ord, method, CAST(resolution AS DOUBLE) AS resolution FROM fx_quality)"


def _quality(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "fx_quality").withColumn("resolution", F.col("resolution").cast("double"))


@query(_CURATE + " SELECT CAST(row_ord AS VARCHAR) AS unit_id, CASE WHEN resolution > 100000 THEN 'RESOLUTION_THRESHOLD' ELSE 'NULL_RESOLUTION' END AS reason_code FROM q WHERE resolution > 100000 OR resolution IS NULL")
def resolution_filter(spark: SparkSession, d: str) -> DataFrame:
    return curate.apply_rules(_quality(spark, d), curate.resolution(100000), "row_ord")[1].select("unit_id", "reason_code")


@query(_CURATE + " SELECT row_ord, method FROM q WHERE upper(method) IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND upper(method) <> '2-HIGH'")
def method_filter(spark: SparkSession, d: str) -> DataFrame:
    return curate.apply_rules(_quality(spark, d), curate.method(["1-urgent", "2-high", "3-medium"], ["2-HIGH"]), "row_ord")[0].select("row_ord", "method")


@query("SELECT CAST(c.c_custkey AS BIGINT) AS entry_id FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey WHERE r.r_name IN ('ASIA', 'EUROPE') AND n.n_name NOT IN ('CHINA', 'FRANCE')")
def organism_filter(spark: SparkSession, d: str) -> DataFrame:
    n = frame(spark, d, "nation").join(frame(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.array("r_name", "n_name").alias("lineage"))
    t = frame(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").cast("bigint").alias("entry_id"), "lineage")
    return curate.apply_rules(t, curate.organism(["ASIA", "EUROPE"], ["CHINA", "FRANCE"]))[0].select("entry_id")


@query(ctes("fx_quality") + " SELECT entry_id, min(row_ord) AS row_ord FROM fx_quality GROUP BY 1")
def dedup_entry_id(spark: SparkSession, d: str) -> DataFrame:
    return curate.deduplicate(frame(spark, d, "fx_quality"), "entry_id", ["row_ord"])[0].select("entry_id", "row_ord")


@query("SELECT CAST(min(p_partkey) AS BIGINT) AS entry_id FROM part GROUP BY p_name, p_type")
def dedup_exact_hash(spark: SparkSession, d: str) -> DataFrame:
    t = frame(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("entry_id"), "p_name", "p_type")
    return curate.deduplicate(t, "exact_hash")[0].select("entry_id")


@query(_CURATE + " SELECT applied_rule, reason_code, count(*) AS structures_excluded FROM (SELECT CASE WHEN resolution > 100000 OR resolution IS NULL THEN 'resolution' ELSE 'method' END AS applied_rule, CASE WHEN resolution > 100000 THEN 'RESOLUTION_THRESHOLD' WHEN resolution IS NULL THEN 'NULL_RESOLUTION' ELSE 'METHOD_EXCLUDED' END AS reason_code FROM q WHERE resolution > 100000 OR resolution IS NULL OR method = '5-LOW') GROUP BY ALL")
def exclusion_summary(spark: SparkSession, d: str) -> DataFrame:
    return curate.summarize(curate.apply_rules(_quality(spark, d), [*curate.resolution(100000), *curate.method(exclude=["5-LOW"])], "row_ord")[1])


@query("SELECT CAST(p_partkey AS BIGINT) AS id, replace(upper(p_name), ' ', '') AS sequence, CAST(len(p_name) AS INT) AS n, CASE WHEN trim(p_brand) IN ('', '.', '?') THEN NULL ELSE trim(p_brand) END AS brand, TRY_CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS number FROM part")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    p = frame(spark, d, "part")
    return p.select(F.col("p_partkey").cast("bigint").alias("id"), S.entity_sequence(F.lit(""), F.col("p_name")).alias("sequence"), F.length("p_name").alias("n"), S.clean(F.col("p_brand")).alias("brand"), S.as_int(F.regexp_extract("p_brand", "[0-9]+", 0)).alias("number"))


_PLAN = TYPES + """, m AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY entry_id ORDER BY f) AS VARCHAR) AS c FROM (SELECT *, CASE WHEN type = 'polymer' AND seq_can <> '' THEN min(entity_ord) OVER (PARTITION BY entry_id, seq_can, type = 'polymer') ELSE entity_ord END AS f FROM fx_types)),
ch AS (SELECT entry_id, id, entity_id, chr(CAST(64 + row_number() OVER (PARTITION BY entry_id ORDER BY asym_ord) AS INT)) AS nc FROM fx_asym),
a1 AS (SELECT a.* REPLACE (ch.nc AS label_asym_id) FROM fx_atoms a JOIN ch ON ch.entry_id = a.entry_id AND ch.id = a.label_asym_id),
a0 AS (SELECT * REPLACE (CAST(dense_rank() OVER (PARTITION BY entry_id, label_asym_id ORDER BY f) AS INT) AS label_seq_id) FROM (SELECT *, min(atom_ord) OVER (PARTITION BY entry_id, label_asym_id, label_seq_id, label_comp_id, ins_code) AS f FROM a1)),
a2 AS (SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY entry_id ORDER BY CASE WHEN group_pdb = 'ATOM' THEN g0 END NULLS LAST, atom_ord) AS BIGINT) AS atom_ord) FROM (SELECT *, min(atom_ord) FILTER (group_pdb = 'ATOM') OVER (PARTITION BY entry_id, label_asym_id, label_seq_id, label_comp_id) AS g0 FROM a0)),
e AS (SELECT entry_id, label_asym_id, label_seq_id, label_comp_id, label_alt_id, CAST(sum(CAST(occupancy AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS occ, CAST(sum(CAST(b_iso AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS b, min(atom_ord) AS o FROM a2 WHERE label_alt_id <> '' GROUP BY ALL),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id, label_asym_id, label_seq_id, label_comp_id ORDER BY occ DESC, b, label_alt_id) AS r, min(o) OVER (PARTITION BY entry_id, label_asym_id, label_seq_id, label_comp_id) AS g FROM e) WHERE r = 1),
a3 AS (SELECT a.entry_id, a.label_asym_id, a.label_entity_id, a.label_seq_id, a.label_comp_id, a.label_atom_id, CAST(row_number() OVER (PARTITION BY a.entry_id ORDER BY a.label_alt_id IS NOT NULL, CASE WHEN a.label_alt_id IS NOT NULL THEN w.g END, a.atom_ord) AS BIGINT) AS atom_ord
 FROM a2 a LEFT JOIN w ON w.entry_id = a.entry_id AND w.label_asym_id = a.label_asym_id AND w.label_seq_id IS NOT DISTINCT FROM a.label_seq_id AND w.label_comp_id = a.label_comp_id WHERE a.label_alt_id IS NULL OR a.label_alt_id = w.label_alt_id)
SELECT a3.entry_id, a3.atom_ord, a3.label_asym_id, m.c AS label_entity_id, a3.label_seq_id, a3.label_comp_id, a3.label_atom_id FROM a3 JOIN ch ON ch.entry_id = a3.entry_id AND ch.nc = a3.label_asym_id JOIN m ON m.entry_id = a3.entry_id AND m.id = a3.label_entity_id
 WHERE m.type = 'polymer' OR (m.type <> 'water' AND NOT (""" + _ION.replace("pdbx_description", "m.pdbx_description") + "))"


@query(_PLAN)
def canonical_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The whole canonicalisation plan: remapped chains, renumbered residues, best occupancy by low B, merged entities, no waters or ions."""
    from residua.plans.canonicalise import canonicalise
    from residua.plans.policy import policy

    tables = {"atoms": _atoms(spark, d), "asym_units": frame(spark, d, "fx_asym"), "entities": frame(spark, d, "fx_types")}
    tables["entries"] = tables["atoms"].select("entry_id").distinct()
    p = policy({"identifier_rules": {"chain_id": {"strategy": "remap"}, "residue_numbering": {"strategy": "renumber"}}, "altloc_rules": {"tie_breaker": "lowest_b_factor"}, "entity_rules": {"strategy": "merge_equivalent_entities"}, "ligand_rules": {"strategy": "filter", "keep_waters": False, "keep_ions": False}})
    return canonicalise(tables, p).tables["atoms"].select("entry_id", "atom_ord", "label_asym_id", "label_entity_id", "label_seq_id", "label_comp_id", "label_atom_id")


@query(ATOMS + " SELECT DISTINCT entry_id, label_asym_id FROM (SELECT *, lag(label_seq_id) OVER (PARTITION BY entry_id, label_asym_id ORDER BY auth_seq_id DESC, atom_ord) AS b FROM fx_atoms WHERE group_pdb = 'ATOM' AND label_seq_id IS NOT NULL) WHERE label_seq_id < b")
def discontinuous_numbers(spark: SparkSession, d: str) -> DataFrame:
    atoms = C.reordered(_atoms(spark, d), F.col("auth_seq_id").desc(), F.col("atom_ord"))
    return checks.discontinuous(atoms)


@query(ATOMS + ", r AS (SELECT entry_id, label_asym_id, label_seq_id, arg_min(label_comp_id, atom_ord) AS c FROM fx_atoms WHERE group_pdb = 'ATOM' AND label_seq_id IS NOT NULL GROUP BY ALL) SELECT entry_id, label_asym_id AS chain_id, string_agg(CASE c WHEN 'ALA' THEN 'A' WHEN 'GLY' THEN 'G' ELSE 'X' END, '' ORDER BY label_seq_id) AS sequence FROM r GROUP BY 1, 2")
def sequences_from_atoms(spark: SparkSession, d: str) -> DataFrame:
    return checks.sequences_from_atoms(_atoms(spark, d))


@query("SELECT count(*) AS total, count(*) FILTER (s = 'success') AS success, count(*) FILTER (s = 'warning') AS warning, count(*) FILTER (s = 'failed') AS failed FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'warning' ELSE 'success' END AS s FROM orders)")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "warning").otherwise("success")
    return checks.batch_summary(frame(spark, d, "orders").select(s.alias("status")))


@query(TYPES + ", f AS (SELECT s.entry_id, 'UNRESOLVED_ENTITY_REF' AS code FROM fx_asym s LEFT JOIN fx_types t ON t.entry_id = s.entry_id AND t.id = s.entity_id WHERE t.type IS NULL OR t.type = 'water'), a AS (SELECT DISTINCT entry_id, 'ALTLOC_WITHOUT_OCCUPANCY' AS code, label_asym_id FROM fx_atoms WHERE label_alt_id <> '' AND occupancy < 0.91) SELECT code, count(*) AS n FROM (SELECT code FROM f UNION ALL SELECT code FROM a UNION ALL SELECT 'MISSING_ASSEMBLY' FROM (SELECT DISTINCT entry_id FROM fx_atoms) UNION ALL SELECT 'MISSING_ENTITY_POLY' FROM fx_types WHERE type = 'polymer' UNION ALL SELECT 'MISSING_ENTITY' FROM (SELECT entry_id FROM fx_types GROUP BY 1 HAVING bool_and(type = 'water'))) GROUP BY 1")
def structure_checks(spark: SparkSession, d: str) -> DataFrame:
    """Validation of parsed structures, where waters have lost their entities and low occupancies count as none."""
    atoms = _atoms(spark, d).withColumn("occupancy", F.when(F.col("occupancy") >= 0.91, F.col("occupancy")))
    t = {"entries": atoms.select("entry_id").distinct(), "atoms": atoms, "asym_units": frame(spark, d, "fx_asym"), "entities": frame(spark, d, "fx_types").filter("type <> 'water'")}
    raw = spark.createDataFrame([], "entry_id string, category string, row_ord int, cols map<string,string>")
    return checks.structure(t, raw).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


from residua import file_queries, plan_queries  # noqa: E402, F401  (they register their queries here)
