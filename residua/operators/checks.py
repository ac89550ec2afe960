"""Validation rules over the tables of many entries: a row (entry_id, code, severity, detail) per finding, and a status per entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residua.functions import scalars as S
from residua.operators.canonical import incomplete_chains
from residua.operators.metadata import first_rows, item, keyword_list

#: Three-letter residue codes and their letters; anything else is X.
LETTERS = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V", "SEC": "U", "PYL": "O", "A": "A", "C": "C", "G": "G", "U": "U", "DA": "A", "DC": "C", "DG": "G", "DT": "T"}
#: Elements that make a single-atom ligand an ion.
METALS = ("LI", "NA", "K", "RB", "CS", "MG", "CA", "SR", "BA", "MN", "FE", "CO", "NI", "CU", "ZN", "CD", "HG", "AL", "AG", "AU", "PT", "PB", "MO", "W", "V", "CR", "GA", "Y", "LA", "CE", "SM", "EU", "GD", "TB", "YB", "LU", "TL")


def _found(df: DataFrame, code: str, severity: str, detail=None) -> DataFrame:
    return df.select("entry_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def _without(entries: DataFrame, rows: DataFrame, code: str, severity: str) -> DataFrame:
    return _found(entries.join(rows.select("entry_id").distinct(), "entry_id", "left_anti"), code, severity)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def discontinuous(atoms: DataFrame) -> DataFrame:
    """Chains in which a polymer's number falls below the one before it, in atom order."""
    before = F.lag("label_seq_id").over(Window.partitionBy("entry_id", "label_asym_id").orderBy("atom_ord"))
    t = atoms.filter("group_pdb = 'ATOM' and label_seq_id is not null").withColumn("_b", before)
    return t.filter("label_seq_id < _b").select("entry_id", "label_asym_id").distinct()


def structure(tables: dict[str, DataFrame], raw: DataFrame) -> DataFrame:
    """Findings on a parsed structure: missing or unresolved parts are errors; empty chains, missing assemblies or polymer records, alternate
    locations without occupancy and falling residue numbers are warnings."""
    e, atoms, asym, entities = (tables[k] for k in ("entries", "atoms", "asym_units", "entities"))
    have = lambda c: raw.filter(F.col("category") == c)
    parts = [_without(e, atoms, c, "error") for c in ("MISSING_ATOM_SITE", "ZERO_ATOMS")]
    parts += [_without(e, entities, "MISSING_ENTITY", "error"), _without(e, asym, "MISSING_STRUCT_ASYM", "error"), _without(e, have("_pdbx_struct_assembly"), "MISSING_ASSEMBLY", "warning")]
    ids = entities.select("entry_id", F.col("id").alias("entity_id"))
    parts.append(_found(asym.join(ids, ["entry_id", "entity_id"], "left_anti"), "UNRESOLVED_ENTITY_REF", "error", F.col("id")))
    if "assemblies" in tables:
        used = tables["assemblies"].select("entry_id", F.explode(F.flatten(F.transform("generators", lambda g: g["asym_id_list"]))).alias("id")).distinct()
        parts.append(_found(used.join(asym.select("entry_id", "id"), ["entry_id", "id"], "left_anti"), "UNRESOLVED_ASSEMBLY_CHAIN_REF", "error", F.col("id")))
    chains = atoms.select("entry_id", F.col("label_asym_id").alias("id")).distinct()
    parts.append(_found(asym.join(chains, ["entry_id", "id"], "left_anti"), "EMPTY_CHAIN", "warning", F.col("id")))
    poly = have("_entity_poly").select("entry_id", F.try_element_at("cols", F.lit("entity_id")).alias("id"))
    parts.append(_found(entities.filter("type = 'polymer'").join(poly, ["entry_id", "id"], "left_anti"), "MISSING_ENTITY_POLY", "warning", F.col("id")))
    parts.append(_found(atoms.filter("label_alt_id <> '' and coalesce(occupancy, 0) = 0").select("entry_id", "label_asym_id").distinct(), "ALTLOC_WITHOUT_OCCUPANCY", "warning", F.col("label_asym_id")))
    parts.append(_found(discontinuous(atoms), "DISCONTINUOUS_SEQID", "warning", F.col("label_asym_id")))
    return _all(parts)


def canonical(tables: dict[str, DataFrame], mappings: dict[str, DataFrame], before: dict[str, DataFrame], policy) -> DataFrame:
    """Findings on a canonical structure against the tables it was made from and the policy."""
    e, atoms, asym = tables["entries"], tables["atoms"], tables["asym_units"]
    twice = asym.groupBy("entry_id", "id").count().filter("count > 1")
    parts = [_found(twice, "CANONICAL_CHAIN_ID_COLLISION", "error", F.col("id"))]
    rows = atoms.filter("group_pdb = 'ATOM' and label_seq_id is not null").groupBy("entry_id", "label_asym_id", "label_seq_id", "ins_code").agg(F.count_distinct("label_comp_id").alias("n"))
    parts.append(_found(rows.filter("n > 1"), "RESIDUE_NUMBER_COLLISION", "error", F.concat_ws(":", "label_asym_id", F.col("label_seq_id").cast("string"))))
    parts.append(_without(e, asym, "EMPTY_CANONICAL_STRUCTURE", "error"))
    if policy["altloc_rules.strategy"] == "select_best_occupancy":
        r = ["entry_id", "label_asym_id", "label_seq_id", "label_comp_id"]
        none = before["atoms"].filter("label_alt_id <> ''").groupBy(*r).agg(F.count("occupancy").alias("n")).filter("n = 0")
        parts.append(_found(none, "UNRESOLVED_ALTLOC", "error", F.concat_ws(":", "label_asym_id", F.col("label_seq_id").cast("string"))))
    if "chain_id" in mappings and policy["provenance_rules.record_original_mappings"]:
        known = mappings["chain_id"].select("entry_id", F.col("canonical_chain_id").alias("id"))
        parts.append(_found(asym.join(known, ["entry_id", "id"], "left_anti"), "MAPPING_INCOMPLETE", "error", F.col("id")))
    if policy["entity_rules.strategy"] == "merge_equivalent_entities":
        n = before["entities"].filter("type = 'polymer'").groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce("seq_can", "id")).alias("d"))
        parts.append(_found(n.filter("n > 1 and d > 1"), "ENTITY_MERGE_SKIPPED", "warning", F.col("d")))
    if policy["ligand_rules.strategy"] != "preserve":
        gone = before["asym_units"].groupBy("entry_id").count().join(asym.groupBy("entry_id").agg(F.count(F.lit(1)).alias("k")), "entry_id", "left").filter("count > coalesce(k, 0)")
        parts.append(_found(gone, "LIGANDS_EXCLUDED", "warning", F.col("count") - F.coalesce("k", F.lit(0))))
    if policy["missing_data_rules.incomplete_chains.strategy"] == "truncate_to_complete_regions":
        parts.append(_found(incomplete_chains(before["atoms"]), "INCOMPLETE_CHAIN_TRUNCATED", "warning", F.col("label_asym_id")))
    return _all(parts)


def status(entries: DataFrame, found: DataFrame, warnings_as_errors: bool = False) -> DataFrame:
    """(entry_id, status): failed, warning or valid."""
    n = found.groupBy("entry_id").agg(F.bool_or(F.col("severity") == "error").alias("bad"))
    bad = F.col("bad") | F.lit(warnings_as_errors)
    return entries.select("entry_id").join(n, "entry_id", "left").select("entry_id", F.when(F.col("bad").isNull(), "valid").when(bad, "failed").otherwise("warning").alias("status"))


def worst(*statuses: DataFrame) -> DataFrame:
    """Statuses of several stages as one: failed over warning over anything else."""
    t = _all(list(statuses))
    rank = F.when(F.col("status") == "failed", 2).when(F.col("status") == "warning", 1).otherwise(0)
    return t.groupBy("entry_id").agg(F.max(rank).alias("r")).select("entry_id", F.element_at(F.array(F.lit("success"), F.lit("warning"), F.lit("failed")), F.col("r") + 1).alias("status"))


def batch_summary(statuses: DataFrame) -> DataFrame:
    """One row: total, success, warning, failed."""
    n = lambda s: F.count_if(F.col("status") == s)
    return statuses.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin("success", "valid")).alias("success"), n("warning").alias("warning"), n("failed").alias("failed"))


def sequences_from_atoms(atoms: DataFrame) -> DataFrame:
    """(entry_id, chain_id, sequence) of numbered ATOM rows: a letter per residue in order of number."""
    table = F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv])
    r = atoms.filter("group_pdb = 'ATOM' and label_seq_id is not null").groupBy("entry_id", F.col("label_asym_id").alias("chain_id"), "label_seq_id").agg(F.min_by("label_comp_id", "atom_ord").alias("c"))
    letter = F.coalesce(F.try_element_at(table, F.upper("c")), F.lit("X"))
    g = r.groupBy("entry_id", "chain_id").agg(F.array_sort(F.collect_list(F.struct("label_seq_id", letter.alias("l")))).alias("g"))
    return g.select("entry_id", "chain_id", F.array_join(F.transform("g", lambda x: x["l"]), "").alias("sequence"))


def single_atom_ions(atoms: DataFrame) -> DataFrame:
    """(entry_id, chain_id, comp_id) of HETATM groups of one atom that is a metal."""
    t = atoms.filter("group_pdb = 'HETATM'").groupBy("entry_id", F.col("label_asym_id").alias("chain_id"), F.col("label_comp_id").alias("comp_id"), "auth_seq_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.upper("type_symbol")).alias("e"))
    return t.filter((F.col("n") == 1) & F.col("e").isin(*METALS)).select("entry_id", "chain_id", "comp_id").distinct()


def archive_metadata(entries: DataFrame, raw: DataFrame) -> DataFrame:
    """Dates, keywords as a list, space group and unit cell of each entry."""
    t = entries.select("entry_id")
    for name, cat in (("k", "_struct_keywords"), ("s", "_symmetry"), ("c", "_cell"), ("d", "_pdbx_database_status")):
        t = t.join(first_rows(raw, cat).withColumnRenamed("cols", name), "entry_id", "left")
    last = raw.filter("category = '_pdbx_audit_revision_history'").groupBy("entry_id").agg(F.max(S.clean(item("revision_date"))).alias("revision_date"))
    cell = F.struct(*[S.as_float(item(i, "c")).alias(n) for n, i in (("a", "length_a"), ("b", "length_b"), ("c", "length_c"), ("alpha", "angle_alpha"), ("beta", "angle_beta"), ("gamma", "angle_gamma"))])
    return t.join(last, "entry_id", "left").select("entry_id", S.clean(item("recvd_initial_deposition_date", "d")).alias("deposition_date"), "revision_date", keyword_list(S.clean(item("pdbx_keywords", "k"))).alias("keywords"), S.clean(item("space_group_name_H-M", "s")).alias("space_group"), cell.alias("unit_cell"))
