"""The canonicalisation plan: steps in a fixed order over the tables of many entries.

The policy is known when the plan is built, so a strategy that changes nothing adds no node to it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions import scalars as S
from residua.operators import canonical as C
from residua.plans.policy import Policy

#: Columns of each table that hold chain identifiers.
CHAIN_COLUMNS = {"atoms": ("label_asym_id",), "asym_units": ("id",), "connections": ("ptnr1.label_asym_id", "ptnr2.label_asym_id"), "conf_records": ("beg_label_asym_id", "end_label_asym_id"), "sheet_strands": ("beg_label_asym_id", "end_label_asym_id")}


@dataclass
class Canonical:
    """The tables after all steps, the mappings, diagnostics, status per entry, and the names of the steps that ran."""

    tables: dict[str, DataFrame]
    mappings: dict[str, DataFrame] = field(default_factory=dict)
    diagnostics: DataFrame | None = None
    status: DataFrame | None = None
    report: DataFrame | None = None
    transforms: list[str] = field(default_factory=list)


def canonicalise(tables: dict[str, DataFrame], policy: Policy) -> Canonical:
    """tables: entries, atoms, asym_units, entities, and where they are there assemblies, connections, conf_records, sheet_strands, raw.

    ``raw`` isn't rewritten: metadata from it keeps original identifiers.
    """
    t, out, notes = dict(tables), Canonical({}), []
    if policy["identifier_rules.residue_numbering.strategy"] == "renumber" or policy["altloc_rules.strategy"] != "preserve":
        t["atoms"] = t["atoms"].repartition("entry_id")  # one exchange; every window below is within an entry
    record = policy["provenance_rules.record_original_mappings"]

    def done(name: str, strategy: str) -> None:
        if strategy != "preserve":
            out.transforms.append(f"{name}:{strategy}")

    s = policy["identifier_rules.chain_id.strategy"]
    done("chain_id", s)
    if s != "preserve":
        mapping = C.chain_map(t["asym_units"], s)
        for name, columns in CHAIN_COLUMNS.items():
            if name in t:
                t[name] = C.rename_chains(t[name], mapping, *columns)
        if "assemblies" in t:
            t["assemblies"] = C.rename_generators(t["assemblies"], mapping)
        out.mappings["chain_id"] = mapping
    s = policy["identifier_rules.residue_numbering.strategy"]
    done("residue_numbering", s)
    keep_codes = policy["identifier_rules.residue_numbering.preserve_insertion_codes"]
    if s != "preserve" or not keep_codes:
        t["atoms"], out.mappings["residue_number"] = C.number_residues(t["atoms"], s, keep_codes)
    ids, s = policy["identifier_rules.assembly_id.strategy"], policy["assembly_rules.strategy"]
    if ids != "preserve" or s != "preserve_as_reported":
        out.transforms.append(f"assembly:{s}/id:{ids}")
    if "assemblies" in t:
        t["assemblies"], out.mappings["assembly"] = C.number_assemblies(t["assemblies"], ids, s)

    s = policy["missing_data_rules.missing_atoms.strategy"]
    done("missing_atoms", s)
    if s in ("annotate", "drop_partial_residue"):
        lacks = C.missing_backbone(t["atoms"])
        if policy["missing_data_rules.missing_atoms.record_missingness"]:
            notes.append(C.diagnostic(lacks, "MISSING_ATOMS", F.concat(F.lit("lacks "), F.array_join("missing", ", ")), S.residue_id(F.col("label_asym_id"), F.col("label_seq_id"))))
        t["atoms"] = C.drop_partial_residues(t["atoms"]) if s == "drop_partial_residue" else C.polymers_first(t["atoms"])
    s = policy["missing_data_rules.missing_residues.strategy"]
    done("missing_residues", s)
    if policy["missing_data_rules.missing_residues.record_gaps"]:
        notes.append(C.diagnostic(C.sequence_gaps(t["atoms"]), "SEQUENCE_GAP", F.concat(F.lit("between "), F.col("after_seq"), F.lit(" and "), F.col("before_seq")), F.col("label_asym_id")))
    if s == "drop_chain_segment":
        t["atoms"] = C.drop_gapped_chains(t["atoms"])
    s = policy["missing_data_rules.incomplete_chains.strategy"]
    done("incomplete_chains", s)
    if s == "exclude":
        t["atoms"], t["asym_units"] = C.exclude_incomplete(t["atoms"], t["asym_units"])
    elif s == "truncate_to_complete_regions":
        t["atoms"] = C.truncate_to_regions(t["atoms"])

    s = policy["altloc_rules.strategy"]
    done("altloc", s)
    if s != "preserve":
        t["atoms"], picked = C.pick_altlocs(t["atoms"], s, policy["altloc_rules.tie_breaker"], policy["altloc_rules.user_defined_altloc"])
        if policy["altloc_rules.record_selection"]:
            out.mappings["altloc"] = picked
    s = policy["entity_rules.strategy"]
    done("entity", s)
    if s != "preserve":
        mapping = C.map_entities(t["entities"], s)
        t["entities"] = C.merged_entities(t["entities"], mapping)
        t["atoms"] = C.apply_entity_map(t["atoms"], mapping, "label_entity_id")
        t["asym_units"] = C.apply_entity_map(t["asym_units"], mapping, "entity_id")
        if policy["entity_rules.preserve_original_entity_ids"]:
            out.mappings["entity"] = mapping
    s = policy["ligand_rules.strategy"]
    done("ligands", s)
    if s != "preserve":
        t["asym_units"], t["atoms"], found = C.filter_ligands(t["asym_units"], t["atoms"], t["entities"], s, policy["ligand_rules.keep_waters"], policy["ligand_rules.keep_ions"], policy["ligand_rules.keep_nonpolymer_ligands"])
        notes.append(found)

    notes.append(C.collision_notes(t["asym_units"], t["atoms"]))
    for n in notes:
        out.diagnostics = n if out.diagnostics is None else out.diagnostics.unionByName(n)
    strict = policy["validation_rules.strictness"]
    out.status = C.status(t["entries"], out.diagnostics, strict, policy["validation_rules.fail_on_unresolved_issues"], policy["validation_rules.warnings_as_errors"])
    if strict == "strict":
        out.diagnostics = out.diagnostics.unionByName(out.diagnostics.filter("severity = 'warning'").withColumn("severity", F.lit("error")))
    if policy["provenance_rules.emit_canonicalisation_report"]:
        out.report = out.diagnostics.groupBy("entry_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "info").alias("notes"))
    if not record:
        out.mappings = {k: v for k, v in out.mappings.items() if k == "altloc"}
    out.tables = t
    return out
