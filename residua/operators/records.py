"""Machine-learning records: chains, residues, interfaces, and their filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residua.operators import spatial

AMINO = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL", "SEC", "PYL")
NUCLEOTIDES = ("A", "C", "G", "U", "I", "DA", "DC", "DG", "DT", "DI", "DU")


def chain_records(atoms: DataFrame, asym: DataFrame, entities: DataFrame) -> DataFrame:
    """Polymer chains that have atoms: (entry_id, chain_id, entity_id, sequence, residue_count, atom_count)."""
    n = atoms.groupBy("entry_id", F.col("label_asym_id").alias("id")).agg(F.count_distinct(F.struct("label_seq_id", "auth_seq_id")).alias("residue_count"), F.count(F.lit(1)).alias("atom_count"))
    e = entities.filter("type = 'polymer'").select("entry_id", F.col("id").alias("entity_id"), F.col("seq_can").alias("sequence"))
    return asym.join(e, ["entry_id", "entity_id"]).join(n, ["entry_id", "id"]).select("entry_id", F.col("id").alias("chain_id"), "entity_id", "sequence", "residue_count", "atom_count")


def residue_records(atoms: DataFrame, polymers: DataFrame, fields: Sequence[str] = ("label_atom_id", "x", "y", "z")) -> DataFrame:
    """Residues of polymer chains with their atoms in file order; ``residue_ord`` numbers them by (chain, number or 0, first appearance)."""
    g = spatial.in_chains(atoms, polymers).groupBy("entry_id", F.col("label_asym_id").alias("chain_id"), F.col("label_seq_id").alias("seq_id"), "auth_seq_id", F.col("label_comp_id").alias("comp_id"))
    t = g.agg(F.min("atom_ord").alias("first_ord"), F.count(F.lit(1)).alias("atom_count"), F.array_sort(F.collect_list(F.struct("atom_ord", *fields))).alias("atoms"))
    order = Window.partitionBy("entry_id").orderBy("chain_id", F.coalesce("seq_id", F.lit(0)), "first_ord")
    return t.withColumn("residue_ord", F.row_number().over(order))


def interface_records(interfaces: DataFrame) -> DataFrame:
    return interfaces.select(F.concat_ws("_", "entry_id", "chain_a", "chain_b").alias("interface_id"), "entry_id", "chain_a", "chain_b", "residues_a", "residues_b", "contact_count")


def residue_type(comp):
    return F.when(F.upper(comp).isin(*AMINO), "amino_acid").when(F.upper(comp).isin(*NUCLEOTIDES), "nucleotide").otherwise("non_standard")


def interface_type(a, b):
    """protein_protein, protein_rna, protein_dna, protein_ligand or other, from the polymer types of both sides."""
    kind = lambda t: F.when(F.lower(t).contains("polypeptide"), "protein").when(F.lower(t).contains("polydeoxyribonucleotide"), "dna").when(F.lower(t).contains("polyribonucleotide"), "rna").otherwise("ligand")
    x, y = kind(a), kind(b)
    other = F.when(x == "protein", y).otherwise(x)
    return F.when((x == "protein") | (y == "protein"), F.concat(F.lit("protein_"), other)).otherwise(F.lit("other"))


def typed_interfaces(interfaces: DataFrame, asym: DataFrame, entities: DataFrame) -> DataFrame:
    """Interfaces with ``interface_type``, from the polymer types of both chains' entities; an unknown chain counts as a ligand."""
    kind = F.col("poly.type") if "poly" in entities.columns else F.col("poly_type")
    e = entities.select("entry_id", F.col("id").alias("entity_id"), kind.alias("_t"))
    chains = asym.select("entry_id", F.col("id").alias("_id"), "entity_id").join(e, ["entry_id", "entity_id"]).groupBy("entry_id", "_id").agg(F.min("_t").alias("_t"))
    t = interfaces
    for side in "ab":
        t = t.join(chains.toDF("entry_id", f"chain_{side}", f"_{side}"), ["entry_id", f"chain_{side}"], "left")
    none = F.lit("")
    return t.withColumn("interface_type", interface_type(F.coalesce("_a", none), F.coalesce("_b", none))).select(*interfaces.columns, "interface_type")


def filter_residues(residues: DataFrame, types: Sequence[str] | None = None, full_backbone: bool = False) -> DataFrame:
    t = residues if types is None else residues.filter(residue_type(F.col("comp_id")).isin(*types))
    if full_backbone:
        t = t.filter(F.size(F.array_intersect(F.transform("atoms", lambda a: a["label_atom_id"]), F.array(*[F.lit(x) for x in ("N", "CA", "C", "O")]))) == 4)
    return t


def filter_interfaces(interfaces: DataFrame, types: Sequence[str] | None = None, min_contacts: int = 0, min_area: float | None = None) -> DataFrame:
    if min_area is not None:
        raise NotImplementedError("buried area isn't computed")
    t = interfaces.filter(F.col("contact_count") >= min_contacts)
    return t if types is None else t.filter(F.col("interface_type").isin(*types))


def with_annotations(chains: DataFrame, **tables: DataFrame) -> DataFrame:
    """Chain records with metadata: per table, the rows of the chain (where it has chain_id) or else of the entry, as a list."""
    out = chains
    for name, t in tables.items():
        keys = ["entry_id", "chain_id"] if "chain_id" in t.columns else ["entry_id"]
        rest = [c for c in t.columns if c not in keys]
        out = out.join(t.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name)), keys, "left")
    return out
