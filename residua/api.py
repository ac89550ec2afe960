"""One function per task, over ``Structures``: the tables of any number of entries.

``mmcif_to_structure`` reads one file or a thousand; every function below works on all entries it is given and returns DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.functions import scalars as S
from residua.operators import metadata as M
from residua.operators import records as R
from residua.operators import similarity as X
from residua.operators import spatial
from residua.plans.canonicalise import Canonical, canonicalise
from residua.plans.policy import Policy, load_policy, policy
from residua.sources import cif, fetch, sequences

__all__ = [
    "Structures", "load_policy", "policy", "fetch_mmcif", "fetch_list_mmcif", "mmcif_to_structure", "from_tables", "from_raw_bytes", "from_parsed_structure", "from_canonical_structures", "from_annotated_structures", "retrieve", "retrieve_lineages", "canonicalise_structure", "collect_metadata",
    "extract_entity_metadata", "extract_entry_metadata", "extract_ligand_metadata", "extract_metadata", "extract_metadata_category", "extract_quality", "extract_taxonomies", "extract_taxonomy",
    "extract_uniprot_mappings", "annotate_chain_interfaces", "annotate_ligand_contacts", "annotate_pairwise_sequence_identity", "annotate_structure_counts", "extract_chain_records",
    "extract_interface_records", "extract_residue_records", "cluster_similar_items", "compute_sequence_similarity", "partition_dataset",
]

#: Tables a plan needs, with columns that must be there.
NEEDED = {"entries": ("entry_id",), "atoms": ("entry_id", "atom_ord", "group_pdb", "label_asym_id", "label_entity_id", "label_seq_id", "label_comp_id", "label_atom_id", "x", "y", "z"), "asym_units": ("entry_id", "asym_ord", "id", "entity_id"), "entities": ("entry_id", "entity_ord", "id", "type")}


@dataclass(frozen=True)
class Structures:
    tables: dict[str, DataFrame]

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    @property
    def polymers(self) -> DataFrame:
        return spatial.polymer_chains(self["asym_units"], self["entities"])

    def entry(self, entry_id: str) -> Structures:
        """The tables of one entry."""
        return replace(self, tables={k: t.filter(F.col("entry_id") == entry_id) for k, t in self.tables.items()})


def from_tables(tables: Mapping[str, DataFrame]) -> Structures:
    """Enters with tables of one's own, after a check of their columns."""
    for name, columns in NEEDED.items():
        if name not in tables:
            raise ValueError(f"table {name} is missing")
        lacks = set(columns) - set(tables[name].columns)
        if lacks:
            raise ValueError(f"{name} lacks {', '.join(sorted(lacks))}")
    return Structures(dict(tables))


def from_parsed_structure(tables: Mapping[str, DataFrame], provider: str = "external", source_uri: str | None = None) -> tuple[Structures, DataFrame, DataFrame]:
    """(structures, provenance, status) of tables that something else has parsed: nothing is fetched, parsed or validated, every entry succeeds."""
    s = from_tables(tables)
    none = lambda t: F.lit(None).cast(t)
    came = s["entries"].select("entry_id", F.lit(provider).alias("provider"), F.lit(source_uri).cast("string").alias("source_uri"), F.lit(False).alias("from_cache"), none("timestamp").alias("retrieved_at"))
    return s, came, s["entries"].select("entry_id", F.lit("success").alias("status"))


def from_canonical_structures(tables: Mapping[str, DataFrame], mappings: Mapping[str, DataFrame] | None = None) -> tuple[Structures, dict[str, DataFrame], Canonical]:
    """What ``canonicalise_structure`` returns, of tables that are canonical already."""
    s = from_tables(tables)
    return s, dict(mappings or {}), Canonical(dict(s.tables), dict(mappings or {}), status=s["entries"].select("entry_id", F.lit("success").alias("status")))


def from_annotated_structures(tables: Mapping[str, DataFrame], layers: Mapping[str, DataFrame]) -> tuple[Structures, dict[str, DataFrame]]:
    """Canonical tables with annotation layers of one's own, each with its name as ``layer_type``."""
    for name, t in layers.items():
        if "entry_id" not in t.columns:
            raise ValueError(f"layer {name} lacks entry_id")
    return from_tables(tables), {name: t.withColumn("layer_type", F.lit(name)) for name, t in layers.items()}


def retrieve(s: Structures, table: DataFrame, required: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entries with the rows of a user's table by entry_id, diagnostics for entries it lacks): archive, UniProt, SIFTS or taxonomy rows."""
    return M.attach(s["entries"], table, required=required)


def retrieve_lineages(taxa: DataFrame) -> DataFrame:
    """(taxon_id, lineage) from a user's (taxon_id, parent_id, name)."""
    return M.lineages(taxa)


def fetch_list_mmcif(spark: SparkSession, entry_ids: Sequence[str], provider: str, output_dir: str, source_uri: str | None = None, fetch_options: fetch.FetchOptions | None = None, **more) -> DataFrame:
    return fetch.fetch_many(spark, list(entry_ids), output_dir, provider, source_uri, fetch_options, **more)


def fetch_mmcif(spark: SparkSession, entry_id: str, provider: str, output_dir: str, source_uri: str | None = None, fetch_options: fetch.FetchOptions | None = None, **more):
    """The provenance row of one entry."""
    return fetch_list_mmcif(spark, [entry_id], provider, output_dir, source_uri, fetch_options, **more).first()


def mmcif_to_structure(spark: SparkSession, path: str | list[str], model_num: int = 1) -> tuple[Structures, DataFrame, DataFrame]:
    """(structures, diagnostics, status per entry) of the files under ``path``. The parsed rows are written once and read by every table."""
    rows = X.stored(cif.read_rows(spark.read.format("binaryFile").load(path)), "cif-rows")
    t = cif.tables(rows, model_num)
    return Structures({k: v for k, v in t.items() if k not in ("diagnostics", "status")}), t["diagnostics"], t["status"]


def from_raw_bytes(files: DataFrame, model_num: int = 1) -> tuple[Structures, DataFrame, DataFrame]:
    """The same from a table (path, content)."""
    t = cif.tables(X.stored(cif.read_rows(files), "cif-rows"), model_num)
    return Structures({k: v for k, v in t.items() if k not in ("diagnostics", "status")}), t["diagnostics"], t["status"]


def canonicalise_structure(structures: Structures, rules: Policy) -> tuple[Structures, dict[str, DataFrame], Canonical]:
    out = canonicalise(structures.tables, rules)
    return Structures(out.tables), out.mappings, out


def collect_metadata(s: Structures) -> dict[str, DataFrame]:
    return M.collect(s["entries"], s["entities"], s["asym_units"], s["atoms"], s["raw"])


def extract_metadata_category(s: Structures, category: str, columns: Sequence[str] | None = None) -> DataFrame:
    return M.category(s["raw"], category, columns)


def extract_metadata(s: Structures, category: str, keys: Sequence[str]) -> DataFrame:
    return extract_metadata_category(s, category, keys)


def extract_entry_metadata(s: Structures) -> DataFrame:
    return M.entry_metadata(s["entries"], s["raw"])


def extract_taxonomies(s: Structures) -> DataFrame:
    return M.taxonomies(s["raw"])


def extract_taxonomy(s: Structures) -> DataFrame:
    return M.first_taxonomy(M.taxonomies(s["raw"]))


def extract_quality(s: Structures) -> DataFrame:
    return M.quality(s["raw"])


def extract_entity_metadata(s: Structures) -> DataFrame:
    return M.entity_metadata(s["entities"], s["asym_units"], s["raw"])


def extract_ligand_metadata(s: Structures, include_waters: bool = False) -> DataFrame:
    return M.ligand_metadata(s["raw"], s["asym_units"], s["atoms"], include_waters)


def extract_uniprot_mappings(s: Structures) -> DataFrame:
    return M.uniprot_mappings(s["raw"])


def annotate_structure_counts(s: Structures) -> DataFrame:
    more = {k: s.tables.get(k) for k in ("assemblies", "connections", "conf_records", "sheet_strands")}
    return spatial.structure_counts(s["atoms"], s["asym_units"], s["entities"], **more)


def annotate_ligand_contacts(s: Structures, distance_cutoff: float = 4.0, include_waters: bool = False) -> DataFrame:
    return spatial.contact_layers(s["atoms"], s.polymers, distance_cutoff, include_waters)


def annotate_chain_interfaces(s: Structures, distance_cutoff: float = 4.0) -> DataFrame:
    return spatial.chain_interfaces(s["atoms"], s.polymers, distance_cutoff)


def annotate_pairwise_sequence_identity(left: Structures, right: Structures) -> tuple[DataFrame, DataFrame]:
    """(all pairs of entity sequences, the best pair)."""

    def named(s: Structures) -> DataFrame:
        seq = S.entity_sequence(F.col("poly.seq_can"), F.col("poly.seq")) if "poly" in s["entities"].columns else S.entity_sequence(F.lit(""), F.col("seq_can"))
        return s["entities"].select("id", F.col("entity_ord").alias("ord"), seq.alias("sequence")).filter("sequence is not null")

    pairs = spatial.pairwise_identity(named(left), named(right))
    return pairs, spatial.best_identity(pairs)


def extract_chain_records(s: Structures) -> DataFrame:
    return R.chain_records(s["atoms"], s["asym_units"], s["entities"])


def extract_residue_records(s: Structures) -> DataFrame:
    return R.residue_records(s["atoms"], s.polymers)


def extract_interface_records(s: Structures, distance_cutoff: float = 4.0) -> DataFrame:
    return R.interface_records(annotate_chain_interfaces(s, distance_cutoff))


def compute_sequence_similarity(spark: SparkSession, items: Mapping[str, str] | DataFrame | str, threshold: float = 0.3, k: int = 3, engine: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Relationships between sequences: a mapping of ids to sequences, chain records, or a FASTA folder.

    The native engine scores Jaccard similarity of letter k-grams from ``threshold`` up; ``engine`` may replace it: it gets (item_id, sequence) and
    returns hits (query, target, score, coverage, line_no). Sequences that are NULL are left out, self hits and the weaker of two hits of a pair too.
    """
    if isinstance(items, str):
        t = sequences.read_fasta(spark, items).select("item_id", "sequence")
    elif isinstance(items, DataFrame):
        t = items.select(S.item_id(F.col("entry_id"), F.col("chain_id")).alias("item_id"), "sequence") if "chain_id" in items.columns else items.select("item_id", "sequence")
    else:
        t = spark.createDataFrame(list(items.items()), "item_id string, sequence string")
    t = t.filter("sequence is not null")
    if engine is not None:
        return X.relationships(X.best_hits(engine(t)), F.col("score"), F.col("coverage"), engine=getattr(engine, "__name__", "custom"), identity=F.col("score"))
    p = X.jaccard_pairs(t, Fraction(str(threshold)) * 100, k, words=False)
    union = F.col("size_a") + F.col("size_b") - F.col("shared")
    return X.relationships(p, F.col("shared") / union, F.col("shared") / F.greatest("size_a", "size_b"), k=str(k), threshold=str(threshold))


def cluster_similar_items(items: DataFrame, relationships: DataFrame, threshold: float) -> DataFrame:
    """(item_id, item_ord) and relationships -> clusters."""
    return X.clusters(items, relationships, threshold)


def partition_dataset(clusters: DataFrame, pct_train: float = 0.6, pct_val: float = 0.2, pct_test: float = 0.2, keep_similar_items: bool = True) -> DataFrame:
    """(cluster_ord, item_id, split)."""
    f = (pct_train, pct_val, pct_test)
    if keep_similar_items:
        return X.members_of(X.partition_keep_large(clusters, f), "split").select("cluster_ord", "item_id", "split")
    return X.partition_proportional(clusters, f)
