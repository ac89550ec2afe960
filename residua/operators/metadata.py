"""Metadata from raw categories: ``raw(entry_id, category, row_ord, cols MAP<STRING,STRING>)`` and the typed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.functions import scalars as S
from residua.operators.ranking import stored

WATERS = ("HOH", "WAT", "DOD")


def item(name: str, cols: str = "cols") -> Column:
    return F.try_element_at(F.col(cols), F.lit(name))


def category(raw: DataFrame, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of one category in order; with ``columns``, those as columns, NULL where a row lacks them."""
    name = name if name.startswith("_") else f"_{name}"
    t = raw.filter(F.col("category") == name)
    return t if columns is None else t.select("entry_id", "row_ord", *[item(c).alias(c) for c in columns])


def first_rows(raw: DataFrame, name: str) -> DataFrame:
    """(entry_id, cols): the first row of a category per entry."""
    return category(raw, name).groupBy("entry_id").agg(F.min_by("cols", "row_ord").alias("cols"))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, NULLs equal."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def entry_metadata(entries: DataFrame, raw: DataFrame) -> DataFrame:
    def one(name: str) -> DataFrame:
        return first_rows(raw, name).withColumnRenamed("cols", name)

    t = entries.join(one("_struct"), "entry_id", "left").join(one("_struct_keywords"), "entry_id", "left").join(one("_citation"), "entry_id", "left")
    got = lambda n, c: S.clean(item(c, n))
    return t.select(
        "entry_id",
        F.coalesce(got("_struct", "title"), S.clean(F.col("title"))).alias("title"),
        F.coalesce(got("_struct_keywords", "text"), got("_struct_keywords", "pdbx_keywords")).alias("keywords"),
        got("_citation", "title").alias("citation_title"),
        got("_citation", "pdbx_database_id_DOI").alias("doi"),
        got("_citation", "pdbx_database_id_PubMed").alias("pubmed_id"),
        S.provenance(F.lit("_struct"), F.col("entry_id")).alias("provenance"),
    )


def keyword_list(keywords: Column) -> Column:
    """Keywords split at commas, trimmed, empties left out."""
    return F.filter(F.transform(F.split(keywords, ","), lambda k: F.trim(k)), lambda k: k != "")


def union_sources(*sources: DataFrame) -> DataFrame:
    """Sources one after another: rows get ``src_ord``, and their ``row_ord`` counts within a source."""
    out = None
    for k, s in enumerate(sources):
        s = s.withColumn("src_ord", F.lit(k + 1))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def taxonomies(raw: DataFrame) -> DataFrame:
    """Organisms of entities: genetically manipulated sources, then natural ones, then synthetic. Of several items for a value the first that
    says something counts."""

    def take(name: str, taxid: Sequence[str], scientific: Sequence[str], common: Sequence[str], host: Sequence[str] = (), system: Sequence[str] = ()) -> DataFrame:
        some = lambda names: S.first_value(*[item(n) for n in names]) if names else F.lit(None).cast("string")
        host_id, host_name, host_common = host or ((), (), ())
        return category(raw, name).select(
            "entry_id",
            "row_ord",
            S.clean(item("entity_id")).alias("entity_id"),
            S.as_int(some(taxid)).alias("ncbi_taxon_id"),
            some(scientific).alias("organism_scientific"),
            some(common).alias("organism_common"),
            S.as_int(some(host_id)).alias("host_ncbi_taxon_id"),
            some(host_name).alias("host_scientific"),
            some(host_common).alias("host_common"),
            some(system).alias("expression_system"),
            S.provenance(F.lit(name), item("entity_id")).alias("provenance"),
        )

    return union_sources(
        take("_entity_src_gen", ["pdbx_gene_src_ncbi_taxonomy_id"], ["pdbx_gene_src_scientific_name", "gene_src_scientific_name"], ["gene_src_common_name"], (["pdbx_host_org_ncbi_taxonomy_id"], ["pdbx_host_org_scientific_name"], ["host_org_common_name"]), ["expression_system_id", "plasmid_name"]),
        take("_entity_src_nat", ["pdbx_ncbi_taxonomy_id", "ncbi_taxonomy_id"], ["pdbx_organism_scientific", "organism_scientific"], ["common_name", "organism_common_name"]),
        take("_pdbx_entity_src_syn", ["ncbi_taxonomy_id"], ["organism_scientific"], ["organism_common_name"]),
    )


def first_taxonomy(t: DataFrame, keys: Sequence[str] = ("entry_id",)) -> DataFrame:
    return first_by(t, keys, ["src_ord", "row_ord"])


def joined_methods(t: DataFrame, key: str = "entry_id", order: str = "row_ord", method: str = "method") -> DataFrame:
    """(key, methods): cleaned values in order, joined with '; '; NULL where none is left."""
    m = t.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), S.clean(F.col(method)).alias("m")))).alias("l"))
    names = F.filter(F.transform("l", lambda x: x["m"]), lambda x: x.isNotNull())
    return m.select(key, F.when(F.size(names) > 0, F.array_join(names, "; ")).alias("methods"))


def quality(raw: DataFrame) -> DataFrame:
    """Methods, and figures of the first _refine and _reflns rows, of entries that have any of the three categories."""
    methods = joined_methods(category(raw, "_exptl", ["method"]))
    refine, reflns = first_rows(raw, "_refine").withColumnRenamed("cols", "r"), first_rows(raw, "_reflns").withColumnRenamed("cols", "n")
    t = methods.join(refine, "entry_id", "full").join(reflns, "entry_id", "full")
    num = lambda c, m: S.as_float(item(c, m))
    return t.select("entry_id", F.col("methods").alias("experimental_method"), num("ls_d_res_high", "r").alias("resolution"), num("ls_R_factor_R_work", "r").alias("r_work"), num("ls_R_factor_R_free", "r").alias("r_free"), S.as_int(item("number_obs", "n")).alias("observed_reflections"), num("percent_possible_obs", "n").alias("percent_possible_observed"), num("B_iso_mean", "r").alias("mean_b_factor"), S.provenance(F.lit("_exptl,_refine,_reflns"), F.lit(None).cast("string")).alias("provenance"))


def chains_of_entities(asym: DataFrame) -> DataFrame:
    """(entry_id, entity_id, chain_ids in order)."""
    g = asym.groupBy("entry_id", "entity_id").agg(F.array_sort(F.collect_list(F.struct("asym_ord", "id"))).alias("g"))
    return g.select("entry_id", "entity_id", F.transform("g", lambda x: x["id"]).alias("chain_ids"))


def entity_metadata(entities: DataFrame, asym: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Entities with their chains (none: an empty list) and, from raw _entity rows (the last of an id), EC number, mutation, fragment."""
    t = entities.join(chains_of_entities(asym).withColumnRenamed("entity_id", "id"), ["entry_id", "id"], "left").withColumn("chain_ids", F.coalesce("chain_ids", F.array().cast("array<string>")))
    if raw is None:
        return t
    last = category(raw, "_entity").withColumn("id", S.clean(item("id"))).groupBy("entry_id", "id").agg(F.max_by("cols", "row_ord").alias("_c"))
    t = t.join(last, ["entry_id", "id"], "left")
    return t.withColumns({"ec_number": S.clean(item("pdbx_ec", "_c")), "mutation": S.clean(item("pdbx_mutation", "_c")), "fragment": S.clean(item("pdbx_fragment", "_c"))}).drop("_c")


def ligands_from_atoms(atoms: DataFrame, waters: bool = False) -> DataFrame:
    """(entry_id, entity_id, comp_id, chain_ids) of HETATM rows."""
    t = atoms.filter("group_pdb = 'HETATM'")
    if not waters:
        t = t.filter(~F.upper("label_comp_id").isin(*WATERS))
    return t.groupBy("entry_id", F.col("label_entity_id").alias("entity_id"), F.col("label_comp_id").alias("comp_id")).agg(F.sort_array(F.collect_set("label_asym_id")).alias("chain_ids"))


def ligand_metadata(raw: DataFrame, asym: DataFrame, atoms: DataFrame, waters: bool = False) -> DataFrame:
    """Listed non-polymers with their name (else their component's), formula and chains, each (entity, component) once; entries that are left
    without one get what their atoms show."""
    t = category(raw, "_pdbx_entity_nonpoly", ["entity_id", "comp_id", "name"]).withColumns({"entity_id": S.clean(F.col("entity_id")), "comp_id": S.clean(F.col("comp_id"))}).filter("comp_id is not null")
    if not waters:
        t = t.filter(~F.upper("comp_id").isin(*WATERS))
    t = first_by(t, ["entry_id", "entity_id", "comp_id"], ["row_ord"])
    comp = category(raw, "_chem_comp").withColumn("comp_id", item("id")).groupBy("entry_id", "comp_id").agg(F.max_by("cols", "row_ord").alias("_c"))
    listed = t.join(comp, ["entry_id", "comp_id"], "left").join(chains_of_entities(asym), ["entry_id", "entity_id"], "left")
    listed = listed.select("entry_id", "entity_id", "comp_id", S.first_value(F.col("name"), item("name", "_c")).alias("name"), S.clean(item("formula", "_c")).alias("formula"), S.as_float(item("formula_weight", "_c")).alias("formula_weight"), F.coalesce("chain_ids", F.array().cast("array<string>")).alias("chain_ids"), S.provenance(F.lit("_pdbx_entity_nonpoly"), F.col("entity_id")).alias("provenance"))
    return with_fallback(listed, ligands_from_atoms(atoms, waters))


def with_fallback(listed: DataFrame, other: DataFrame) -> DataFrame:
    """``listed``, and rows of ``other`` for entries that it lacks."""
    return listed.unionByName(other.join(listed.select("entry_id").distinct(), "entry_id", "left_anti"), allowMissingColumns=True)


UNIPROT_KEY = ("entry_id", "entity_id", "asym_id", "accession", "seq_id_start", "seq_id_end", "uniprot_start", "uniprot_end")


def uniprot_mappings(raw: DataFrame) -> DataFrame:
    """Reference sequences (the row's accession, else its reference's), then SIFTS segments; rows without an accession go, and the first of
    those equal in entity, chain, accession and ranges stays."""
    ref = category(raw, "_struct_ref").withColumn("ref_id", item("id")).groupBy("entry_id", "ref_id").agg(F.max_by("cols", "row_ord").alias("_r"))
    seq = category(raw, "_struct_ref_seq").withColumn("ref_id", item("ref_id")).join(ref, ["entry_id", "ref_id"], "left")
    ends = lambda *names: [S.as_int(item(n)).alias(to) for n, to in zip(names, UNIPROT_KEY[4:], strict=True)]
    a = seq.select(
        "entry_id", "row_ord", S.clean(item("entity_id", "_r")).alias("entity_id"), S.clean(item("pdbx_strand_id")).alias("asym_id"),
        S.first_value(item("pdbx_db_accession"), item("pdbx_db_accession", "_r")).alias("accession"),
        S.clean(item("db_name", "_r")).alias("db_name"), S.clean(item("db_code", "_r")).alias("db_code"),
        *ends("seq_align_beg", "seq_align_end", "db_align_beg", "db_align_end"),
        F.lit(None).cast("double").alias("identity"), S.provenance(F.lit("_struct_ref_seq"), item("align_id")).alias("provenance"),
    )
    b = category(raw, "_pdbx_sifts_unp_segments").select(
        "entry_id", "row_ord", S.clean(item("entity_id")).alias("entity_id"), S.clean(item("asym_id")).alias("asym_id"), S.clean(item("unp_acc")).alias("accession"),
        F.lit("UNP").alias("db_name"), F.lit(None).cast("string").alias("db_code"),
        *ends("seq_id_start", "seq_id_end", "unp_start", "unp_end"),
        S.as_float(item("identity")).alias("identity"), S.provenance(F.lit("_pdbx_sifts_unp_segments"), item("segment_id")).alias("provenance"),
    )
    return first_by(union_sources(a, b).filter("accession is not null"), UNIPROT_KEY, ["src_ord", "row_ord"])


def categories(raw: DataFrame) -> DataFrame:
    return raw.groupBy("entry_id").agg(F.sort_array(F.collect_set("category")).alias("categories"))


def collect(entries: DataFrame, entities: DataFrame, asym: DataFrame, atoms: DataFrame, raw: DataFrame) -> dict[str, DataFrame]:
    """All metadata tables."""
    return {"entry": entry_metadata(entries, raw), "taxonomy": taxonomies(raw), "quality": quality(raw), "entity": entity_metadata(entities, asym, raw), "ligand": ligand_metadata(raw, asym, atoms), "uniprot": uniprot_mappings(raw), "categories": categories(raw)}


def attach(base: DataFrame, external: DataFrame, key: str = "entry_id", required: bool = False) -> tuple[DataFrame, DataFrame]:
    """``base`` with a user's table by key, and diagnostics for entries it lacks."""
    missing = base.select(key).distinct().join(external, key, "left_anti")
    code = "REQUIRED_SOURCE_MISSING" if required else "MISSING_METADATA"
    notes = missing.select(F.col(key).alias("entry_id"), F.lit("metadata").alias("stage"), F.lit(code).alias("code"), F.lit("error" if required else "warning").alias("severity"))
    return base.join(external, key, "left"), notes


def validate(md_entry: DataFrame, fields: Sequence[str]) -> DataFrame:
    """PARTIAL_METADATA for each entry and field without a value."""
    pairs = F.explode(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))
    return md_entry.select("entry_id", pairs.alias("field")).filter("field is not null").select("entry_id", F.lit("PARTIAL_METADATA").alias("code"), F.lit("warning").alias("severity"), "field")


def stale(retrieved: DataFrame, before: str, column: str = "retrieved_at") -> DataFrame:
    """STALE_METADATA for each entry whose newest row is older than ``before`` (a timestamp as text)."""
    t = retrieved.groupBy("entry_id").agg(F.max(column).alias("_t")).filter(F.col("_t") < F.lit(before).cast("timestamp"))
    return t.select("entry_id", F.lit("STALE_METADATA").alias("code"), F.lit("warning").alias("severity"))


def lineages(taxa: DataFrame, most_ranks: int = 64) -> DataFrame:
    """(taxon_id, parent_id, name), roots their own parents or without one -> (taxon_id, lineage): names from the root down to the taxon.

    Each round doubles the stretch of every line that is known, so rounds grow with the logarithm of the depth; state is in written tables.
    Lines of more than ``most_ranks`` taxa, such as circles, are an error. A parent that isn't there ends the line.
    """
    known = stored(taxa.groupBy("taxon_id").agg(F.min("parent_id").alias("up"), F.min("name").alias("name")), "taxa")
    up = F.when(F.col("up") != F.col("taxon_id"), F.col("up"))
    t = stored(known.select("taxon_id", up.alias("up"), F.array("name").alias("lineage")), "lines")
    size = 1
    while not t.filter("up is not null").isEmpty():
        if size > most_ranks:
            raise ValueError(f"a line of more than {most_ranks} taxa")
        above = t.toDF("up", "then", "before")
        t = stored(t.join(above, "up", "left").select("taxon_id", F.col("then").alias("up"), F.when(F.col("before").isNull(), F.col("lineage")).otherwise(F.concat("before", "lineage")).alias("lineage")), "lines")
        size *= 2
    return t.select("taxon_id", "lineage")


def merge_layers(*layers: DataFrame) -> DataFrame:
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out
