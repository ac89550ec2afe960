"""Curation: entry filters with reasons, deduplication, counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One exclusion: rows for which ``when`` holds (NULL doesn't) go with this code."""

    code: str
    when: Column
    message: str = ""
    name: str = field(default="")


def resolution(most: float, null_behavior: str = "exclude", column: str = "resolution") -> list[Rule]:
    c = F.col(column)
    rules = [Rule("RESOLUTION_THRESHOLD", c > F.lit(most), f"resolution over {most}", "resolution")]
    if null_behavior == "exclude":
        rules.append(Rule("NULL_RESOLUTION", c.isNull(), "no resolution", "resolution"))
    elif null_behavior not in ("include", "keep"):
        raise ValueError(f"unknown null_resolution_behavior: {null_behavior}")
    return rules


def method(include: Sequence[str] = (), exclude: Sequence[str] = (), column: str = "method") -> list[Rule]:
    """Methods compare in upper case; exclusion wins."""
    m = F.upper(F.col(column))
    rules = []
    if exclude:
        rules.append(Rule("METHOD_EXCLUDED", m.isin(*[x.upper() for x in exclude]), "method is excluded", "method"))
    if include:
        rules.append(Rule("METHOD_NOT_INCLUDED", m.isNull() | ~m.isin(*[x.upper() for x in include]), "method isn't included", "method"))
    return rules


def organism(include: Sequence[str] = (), exclude: Sequence[str] = (), lineage: str = "lineage") -> list[Rule]:
    """By any taxon on the lineage; without a lineage, an entry goes as soon as a list is given."""
    c = F.col(lineage)
    names = lambda xs: F.array(*[F.lit(x) for x in xs])
    rules = []
    if include or exclude:
        rules.append(Rule("MISSING_TAXONOMY", c.isNull() | (F.size(c) == 0), "no taxonomy", "organism"))
    if exclude:
        rules.append(Rule("ORGANISM_EXCLUDED", F.arrays_overlap(c, names(exclude)), "organism is excluded", "organism"))
    if include:
        rules.append(Rule("ORGANISM_NOT_INCLUDED", ~F.arrays_overlap(c, names(include)), "organism isn't included", "organism"))
    return rules


def source(include: Sequence[str] = (), exclude: Sequence[str] = (), column: str = "source") -> list[Rule]:
    c = F.col(column)
    rules = [Rule("SOURCE_EXCLUDED", c.isin(*exclude), "source is excluded", "source")] if exclude else []
    return rules + ([Rule("SOURCE_NOT_INCLUDED", c.isNull() | ~c.isin(*include), "source isn't included", "source")] if include else [])


def chain_length(least: int, column: str = "longest_chain") -> list[Rule]:
    """All polymer chains shorter than ``least``: their longest is."""
    return [Rule("CHAIN_TOO_SHORT", F.col(column) < least, f"all chains under {least}", "chain_length")]


def longest_chains(chains: DataFrame) -> DataFrame:
    return chains.groupBy("entry_id").agg(F.max("residue_count").alias("longest_chain"))


def incomplete_entries(diagnostics: DataFrame) -> DataFrame:
    """Entries with findings that make them incomplete."""
    return diagnostics.filter(F.col("code").isin("INCOMPLETE_CHAIN", "SEQUENCE_GAP", "MISSING_ATOMS")).select("entry_id").distinct()


def biomolecules(entities: DataFrame) -> DataFrame:
    """(entry_id, has_protein, has_dna, has_rna) from polymer types."""
    t = F.lower(F.coalesce(F.col("poly.type"), F.lit(""))) if "poly" in entities.columns else F.lower(F.col("poly_type"))
    return entities.groupBy("entry_id").agg(F.bool_or(t.contains("polypeptide")).alias("has_protein"), F.bool_or(t.contains("polydeoxyribonucleotide")).alias("has_dna"), F.bool_or(t.contains("polyribonucleotide")).alias("has_rna"))


def biomolecule(kinds: Sequence[str]) -> list[Rule]:
    ok = F.lit(False)
    for k in kinds:
        ok = ok | {"proteins": F.col("has_protein"), "dna": F.col("has_dna"), "rna": F.col("has_rna"), "complexes": F.col("has_protein") & (F.col("has_dna") | F.col("has_rna"))}[k]
    return [Rule("BIOMOLECULE_TYPE", ~ok, "biomolecule type isn't selected", "biomolecule")]


def apply_rules(df: DataFrame, rules: Sequence[Rule], unit: str = "entry_id", granularity: str = "structure") -> tuple[DataFrame, DataFrame]:
    """(kept, exclusions): a row goes by the first rule that holds. One pass; both results share its expression."""
    hit = F.coalesce(*[F.when(F.coalesce(r.when, F.lit(False)), F.struct(F.lit(r.code).alias("code"), F.lit(r.message).alias("message"), F.lit(r.name or r.code).alias("rule"))) for r in rules]) if rules else F.lit(None).cast("struct<code:string,message:string,rule:string>")
    t = df.withColumn("_x", hit)
    gone = t.filter("_x is not null").select(F.col(unit).cast("string").alias("unit_id"), F.lit(granularity).alias("granularity"), F.col("_x.code").alias("reason_code"), F.col("_x.message").alias("reason_message"), F.col("_x.rule").alias("applied_rule"))
    return t.filter("_x is null").drop("_x"), gone


def deduplicate(df: DataFrame, strategy: str = "entry_id", order: Sequence[str] = (), columns: Sequence[str] | None = None, unit: str = "entry_id") -> tuple[DataFrame, DataFrame]:
    """(kept, exclusions): the first row of each id, or of each hash over ``columns`` (default: all but the unit and the order)."""
    if strategy == "entry_id":
        key = F.col(unit)
    elif strategy == "exact_hash":
        names = columns or [c for c in df.columns if c != unit and c not in order]
        key = F.sha2(F.to_json(F.struct(*[F.col(c) for c in names]), {"ignoreNullFields": "false"}), 256)
    else:
        raise ValueError(f"unknown deduplication strategy: {strategy}")
    w = Window.partitionBy("_k").orderBy(*(order or [unit]))
    t = df.withColumn("_k", key).withColumn("_n", F.row_number().over(w))
    gone = t.filter("_n > 1").select(F.col(unit).cast("string").alias("unit_id"), F.lit("structure").alias("granularity"), F.lit("DUPLICATE").alias("reason_code"), F.lit("duplicate of an earlier row").alias("reason_message"), F.lit(strategy).alias("applied_rule"))
    return t.filter("_n = 1").drop("_k", "_n"), gone


def summarize(exclusions: DataFrame) -> DataFrame:
    return exclusions.groupBy("applied_rule", "reason_code").agg(F.count(F.lit(1)).alias("structures_excluded"))


def counts(n_input: int, kept: DataFrame, exclusions: DataFrame) -> DataFrame:
    """One row: input, selected, excluded, duplicates."""
    x = exclusions.agg(F.count_if(F.col("reason_code") != "DUPLICATE").alias("excluded"), F.count_if(F.col("reason_code") == "DUPLICATE").alias("duplicates"))
    return kept.agg(F.count(F.lit(1)).alias("selected")).join(x, how="cross").withColumn("input", F.lit(n_input).cast("bigint")).select("input", "selected", "excluded", "duplicates")


def validate(c: DataFrame) -> DataFrame:
    """(code, severity) over the counts row: an empty dataset is an error; over half excluded or 30 % duplicates are warnings."""
    codes = F.array(F.when(F.col("selected") == 0, F.struct(F.lit("EMPTY_DATASET").alias("code"), F.lit("error").alias("severity"))), F.when(F.col("excluded") > 0.5 * F.col("input"), F.struct(F.lit("HIGH_EXCLUSION_RATE").alias("code"), F.lit("warning").alias("severity"))), F.when(F.col("duplicates") > 0.3 * F.col("input"), F.struct(F.lit("HIGH_DUPLICATION_RATE").alias("code"), F.lit("warning").alias("severity"))))
    return c.select(F.explode(F.filter(codes, lambda x: x.isNotNull())).alias("x")).select("x.*")
