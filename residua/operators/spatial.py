"""Distance joins on a grid, and the annotations built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.functions import scalars as S
from residua.operators.metadata import WATERS

AXES = ("x", "y", "z")


def grid_join(left: DataFrame, right: DataFrame, cutoff: float, keys: Sequence[str] = ("entry_id",), condition: Column | None = None, prefixes: tuple[str, str] = ("a_", "b_")) -> DataFrame:
    """Pairs of points of equal ``keys`` with squared distance <= cutoff ** 2, as ``d2``; columns get the prefixes.

    Points fall into cells as wide as the cutoff; the left side is copied into its 27 neighbouring cells, so that each pair meets in
    one cell, and the join is an equi-join on (keys, cell) with the exact test after it. ``condition`` is over prefixed columns.
    """
    if cutoff <= 0:
        raise ValueError("the cutoff must be positive")
    cell = [F.floor(F.col(c) / F.lit(cutoff)).cast("bigint") for c in AXES]
    near = F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))
    a, b = prefixes
    lhs = left
    for i, c in enumerate(cell):
        lhs = lhs.withColumn(f"_d{i}", near).withColumn(f"_c{i}", c + F.col(f"_d{i}")).drop(f"_d{i}")
    rhs = right
    for i, c in enumerate(cell):
        rhs = rhs.withColumn(f"_c{i}", c)
    lhs, rhs = lhs.toDF(*[f"{a}{c}" for c in lhs.columns]), rhs.toDF(*[f"{b}{c}" for c in rhs.columns])
    on = F.lit(True)
    for k in [*keys, "_c0", "_c1", "_c2"]:
        on = on & (F.col(f"{a}{k}") == F.col(f"{b}{k}"))
    if condition is not None:
        on = on & condition
    d2 = S.squared_distance(tuple(F.col(f"{a}{c}") for c in AXES), tuple(F.col(f"{b}{c}") for c in AXES))
    t = lhs.join(rhs, on & (d2 <= F.lit(cutoff * cutoff))).withColumn("d2", d2)
    return t.drop(*[f"{p}_c{i}" for p in prefixes for i in range(3)])


def polymer_chains(asym: DataFrame, entities: DataFrame) -> DataFrame:
    """(entry_id, id) of chains whose entity is a polymer."""
    e = entities.filter("type = 'polymer'").select("entry_id", F.col("id").alias("entity_id"))
    return asym.join(e, ["entry_id", "entity_id"], "left_semi").select("entry_id", "id").distinct()


def in_chains(atoms: DataFrame, chains: DataFrame) -> DataFrame:
    return atoms.join(chains.select("entry_id", F.col("id").alias("label_asym_id")), ["entry_id", "label_asym_id"], "left_semi")


def is_ligand(waters: bool = False) -> Column:
    het = F.col("group_pdb") == "HETATM"
    return het if waters else het & ~F.upper("label_comp_id").isin(*WATERS)


def ligand_contacts(atoms: DataFrame, polymers: DataFrame, cutoff: float = 4.0, waters: bool = False) -> DataFrame:
    """(entry, ligand, residue, min_d2): residues of polymer chains within the cutoff of a ligand, with the least squared distance.

    A ligand is (chain, author number, component) of HETATM rows; NULL numbers compare equal.
    """
    cols = ["entry_id", "label_asym_id", "label_seq_id", "auth_seq_id", "label_comp_id", *AXES]
    t = grid_join(atoms.filter(is_ligand(waters)).select(*cols), in_chains(atoms, polymers).select(*cols), cutoff)
    return t.groupBy(F.col("a_entry_id").alias("entry_id"), F.col("a_label_asym_id").alias("ligand_asym_id"), F.col("a_auth_seq_id").alias("ligand_seq_id"), F.col("a_label_comp_id").alias("ligand_comp_id"), F.col("b_label_asym_id").alias("asym_id"), F.col("b_label_seq_id").alias("seq_id"), F.col("b_label_comp_id").alias("comp_id")).agg(F.min("d2").alias("min_d2"))


def contact_layers(atoms: DataFrame, polymers: DataFrame, cutoff: float = 4.0, waters: bool = False) -> DataFrame:
    """A row per ligand, also without contacts: its residues sorted by (chain, number, component), distances to three places."""
    key = ["entry_id", "ligand_asym_id", "ligand_seq_id", "ligand_comp_id"]
    each = ligand_contacts(atoms, polymers, cutoff, waters).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("asym_id", "seq_id", "comp_id", F.round(F.sqrt("min_d2"), 3).alias("distance")))).alias("contacts"))
    all_ = atoms.filter(is_ligand(waters)).select("entry_id", F.col("label_asym_id").alias("ligand_asym_id"), F.col("auth_seq_id").alias("ligand_seq_id"), F.col("label_comp_id").alias("ligand_comp_id")).distinct()
    r = each.toDF(*[f"_{c}" for c in each.columns])
    on = F.lit(True)
    for k in key:
        on = on & all_[k].eqNullSafe(r[f"_{k}"])
    return all_.join(r, on, "left").select(*key, F.coalesce("_contacts", F.array().cast("array<struct<asym_id:string,seq_id:int,comp_id:string,distance:double>>")).alias("contacts"))


def chain_interfaces(atoms: DataFrame, polymers: DataFrame | None, cutoff: float = 4.0, keys: Sequence[str] = ("entry_id",)) -> DataFrame:
    """(keys, chain_a, chain_b, residues_a, residues_b, contact_count) of chain pairs a < b that have atoms within the cutoff.

    Residues are chain:number strings, sorted; contact_count is how many there are on both sides.
    """
    t = atoms if polymers is None else in_chains(atoms, polymers)
    t = t.select(*keys, "label_asym_id", "label_seq_id", *AXES)
    p = grid_join(t, t, cutoff, keys, F.col("a_label_asym_id") < F.col("b_label_asym_id"))
    g = p.groupBy(*[F.col(f"a_{k}").alias(k) for k in keys], F.col("a_label_asym_id").alias("chain_a"), F.col("b_label_asym_id").alias("chain_b"))
    sides = [F.sort_array(F.collect_set(S.residue_id(F.col(f"{s}_label_asym_id"), F.col(f"{s}_label_seq_id")))) for s in "ab"]
    t = g.agg(sides[0].alias("residues_a"), sides[1].alias("residues_b"))
    return t.withColumn("contact_count", (F.size("residues_a") + F.size("residues_b")).cast("bigint"))


def residues_near(residues: DataFrame, targets: DataFrame, radius: float, keys: Sequence[str] = ("entry_id",)) -> DataFrame:
    """Pairs of residues with CA atoms within ``radius``: (entry_id, label_asym_id, label_seq_id) of target and neighbour."""
    ca = lambda t: t.filter("label_atom_id = 'CA'").select(*keys, "label_asym_id", "label_seq_id", *AXES)
    return grid_join(ca(targets), ca(residues), radius, keys)


def structure_counts(atoms: DataFrame, asym: DataFrame, entities: DataFrame, assemblies: DataFrame | None = None, connections: DataFrame | None = None, conf_records: DataFrame | None = None, sheet_strands: DataFrame | None = None) -> DataFrame:
    """Atoms, chains, entities, distinct residues, atoms with an alternate label, by entry; of the optional tables, those that are given."""
    a = atoms.groupBy("entry_id").agg(F.count(F.lit(1)).alias("atom_count"), F.count_distinct(F.struct("label_asym_id", "label_seq_id", "auth_seq_id", "label_comp_id")).alias("residue_count"), F.count_if(F.coalesce(F.col("label_alt_id") != "", F.lit(False))).alias("altloc_atom_count"), F.count_if(F.col("group_pdb") == "ATOM").alias("atom_rows"), F.count_if(F.col("group_pdb") == "HETATM").alias("hetatm_rows"))
    for t, name in ((asym, "chain_count"), (entities, "entity_count"), (assemblies, "assembly_count"), (connections, "connection_count"), (conf_records, "conf_record_count"), (sheet_strands, "sheet_strand_count")):
        if t is not None:
            a = a.join(t.groupBy("entry_id").agg(F.count(F.lit(1)).alias(name)), "entry_id", "full")
    return a.fillna(0)


def counts_by(df: DataFrame, column: str) -> DataFrame:
    """(entry_id, value, n)."""
    return df.groupBy("entry_id", F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def pairwise_identity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every sequence of ``left`` (id, ord, sequence) against every one of ``right``: identity, aligned, coverage.

    It is a product by definition; both sides are the few entities of two structures.
    """
    pre = lambda t, p: t.select(F.col("id").alias(f"{p}_id"), F.col("ord").alias(f"{p}_ord"), F.col("sequence").alias(f"{p}_seq"))
    t = pre(left, "left").crossJoin(pre(right, "right"))
    return t.withColumn("m", S.ungapped(F.col("left_seq"), F.col("right_seq"))).select("left_id", "right_id", "left_ord", "right_ord", "m.*")


def best_identity(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The pair of greatest identity, the first of equals."""
    order = F.struct(F.coalesce("identity", F.lit(0.0)), -F.col("left_ord"), -F.col("right_ord"))
    best = F.max_by(F.struct("left_id", "right_id", "identity", "aligned", "coverage"), order).alias("b")
    return (pairs.groupBy(*keys).agg(best) if keys else pairs.agg(best)).select(*keys, "b.*").filter("left_id is not null")
