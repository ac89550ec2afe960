"""Registered queries of dataset plans, network and metadata operators that work on tables of any kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.fixtures import ctes, frame
from residua.functions import scalars as S
from residua.operators import checks, curate, metadata, records, similarity, spatial
from residua.plans import datasets
from residua.queries import _raw, query
from residua.sources import fetch

#: Chains of parts: each part is linked with the next one, with a score from its size.
EDGES = "e AS (SELECT CAST(p_partkey AS BIGINT) AS source_id, CAST(p_partkey + 1 AS BIGINT) AS target_id, p_size / 50.0::DOUBLE AS score, (p_partkey % 10) / 10.0::DOUBLE AS coverage, CASE WHEN p_partkey % 2 = 0 THEN 'sequence' ELSE 'structure' END AS similarity_type FROM part WHERE p_partkey < (SELECT max(p_partkey) FROM part))"
#: Runs of parts that links of at least half hold together, and their members.
CHAINS = "WITH " + EDGES + ", b AS (SELECT CAST(p_partkey AS BIGINT) AS item_id, CASE WHEN e.score >= 0.5 THEN 0 ELSE 1 END AS starts FROM part LEFT JOIN e ON e.target_id = p_partkey), r AS (SELECT item_id, CAST(sum(starts) OVER (ORDER BY item_id) AS INT) AS cluster_ord FROM b)"
SPLITS = "s AS (SELECT CAST(p_partkey AS BIGINT) AS item_id, CAST(p_partkey // 3 AS BIGINT) AS cluster_ord, CASE WHEN p_partkey % 10 < 6 THEN 'train' WHEN p_partkey % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM part)"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("item_id"), F.col("p_partkey").cast("bigint").alias("item_ord"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    p = frame(spark, d, "part")
    kind = F.when(F.col("p_partkey") % 2 == 0, "sequence").otherwise("structure")
    t = p.select(F.col("p_partkey").cast("bigint").alias("source_id"), (F.col("p_partkey") + 1).cast("bigint").alias("target_id"), (F.col("p_size") / F.lit(50.0)).alias("score"), (F.col("p_partkey") % 10 / F.lit(10.0)).alias("coverage"), kind.alias("similarity_type"))
    return t.join(_parts(spark, d).select(F.col("item_id").alias("target_id")), "target_id", "left_semi")


def _splits(spark: SparkSession, d: str) -> DataFrame:
    tenth = F.col("item_id") % 10
    return _parts(spark, d).select("item_id", F.floor(F.col("item_id") / 3).alias("cluster_ord"), F.when(tenth < 6, "train").when(tenth < 8, "val").otherwise("test").alias("split"))


@query(CHAINS + " SELECT cluster_ord, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS components, count(*) AS n_components FROM r GROUP BY 1")
def cluster_threshold(spark: SparkSession, d: str) -> DataFrame:
    c = similarity.clusters(_parts(spark, d), _edges(spark, d), 0.5)
    return c.select("cluster_ord", F.array_join(F.transform("components", lambda x: x.cast("string")), ",").alias("components"), "n_components")


@query(CHAINS + ", c AS (SELECT cluster_ord, count(*) AS n FROM r GROUP BY 1), k AS (SELECT CASE WHEN n < 3 THEN 2147483647 ELSE cluster_ord END AS k, sum(n) AS n FROM c GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY k) AS INT) AS cluster_ord, CAST(n AS BIGINT) AS n_components FROM k")
def merge_small_clusters(spark: SparkSession, d: str) -> DataFrame:
    return similarity.merge_small(similarity.clusters(_parts(spark, d), _edges(spark, d), 0.5), 3).select("cluster_ord", "n_components")


@query("SELECT CAST(row_number() OVER (ORDER BY p_partkey) AS INT) AS cluster_ord, CAST(p_partkey AS VARCHAR) AS components, CAST(1 AS BIGINT) AS n_components FROM part")
def clusters_disabled(spark: SparkSession, d: str) -> DataFrame:
    c = similarity.clusters(_parts(spark, d), _edges(spark, d), 0.5, enabled=False)
    return c.select("cluster_ord", F.array_join(F.transform("components", lambda x: x.cast("string")), ",").alias("components"), "n_components")


@query(CHAINS + """, both_ AS (SELECT source_id AS item_id, target_id AS other, score FROM e UNION ALL SELECT target_id, source_id, score FROM e),
m AS (SELECT r.cluster_ord, r.item_id, avg(CAST(b.score AS DECIMAL(18,9))) AS mean FROM both_ b JOIN r ON r.item_id = b.item_id JOIN r o ON o.item_id = b.other AND o.cluster_ord = r.cluster_ord GROUP BY 1, 2),
w AS (SELECT cluster_ord, item_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_ord ORDER BY round(mean, 12) DESC, item_id) AS n FROM m) WHERE n = 1)
SELECT c.cluster_ord, w.item_id AS representative_id FROM (SELECT DISTINCT cluster_ord FROM r) c LEFT JOIN w ON w.cluster_ord = c.cluster_ord""")
def cluster_representatives(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    members = similarity.members_of(similarity.clusters(_parts(spark, d), e, 0.5))
    return similarity.representatives(members, e)


@query("WITH " + EDGES + " SELECT source_id, target_id, similarity_type FROM e WHERE coverage >= 0.3 AND (similarity_type <> 'sequence' OR score >= 0.4)")
def similarity_network(spark: SparkSession, d: str) -> DataFrame:
    return similarity.network(_edges(spark, d), {"sequence": 0.4, "structure": None}, 0.3).select("source_id", "target_id", "similarity_type")


@query("WITH " + EDGES + " SELECT source_id, target_id, similarity_type, score FROM e UNION ALL SELECT source_id, target_id, 'fold', 0.5::DOUBLE FROM e WHERE coverage > 0.5")
def merged_relationships(spark: SparkSession, d: str) -> DataFrame:
    """A user's structure scores, with pairs the other way round, beside the engine's."""
    e = _edges(spark, d)
    own = e.filter("coverage > 0.5").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit("fold").alias("similarity_type"), F.lit(0.5).alias("score"))
    return similarity.merge_relationships(e.drop("coverage"), own).select("source_id", "target_id", "similarity_type", "score")


_LEAK = "WITH " + EDGES + ", " + SPLITS + """, x AS (SELECT score FROM e JOIN s a ON a.item_id = source_id JOIN s b ON b.item_id = target_id WHERE a.split <> b.split), z AS (SELECT cluster_ord, count(*) AS k, count(DISTINCT split) AS q FROM s GROUP BY 1),
f AS (SELECT 'FORBIDDEN_CROSS_SPLIT_SIMILARITY' AS code, 'error' AS severity, count(*) AS n FROM x UNION ALL SELECT 'CLUSTER_ISOLATION_VIOLATED', 'error', count(*) FROM z WHERE q > 1 UNION ALL SELECT 'CROSS_SPLIT_SIMILARITY_ABOVE_THRESHOLD', 'warning', count(*) FROM x WHERE score >= 0.5
 UNION ALL SELECT 'UNBALANCED_PARTITION', 'warning', count(*) FROM (SELECT abs(count(*) / (SELECT count(*) FROM s)::DOUBLE - CASE split WHEN 'train' THEN 0.3 WHEN 'val' THEN 0.5 ELSE 0.2 END) AS off FROM s GROUP BY split) WHERE off > 0.05
 UNION ALL SELECT 'LARGE_CLUSTER', 'warning', count(*) FROM (SELECT max(k) AS m, sum(k) AS t FROM z) WHERE m > 0.1 * t UNION ALL SELECT 'SINGLETON_DOMINATED', 'warning', count(*) FROM (SELECT count(*) FILTER (k = 1) AS a, count(*) AS t FROM z) WHERE a > 0.8 * t)
SELECT code, severity, n FROM f WHERE n > 0"""


@query(_LEAK)
def leakage_findings(spark: SparkSession, d: str) -> DataFrame:
    return similarity.leakage(_edges(spark, d), _splits(spark, d), (0.3, 0.5, 0.2), 0.5)


@query(CHAINS + ", i AS (SELECT *, row_number() OVER (PARTITION BY cluster_ord ORDER BY item_id) - 1 AS i, count(*) OVER (PARTITION BY cluster_ord) AS n FROM r) SELECT item_id, CASE WHEN i < round_even(n * 0.6::DOUBLE, 0) THEN 'train' WHEN i < round_even(n * 0.6::DOUBLE, 0) + round_even(n * 0.2::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM i")
def leakage_safe_splits(spark: SparkSession, d: str) -> DataFrame:
    """The whole plan over strong links, clusters cut at the shares."""
    return datasets.build_leakage_safe(_parts(spark, d), _edges(spark, d), 0.5, keep_similar=False).splits.select("item_id", "split")


_Q = ctes("fx_quality") + ", q AS (SELECT entry_id, row_ord, method, CAST(resolution AS DOUBLE) AS resolution FROM fx_quality), k AS (SELECT * FROM q WHERE resolution <= 100000), c AS (SELECT (SELECT count(*) FROM q) AS n_in, (SELECT count(DISTINCT entry_id) FROM k) AS selected, (SELECT count(*) FROM q) - (SELECT count(*) FROM k) AS excluded, (SELECT count(*) - count(DISTINCT entry_id) FROM k) AS duplicates)"


def _dataset(spark: SparkSession, d: str) -> datasets.Dataset:
    t = frame(spark, d, "fx_quality").withColumn("resolution", F.col("resolution").cast("double"))
    return datasets.build_dataset(t, curate.resolution(100000), "entry_id", ["row_ord"])


@query(_Q + ' SELECT n_in AS "input", selected, excluded, duplicates FROM c')
def dataset_counts(spark: SparkSession, d: str) -> DataFrame:
    return _dataset(spark, d).counts


@query(_Q + " SELECT * FROM (SELECT CASE WHEN selected = 0 THEN 'EMPTY_DATASET' END AS code, 'error' AS severity FROM c UNION ALL SELECT CASE WHEN excluded > 0.5 * n_in THEN 'HIGH_EXCLUSION_RATE' END, 'warning' FROM c UNION ALL SELECT CASE WHEN duplicates > 0.3 * n_in THEN 'HIGH_DUPLICATION_RATE' END, 'warning' FROM c) WHERE code IS NOT NULL")
def dataset_findings(spark: SparkSession, d: str) -> DataFrame:
    return _dataset(spark, d).findings


@query("SELECT CAST(l_orderkey AS BIGINT) AS entry_id FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1 HAVING max(n) >= 3")
def chain_length_filter(spark: SparkSession, d: str) -> DataFrame:
    chains = frame(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("bigint").alias("entry_id"), "l_returnflag").agg(F.count(F.lit(1)).alias("residue_count"))
    return curate.apply_rules(curate.longest_chains(chains), curate.chain_length(3))[0].select("entry_id")


_CODES = {"1-URGENT": "INCOMPLETE_CHAIN", "2-HIGH": "SEQUENCE_GAP", "3-MEDIUM": "MISSING_ATOMS"}


@query("SELECT DISTINCT CAST(o_custkey AS BIGINT) AS entry_id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def incomplete_filter(spark: SparkSession, d: str) -> DataFrame:
    code = F.coalesce(*[F.when(F.col("o_orderpriority") == k, v) for k, v in _CODES.items()], F.lit("ALTLOC"))
    return curate.incomplete_entries(frame(spark, d, "orders").select(F.col("o_custkey").cast("bigint").alias("entry_id"), code.alias("code")))


_KIND = "CASE p_partkey % 4 WHEN 0 THEN 'polypeptide(L)' WHEN 1 THEN 'polydeoxyribonucleotide' WHEN 2 THEN 'polyribonucleotide' END"


@query(f"SELECT CAST(p_partkey // 2 AS BIGINT) AS entry_id, bool_or(k = 'polypeptide(L)') AS has_protein, bool_or(k = 'polydeoxyribonucleotide') AS has_dna, bool_or(k = 'polyribonucleotide') AS has_rna FROM (SELECT *, coalesce({_KIND}, '') AS k FROM part) GROUP BY 1 HAVING bool_or(k = 'polypeptide(L)') AND (bool_or(k = 'polydeoxyribonucleotide') OR bool_or(k = 'polyribonucleotide'))")
def biomolecule_filter(spark: SparkSession, d: str) -> DataFrame:
    e = frame(spark, d, "part").selectExpr("CAST(p_partkey DIV 2 AS BIGINT) AS entry_id", f"{_KIND} AS poly_type")
    return curate.apply_rules(curate.biomolecules(e), curate.biomolecule(["complexes"]))[0]


@query("SELECT CAST(c_custkey AS VARCHAR) AS unit_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'SOURCE_EXCLUDED' ELSE 'SOURCE_NOT_INCLUDED' END AS reason_code FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def source_filter(spark: SparkSession, d: str) -> DataFrame:
    rules = curate.source(["BUILDING", "MACHINERY"], ["BUILDING"], "c_mktsegment")
    return curate.apply_rules(frame(spark, d, "customer"), rules, "c_custkey")[1].select("unit_id", "reason_code")


_RES = "SELECT CAST(l_suppkey AS VARCHAR) AS entry_id, l_returnflag AS chain, CAST(l_linenumber AS INT) AS seq, CASE l_linenumber % 4 WHEN 0 THEN 'ala' WHEN 1 THEN 'DG' WHEN 2 THEN 'XYZ' ELSE 'GLY' END AS comp, CASE l_partkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'CA' WHEN 2 THEN 'C' ELSE 'O' END AS atom FROM lineitem"


@query(f"SELECT entry_id, chain AS chain_id, seq AS seq_id, comp AS comp_id FROM ({_RES}) WHERE upper(comp) IN ('ALA', 'GLY') GROUP BY ALL HAVING count(DISTINCT atom) = 4")
def residue_filter(spark: SparkSession, d: str) -> DataFrame:
    t = frame(spark, d, "lineitem").selectExpr("CAST(l_suppkey AS STRING) AS entry_id", "l_returnflag AS chain_id", "CAST(l_linenumber AS INT) AS seq_id", "CASE l_linenumber % 4 WHEN 0 THEN 'ala' WHEN 1 THEN 'DG' WHEN 2 THEN 'XYZ' ELSE 'GLY' END AS comp_id", "CASE l_partkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'CA' WHEN 2 THEN 'C' ELSE 'O' END AS label_atom_id")
    r = t.groupBy("entry_id", "chain_id", "seq_id", "comp_id").agg(F.collect_set(F.struct("label_atom_id")).alias("atoms"))
    return records.filter_residues(r, ["amino_acid"], full_backbone=True).drop("atoms")


@query(ctes("fx_atoms") + ", ca AS (SELECT DISTINCT entry_id, label_asym_id, label_seq_id, x, y, z FROM fx_atoms WHERE label_atom_id = 'CA') SELECT a.entry_id, a.label_asym_id AS chain_a, a.label_seq_id AS seq_a, b.label_asym_id AS chain_b, b.label_seq_id AS seq_b FROM ca a JOIN ca b ON a.entry_id = b.entry_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 36 WHERE a.label_asym_id = 'A'")
def context_residues(spark: SparkSession, d: str) -> DataFrame:
    ca = frame(spark, d, "fx_atoms").select("entry_id", "label_asym_id", "label_seq_id", "label_atom_id", "x", "y", "z").distinct()
    t = spatial.residues_near(ca, ca.filter("label_asym_id = 'A'"), 6.0)
    return t.select(F.col("a_entry_id").alias("entry_id"), F.col("a_label_asym_id").alias("chain_a"), F.col("a_label_seq_id").alias("seq_a"), F.col("b_label_asym_id").alias("chain_b"), F.col("b_label_seq_id").alias("seq_b"))


@query("SELECT n_nationkey AS entry_id, n_name AS chain_id, (SELECT string_agg(s_name, ',' ORDER BY s_name) FROM supplier WHERE s_nationkey = n_nationkey) AS taxonomy, CASE WHEN n_regionkey < 2 THEN CAST(n_regionkey AS VARCHAR) END AS uniprot FROM nation")
def annotated_chains(spark: SparkSession, d: str) -> DataFrame:
    n = frame(spark, d, "nation").select(F.col("n_nationkey").alias("entry_id"), F.col("n_name").alias("chain_id"), "n_regionkey")
    tax = frame(spark, d, "supplier").select(F.col("s_nationkey").alias("entry_id"), "s_name")
    uni = n.filter("n_regionkey < 2").select("entry_id", "chain_id", F.col("n_regionkey").cast("string").alias("r"))
    t = records.with_annotations(n.select("entry_id", "chain_id"), taxonomy=tax, uniprot=uni)
    return t.select("entry_id", "chain_id", F.array_join("taxonomy.s_name", ",").alias("taxonomy"), F.array_join("uniprot.r", ",").alias("uniprot"))


@query("SELECT string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS providers, min(o_orderdate) AS first_retrieved, max(o_orderdate) AS last_retrieved, count(*) AS entries, count(*) FILTER (o_orderstatus = 'F') AS from_cache FROM orders")
def dataset_provenance(spark: SparkSession, d: str) -> DataFrame:
    o = frame(spark, d, "orders").select(F.col("o_orderpriority").alias("provider"), F.col("o_orderdate").alias("retrieved_at"), (F.col("o_orderstatus") == "F").alias("from_cache"))
    return datasets.provenance(o).withColumn("providers", F.array_join("providers", ","))


@query("SELECT entry_id, max(s) AS worst FROM (SELECT o_custkey AS entry_id, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END AS s FROM orders UNION ALL SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END FROM customer) GROUP BY 1")
def merged_status(spark: SparkSession, d: str) -> DataFrame:
    a = frame(spark, d, "orders").select(F.col("o_custkey").alias("entry_id"), F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "warning").otherwise("success").alias("status"))
    b = frame(spark, d, "customer").select(F.col("c_custkey").alias("entry_id"), F.when(F.col("c_acctbal") < 0, "warning").otherwise("valid").alias("status"))
    return checks.worst(a, b).select("entry_id", F.when(F.col("status") == "failed", 2).when(F.col("status") == "warning", 1).otherwise(0).alias("worst"))


@query("SELECT CAST(c_custkey AS BIGINT) AS entry_id, 'PARTIAL_METADATA' AS code, field FROM customer, (VALUES ('title'), ('method')) AS f(field) WHERE (field = 'title' AND c_custkey % 3 = 0) OR (field = 'method' AND c_mktsegment = 'BUILDING') UNION ALL SELECT c_custkey, 'REQUIRED_SOURCE_MISSING', NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, 'STALE_METADATA', NULL FROM orders GROUP BY 1 HAVING max(o_orderdate) < TIMESTAMP '1998-01-01'")
def metadata_checks(spark: SparkSession, d: str) -> DataFrame:
    """Missing fields, entries that a required table lacks, and entries whose newest rows are old."""
    c = frame(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("entry_id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("title"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("method"))
    o = frame(spark, d, "orders").select(F.col("o_custkey").cast("bigint").alias("entry_id"), F.col("o_orderdate").alias("retrieved_at"))
    gone = metadata.attach(c, o, required=True)[1]
    old = metadata.stale(o, "1998-01-01")
    return metadata.merge_layers(*[t.select("entry_id", "code", *(["field"] if "field" in t.columns else [])) for t in (metadata.validate(c, ["title", "method"]), gone, old)])


@query("SELECT CAST(n_nationkey + 100 AS BIGINT) AS taxon_id, 'root > ' || r_name || ' > ' || n_name AS lineage FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_regionkey + 10, 'root > ' || r_name FROM region UNION ALL SELECT 1, 'root'")
def taxonomy_lineage(spark: SparkSession, d: str) -> DataFrame:
    """A user's taxonomy as (taxon, parent, name), its lines of descent from the root on."""
    n = frame(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("bigint").alias("taxon_id"), (F.col("n_regionkey") + 10).cast("bigint").alias("parent_id"), F.col("n_name").alias("name"))
    r = frame(spark, d, "region").select((F.col("r_regionkey") + 10).cast("bigint").alias("taxon_id"), F.lit(1).cast("bigint").alias("parent_id"), F.col("r_name").alias("name"))
    root = spark.range(1, 2).select(F.col("id").alias("taxon_id"), F.col("id").alias("parent_id"), F.lit("root").alias("name"))
    return metadata.lineages(n.unionByName(r).unionByName(root)).select("taxon_id", F.array_join("lineage", " > ").alias("lineage"))


@query("SELECT o_orderpriority AS bucket, least(count(*), 40) AS n FROM (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderpriority FROM orders ORDER BY o_custkey, o_orderpriority) GROUP BY 1")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """How many entries a sample of 40 a bucket has, each entry in its first bucket only."""
    o = frame(spark, d, "orders").select(F.col("o_orderpriority").alias("bucket"), F.col("o_orderpriority").alias("bucket_ord"), F.col("o_custkey").alias("entry_id")).distinct()
    picked = fetch.stratified(o, o.select("bucket").distinct().withColumn("count", F.lit(40)), 7)
    return picked.groupBy("bucket").agg(F.count_distinct("entry_id").alias("n"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size + 0.5::DOUBLE END AS number, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS first, 'https://files.rcsb.org/download/' || upper(p_type) || '.cif' AS url, p_brand || '_' || p_type AS item_id, '_part' AS category FROM part")
def scalar_values(spark: SparkSession, d: str) -> DataFrame:
    p = frame(spark, d, "part")
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit("d"))).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5 ")))
    return p.select(F.col("p_partkey").alias("id"), S.as_float(text).alias("number"), S.first_value(F.when(F.col("p_size") % 2 == 0, F.lit(" ? ")).otherwise(F.col("p_name")), F.col("p_type")).alias("first"), S.source_url(F.lower("p_type"), "pdb").alias("url"), S.item_id(F.col("p_brand"), F.col("p_type")).alias("item_id"), S.provenance(S.category_name(F.lit("part")), F.col("p_brand"))["category"].alias("category"))


@query("WITH " + SPLITS + " SELECT 'p' AS policy_id, '1' AS policy_version, 0.5::DOUBLE AS threshold, '0.3,0.5,0.2' AS fractions, CAST(7 AS BIGINT) AS seed, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test, count(DISTINCT cluster_ord) AS n_clusters, "
    "sha256('[[' || string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) FILTER (split = 'train') || '],[' || string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) FILTER (split = 'val') || '],[' || string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) FILTER (split = 'test') || ']]') AS checksum FROM s")  # fmt: skip
def split_provenance(spark: SparkSession, d: str) -> DataFrame:
    t = datasets.split_provenance(_splits(spark, d), (0.3, 0.5, 0.2), 0.5, "p", "1", 7)
    return t.withColumn("fractions", F.array_join(F.transform("fractions", lambda x: x.cast("string")), ","))


_TYPE = "CASE WHEN {k} % 4 = 0 THEN 'polypeptide(L)' WHEN {k} % 4 = 1 THEN 'polydeoxyribonucleotide' WHEN {k} % 4 = 2 THEN 'polyribonucleotide' END"


@query("WITH i AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS entry_id, CAST(l_suppkey AS BIGINT) AS a, CAST(l_linenumber AS BIGINT) AS b, l_partkey % 7 AS contact_count FROM lineitem), t AS (SELECT entry_id, a, b, " + ", ".join(f"CASE {k} % 4 WHEN 0 THEN 'protein' WHEN 1 THEN 'dna' WHEN 2 THEN 'rna' ELSE 'ligand' END AS k{k}" for k in "ab") + " FROM i WHERE contact_count >= 3), y AS (SELECT entry_id, CAST(a AS VARCHAR) AS chain_a, CAST(b AS VARCHAR) AS chain_b, CASE WHEN ka = 'protein' THEN 'protein_' || kb WHEN kb = 'protein' THEN 'protein_' || ka ELSE 'other' END AS interface_type FROM t) SELECT * FROM y WHERE interface_type IN ('protein_dna', 'protein_protein', 'protein_ligand')")
def interface_filter(spark: SparkSession, d: str) -> DataFrame:
    """Interfaces of the wanted types with enough contacts; some chains' entities have no polymer type."""
    i = frame(spark, d, "lineitem").selectExpr("CAST(l_partkey AS STRING) AS entry_id", "CAST(l_suppkey AS STRING) AS chain_a", "CAST(l_linenumber AS STRING) AS chain_b", "l_partkey % 7 AS contact_count").distinct()
    asym = i.select("entry_id", F.explode(F.array("chain_a", "chain_b")).alias("id")).distinct().withColumn("entity_id", F.col("id"))
    entities = asym.selectExpr("entry_id", "id", _TYPE.format(k="CAST(id AS BIGINT)") + " AS poly_type")
    t = records.filter_interfaces(records.typed_interfaces(i, asym, entities), ["protein_dna", "protein_protein", "protein_ligand"], 3)
    return t.select("entry_id", "chain_a", "chain_b", "interface_type")


@query("SELECT CAST(l_orderkey AS VARCHAR) || '_' || l_returnflag || '_' || CAST(l_linenumber AS VARCHAR) AS item_id, count(*) AS n FROM lineitem GROUP BY 1")
def residue_item_ids(spark: SparkSession, d: str) -> DataFrame:
    t = frame(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.col("l_returnflag").alias("chain_id"), F.col("l_linenumber").alias("seq_id"))
    return datasets.item_ids(t, "residue").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand AS item_id, arg_min(p_name, (-len(p_name), p_partkey)) AS sequence FROM part GROUP BY 1")
def representative_sequences(spark: SparkSession, d: str) -> DataFrame:
    p = frame(spark, d, "part").select(F.col("p_brand").alias("entry_id"), F.col("p_partkey").alias("chain_ord"), F.col("p_name").alias("sequence"))
    return datasets.representative_sequences(p)


@query("SELECT CAST(c_custkey AS VARCHAR) AS entry_id, CASE WHEN c_custkey % 3 <> 0 THEN '2020-01-0' || (c_custkey % 9) END AS deposition_date, (SELECT max(strftime(o_orderdate, '%Y-%m-%d')) FROM orders WHERE o_custkey = c_custkey) AS revision_date, c_mktsegment || '|' || c_nationkey AS keywords, CASE WHEN c_nationkey % 2 = 0 THEN 'P 1' END AS space_group, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey + 0.5::DOUBLE END AS a, 90::DOUBLE AS gamma FROM customer")
def archive_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Dates, keywords, space group and cell of entries; null tokens and text that isn't a number come out as NULL."""
    raw = _raw(
        spark, d,
        _struct_keywords=("customer", "c_custkey", "0", {"pdbx_keywords": "concat(c_mktsegment, ' , ', c_nationkey)"}),
        _symmetry=("customer", "c_custkey", "0", {"space_group_name_H-M": "CASE WHEN c_nationkey % 2 = 0 THEN ' P 1 ' ELSE '?' END"}),
        _cell=("customer", "c_custkey", "0", {"length_a": "CASE WHEN c_custkey % 4 = 0 THEN 'wide' ELSE concat(c_custkey, '.5') END", "angle_gamma": "'90'"}),
        _pdbx_database_status=("customer", "c_custkey", "0", {"recvd_initial_deposition_date": "CASE WHEN c_custkey % 3 = 0 THEN '.' ELSE concat('2020-01-0', c_custkey % 9) END"}),
        _pdbx_audit_revision_history=("orders", "o_custkey", "o_orderkey", {"revision_date": "date_format(o_orderdate, 'yyyy-MM-dd')"}),
    )
    entries = frame(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("entry_id"))
    t = checks.archive_metadata(entries, raw)
    return t.select("entry_id", "deposition_date", "revision_date", F.array_join("keywords", "|").alias("keywords"), "space_group", F.col("unit_cell.a").alias("a"), F.col("unit_cell.gamma").alias("gamma"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS entry_id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN '_a,_b' ELSE '_a' END AS categories FROM customer UNION ALL SELECT DISTINCT CAST(o_custkey AS VARCHAR), '_b' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def raw_categories(spark: SparkSession, d: str) -> DataFrame:
    raw = _raw(spark, d, _b=("orders", "o_custkey", "o_orderkey", {"x": "1"}), _a=("customer", "c_custkey", "0", {"x": "1"}))
    return metadata.categories(raw).select("entry_id", F.array_join("categories", ",").alias("categories"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS entry_id, l_returnflag AS chain_id, CASE WHEN l_linenumber % 2 = 0 THEN 'ZN' ELSE 'HEM' END AS comp_id FROM lineitem GROUP BY l_orderkey, l_returnflag, l_linenumber HAVING count(*) = 1 AND l_linenumber % 2 = 0 AND l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag) = 1")
def single_atom_ions(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("l_linenumber") % 2 == 0
    t = frame(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("entry_id"), F.when(F.col("l_returnflag") == "R", "HETATM").otherwise("ATOM").alias("group_pdb"), F.col("l_returnflag").alias("label_asym_id"), F.when(even, "ZN").otherwise("HEM").alias("label_comp_id"), F.col("l_linenumber").cast("string").alias("auth_seq_id"), F.when(even, "Zn").otherwise("C").alias("type_symbol"))
    return checks.single_atom_ions(t)


@query(ctes("fx_asym") + ", y AS (SELECT entry_id, id FROM fx_asym UNION ALL SELECT entry_id, id FROM fx_asym WHERE CAST(entry_id AS BIGINT) % 10 = 0 AND id = 'A'), f AS (SELECT 'CANONICAL_CHAIN_ID_COLLISION' AS code, 'error' AS severity, count(*) AS n FROM (SELECT entry_id, id FROM y GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'RESIDUE_NUMBER_COLLISION', 'error', count(*) FROM (SELECT entry_id, label_asym_id, label_seq_id FROM fx_atoms WHERE group_pdb = 'ATOM' AND label_seq_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT label_comp_id) > 1) UNION ALL SELECT 'MAPPING_INCOMPLETE', 'error', count(*) FROM y WHERE CAST(entry_id AS BIGINT) % 3 = 0 UNION ALL SELECT 'EMPTY_CANONICAL_STRUCTURE', 'error', count(DISTINCT o_orderkey) FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT entry_id FROM y) UNION ALL SELECT 'LIGANDS_EXCLUDED', 'warning', count(*) FROM (SELECT entry_id FROM fx_asym WHERE CAST(entry_id AS BIGINT) % 10 <> 0 GROUP BY 1 HAVING bool_or(id = 'R') AND CAST(entry_id AS BIGINT) % 4 = 1)) SELECT * FROM f WHERE n > 0")
def canonical_checks(spark: SparkSession, d: str) -> DataFrame:
    """Validation of canonical structures: chains that occur twice, entries without a mapping, without chains, or with fewer chains than before."""
    from residua.plans.policy import policy

    atoms, asym, number = frame(spark, d, "fx_atoms"), frame(spark, d, "fx_asym"), F.col("entry_id").cast("bigint")
    before = asym.unionByName(asym.filter((number % 10 != 0) & (number % 4 == 1) & (F.col("id") == "R")))
    tables = {"entries": frame(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("entry_id")).distinct(), "atoms": atoms, "asym_units": asym.unionByName(asym.filter((number % 10 == 0) & (F.col("id") == "A")))}
    known = asym.filter(number % 3 != 0).select("entry_id", F.col("id").alias("canonical_chain_id"))
    rules = policy({"ligand_rules": {"strategy": "filter"}, "provenance_rules": {"record_original_mappings": True}})
    found = checks.canonical(tables, {"chain_id": known}, {"atoms": atoms, "asym_units": before, "entities": frame(spark, d, "fx_types")}, rules)
    return found.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))
