"""The driver tables seen as structure data: one SQL text for Spark and DuckDB alike ({S} is the string type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "fx_atoms": """
SELECT CAST(l_orderkey AS {S}) AS entry_id,
 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate) AS BIGINT) AS atom_ord,
 CASE WHEN l_returnflag='R' THEN 'HETATM' ELSE 'ATOM' END AS group_pdb,
 l_returnflag AS label_asym_id,
 CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '2' ELSE '3' END AS label_entity_id,
 CASE WHEN l_returnflag='R' THEN NULL ELSE CAST(l_linenumber AS INT) END AS label_seq_id,
 CAST(l_linenumber AS {S}) AS auth_seq_id,
 CAST(NULL AS {S}) AS ins_code,
 CASE l_suppkey % 3 WHEN 0 THEN 'ALA' WHEN 1 THEN 'GLY' ELSE 'HOH' END AS label_comp_id,
 CASE l_partkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'CA' WHEN 2 THEN 'C' ELSE 'O' END AS label_atom_id,
 CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_linestatus END AS label_alt_id,
 CAST(l_quantity AS INT) AS x, CAST(round(l_discount*100) AS INT) AS y, CAST(round(l_tax*100) AS INT) AS z,
 CAST(1 - l_discount AS DECIMAL(18,4)) AS occupancy, CAST(l_quantity AS DECIMAL(18,4)) AS b_iso
FROM lineitem""",
    "fx_asym": """
SELECT entry_id, label_asym_id AS id, label_entity_id AS entity_id,
 CAST(row_number() OVER (PARTITION BY entry_id ORDER BY min(atom_ord)) AS INT) AS asym_ord,
 CASE WHEN CAST(entry_id AS BIGINT) % 10 = 0 THEN 'X' ELSE label_asym_id END AS auth_id
FROM fx_atoms GROUP BY entry_id, label_asym_id, label_entity_id""",
    "fx_types": """
SELECT DISTINCT entry_id, label_entity_id AS id, CAST(label_entity_id AS INT) AS entity_ord,
 CASE WHEN label_entity_id = '3' THEN CASE CAST(entry_id AS BIGINT) % 3 WHEN 0 THEN 'water' ELSE 'non-polymer' END ELSE 'polymer' END AS type,
 CASE WHEN label_entity_id = '3' THEN CASE CAST(entry_id AS BIGINT) % 4 WHEN 0 THEN 'ZINC ION' WHEN 1 THEN 'Glutathione' ELSE 'heme' END ELSE 'chain' END AS pdbx_description,
 CASE WHEN label_entity_id = '3' THEN CAST(NULL AS {S}) ELSE concat('SEQ', CAST(CAST(entry_id AS BIGINT) % 7 AS {S})) END AS seq_can
FROM fx_atoms""",
    "fx_entities": """
SELECT p_brand AS entry_id, CAST(p_partkey AS BIGINT) AS entity_ord, CAST(p_partkey AS {S}) AS id,
 CASE WHEN p_type IN ('SMALL','LARGE') THEN 'non-polymer' WHEN p_type='MEDIUM' THEN 'water' ELSE 'polymer' END AS type,
 p_name AS pdbx_description, CASE WHEN p_size % 5 = 0 THEN NULL ELSE concat(p_name,'-',p_type) END AS seq_can
FROM part""",
    "fx_quality": """
SELECT CAST(o_custkey AS {S}) AS entry_id, CAST(o_orderkey AS BIGINT) AS row_ord, o_orderpriority AS method,
 CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS resolution
FROM orders""",
    "fx_taxonomy": """
SELECT CAST(1 AS INT) AS src_ord, CAST(c_custkey AS BIGINT) AS row_ord, CAST(c_nationkey AS {S}) AS entity_id, c_name AS organism FROM customer
UNION ALL SELECT 2, CAST(s_suppkey AS BIGINT), CAST(s_nationkey AS {S}), s_name FROM supplier
UNION ALL SELECT 3, CAST(n_nationkey AS BIGINT), CAST(n_regionkey AS {S}), n_name FROM nation""",
    "fx_refseq": """
SELECT CAST(l_orderkey AS {S}) AS entry_id, CAST(l_orderkey AS BIGINT) AS row_ord, CAST(l_partkey AS {S}) AS ref_id, l_returnflag AS asym_id,
 CAST(l_linenumber AS INT) AS seq_id_start, l_linestatus AS seq_id_end, CAST(l_suppkey AS BIGINT) AS tie
FROM lineitem""",
    "fx_points": """
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(label AS {S}) AS label_asym_id, CAST(embedding[{0}] AS DOUBLE) AS x, CAST(embedding[{1}] AS DOUBLE) AS y, CAST(embedding[{2}] AS DOUBLE) AS z
FROM embeddings""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a fixture over one."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = SQL[name].replace("{S}", "STRING").replace("{0}", "0").replace("{1}", "1").replace("{2}", "2")
    used = {t: frame(spark, sf_dir, t) for t in (*TABLES, *SQL) if f"FROM {t}" in sql}
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **used)


def ctes(*names: str) -> str:
    """The same fixtures as WITH clauses for DuckDB."""
    order: list[str] = []

    def add(name: str) -> None:
        for t in SQL:
            if f"FROM {t}" in SQL[name]:
                add(t)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    text = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    return "WITH " + text.replace("{S}", "VARCHAR").replace("{0}", "1").replace("{1}", "2").replace("{2}", "3")
