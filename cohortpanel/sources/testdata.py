"""Views over the star-schema test tables that give prediction rows and a reference panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BINDING_SQL = """
SELECT n_name AS identity,
       concat(replace(upper(p_name), ' ', ''), chr(65 + p_size % 26)) AS peptide,
       concat('HLA-', element_at(array('A', 'B', 'C'), CAST(1 + CAST(substr(p_brand, 7) AS int) % 3 AS int)), '*', lpad(substr(p_brand, 7), 2, '0'), ':01') AS mhc,
       l_extendedprice / 1000.0D AS rank_el
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
"""
PANEL_SQL = """
WITH h AS (
  SELECT n_name AS population, r_name AS region, element_at(array('A', 'B', 'C'), CAST(1 + CAST(substr(p_brand, 7) AS int) % 3 AS int)) AS locus,
         concat(element_at(array('A', 'B', 'C'), CAST(1 + CAST(substr(p_brand, 7) AS int) % 3 AS int)), '*', lpad(substr(p_brand, 7), 2, '0'), ':01') AS allele
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
  JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey JOIN {part} ON l_partkey = p_partkey
), ac AS (SELECT population, region, locus, allele, count(*) AS n FROM h GROUP BY population, region, locus, allele),
ss AS (SELECT n_name AS population, count(*) AS sample_size FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name)
SELECT population, region, locus, allele, 0.95D * n / sum(n) OVER (PARTITION BY population, locus) AS allele_frequency, CAST(sample_size AS double) AS sample_size
FROM ac JOIN ss USING (population)
"""


def _tables(spark: SparkSession, sf_dir: str, names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names.split()}


def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of bindings.SCHEMA. The tables have no row order, so all ordinals are equal and ties go by text."""
    rows = spark.sql(BINDING_SQL, **_tables(spark, sf_dir, "lineitem part supplier nation"))
    return rows.selectExpr("identity AS file_name", "0 AS file_ordinal", "0L AS row_ordinal", "identity", "peptide", "mhc", "rank_el")


def reference_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(population, region, locus, allele, allele_frequency, sample_size)"""
    return spark.sql(PANEL_SQL, **_tables(spark, sf_dir, "lineitem orders customer nation region part"))
