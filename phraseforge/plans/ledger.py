"""The run ledger over lineitem: one text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LEDGER_SQL = """
WITH d AS (
  SELECT l_partkey AS case_id, l_linenumber AS run_id, l_suppkey, l_quantity, l_returnflag, l_linestatus,
         row_number() OVER (PARTITION BY l_partkey, l_linenumber
                            ORDER BY l_orderkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS rn
  FROM lineitem),
c AS (
  SELECT case_id, run_id, l_suppkey, l_returnflag, l_linestatus, case_id % 6 AS g,
         CASE WHEN case_id % 6 = 0 OR (case_id % 6 = 1 AND l_quantity < 20)
              THEN concat('NF-', lpad(CAST(case_id AS VARCHAR(10)), 6, '0'))
              WHEN case_id % 6 = 5 AND l_quantity < 10
              THEN concat('Z', lpad(CAST(case_id % 100 AS VARCHAR(10)), 2, '0'), '.9')
              ELSE concat(chr(CAST(65 + case_id % 22 AS INT)), lpad(CAST(case_id % 100 AS VARCHAR(10)), 2, '0'), '.',
                          CASE WHEN case_id % 6 = 2 THEN CAST(l_suppkey % 3 AS VARCHAR(10)) ELSE '0' END)
         END AS code_complete
  FROM d WHERE rn = 1)
SELECT case_id, run_id, code_complete,
       CASE WHEN code_complete LIKE 'NF-%' THEN code_complete ELSE split_part(code_complete, '.', 1) END AS category,
       CASE WHEN code_complete LIKE 'NF-%' THEN NULL
            WHEN g = 3 THEN 'yes' WHEN g = 4 AND case_id % 4 < 2 THEN 'no'
            WHEN l_linestatus = 'O' THEN 'yes' ELSE 'no' END AS consistency,
       CASE WHEN code_complete LIKE 'NF-%' THEN 'nf'
            WHEN l_returnflag = 'A' THEN 'exact_complete' WHEN l_returnflag = 'N' THEN 'exact_core'
            ELSE 'catalog_search' END AS match_type,
       CASE WHEN code_complete LIKE 'NF-%' THEN 0 ELSE CAST(2 + case_id % 3 AS INT) END AS depth
FROM c
"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, run_id, code_complete, category, consistency, match_type, depth."""
    return spark.sql(LEDGER_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
