"""Records of the test tables in the library's terms: entry, document, value, relation, unit, source row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Class bounds of the bound value column.
LOWER, UPPER = 4.5, 4.85
#: The same records for an SQL engine.
RECORDS_SQL = """records AS (
  SELECT l_partkey AS entry, l_suppkey AS document, log10(l_extendedprice) AS value,
         CASE WHEN l_returnflag = 'R' THEN '>' ELSE '=' END AS relation, year(l_shipdate) AS year,
         l_orderkey, l_linenumber, l_extendedprice AS raw, l_quantity AS quantity, l_linestatus AS status,
         CASE l_linenumber WHEN 1 THEN 'nM' WHEN 2 THEN 'uM' WHEN 3 THEN 'mM' WHEN 4 THEN 'M' WHEN 5 THEN 'pM' ELSE 'kg' END AS unit
  FROM lineitem)"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.lit("kg")
    for n, u in ((5, "pM"), (4, "M"), (3, "mM"), (2, "uM"), (1, "nM")):
        units = F.when(F.col("l_linenumber") == n, u).otherwise(units)
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("entry"),
        F.col("l_suppkey").alias("document"),
        F.log10("l_extendedprice").alias("value"),
        F.when(F.col("l_returnflag") == "R", ">").otherwise("=").alias("relation"),
        F.year("l_shipdate").alias("year"),
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").alias("raw"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_linestatus").alias("status"),
        units.alias("unit"),
    )
