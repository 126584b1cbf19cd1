"""The driver's tables seen as pooled reads, so that every operator runs on them.

A line item is an allele call: pool and read from the order, site from the part, mate from the line number, allele from
the return flag. Repeated (read, site) keeps the first row by a total order. A part is a draft haplotype of 12 sites in
the pool p_partkey % 8, of weight p_size. Whole tables, always.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SITES, POOLS = 12, 8

CALLS_SQL = """calls AS (SELECT pool, read_id, site, mate, allele FROM (
  SELECT CAST(l_orderkey % 8 AS BIGINT) AS pool, l_orderkey AS read_id, CAST(l_partkey % 12 AS BIGINT) AS site, CAST(l_linenumber % 2 AS BIGINT) AS mate,
         CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS BIGINT) AS allele,
         row_number() OVER (PARTITION BY l_orderkey, l_partkey % 12 ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn
  FROM lineitem) WHERE rn = 1)"""
HAPS_SQL = """drafts AS (SELECT CAST(p_partkey % 8 AS BIGINT) AS pool, lpad(bin((p_partkey * 2654435761) % 4096), 12, '0') AS hap, CAST(sum(p_size) AS BIGINT) AS n
  FROM part GROUP BY 1, 2),
haps AS (SELECT hap, n / sum(n) OVER () AS freq FROM (SELECT hap, CAST(sum(n) AS DOUBLE) AS n FROM drafts GROUP BY hap))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls with what orders them; repeated sites of a read included."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % POOLS).alias("pool"), F.col("l_orderkey").alias("read_id"), (F.col("l_partkey") % SITES).alias("site"),
        (F.col("l_linenumber") % 2).cast("long").alias("mate"), (F.col("l_returnflag") == "R").cast("long").alias("allele"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
    )


ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pool, read_id, site, mate, allele: one call for each read and site. An aggregate (min of the order), not a window:
    it combines before the shuffle."""
    first = F.min(F.struct(*ORDER, "mate", "allele")).alias("x")
    return raw_calls(spark, sf_dir).groupBy("pool", "read_id", "site").agg(first).select("pool", "read_id", "site", "x.mate", "x.allele")


def position(site: Column) -> Column:
    return (site + 1) * 100


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pool, hap, n."""
    code = (F.col("p_partkey") * 2654435761) % 4096
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % POOLS).alias("pool"), F.lpad(F.bin(code), SITES, "0").alias("hap"), "p_size")
    return rows.groupBy("pool", "hap").agg(F.sum("p_size").alias("n"))


def haps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hap, freq over all pools together. At most 2 ** SITES rows, so the total is a window over few rows."""
    n = drafts(spark, sf_dir).groupBy("hap").agg(F.sum("n").cast("double").alias("n"))
    return n.select("hap", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("freq"))
