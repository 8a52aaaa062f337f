"""How the test tables stand in for a matrix, its cells and its genes; the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.cells import sparse
from tessera.session import table


def matrix(spark: SparkSession, d: str) -> DataFrame:
    return sparse(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_id"), F.col("l_quantity").alias("value")))


def obs(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.select(F.col("o_orderkey").alias("cell_id"), F.col("n_name").alias("sample"), F.col("r_name").alias("condition"), F.col("c_mktsegment").alias("cell_type"), F.col("o_orderpriority").alias("cluster"), F.col("o_orderstatus").alias("batch"))


def var(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    kind = F.when(F.col("p_size") <= 3, "MT-G").when(F.col("p_size") <= 8, "RPL").when(F.col("p_size") <= 10, "HBA").otherwise("G")
    return p.select(F.col("p_partkey").alias("gene_id"), F.concat(kind, key).alias("gene_name"), F.col("p_brand").alias("term"), "p_size")


SQL = """m as (select l_orderkey as cell_id, l_partkey as gene_id, sum(l_quantity) as value from lineitem group by 1, 2 having sum(l_quantity) <> 0),
 o as (select o_orderkey as cell_id, n_name as sample, r_name as condition, c_mktsegment as cell_type, o_orderpriority as cluster, o_orderstatus as batch
   from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
 v as (select p_partkey as gene_id, (case when p_size <= 3 then 'MT-G' when p_size <= 8 then 'RPL' when p_size <= 10 then 'HBA' else 'G' end) || p_partkey as gene_name, p_brand as term, p_size from part)"""
QC = SQL + """,
 q0 as (select cell_id, sum(value) as t, count(*) as g, sum(case when gene_name like 'MT-%' then value else 0 end) as mt from m join v using (gene_id) group by 1),
 q as (select o.*, coalesce(t, 0) as total_counts, coalesce(g, 0) as n_genes_by_counts, coalesce(mt, 0) as total_counts_mt,
   case when coalesce(t, 0) > 0 then 100 * mt / t else 0 end as pct_counts_mt, ln(1 + coalesce(t, 0)) as log1p_total_counts, ln(1 + coalesce(g, 0)) as log1p_n_genes_by_counts from o left join q0 using (cell_id))"""
