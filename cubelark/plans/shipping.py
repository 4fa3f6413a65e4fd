"""Volume shipping (Q7) and market share (Q8) as DataFrame plans, with and without the Bloom join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import year
from ..operators.bloom import bloom_join
from ..operators.relational import group_sum, share, volume
from ..sources.tables import table

FIRST, LAST = "1995-01-01", "1996-12-31"


def q7(spark: SparkSession, sf_dir: str, one: str, two: str, bloom: bool = False) -> DataFrame:
    """Revenue between two nations by direction and ship year; unknown names give no rows."""
    nation = table(spark, sf_dir, "nation").where(F.col("n_name").isin(one, two))
    supplier = table(spark, sf_dir, "supplier").join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supp_nation")), "s_nationkey")
    customer = table(spark, sf_dir, "customer").join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("cust_nation")), "c_nationkey")
    line = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate").cast("date").between(F.lit(FIRST).cast("date"), F.lit(LAST).cast("date")))
    line = line.select("l_orderkey", "l_suppkey", year(F.col("l_shipdate")).alias("l_year"), volume().alias("volume"))
    supplier = supplier.select("s_suppkey", "supp_nation")
    shipped = bloom_join(line, "l_suppkey", supplier, "s_suppkey") if bloom else line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    ordered = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customer.select("c_custkey", "cust_nation"), F.col("o_custkey") == F.col("c_custkey"))
    both = shipped.join(ordered, F.col("l_orderkey") == F.col("o_orderkey")).where("supp_nation <> cust_nation" if one != two else "true")
    return group_sum(both, ["supp_nation", "cust_nation", "l_year"], F.col("volume"), "revenue").orderBy("supp_nation", "cust_nation", "l_year")


def q8(spark: SparkSession, sf_dir: str, nation: str, region: str, kind: str, bloom: bool = False) -> DataFrame:
    """A nation's share of a region's market for a part type, by order year; only years with sales."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").where(F.col("r_name") == region)
    buyers = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey")
    customer = table(spark, sf_dir, "customer").join(buyers, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey")
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate").cast("date").between(F.lit(FIRST).cast("date"), F.lit(LAST).cast("date")))
    orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", year(F.col("o_orderdate")).alias("o_year"))
    part = table(spark, sf_dir, "part").where(F.col("p_type") == kind).select("p_partkey")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", volume().alias("volume"))
    sold = bloom_join(line, "l_partkey", part, "p_partkey") if bloom else line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    supplier = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("nation"))
    sales = sold.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    out = share(sales, ["o_year"], F.col("volume"), F.col("nation") == nation, "mkt_share")
    return out.select("o_year", F.round("mkt_share", 9).alias("mkt_share")).orderBy("o_year")
