"""Plain relational shapes over the star schema: all join kinds, grouping, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import readers
from .registry import query, table


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def q_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey").join(o.where("o_orderstatus = 'F'"), "c_custkey", "left_semi").join(o.where("o_orderpriority = '1-URGENT'"), "c_custkey", "left_anti")


@query("""SELECT coalesce(c_nationkey, s_nationkey) AS nation, n_c, n_s FROM (SELECT c_nationkey, count(*) AS n_c FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c FULL OUTER JOIN (SELECT s_nationkey, count(*) AS n_s FROM supplier GROUP BY 1) s ON c_nationkey = s_nationkey""")
def q_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n_c"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n_s"))
    return c.join(s, "nation", "full_outer")


@query("""SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def q_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    # Orders are summed before the small sides join, so that only one row an order goes on.
    per_order = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    joined = per_order.join(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    joined = joined.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def q_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus)::INT AS g_status, grouping(o_orderpriority)::INT AS g_priority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def q_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.grouping("o_orderstatus").cast("int").alias("g_status"), F.grouping("o_orderpriority").cast("int").alias("g_priority"), F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey, k::INT AS k FROM r WHERE k <= 3""")
def q_top_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", k.alias("k")).where("k <= 3")


@query("""WITH RECURSIVE t(node, parent, depth) AS (SELECT p_partkey, p_partkey // 2, 0 FROM part WHERE p_partkey = 1 UNION ALL SELECT p.p_partkey, p.p_partkey // 2, depth + 1 FROM part p JOIN t ON p.p_partkey // 2 = t.node WHERE p.p_partkey > 1) SELECT node, depth FROM t""")
def q_tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.expr("p_partkey div 2").alias("parent"))
    return readers.tree(spark, nodes, 1, "node", "parent").select(F.col("id").alias("node"), "depth")
