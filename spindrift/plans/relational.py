"""Relational queries over the star schema: what the DataFrame layer itself has to answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        _t(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n_rows"))
    )


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, l, n = (_t(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "nation"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    joined = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.groupBy("n_name").agg(F.round(F.sum(net), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("n_orders"))


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_custkey", "o_totalprice")


def rollup_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (_t(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def rank_in_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    ranked = _t(spark, sf_dir, "customer").withColumn("place", F.row_number().over(w).cast("long"))
    return ranked.where("place <= 10").select("c_mktsegment", "place", "c_custkey", "c_acctbal")


def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


def customers_without_large_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


def customers_with_large_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


def nations_on_both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier")
    a = c.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nationkey"))
    b = s.select(F.col("s_nationkey").alias("nationkey"))
    return a.intersect(b).select("nationkey", F.lit("both").alias("side")).unionByName(a.exceptAll(b).distinct().join(a.intersect(b), "nationkey", "left_anti").select("nationkey", F.lit("customers").alias("side")))


def nation_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier")
    a = c.groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n_customers"))
    b = s.groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    return a.join(b, "nationkey", "full").select("nationkey", F.coalesce("n_customers", F.lit(0)).alias("n_customers"), F.coalesce("n_suppliers", F.lit(0)).alias("n_suppliers"))


QUERIES = {f.__name__: f for f in (pricing_summary, revenue_by_nation, top_orders, rollup_by_region, rank_in_segment, customers_without_orders, customers_without_large_orders, customers_with_large_orders, nations_on_both_sides, nation_balance)}

ORACLE_SQL = {
    "pricing_summary": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n_rows from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2",
    "revenue_by_nation": "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(distinct o_orderkey) as n_orders from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1",
    "top_orders": "select o_orderkey, o_custkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20",
    "rollup_by_region": "select r_name, n_name, count(*) as n_customers, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)",
    "rank_in_segment": "select c_mktsegment, place, c_custkey, c_acctbal from (select *, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as place from customer) where place <= 10",
    "customers_without_orders": "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)",
    "customers_without_large_orders": "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)",
    "customers_with_large_orders": "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)",
    "nations_on_both_sides": "select nationkey, 'both' as side from (select c_nationkey as nationkey from customer where c_acctbal > 9000 intersect select s_nationkey from supplier) union all select nationkey, 'customers' from (select c_nationkey as nationkey from customer where c_acctbal > 9000 except select s_nationkey from supplier)",
    "nation_balance": "select coalesce(a.k, b.k) as nationkey, coalesce(n_customers, 0) as n_customers, coalesce(n_suppliers, 0) as n_suppliers from (select c_nationkey as k, count(*) as n_customers from customer group by 1) a full join (select s_nationkey as k, count(*) as n_suppliers from supplier group by 1) b on a.k = b.k",
}
