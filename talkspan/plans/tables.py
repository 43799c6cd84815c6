"""Plain relational queries over the test tables: what Spark brings along, so that one session serves them too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkspan.plans.fixtures import table
from talkspan.plans.registry import query


@query("""
select l_returnflag, l_linestatus, cast(round(sum(l_quantity)) as bigint) as quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity")).cast("long").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""
select n_name, count(distinct c_custkey) as customers, count(*) as orders from nation join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey
where o_orderstatus = 'F' group by all""")
def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.countDistinct("c_custkey").alias("customers"), F.count("*").alias("orders"))


@query("select r_name, n_name, count(*) as suppliers from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def suppliers_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("suppliers"))


@query("select o_orderpriority, o_orderstatus, count(*) as n from orders group by cube (o_orderpriority, o_orderstatus)")
def orders_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("""
select o_custkey, o_orderkey, row_number() over w as place, dense_rank() over (partition by o_custkey order by o_orderpriority) as priority, lag(o_orderkey) over w as before
from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey) qualify row_number() over w <= 3""")
def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).cast("long")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place"), p.alias("priority"), F.lag("o_orderkey").over(w).alias("before"))
    return rows.where("place <= 3")


@query("select c_custkey, c_acctbal from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def customers_without_urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_acctbal")
