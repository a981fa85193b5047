"""Relational forms that the planner has built in: cubes, rollups, sets, ranks, approximate counts, own aggregates, handlers by name."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import registry
from ..sources.tables import load


def cube_sales(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem")  # noqa: E741
    return l.cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("g"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


def rollup_orders(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.rollup("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


def grouping_sets(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem")  # noqa: E741
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return l.groupingSets([[flag], [status], []], flag, status).agg(F.count(F.lit(1)).alias("n"))


def approx_distinct(spark, sf_dir):
    """Whether the approximate count of each event type's users lies within a tenth of the exact one."""
    e = load(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("x"))
    return e.select("event_type", F.col("x").alias("users"), (F.abs(F.col("a") - F.col("x")) <= 0.1 * F.col("x")).alias("near"))


def geometric_mean(spark, sf_dir):
    """An aggregate of our own over each event type, combined from sums of logarithms: a plain expression, no Python."""
    e = load(spark, sf_dir, "events").where("value > 0")
    return e.groupBy("event_type").agg(F.round(F.exp(F.avg(F.log("value"))), 4).alias("gmean"))


def pandas_aggregate(spark, sf_dir):
    """A grouped pandas aggregate: the interquartile range of each nation's balances. A group's column is in one task, so it is for bounded groups."""

    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.quantile(0.75) - v.quantile(0.25))

    return load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(spread("c_acctbal"), 4).alias("iqr"))


def top_orders(spark, sf_dir):
    """The three dearest orders of each status; the limit goes below the shuffle."""
    w = Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return load(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_orderstatus", "o_orderkey", "rank")


def set_operations(spark, sf_dir):
    """Customers that order and have money, and those with money that don't."""
    c = load(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_custkey")
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    both, only = c.intersect(o).withColumn("kind", F.lit("both")), c.exceptAll(o.distinct()).withColumn("kind", F.lit("only"))
    return both.unionByName(only)


def handler_dispatch(spark, sf_dir):
    """Each page's address through the handler that its row names; unknown names give null."""
    name = F.when(F.col("page_id") % 3 == 0, "text:endpoint").when(F.col("page_id") % 3 == 1, "text:object_key").otherwise("text:gone")
    return load(spark, sf_dir, "pages").select("page_id", registry.dispatch(name, F.col("url"), ["text:endpoint", "text:object_key"]).alias("out"))


def list_port(spark, sf_dir):
    """A table function's rows, joined laterally: the labels of each host."""
    registry.register(spark)
    load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).createOrReplaceTempView("quill_hosts")
    return spark.sql("SELECT page_id, place, part FROM quill_hosts, LATERAL list_port(host, '.')")


QUERIES = [cube_sales, rollup_orders, grouping_sets, approx_distinct, geometric_mean, pandas_aggregate, top_orders, set_operations, handler_dispatch, list_port]

ORACLES = {
    "cube_sales": "SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::BIGINT AS g, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rollup_orders": "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "approx_distinct": "SELECT event_type, count(DISTINCT user_id) AS users, true AS near FROM events GROUP BY 1",
    "geometric_mean": "SELECT event_type, round(exp(avg(ln(value))), 4) AS gmean FROM events WHERE value > 0 GROUP BY 1",
    "pandas_aggregate": "SELECT c_nationkey, round(quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25), 4) AS iqr FROM customer GROUP BY 1",
    "top_orders": "SELECT o_orderstatus, o_orderkey, row_number() OVER w::INT AS rank FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) QUALIFY rank <= 3",
    "set_operations": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'both' ELSE 'only' END AS kind FROM customer WHERE c_acctbal > 5000",
    "handler_dispatch": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_extract(url, '://([^?#]*)', 1) WHEN 1 THEN regexp_extract(url, '^https?://([^?#]*)', 1) END AS out FROM pages",
    "list_port": "SELECT page_id, (unnest(range(len(p))))::INT AS place, unnest(p) AS part FROM (SELECT page_id, string_split(regexp_extract(url, '://([^/?#]*)', 1), '.') AS p FROM pages)",
}
