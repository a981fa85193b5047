"""Validation rules as queries that return the rows in breach."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import load, micros


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return df.join(parent.select(F.col(parent_key).alias("parent_key")), F.col(key) == F.col("parent_key"), "left_anti")


def out_of_order(df: DataFrame, key: str, order: list[str], value: str, strict: bool = False) -> DataFrame:
    """Rows whose value falls below the one before, or equals it if ``strict``."""
    d = df.withColumn("before", F.lag(value).over(Window.partitionBy(key).orderBy(*order)))
    return d.where(F.col("before") >= F.col(value) if strict else F.col("before") > F.col(value))


def dq_refs(spark, sf_dir):
    """Lines of unknown orders; lines of returned parts stand for broken references."""
    l = load(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "R", -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey")).alias("ref"), "l_partkey", "l_suppkey")  # noqa: E741
    return orphans(l, "ref", load(spark, sf_dir, "orders"), "o_orderkey").select("ref", "l_partkey", "l_suppkey")


def dq_unique(spark, sf_dir):
    return duplicates(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def dq_monotone(spark, sf_dir):
    d = load(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return out_of_order(d, "user_id", ["event_id"], "value").select("event_id", "before")


def dq_strict(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return out_of_order(d, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_linenumber", True).select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").alias("line"))


def dq_ranges(spark, sf_dir):
    """Rule by rule: how many rows break it."""
    l = load(spark, sf_dir, "lineitem")  # noqa: E741
    rules = {"quantity over 45": F.col("l_quantity") > 45, "discount over 0.08": F.col("l_discount") > 0.08, "no tax": F.col("l_tax") <= 0, "unknown flag": ~F.col("l_returnflag").isin("A", "N", "R")}
    hits = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    return l.select(F.explode(hits).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def dq_pair(spark, sf_dir):
    """Both or neither: a user's days with a purchase but no signup, or the reverse."""
    e = load(spark, sf_dir, "events").groupBy("user_id", F.floor(micros() / 86_400_000_000).alias("day")).agg(F.max(F.col("event_type") == "purchase").alias("a"), F.max(F.col("event_type") == "signup").alias("b"))
    return e.where(F.col("a") != F.col("b"))


def dq_status(spark, sf_dir):
    """Shape by status: open orders without a price, closed ones of low priority."""
    o = load(spark, sf_dir, "orders")
    bad = F.when((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") < 20_000), "open and cheap").when((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").startswith("5"), "closed and low")
    return o.select("o_orderkey", bad.alias("breach")).where("breach IS NOT NULL")


def dq_index_range(spark, sf_dir):
    """Line numbers beyond the order's number of lines."""
    l = load(spark, sf_dir, "lineitem")  # noqa: E741
    n = F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))
    return l.withColumn("n", n).where(F.col("l_linenumber") > F.col("n")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "n")


def dq_parallel(spark, sf_dir):
    """Parallel arrays of one length: an order's parts against its distinct suppliers."""
    g = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.size(F.collect_list("l_partkey")).alias("parts"), F.size(F.collect_set("l_suppkey")).alias("suppliers"))
    return g.where("parts <> suppliers")


def dq_vocabulary(spark, sf_dir):
    """Event types outside the closed vocabulary."""
    known = F.array(*map(F.lit, ("click", "view", "purchase")))
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    return e.select("user_id", F.array_join(F.array_sort(F.array_except("t", known)), ",").alias("unknown")).where("unknown <> ''")


QUERIES = [dq_refs, dq_unique, dq_monotone, dq_strict, dq_ranges, dq_pair, dq_status, dq_index_range, dq_parallel, dq_vocabulary]

ORACLES = {
    "dq_refs": "SELECT -l_orderkey - 1 AS ref, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
    "dq_unique": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "dq_monotone": "WITH d AS (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT event_id, before FROM d WHERE before > value",
    "dq_strict": "WITH d AS (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem) SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber AS line FROM d WHERE b >= l_linenumber",
    "dq_ranges": """WITH r AS (SELECT unnest([CASE WHEN l_quantity > 45 THEN 'quantity over 45' END, CASE WHEN l_discount > 0.08::DOUBLE THEN 'discount over 0.08' END, CASE WHEN l_tax <= 0 THEN 'no tax' END, CASE WHEN l_returnflag NOT IN ('A', 'N', 'R') THEN 'unknown flag' END]) AS rule FROM lineitem)
SELECT rule, count(*) AS n FROM r WHERE rule IS NOT NULL GROUP BY 1""",
    "dq_pair": "SELECT user_id, epoch_us(ts) // 86400000000 AS day, bool_or(event_type = 'purchase') AS a, bool_or(event_type = 'signup') AS b FROM events GROUP BY 1, 2 HAVING a <> b",
    "dq_status": "WITH b AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice < 20000 THEN 'open and cheap' WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '5%' THEN 'closed and low' END AS breach FROM orders) SELECT * FROM b WHERE breach IS NOT NULL",
    "dq_index_range": "WITH d AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT * FROM d WHERE l_linenumber > n",
    "dq_parallel": "SELECT l_orderkey, count(*)::INT AS parts, count(DISTINCT l_suppkey)::INT AS suppliers FROM lineitem GROUP BY 1 HAVING count(*) <> count(DISTINCT l_suppkey)",
    "dq_vocabulary": "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS unknown FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY 1",
}
