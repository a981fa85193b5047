"""Job graphs as edge tables: levels, failure closure, bindings, timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rounds import stored
from ..sources.tables import load

def levels(steps: DataFrame, edges: DataFrame, costs: bool = False) -> DataFrame:
    """(step, level, done): each step's longest distance from a source, and the sum of costs on
    the dearest way to its end; null on or behind a cycle.

    Rounds over the frontier: a step is done in the round after the last of its needs. Each
    edge is met once, when its source is done, so the work is one join of every edge in all,
    whatever the number of paths; rounds are as many as levels.
    """
    need = stored(edges.distinct().groupBy("dst").agg(F.count(F.lit(1)).alias("needs")))
    cost = F.col("cost") if costs else F.lit(0.0)
    rest = steps.select("step", cost.alias("cost")).join(need, F.col("step") == F.col("dst"), "left").select("step", "cost", F.coalesce("needs", F.lit(0)).alias("needs"))
    front = stored(rest.where("needs = 0").select("step", F.lit(0).alias("level"), F.col("cost").alias("done")))
    waiting = stored(rest.where("needs > 0").withColumn("level", F.lit(-1)).withColumn("done", F.lit(0.0)))
    ready, edges = [front], stored(edges.distinct())
    while not front.isEmpty():
        met = edges.join(front, F.col("src") == F.col("step")).groupBy("dst").agg(F.count(F.lit(1)).alias("k"), F.max("level").alias("l"), F.max("done").alias("d"))
        now = waiting.join(met, F.col("step") == F.col("dst"), "left").select(
            "step", "cost", (F.col("needs") - F.coalesce("k", F.lit(0))).alias("needs"), F.greatest("level", "l").alias("level"), F.greatest("done", "d").alias("done")
        )
        now = stored(now)
        front = now.where("needs = 0").select("step", (F.col("level") + 1).alias("level"), (F.col("done") + F.col("cost")).alias("done"))
        waiting = now.where("needs > 0")
        ready.append(front)
    every = ready[0]
    for r in ready[1:]:
        every = every.unionByName(r)
    return every.unionByName(waiting.select("step", F.lit(None).cast("int").alias("level"), F.lit(None).cast("double").alias("done")))


def closure(start: DataFrame, edges: DataFrame) -> DataFrame:
    """The steps that can be reached from ``start`` (step), themselves included; each is gone on from once, so cycles end."""
    found = front = stored(start.select("step").distinct())
    while not front.isEmpty():
        new = edges.join(front, F.col("src") == F.col("step")).select(F.col("dst").alias("step")).distinct()
        front = stored(new.join(found, "step", "left_anti"))
        found = stored(found.unionByName(front))
    return found


def _graph(spark, sf_dir):
    """Orders as steps; each needs the orders a tenth and a fifteenth of its number."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"), "o_totalprice", "o_orderpriority")
    steps = o.select("step", (F.col("o_totalprice") / 1000).alias("cost"), F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW").alias("optional"))
    need = lambda n: o.where(F.col("step") >= n).select(F.floor(F.col("step") / n).alias("src"), F.col("step").alias("dst"))
    return steps, need(10).unionByName(need(15)).where("src > 0").distinct()


def dag_levels(spark, sf_dir):
    return levels(*_graph(spark, sf_dir)).select("step", "level")


def dag_cycle(spark, sf_dir):
    """With an edge back from 200 to 2, a cycle: the steps on it, and those behind it, have no level."""
    steps, edges = _graph(spark, sf_dir)
    back = steps.where("step = 200").select(F.col("step").alias("src"), F.lit(2).cast("long").alias("dst"))
    return levels(steps, edges.unionByName(back)).select("step", "level")


def dag_failed_closure(spark, sf_dir):
    """After step 3 fails: dropped optional dependents, and required ones that fail the chain."""
    steps, edges = _graph(spark, sf_dir)
    gone = closure(steps.where("step = 3"), edges)
    return gone.join(steps, "step").select("step", F.when(F.col("step") == 3, "failed").when(F.col("optional"), "dropped").otherwise("chain fails").alias("outcome"))


def critical_path(spark, sf_dir):
    """Earliest end of each step: its cost after the latest of its needs."""
    return levels(*_graph(spark, sf_dir), costs=True).select("step", F.round("done", 5).alias("done"))


def unknown_needs(spark, sf_dir):
    """Edges whose source is no step, by anti-join."""
    steps, edges = _graph(spark, sf_dir)
    more = edges.unionByName(steps.select((F.col("step") * 2).alias("src"), F.col("step").alias("dst")))
    return more.join(steps, more.src == steps.step, "left_anti")


def _bindings(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(
        F.col("l_orderkey").alias("step"), F.col("l_linenumber").alias("port"), F.when(F.col("l_returnflag") == "R", "https://h/o").alias("url"),
        F.when(F.col("l_linestatus") == "O", F.col("l_partkey")).alias("from_step"), F.when(F.col("l_discount") >= 0.05, "/p").alias("path"), (F.col("l_tax") > 0.06).alias("retained"),
    )


def binding_exclusive(spark, sf_dir):
    """Bindings that don't name exactly one of url, step and path; and retained ones without a url."""
    n = sum((F.col(c).isNotNull().cast("int") for c in ("url", "from_step", "path")), F.lit(0))
    why = F.when(n != 1, F.concat(n.cast("string"), F.lit(" given"))).when(F.col("retained") & F.col("url").isNull(), "retained without a url")
    return _bindings(spark, sf_dir).groupBy(why.alias("why")).agg(F.count(F.lit(1)).alias("n")).where(F.col("why").isNotNull())


def port_unique(spark, sf_dir):
    return _bindings(spark, sf_dir).groupBy("step", "port").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def put_fanout(spark, sf_dir):
    """Puts of an order: the worst wait, the sum of retries, and how many before the first refusal."""
    l = load(spark, sf_dir, "lineitem")  # noqa: E741
    first = F.min(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")))
    g = l.groupBy("l_orderkey").agg(F.max("l_tax").alias("worst_wait"), F.round(F.sum("l_discount"), 3).alias("retry_s"), first.alias("stop"), F.max("l_linenumber").alias("last"))
    return g.select("l_orderkey", "worst_wait", "retry_s", F.coalesce(F.col("stop") - 1, F.col("last")).alias("reached"))


def step_rollup(spark, sf_dir):
    """Leg seconds by status: wait, run and put add up; the worst put is kept apart."""
    o = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")
    legs = o.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 3).alias("run_s"), F.round(F.sum("l_discount"), 3).alias("wait_s"), F.max("l_tax").alias("worst_put_s"), F.count(F.lit(1)).alias("puts")
    )
    return legs.withColumn("seconds", F.round(F.col("run_s") + F.col("wait_s"), 3))


def span_flatten(spark, sf_dir):
    """Nested timings as flat spans: one row per leg, with its ordinal in the step."""
    e = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("price"), F.array(F.struct(F.lit("slot").alias("leg"), F.col("l_tax").alias("s")), F.struct(F.lit("run").alias("leg"), F.col("l_quantity").alias("s")), F.struct(F.lit("put").alias("leg"), F.col("l_discount").alias("s"))).alias("legs"))
    flat = e.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price", F.posexplode("legs").alias("pos", "x"))
    w = Window.partitionBy("l_orderkey", "x.leg").orderBy("l_linenumber", "l_partkey", "l_suppkey", "price")
    return flat.select("l_orderkey", "l_partkey", "l_suppkey", "pos", "x.leg", F.col("x.s").alias("seconds"), (F.row_number().over(w) - 1).alias("ordinal"))


def legs_complete(spark, sf_dir):
    """Orders by the flags that their lines lack of the full set."""
    o = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("seen"))
    missing = F.array_except(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("seen"))
    return o.select(F.array_join(missing, ",").alias("missing")).groupBy("missing").agg(F.count(F.lit(1)).alias("n"))


def put_prefix(spark, sf_dir):
    """Lines of an order before its first returned one: puts stop at the first refusal."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    d = load(spark, sf_dir, "lineitem").withColumn("bad", F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).over(w))
    return d.where("bad = 0").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("puts"))


def output_weights(spark, sf_dir):
    """Every order with its lines' weight; absent outputs weigh nothing."""
    o, l = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")  # noqa: E741
    g = l.groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 2).alias("bytes"))
    return o.join(g, o.o_orderkey == g.l_orderkey, "left").select("o_orderkey", F.coalesce("bytes", F.lit(0.0)).alias("bytes"), F.col("bytes").isNotNull().alias("present"))


def shape_digest(spark, sf_dir):
    """A digest of each order's shape: its sorted parts, never their values."""
    l = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_partkey")).cast("array<string>"), ",").alias("parts"))  # noqa: E741
    return l.select("l_orderkey", F.sha2("parts", 256).alias("digest"))


QUERIES = [
    dag_levels, dag_cycle, dag_failed_closure, critical_path, unknown_needs, binding_exclusive, port_unique, put_fanout, step_rollup, span_flatten, legs_complete, put_prefix,
    output_weights, shape_digest,
]

_G = """s AS (SELECT o_orderkey AS step, o_totalprice / 1000 AS cost, o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') AS optional FROM orders),
e AS (SELECT DISTINCT src, step AS dst FROM (SELECT step // 10 AS src, step FROM s UNION ALL SELECT step // 15, step FROM s) WHERE src > 0)"""
_L = "w(step, level) AS (SELECT step, 0 FROM s WHERE step NOT IN (SELECT dst FROM {e}) UNION SELECT e.dst, level + 1 FROM w JOIN {e} e ON src = step WHERE level <= 40) SELECT s.step, CASE WHEN max(level) <= 40 THEN max(level) END AS level FROM s LEFT JOIN w ON w.step = s.step GROUP BY 1"
_B = """b AS (SELECT l_orderkey AS step, l_linenumber AS port, l_returnflag = 'R' AS url, (l_returnflag = 'R')::INT + (l_linestatus = 'O')::INT + (l_discount >= 0.05)::INT AS n, l_tax > 0.06 AS retained FROM lineitem)"""
ORACLES = {
    "dag_levels": f"WITH RECURSIVE {_G}, {_L.format(e='e')}",
    # on or behind the cycle: whatever 2 reaches
    "dag_cycle": f"""WITH RECURSIVE {_G}, g(step) AS (SELECT step FROM s WHERE step = 2 AND EXISTS (SELECT 1 FROM s WHERE step = 200) UNION SELECT dst FROM g JOIN e ON src = g.step),
w(step, level) AS (SELECT step, 0 FROM s WHERE step NOT IN (SELECT dst FROM e) UNION SELECT e.dst, level + 1 FROM w JOIN e ON src = step WHERE level <= 40) SELECT s.step, CASE WHEN s.step NOT IN (SELECT step FROM g) THEN max(level) END AS level FROM s LEFT JOIN w ON w.step = s.step GROUP BY s.step""",
    "dag_failed_closure": f"WITH RECURSIVE {_G}, g(step) AS (SELECT step FROM s WHERE step = 3 UNION SELECT dst FROM g JOIN e ON src = g.step) SELECT step, CASE WHEN step = 3 THEN 'failed' WHEN optional THEN 'dropped' ELSE 'chain fails' END AS outcome FROM g JOIN s USING (step)",
    "critical_path": f"WITH RECURSIVE {_G}, w(step, done) AS (SELECT step, cost FROM s WHERE step NOT IN (SELECT dst FROM e) UNION ALL SELECT e.dst, done + s.cost FROM w JOIN e ON src = w.step JOIN s ON s.step = e.dst) SELECT step, round(max(done), 5) AS done FROM w GROUP BY 1",
    "unknown_needs": f"WITH {_G} SELECT src, dst FROM (SELECT * FROM e UNION ALL SELECT step * 2, step FROM s) x WHERE src NOT IN (SELECT step FROM s)",
    "binding_exclusive": f"WITH {_B}, w AS (SELECT CASE WHEN n <> 1 THEN n || ' given' WHEN retained AND NOT url THEN 'retained without a url' END AS why FROM b) SELECT why, count(*) AS n FROM w WHERE why IS NOT NULL GROUP BY 1",
    "port_unique": f"WITH {_B} SELECT step, port, count(*) AS n FROM b GROUP BY 1, 2 HAVING count(*) > 1",
    "put_fanout": "SELECT l_orderkey, max(l_tax) AS worst_wait, round(sum(l_discount), 3) AS retry_s, coalesce(min(l_linenumber) FILTER (l_returnflag = 'R') - 1, max(l_linenumber))::INT AS reached FROM lineitem GROUP BY 1",
    "step_rollup": """WITH g AS (SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 3) AS run_s, round(sum(l_discount), 3) AS wait_s, max(l_tax) AS worst_put_s, count(*) AS puts FROM lineitem GROUP BY 1, 2)
SELECT *, round(run_s + wait_s, 3) AS seconds FROM g""",
    "span_flatten": """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS price, 0 AS pos, 'slot' AS leg, l_tax AS seconds FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 1, 'run', l_quantity FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 2, 'put', l_discount FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, pos, leg, seconds, (row_number() OVER (PARTITION BY l_orderkey, leg ORDER BY l_linenumber, l_partkey, l_suppkey, price) - 1)::INT AS ordinal FROM f""",
    "legs_complete": """WITH g AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS seen FROM lineitem GROUP BY 1)
SELECT array_to_string(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(seen, x)), ',') AS missing, count(*) AS n FROM g GROUP BY 1""",
    "put_prefix": """WITH d AS (SELECT l_orderkey, max((l_returnflag = 'R')::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS bad FROM lineitem) SELECT l_orderkey, count(*) AS puts FROM d WHERE bad = 0 GROUP BY 1""",
    "output_weights": "WITH g AS (SELECT l_orderkey, round(sum(l_quantity), 2) AS bytes FROM lineitem GROUP BY 1) SELECT o_orderkey, coalesce(bytes, 0) AS bytes, bytes IS NOT NULL AS present FROM orders LEFT JOIN g ON o_orderkey = l_orderkey",
    "shape_digest": "SELECT l_orderkey, sha256(string_agg(p::VARCHAR, ',' ORDER BY p)) AS digest FROM (SELECT DISTINCT l_orderkey, l_partkey AS p FROM lineitem) GROUP BY 1",
}
