"""The event stream in batch form: verdicts, ordered settlement, dedupe, clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import load, micros
from .sequential import keep_in_order

# The status code that stands for each event type here.
STATUS = {"click": 200, "view": 202, "purchase": 409, "signup": 503}


def verdict(status):
    """2xx accepts, 4xx rejects, all else is tried again."""
    return F.when(status.between(200, 299), "accepted").when(status.between(400, 499), "rejected").otherwise("retry")


def settled_prefix_of(frames: DataFrame, stream: str, seq: str, settled: str) -> DataFrame:
    """Frames before their stream's first unsettled one."""
    w = Window.partitionBy(stream)
    stop = F.min(F.when(~F.col(settled), F.col(seq))).over(w)
    return frames.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col(seq) < F.col("stop"))).drop("stop")


def clock_bounds_of(samples: DataFrame, key: str, order: str, last: int = 64) -> DataFrame:
    """Offset bounds from four timestamps, over the last samples: max of the lower, min of the upper."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    recent = samples.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= last)
    theta = recent.select(key, (F.col("server_recv") - F.col("send")).alias("hi"), (F.col("server_send") - F.col("recv")).alias("lo"))
    return theta.groupBy(key).agg(F.max("lo").alias("theta_min"), F.min("hi").alias("theta_max"), F.count(F.lit(1)).alias("n"))


def _status():
    c = F.lit(500)
    for k, v in STATUS.items():
        c = F.when(F.col("event_type") == k, v).otherwise(c)
    return c


def _frames(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros().alias("us"), _status().alias("status")).withColumn("verdict", verdict(F.col("status")))


def ack_verdict(spark, sf_dir):
    return _frames(spark, sf_dir).groupBy("status", "verdict").agg(F.count(F.lit(1)).alias("n"))


def settled_prefix(spark, sf_dir):
    d = _frames(spark, sf_dir).withColumn("ok", F.col("verdict") != "retry")
    return settled_prefix_of(d, "user_id", "event_id", "ok").select("user_id", "event_id", "verdict")


def dead_letter(spark, sf_dir):
    """Rejected frames of the settled prefix."""
    return settled_prefix(spark, sf_dir).where(F.col("verdict") == "rejected")


def retry_suffix(spark, sf_dir):
    d = _frames(spark, sf_dir).where(F.col("verdict") == "retry")
    return d.groupBy("user_id").agg(F.min("event_id").alias("head"), F.count(F.lit(1)).alias("pending"))


def in_flight(spark, sf_dir):
    """At most 32 frames of a stream in flight: the window each frame is sent in."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    d = _frames(spark, sf_dir).withColumn("i", F.row_number().over(w) - 1)
    return d.select("event_id", F.floor(F.col("i") / 32).alias("flight")).groupBy("flight").agg(F.count(F.lit(1)).alias("n"))


def strict_ack(spark, sf_dir):
    """ACKs (purchases a second later) against frames: those of no frame are protocol errors."""
    d = _frames(spark, sf_dir)
    acks = d.select(F.when(F.col("event_type") == "purchase", -F.col("event_id") - 1).otherwise(F.col("event_id")).alias("seq"))
    return acks.join(d.select(F.col("event_id").alias("seq")), "seq", "left_anti")


def delivery_outcomes(df: DataFrame, delivery: list[str], attempt: str, content: Column) -> DataFrame:
    """(delivery ..., frames, outcome) of each delivery: new, a replay of the same content in the same attempt, or a conflict."""
    g = df.groupBy(*delivery).agg(F.count(F.lit(1)).alias("frames"), F.count_distinct(content).alias("_c"), F.count_distinct(attempt).alias("_a"))
    outcome = F.when((F.col("_c") > 1) | (F.col("_a") > 1), "conflict").when(F.col("frames") > 1, "replay").otherwise("new")
    return g.select(*delivery, "frames", outcome.alias("outcome"))


def delivery_dedupe(spark, sf_dir):
    """Lines as deliveries of an order's number; its attempt is the flag, its content the part."""
    l = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_partkey") % 3).alias("part"))  # noqa: E741
    return delivery_outcomes(l, ["l_orderkey", "l_linenumber"], "l_returnflag", F.sha2(F.col("part").cast("string"), 256))


def result_once(spark, sf_dir):
    """One result for each (user, type): the first; how many came after."""
    g = _frames(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("us", "event_id")).alias("kept"), (F.count(F.lit(1)) - 1).alias("repeats"))
    return g


def clock_bounds(spark, sf_dir):
    d = _frames(spark, sf_dir)
    jitter = (F.col("event_id") * 7919 % 1000).cast("long")
    s = d.select("user_id", "us", F.col("us").alias("send"), (F.col("us") + 5000 + jitter).alias("server_recv"), (F.col("us") + 6000 + jitter).alias("server_send"), (F.col("us") + 9000 + 2 * jitter).alias("recv"))
    return clock_bounds_of(s, "user_id", "us")


def allowed_restarts(df: DataFrame, key: str, t: str, most: int, span: float) -> DataFrame:
    """The restarts of each box that its limit lets through: fewer than ``most`` allowed ones in
    the ``span`` before. Refused ones are not recorded, so they don't count."""

    def decide(recent, now):
        recent = tuple(x for x in recent if now - x < span)
        return (True, (*recent, now)) if len(recent) < most else (False, recent)

    return keep_in_order(df, key, [t], (), decide, t)


def restart_limit(spark, sf_dir):
    """Users' restarts (purchases) of which three in ten days are allowed."""
    d = _frames(spark, sf_dir).where(F.col("event_type") == "purchase").select("user_id", "event_id", F.floor(F.col("us") / 1_000_000).alias("s"))
    return allowed_restarts(d, "user_id", "s", 3, 864_000).select("event_id", "user_id")


def dispatch_routes(spark, sf_dir):
    route = F.when(F.col("event_type").isin("click", "view"), "ops").when(F.col("event_type") == "purchase", "rank").otherwise("heavy")
    return _frames(spark, sf_dir).groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("load"))


def first_success(spark, sf_dir):
    """Boot time is billed once: on a user's first accepted frame."""
    ok = _frames(spark, sf_dir).where(F.col("verdict") == "accepted")
    return ok.groupBy("user_id").agg(F.min_by("event_id", F.struct("us", "event_id")).alias("billed"))


def exit_kind(spark, sf_dir):
    """Each start after the previous event: planned, none or unclean."""
    w = Window.partitionBy("user_id").orderBy("us")
    d = _frames(spark, sf_dir).withColumn("before", F.lag("event_type").over(w))
    kind = F.when(F.col("before").isNull(), "none").when(F.col("before") == "purchase", "planned").otherwise("unclean")
    return d.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def replay_missing(spark, sf_dir):
    """Bootstrap frames to send again: users' first frames that no pending frame repeats."""
    d = _frames(spark, sf_dir)
    head = d.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    pending = d.where(F.col("verdict") == "retry").select("event_id")
    return head.join(pending, "event_id", "left_anti")


QUERIES = [
    ack_verdict, settled_prefix, dead_letter, retry_suffix, in_flight, strict_ack, delivery_dedupe, result_once, clock_bounds, restart_limit, dispatch_routes,
    first_success, exit_kind, replay_missing,
]

_F = "f AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in STATUS.items()) + " ELSE 500 END AS status FROM events), v AS (SELECT *, CASE WHEN status BETWEEN 200 AND 299 THEN 'accepted' WHEN status BETWEEN 400 AND 499 THEN 'rejected' ELSE 'retry' END AS verdict FROM f)"
_P = f"{_F}, p AS (SELECT *, min(event_id) FILTER (verdict = 'retry') OVER (PARTITION BY user_id) AS stop FROM v)"
ORACLES = {
    "ack_verdict": f"WITH {_F} SELECT status, verdict, count(*) AS n FROM v GROUP BY 1, 2",
    "settled_prefix": f"WITH {_P} SELECT user_id, event_id, verdict FROM p WHERE stop IS NULL OR event_id < stop",
    "dead_letter": f"WITH {_P} SELECT user_id, event_id, verdict FROM p WHERE (stop IS NULL OR event_id < stop) AND verdict = 'rejected'",
    "retry_suffix": f"WITH {_F} SELECT user_id, min(event_id) AS head, count(*) AS pending FROM v WHERE verdict = 'retry' GROUP BY 1",
    "in_flight": f"WITH {_F}, i AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM v) SELECT (i // 32)::BIGINT AS flight, count(*) AS n FROM i GROUP BY 1",
    "strict_ack": "SELECT -event_id - 1 AS seq FROM events WHERE event_type = 'purchase'",
    "delivery_dedupe": "SELECT l_orderkey, l_linenumber, count(*) AS frames, CASE WHEN count(DISTINCT l_partkey % 3) > 1 OR count(DISTINCT l_returnflag) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'replay' ELSE 'new' END AS outcome FROM lineitem GROUP BY 1, 2",
    "result_once": "SELECT user_id, event_type, arg_min(event_id, epoch_us(ts)) AS kept, count(*) - 1 AS repeats FROM events GROUP BY 1, 2",
    "clock_bounds": f"""WITH {_F}, r AS (SELECT *, event_id * 7919 % 1000 AS j, row_number() OVER (PARTITION BY user_id ORDER BY us DESC) AS rn FROM f)
SELECT user_id, max((us + 6000 + j) - (us + 9000 + 2 * j)) AS theta_min, min((us + 5000 + j) - us) AS theta_max, count(*) AS n FROM r WHERE rn <= 64 GROUP BY 1""",
    "restart_limit": f"""WITH RECURSIVE {_F}, p AS (SELECT user_id, event_id, us // 1000000 AS s, row_number() OVER (PARTITION BY user_id ORDER BY us) AS rn FROM f WHERE event_type = 'purchase'),
t AS (SELECT user_id, event_id, rn, true AS ok, [s] AS recent FROM p WHERE rn = 1 UNION ALL
SELECT p.user_id, p.event_id, p.rn, len(list_filter(t.recent, lambda x: p.s - x < 864000)) < 3, CASE WHEN len(list_filter(t.recent, lambda x: p.s - x < 864000)) < 3 THEN list_append(list_filter(t.recent, lambda x: p.s - x < 864000), p.s) ELSE t.recent END
FROM t JOIN p ON p.user_id = t.user_id AND p.rn = t.rn + 1) SELECT event_id, user_id FROM t WHERE ok""",
    "dispatch_routes": "SELECT CASE WHEN event_type IN ('click', 'view') THEN 'ops' WHEN event_type = 'purchase' THEN 'rank' ELSE 'heavy' END AS route, count(*) AS n, round(sum(value), 3) AS load FROM events GROUP BY 1",
    "first_success": f"WITH {_F} SELECT user_id, arg_min(event_id, us) AS billed FROM v WHERE verdict = 'accepted' GROUP BY 1",
    "exit_kind": "WITH l AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events) SELECT CASE WHEN b IS NULL THEN 'none' WHEN b = 'purchase' THEN 'planned' ELSE 'unclean' END AS kind, count(*) AS n FROM l GROUP BY 1",
    "replay_missing": f"WITH {_F}, h AS (SELECT user_id, min(event_id) AS event_id FROM v GROUP BY 1) SELECT event_id, user_id FROM h WHERE event_id NOT IN (SELECT event_id FROM v WHERE verdict = 'retry')",
}
