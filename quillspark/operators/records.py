"""Durable stream state in batch form: frame checks, invariants, appending, contexts, and defaults."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..sources.tables import load, micros

# Kinds of frames and the patterns of their identities; walls of a delivery, in seconds.
KINDS = ("event", "result", "job_ack")
STREAM_ID, ATTEMPT_ID = r"^[A-Za-z0-9_.-]{1,128}$", r"^[0-9a-f]{32}$"
FRAME_WALL, OPEN_WALL, REOPENS, BACKOFF = 10.0, 10.0, 2, 0.25


def frame_problem(kind: Column, keys: Column, stream_id: Column, seq: Column, attempt_id: Column) -> Column:
    """The first rule that a frame breaks; null for a sound one. Its keys are a closed set, by kind."""
    fixed = F.array(F.lit("type"), F.lit("stream_id"), F.lit("seq"), kind)
    want = F.array_sort(F.when(kind == "result", F.concat(fixed, F.array(F.lit("attempt_id")))).otherwise(fixed))
    return (
        F.when(kind.isNull() | ~kind.isin(*KINDS), "type")
        .when(F.array_sort(keys) != want, "keys")
        .when(stream_id.isNull() | ~stream_id.rlike(STREAM_ID), "stream_id")
        .when(seq.isNull() | (seq < 1), "seq")
        .when((kind == "result") & (attempt_id.isNull() | ~attempt_id.rlike(ATTEMPT_ID)), "attempt_id")
    )


def delivery_wall(frame: Column, open_: Column, reopens: Column, backoff: Column) -> Column:
    return (reopens + 1) * (open_ + frame) + reopens * backoff + 2.0


def _frames(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros().alias("us"))


def frame_checks(spark, sf_dir):
    """Frames as JSON, some malformed; those that are not sound go to a side table with the rule they break."""
    e = _frames(spark, sf_dir)
    kind = F.when(F.col("event_type") == "view", "result").when(F.col("event_type") == "error", "hello").when(F.col("event_type") == "signup", "job_ack").otherwise("event")
    # a key more on every eleventh frame; a bad identity on every seventh; an attempt cut short on every fifth
    fields = [
        F.lit('{"type":"'), kind, F.lit('","stream_id":"'), F.when(F.col("event_id") % 7 == 0, "bad id").otherwise(F.concat(F.lit("u-"), F.col("user_id").cast("string"))), F.lit('","seq":'),
        F.col("event_id").cast("string"), F.lit(',"'), kind, F.lit('":1'), F.when(F.col("event_type") == "view", F.concat(F.lit(',"attempt_id":"'), F.when(F.col("event_id") % 5 == 0, "ab").otherwise(F.md5(F.col("event_id").cast("string"))), F.lit('"'))).otherwise(""),
        F.when(F.col("event_id") % 11 == 0, ',"more":0').otherwise(""), F.lit("}"),
    ]
    d = e.withColumn("frame", F.concat(*fields)).withColumn("m", F.from_json("frame", "map<string,string>"))
    got = lambda k: F.get(F.map_values(F.map_filter("m", lambda key, _: key == k)), F.lit(0))
    problem = frame_problem(got("type"), F.map_keys("m"), got("stream_id"), got("seq").try_cast("long"), got("attempt_id"))
    return d.select("event_id", problem.alias("problem")).where(F.col("problem").isNotNull())


def state_invariants(spark, sf_dir):
    """What a loaded state must not have: repeated identities, jobs and deliveries without each other, jobs that have a result."""
    e = _frames(spark, sf_dir)
    twice = e.groupBy("user_id", F.floor(F.col("us") / 3_600_000_000).alias("seq")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated identity").alias("rule"), "user_id", F.col("seq").alias("id"))
    key = lambda t, name: e.where(F.col("event_type") == t).select("user_id", F.floor("value").alias("id")).distinct().withColumn(name, F.lit(True))
    both = key("click", "inbox").join(key("view", "delivery"), ["user_id", "id"], "full_outer")
    alone = both.select(F.when(F.col("delivery").isNull(), "no delivery").when(F.col("inbox").isNull(), "no job").alias("rule"), "user_id", "id").where(F.col("rule").isNotNull())
    done = key("click", "inbox").join(key("purchase", "result"), ["user_id", "id"], "left_semi").select(F.lit("completed").alias("rule"), "user_id", "id")
    every = twice.unionByName(alone).unionByName(done)
    return every.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def append_frames(spark, sf_dir):
    """Frames numbered in order of arrival. A result (purchase) retires its job (click of the same
    whole value); a second result of one identity is refused and takes no number."""
    e = _frames(spark, sf_dir).withColumn("corr", F.floor("value"))
    w = Window.partitionBy("user_id", "corr").orderBy("us", "event_id")
    is_result = F.col("event_type") == "purchase"
    nth = F.sum(is_result.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = e.withColumn("refused", is_result & (nth > 1)).withColumn("job", (F.col("event_type") == "click")).withColumn("open", F.last(F.when(F.col("event_type").isin("click", "purchase"), F.col("event_type")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)) == "click")
    seq = F.sum((~F.col("refused")).cast("int")).over(Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return d.select("event_id", F.when(~F.col("refused"), seq).alias("seq"), (is_result & ~F.col("refused") & F.coalesce("open", F.lit(False))).alias("retires"))


def context_completeness(spark, sf_dir):
    """Why each user's timeline context is incomplete: no delivery, no clock samples."""
    u = _frames(spark, sf_dir).groupBy("user_id").agg(F.bool_or((F.col("event_type") == "view") & (F.col("value") > 150)).alias("delivery"), F.bool_or((F.col("event_type") == "signup") & (F.col("value") > 150)).alias("clock"))
    why = F.array_compact(F.array(F.when(~F.col("delivery"), "delivery_context_missing"), F.when(~F.col("clock"), "clock_sync_missing")))
    return u.select("user_id", (F.size(why) == 0).alias("complete"), F.array_join(why, ",").alias("reasons"))


def malformed_jobs(spark, sf_dir):
    """Jobs that can't be read: a typed end where they can be addressed, else a protocol error."""
    text = F.when(F.col("event_type") == "error", F.concat(F.lit('{"corr_id":"'), F.col("event_id").cast("string"), F.lit('","job":7}'))).when(F.col("event_type") == "signup", F.lit("{broken")).otherwise(F.concat(F.lit('{"corr_id":"'), F.col("event_id").cast("string"), F.lit('","job":{"type":"ops"}}')))
    d = _frames(spark, sf_dir).withColumn("text", text)
    corr, kind = F.get_json_object("text", "$.corr_id"), F.get_json_object("text", "$.job.type")
    outcome = F.when(kind.isNotNull(), "job").when(corr.isNotNull(), "error result").otherwise("protocol error")
    return d.select("event_id", outcome.alias("outcome"), corr.alias("corr_id"))


def delivery_walls(spark, sf_dir):
    """The longest that one delivery may take, by priority."""
    n = F.substring("o_orderpriority", 1, 1).cast("int")
    return load(spark, sf_dir, "orders").select("o_orderpriority").distinct().select("o_orderpriority", delivery_wall(F.lit(FRAME_WALL), F.lit(OPEN_WALL), n, F.lit(BACKOFF)).alias("wall_s"))


def stamped(spark, sf_dir):
    """Frames without a time of their own get the time of receipt, in UTC."""
    own = F.when(F.col("event_type") != "error", F.floor(F.col("us") / 1_000_000))
    at = F.timestamp_seconds(F.coalesce(own, F.lit(1_706_745_600)))
    return _frames(spark, sf_dir).select("event_id", F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"))


QUERIES = [frame_checks, state_invariants, append_frames, context_completeness, malformed_jobs, delivery_walls, stamped]

_F = "f AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us FROM events)"
ORACLES = {
    "frame_checks": """WITH w AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'type' WHEN event_id % 11 = 0 THEN 'keys' WHEN event_id % 7 = 0 THEN 'stream_id' WHEN event_id < 1 THEN 'seq' WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'attempt_id' END AS problem FROM events) SELECT * FROM w WHERE problem IS NOT NULL""",
    "state_invariants": f"""WITH {_F}, k AS (SELECT DISTINCT event_type, user_id, floor(value)::BIGINT AS id FROM f), i AS (SELECT user_id, id FROM k WHERE event_type = 'click'), d AS (SELECT user_id, id FROM k WHERE event_type = 'view'), r AS (SELECT user_id, id FROM k WHERE event_type = 'purchase'),
x AS (SELECT 'repeated identity' AS rule, (us // 3600000000)::BIGINT AS id FROM f GROUP BY user_id, 2 HAVING count(*) > 1 UNION ALL SELECT 'no delivery', id FROM (SELECT * FROM i EXCEPT SELECT * FROM d) UNION ALL SELECT 'no job', id FROM (SELECT * FROM d EXCEPT SELECT * FROM i) UNION ALL SELECT 'completed', id FROM (SELECT * FROM i INTERSECT SELECT * FROM r))
SELECT rule, count(*) AS n, sum(id)::BIGINT AS ids FROM x GROUP BY 1""",
    "append_frames": f"""WITH {_F}, c AS (SELECT *, floor(value)::BIGINT AS corr FROM f), n AS (SELECT *, event_type = 'purchase' AND count(*) FILTER (event_type = 'purchase') OVER w > 1 AS refused,
arg_max(event_type, (us, event_id)) FILTER (event_type IN ('click', 'purchase')) OVER (PARTITION BY user_id, corr ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM c WINDOW w AS (PARTITION BY user_id, corr ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, sum((NOT refused)::INT) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS q FROM n) SELECT event_id, CASE WHEN NOT refused THEN q END AS seq, event_type = 'purchase' AND NOT refused AND coalesce(b = 'click', false) AS retires FROM s""",
    "context_completeness": """WITH u AS (SELECT user_id, bool_or(event_type = 'view' AND value > 150) AS d, bool_or(event_type = 'signup' AND value > 150) AS c FROM events GROUP BY 1)
SELECT user_id, d AND c AS complete, concat_ws(',', CASE WHEN NOT d THEN 'delivery_context_missing' END, CASE WHEN NOT c THEN 'clock_sync_missing' END) AS reasons FROM u""",
    "malformed_jobs": "SELECT event_id, CASE event_type WHEN 'error' THEN 'error result' WHEN 'signup' THEN 'protocol error' ELSE 'job' END AS outcome, CASE WHEN event_type <> 'signup' THEN event_id::VARCHAR END AS corr_id FROM events",
    "delivery_walls": "SELECT DISTINCT o_orderpriority, (left(o_orderpriority, 1)::INT + 1) * 20.0::DOUBLE + left(o_orderpriority, 1)::INT * 0.25::DOUBLE + 2 AS wall_s FROM orders",
    "stamped": "SELECT event_id, strftime(CASE WHEN event_type <> 'error' THEN ts ELSE TIMESTAMP '2024-02-01 00:00:00' END, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM events",
}
