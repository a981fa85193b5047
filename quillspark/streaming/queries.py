"""Structured Streaming forms: a file source, event time, watermarks, keyed state.

Each query runs over what is there (``availableNow``) and returns its sink's
rows, so they can be compared with the batch forms.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.rounds import shared_folder


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events", files: int | None = None) -> DataFrame:
    """The table's files as a stream, at most ``files`` in a batch; ``ts`` gets the zone that watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    s = (s.option("maxFilesPerTrigger", files) if files else s).parquet(f"{sf_dir}/{table}.parquet*")
    return s.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in s.columns else s


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over all there is; the rows of its Parquet sink, or of its last complete result."""
    spark, at = df.sparkSession, shared_folder(df.sparkSession, "stream")
    w = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/state")
    if mode == "append":
        w.format("parquet").option("path", f"{at}/out").start().awaitTermination()
    else:  # each batch replaces the result before it
        w.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out")).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def stream_dedup(spark, sf_dir):
    """Exactly one frame for each identity, though the stream brings each twice."""
    e = event_stream(spark, sf_dir).withWatermark("ts", "31 days")
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).dropDuplicatesWithinWatermark(["event_id"])
    return drained(twice.select("event_id", "user_id"))


def stream_tumbling(spark, sf_dir):
    """Hourly counts by type; complete mode gives the open windows too."""
    e = event_stream(spark, sf_dir).withWatermark("ts", "1 hour")
    out = drained(e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")), "complete")
    return out.select(F.unix_seconds("w.start").alias("hour"), "event_type", "n", F.round("v", 3).alias("v"))


def stream_sessions(spark, sf_dir):
    """Sessions by user with a gap of thirty minutes."""
    e = event_stream(spark, sf_dir).withWatermark("ts", "1 hour")
    out = drained(e.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")), "complete")
    return out.select("user_id", F.unix_micros("w.start").alias("a"), "n")


def settled(acks: DataFrame, key: str, seq: str, ok: str) -> DataFrame:
    """In-order settlement of a stream of acknowledgements (key, seq from 1 without gaps, ok).

    A frame settles when it and all before it are acknowledged with ``ok``, in whatever
    order and batch that comes; a refused one settles by a later one with ``ok``. The state of a
    key is the next number to settle and those acknowledged beyond it, so it is as
    large as its window of frames in flight.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def settle(k, batches, state):
        following, ahead = state.get if state.exists else (1, [])
        ahead = set(ahead)
        for b in batches:
            ahead.update(int(x) for x in b[b[ok]][seq] if x >= following)
        done = []
        while following in ahead:
            ahead.remove(following)
            done.append(following)
            following += 1
        state.update((following, sorted(ahead)))
        yield pd.DataFrame({key: [k[0]] * len(done), seq: done})

    return acks.select(key, seq, ok).groupBy(key).applyInPandasWithState(settle, f"{key} long, {seq} long", "following long, ahead array<long>", "append", GroupStateTimeout.NoTimeout)


def stream_settle(spark, sf_dir, files: int | None = None):
    """Each user's frames settle in order; those to be tried again settle if a second try (value of 100 or more) is acknowledged."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    seqs = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.row_number().over(w).cast("long").alias("seq"))
    e = event_stream(spark, sf_dir, files=files).select("user_id", "event_id", F.col("event_type").isin("click", "view", "purchase").alias("first"), (F.col("value") >= 100).alias("second"))
    tries = e.withColumn("ok", F.explode(F.array("first", F.col("first") | F.col("second"))))
    return drained(settled(tries.join(seqs, "event_id").select("user_id", "seq", "ok"), "user_id", "seq", "ok"))


def latched(events: DataFrame, key: str, order: str, signal: str) -> DataFrame:
    """(key, order, open): whether a key's admission is open after each event of a stream.

    A "fatal" signal closes it for good; "pending" closes it until "drained" finds the
    outbox empty. Events of a batch are taken in ``order``; a batch follows those before it.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def admit(k, batches, state):
        (now,) = state.get if state.exists else ("open",)
        rows = pd.concat(list(batches)).sort_values(order)  # one trigger's rows of a key
        out = []
        for s in rows[signal]:
            if now != "fatal":
                now = "fatal" if s == "fatal" else "pending" if s == "pending" else "open" if s == "drained" else now
            out.append(now == "open")
        state.update((now,))
        yield pd.DataFrame({key: k[0], order: rows[order], "open": out})

    return events.select(key, order, signal).groupBy(key).applyInPandasWithState(admit, f"{key} long, {order} long, open boolean", "now string", "append", GroupStateTimeout.NoTimeout)


def stream_latch(spark, sf_dir, files: int | None = None):
    """Admission by user: an error is pending until a view drains it, a purchase of 150 or more is fatal."""
    t = F.col("event_type")
    signal = F.when((t == "purchase") & (F.col("value") >= 150), "fatal").when(t == "error", "pending").when(t == "view", "drained").otherwise("none")
    e = event_stream(spark, sf_dir, files=files).select("user_id", "event_id", signal.alias("signal"))
    return drained(latched(e, "user_id", "event_id", "signal"))


def split_sinks(df: DataFrame, sinks: dict[str, Column]) -> dict[str, DataFrame]:
    """Each batch's rows to one table per condition, written under the batch's number, so that a
    batch that runs again replaces what it wrote before."""
    spark, at = df.sparkSession, shared_folder(df.sparkSession, "sinks")

    def write(batch: DataFrame, n: int) -> None:
        for name, rule in sinks.items():
            batch.where(rule).write.mode("overwrite").parquet(f"{at}/{name}/batch={n}")

    df.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{at}/state").foreachBatch(write).start().awaitTermination()
    return {name: spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{at}/{name}") for name in sinks}


def stream_sinks(spark, sf_dir, files: int | None = None):
    """Acknowledged frames go, refused ones to the dead letters, the others stay pending."""
    t = F.col("event_type")
    e = event_stream(spark, sf_dir, files=files).select("event_id", "event_type")
    found = split_sinks(e, {"retired": t.isin("click", "view"), "dead": t == "purchase", "pending": ~t.isin("click", "view", "purchase")})
    out = None
    for name, df in found.items():
        one = df.select("event_id", F.lit(name).alias("sink"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = [stream_sinks, stream_dedup, stream_tumbling, stream_sessions, stream_settle, stream_latch]

ORACLES = {
    "stream_sinks": "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'retired' WHEN event_type = 'purchase' THEN 'dead' ELSE 'pending' END AS sink FROM events",
    "stream_dedup": "SELECT event_id, user_id FROM events",
    "stream_tumbling": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour, event_type, count(*) AS n, round(sum(value), 3) AS v FROM events GROUP BY 1, 2",
    "stream_sessions": """WITH l AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), i AS (SELECT user_id, us, sum((p IS NULL OR us - p > 1800000000)::INT) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, min(us) AS a, count(*) AS n FROM i GROUP BY user_id, k""",
    "stream_settle": """WITH p AS (SELECT user_id, row_number() OVER w AS seq, event_id, min(event_id) FILTER (event_type NOT IN ('click', 'view', 'purchase') AND value < 100) OVER (PARTITION BY user_id) AS stop FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, seq FROM p WHERE stop IS NULL OR event_id < stop""",
    "stream_latch": """WITH p AS (SELECT user_id, event_id, min(event_id) FILTER (event_type = 'purchase' AND value >= 150) OVER (PARTITION BY user_id) AS stop,
arg_max(event_type, event_id) FILTER (event_type IN ('error', 'view')) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last FROM events)
SELECT user_id, event_id, (stop IS NULL OR event_id < stop) AND coalesce(last, 'view') = 'view' AS open FROM p""",
}
