"""Signal measurement: envelopes, differences, silence, boundaries, samples, peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.running import running
from ..sources.tables import load, seconds
from .sequential import keep_in_order

FLOOR = 1e-6


def decibels(rms: Column) -> Column:
    return 20 * F.log10(F.greatest(rms, F.lit(FLOOR)))


def sliding_rms(df: DataFrame, key: str, order: str, value: str, width: int) -> DataFrame:
    """Adds ``rms`` over each sample and the ``width`` - 1 before it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - width, 0)
    return df.withColumn("rms", F.sqrt(F.avg(F.col(value) * F.col(value)).over(w)))


def differences(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds ``diff``: the distance to the previous sample, 0 for the first."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("diff", F.coalesce(F.abs(F.col(value) - before), F.lit(0.0)))


def quiet_spans(df: DataFrame, probes: DataFrame, key: str, t: str, level: str) -> DataFrame:
    """Spans of consecutive samples under each probe's noise level that last its least time."""
    # each sample meets each probe: there are eight at most, by a check of what is given
    rows = probes.limit(9).collect()
    if len(rows) > 8:
        raise ValueError("more than eight probes")
    p = df.withColumn("_p", F.explode(F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, probes.schema))) for r in rows)))).select("*", "_p.*").drop("_p")
    low = p.withColumn("quiet", F.col(level) < F.col("noise"))
    w = Window.partitionBy(key, "probe").orderBy(t)
    runs = low.withColumn("run", F.row_number().over(w) - F.row_number().over(Window.partitionBy(key, "probe", "quiet").orderBy(t)))
    spans = runs.where("quiet").groupBy(key, "probe", "run").agg(F.min(t).alias("a"), F.max(t).alias("b"), F.first("min_d").alias("min_d"), F.count(F.lit(1)).alias("n"))
    return spans.where(F.col("b") - F.col("a") >= F.col("min_d"))


def fraction_picks(df: DataFrame, key: str, order: str, fractions: list[float]) -> DataFrame:
    """The rows at the given fractions of each key's run: row 1 + floor(p (n - 1))."""
    w = Window.partitionBy(key)
    d = df.withColumn("rn", F.row_number().over(w.orderBy(order))).withColumn("n", F.count(F.lit(1)).over(w))
    d = d.withColumn("p", F.explode(F.array(*map(F.lit, fractions))))
    return d.where(F.col("rn") == 1 + F.floor(F.col("p") * (F.col("n") - 1)))


def local_peaks(df: DataFrame, key: str, order: str, value: str, share: float) -> DataFrame:
    """Samples over both neighbours and over ``share`` of the key's greatest."""
    w = Window.partitionBy(key)
    o = w.orderBy(order)
    d = df.withColumns({"before": F.lag(value).over(o), "after": F.lead(value).over(o), "most": F.max(value).over(w)})
    return d.where((F.col(value) > F.col("before")) & (F.col(value) >= F.col("after")) & (F.col(value) > share * F.col("most"))).drop("before", "after", "most")


def or_fallback(found: DataFrame, every: DataFrame, key: str, t: str, fallback: float = 0.0) -> DataFrame:
    """(key, t) of what was found, and ``fallback`` for the keys of ``every`` without any."""
    none = every.select(key).distinct().join(found, key, "left_anti").select(key, F.lit(fallback).alias(t))
    return found.select(key, t).unionByName(none)


def refractory(peaks: DataFrame, key: str, t: str, gap: float) -> DataFrame:
    """Greedy in time: a peak counts if it lies ``gap`` beyond the last one that counts."""

    def decide(last, x):
        ok = last is None or x - last >= gap
        return ok, x if ok else last

    return keep_in_order(peaks, key, [t], None, decide, t)


def _samples(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", seconds().alias("s"))


def level_envelope(spark, sf_dir):
    d = sliding_rms(_samples(spark, sf_dir), "user_id", "s", "value", 8)
    return d.select("event_id", F.round(decibels(F.col("rms")), 4).alias("db"))


def level_windows(spark, sf_dir):
    """Hourly windows: peak and mean level, and the mean over the lead window of five minutes."""
    d = _samples(spark, sf_dir).withColumn("w", F.floor(F.col("s") / 3600))
    lead = F.avg(F.when(F.pmod(F.col("s"), F.lit(3600.0)) < 300, F.col("value")))
    return d.groupBy("w").agg(F.max("value").alias("peak"), F.round(F.avg("value"), 4).alias("mean"), F.round(lead, 4).alias("lead_mean"), F.count(F.lit(1)).alias("n"))


def framediff_stats(spark, sf_dir):
    d = differences(_samples(spark, sf_dir), "user_id", "s", "value").where(F.col("diff") > 0)
    m = d.groupBy("user_id").agg(F.median("diff").alias("median"))
    far = d.join(m, "user_id").groupBy("user_id").agg(F.first("median").alias("median"), F.median(F.abs(F.col("diff") - F.col("median"))).alias("mad"), F.count(F.lit(1)).alias("n"))
    return far.select("user_id", F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad"), "n")


def frame_diff(spark, sf_dir):
    return differences(_samples(spark, sf_dir), "user_id", "s", "value").select("event_id", F.round("diff", 6).alias("diff"))


def boundary_rms(spark, sf_dir):
    """At each purchase: level of the user's samples in the six hours before and after it."""
    e = _samples(spark, sf_dir)
    w = 21_600.0
    at = e.where(F.col("event_type") == "purchase").select("user_id", F.col("event_id").alias("boundary"), F.col("s").alias("t"))
    at = at.withColumn("cell", F.explode(F.sequence(F.floor((F.col("t") - w) / w), F.floor((F.col("t") + w) / w))))
    near = e.withColumn("cell", F.floor(F.col("s") / w)).join(at, ["user_id", "cell"]).where((F.col("s") >= F.col("t") - w) & (F.col("s") < F.col("t") + w))
    rms = lambda side: F.sqrt(F.avg(F.when(side, F.col("value") * F.col("value"))))
    out = near.groupBy("boundary").agg(rms(F.col("s") < F.col("t")).alias("b"), rms(F.col("s") >= F.col("t")).alias("a"))
    return out.select("boundary", F.round(F.coalesce("b", F.lit(0.0)), 4).alias("before"), F.round("a", 4).alias("after"), F.round(F.col("a") - F.coalesce("b", F.lit(0.0)), 4).alias("jump"))


def silence_spans(spark, sf_dir):
    probes = spark.createDataFrame([(0, 20.0, 0.0), (1, 50.0, 3600.0), (2, 80.0, 7200.0)], "probe int, noise double, min_d double")
    d = quiet_spans(_samples(spark, sf_dir), probes, "user_id", "s", "value")
    return d.select("user_id", "probe", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"), "n")


def fraction_sample(spark, sf_dir):
    d = fraction_picks(_samples(spark, sf_dir), "user_id", "s", [0.0, 0.25, 0.5, 1.0])
    return d.select("user_id", "p", "event_id")


def stride_sample(spark, sf_dir):
    d = _samples(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("s")) - 1)
    return d.where(F.col("i") % 3 == 0).select("user_id", "event_id")


def fps_bucket(spark, sf_dir):
    """One sample for each bucket of ten minutes: the first."""
    d = _samples(spark, sf_dir).withColumn("bucket", F.floor(F.col("s") / 600))
    return d.groupBy("user_id", "bucket").agg(F.min_by("event_id", F.struct("s", "event_id")).alias("event_id"))


def even_samples(spark, sf_dir):
    """Source metadata: sixteen evenly spaced samples of each event type."""
    # ranks within days, and days within a type: a type's rows are dealt over its days
    d = running(_samples(spark, sf_dir), F.col("event_type"), ["s", "event_id"], F.floor(F.col("s") / 86_400), F.lit(1), "i", "n").withColumn("i", F.col("i") - 1)
    pick = d.where(F.floor(F.col("i") * 16 / F.col("n")) > F.floor((F.col("i") - 1) * 16 / F.col("n")))
    return pick.groupBy("event_type").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("value"), 4).alias("mean"), F.max("n").alias("n"))


def master_stats(spark, sf_dir):
    v = F.col("value")
    d = _samples(spark, sf_dir).agg(F.sqrt(F.avg(v * v)).alias("r"), F.max(F.abs(v)).alias("k"), F.count(F.lit(1)).alias("n"))
    return d.select(F.round(decibels(F.col("r")), 4).alias("level"), F.round(decibels(F.col("k")), 4).alias("true_peak"), "n")


def peak_candidates(spark, sf_dir):
    return local_peaks(_samples(spark, sf_dir), "user_id", "s", "value", 0.4).select("user_id", "event_id", "value")


def peak_refractory(spark, sf_dir):
    p = local_peaks(_samples(spark, sf_dir), "user_id", "s", "value", 0.4).select("user_id", "event_id", "s")
    return refractory(p, "user_id", "s", 43_200.0).select("user_id", "event_id")


def flare_times(spark, sf_dir):
    """Days of each event type's flares (levels over every other hour's and 0.9 of the greatest); [0] where none is."""
    hours = _samples(spark, sf_dir).groupBy("event_type", F.floor(F.col("s") / 86_400).alias("t")).agg(F.round(F.sum("value"), 3).alias("value"))
    found = local_peaks(hours, "event_type", "t", "value", 0.9).withColumn("t", F.col("t").cast("double"))
    return or_fallback(found.where(F.col("event_type") != "view"), hours, "event_type", "t")


QUERIES = [
    flare_times, level_envelope, level_windows, framediff_stats, frame_diff, boundary_rms, silence_spans, fraction_sample, stride_sample, fps_bucket, even_samples,
    master_stats, peak_candidates, peak_refractory,
]

_E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1000000.0::DOUBLE AS s FROM events)"
_PEAKS = f"""{_E}, k AS (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS n, max(value) OVER (PARTITION BY user_id) AS m FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s)),
p AS (SELECT * FROM k WHERE value > b AND value >= n AND value > 0.4::DOUBLE * m)"""
ORACLES = {
    "flare_times": f"""WITH {_E}, h AS (SELECT event_type, floor(s / 86400)::BIGINT AS t, round(sum(value), 3) AS v FROM e GROUP BY 1, 2), k AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS n, max(v) OVER (PARTITION BY event_type) AS m FROM h WINDOW w AS (PARTITION BY event_type ORDER BY t)),
f AS (SELECT event_type, t::DOUBLE AS t FROM k WHERE v > b AND v >= n AND v > 0.9::DOUBLE * m AND event_type <> 'view') SELECT * FROM f UNION ALL SELECT DISTINCT event_type, 0.0::DOUBLE FROM e WHERE event_type NOT IN (SELECT event_type FROM f)""",
    "level_envelope": f"WITH {_E} SELECT event_id, round(20 * log10(greatest(sqrt(avg(value * value) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)), 1e-6)), 4) AS db FROM e",
    "level_windows": f"WITH {_E} SELECT floor(s / 3600)::BIGINT AS w, max(value) AS peak, round(avg(value), 4) AS mean, round(avg(value) FILTER (s - floor(s / 3600.0::DOUBLE) * 3600.0::DOUBLE < 300), 4) AS lead_mean, count(*) AS n FROM e GROUP BY 1",
    "framediff_stats": f"""WITH {_E}, d AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY s)) AS diff FROM e), f AS (SELECT * FROM d WHERE diff > 0), m AS (SELECT user_id, median(diff) AS m FROM f GROUP BY 1)
SELECT user_id, round(any_value(m), 4) AS median, round(median(abs(diff - m)), 4) AS mad, count(*) AS n FROM f JOIN m USING (user_id) GROUP BY 1""",
    "frame_diff": f"WITH {_E} SELECT event_id, round(coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY s)), 0), 6) AS diff FROM e",
    "boundary_rms": f"""WITH {_E}, b AS (SELECT user_id, event_id AS boundary, s AS t FROM e WHERE event_type = 'purchase'),
g AS (SELECT boundary, sqrt(avg(value * value) FILTER (s < t)) AS b, sqrt(avg(value * value) FILTER (s >= t)) AS a FROM b JOIN e USING (user_id) WHERE s >= t - 21600 AND s < t + 21600 GROUP BY 1)
SELECT boundary, round(coalesce(b, 0), 4) AS before, round(a, 4) AS after, round(a - coalesce(b, 0), 4) AS jump FROM g""",
    "silence_spans": f"""WITH {_E}, p AS (SELECT * FROM (VALUES (0, 20.0::DOUBLE, 0.0::DOUBLE), (1, 50.0, 3600.0), (2, 80.0, 7200.0)) v(probe, noise, min_d)),
q AS (SELECT *, value < noise AS quiet FROM e, p), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, probe ORDER BY s) - row_number() OVER (PARTITION BY user_id, probe, quiet ORDER BY s) AS run FROM q)
SELECT user_id, probe, round(min(s), 3) AS a, round(max(s), 3) AS b, count(*) AS n FROM r WHERE quiet GROUP BY user_id, probe, run HAVING max(s) - min(s) >= any_value(min_d)""",
    "fraction_sample": f"""WITH {_E}, r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY s) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM e)
SELECT user_id, p, event_id FROM r, (VALUES (0.0::DOUBLE), (0.25), (0.5), (1.0)) v(p) WHERE rn = 1 + floor(p * (n - 1))""",
    "stride_sample": f"WITH {_E}, r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY s) - 1 AS i FROM e) SELECT user_id, event_id FROM r WHERE i % 3 = 0",
    "fps_bucket": f"WITH {_E} SELECT user_id, floor(s / 600)::BIGINT AS bucket, arg_min(event_id, s) AS event_id FROM e GROUP BY 1, 2",
    "even_samples": f"""WITH {_E}, r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY s, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM e)
SELECT event_type, count(*) AS samples, round(avg(value), 4) AS mean, max(n) AS n FROM r WHERE floor(i * 16 / n) > floor((i - 1) * 16 / n) GROUP BY 1""",
    "master_stats": "SELECT round(20 * log10(greatest(sqrt(avg(value * value)), 1e-6)), 4) AS level, round(20 * log10(greatest(max(abs(value)), 1e-6)), 4) AS true_peak, count(*) AS n FROM events",
    "peak_candidates": f"WITH {_PEAKS} SELECT user_id, event_id, value FROM p",
    "peak_refractory": f"""WITH RECURSIVE {_PEAKS}, t AS (SELECT user_id, min(s) AS s FROM p GROUP BY 1 UNION ALL SELECT t.user_id, (SELECT min(p.s) FROM p WHERE p.user_id = t.user_id AND p.s >= t.s + 43200) FROM t WHERE t.s IS NOT NULL)
SELECT p.user_id, p.event_id FROM t JOIN p ON p.user_id = t.user_id AND p.s = t.s""",
}
