"""Interval arithmetic: running offsets, complements, islands, keyframes, overlays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import load, seconds
from .sequential import flag_in_order

#: Ends of the stretch that complements refer to, in seconds since 1970: January 2024.
BEGIN, END = 1_704_067_200.0, 1_706_745_600.0


def running_offsets(df: DataFrame, key: str, order: list[str], length: Column) -> DataFrame:
    """start and end of each row when the lengths of one key are laid end to end."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(length).over(w)
    return df.withColumn("end", end).withColumn("start", F.col("end") - length)


def islands(df: DataFrame, key: str, start: str, end: str, gap: float = 0.0) -> DataFrame:
    """Adds ``island``: rows of one key whose start lies over ``gap`` beyond all earlier ends begin a new one."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) - before > gap), 1).otherwise(0)
    return df.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def complement(df: DataFrame, key: str, start: str, end: str, lo: float, hi: float) -> DataFrame:
    """The gaps of each key's spans within [lo, hi], before the first and after the last too."""
    w = Window.partitionBy(key).orderBy(start, end)
    until = F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(lo))
    inner = df.withColumn("a", until).select(key, "a", F.col(start).alias("b"))
    tail = df.groupBy(key).agg(F.max(end).alias("a")).withColumn("b", F.lit(hi))
    return inner.unionByName(tail).where(F.col("b") > F.col("a"))


def ease(p: Column, kind: Column) -> Column:
    """Progress 0..1 bent by its kind: in, out and smooth; else linear."""
    return F.when(kind == "in", p * p).when(kind == "out", 1 - (1 - p) * (1 - p)).when(kind == "smooth", p * p * (3 - 2 * p)).otherwise(p)


def keyframe_spans(df: DataFrame, key: str, t: str, value: str, lo: float, hi: float) -> DataFrame:
    """(t0, v0, t1, v1) of the stretches between a key's keyframes, over [lo, hi]: the
    first keyframe's value holds before it, the last one's after it."""
    w = Window.partitionBy(key).orderBy(t)
    d = df.select(key, F.col(t).alias("t0"), F.col(value).alias("v0"), F.lead(t).over(w).alias("t1"), F.lead(value).over(w).alias("v1"), F.lag(t).over(w).isNull().alias("first"))
    # the last stretch ends beyond hi, so that hi itself lies in it
    body = d.select(key, "t0", "v0", F.coalesce("t1", F.greatest(F.col("t0"), F.lit(hi)) + 1).alias("t1"), F.coalesce("v1", "v0").alias("v1"))
    head = d.where(F.col("first") & (F.col("t0") > lo)).select(key, F.lit(lo).alias("t0"), "v0", F.col("t0").alias("t1"), F.col("v0").alias("v1"))
    return body.unionByName(head)


def sample_keyframes(spans: DataFrame, grid: DataFrame, key: str, bucket: float, kind: Column | None = None) -> DataFrame:
    """Eased values of the keyframe spans at the grid's times (key, t, ...), by a bucketed interval
    join; ``kind`` is of the grid's columns, linear without it. Spans without a length hold no time."""
    cell = lambda c: F.floor(F.col(c) / bucket)
    cells = spans.where(F.col("t1") > F.col("t0")).withColumn("cell", F.explode(F.sequence(cell("t0"), cell("t1"))))
    on = grid.withColumn("cell", cell("t")).join(cells, [key, "cell"]).where((F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t1")))
    p = (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    p = p if kind is None else ease(p, kind)
    return on.select(key, "t", (F.col("v0") + (F.col("v1") - F.col("v0")) * p).alias("value"))


def tempo_factors(speed: Column) -> Column:
    """Factors within [0.5, 2] whose product is ``speed``."""
    k = F.greatest(F.ceil(F.abs(F.log2(speed))) - 1, F.lit(0)).cast("int")
    base = F.when(speed >= 1, 2.0).otherwise(0.5)
    return F.concat(F.array_repeat(base, k), F.array(speed / F.pow(base, k)))


def _segments(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", (1 + F.col("l_discount")).alias("speed"))


def timeline_remap(spark, sf_dir):
    d = running_offsets(_segments(spark, sf_dir), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.col("l_quantity") / F.col("speed"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("start", 4).alias("start_s"), F.round("end", 4).alias("end_s"))


def timeline_length(spark, sf_dir):
    return _segments(spark, sf_dir).groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_quantity") / F.col("speed")), 4).alias("body_s"), F.count(F.lit(1)).alias("segments"))


def keep_frames(spark, sf_dir):
    d = _segments(spark, sf_dir).withColumn("nf", F.round(F.col("l_quantity") / F.col("speed") * 30).cast("long"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "nf")


def _spans(spark, sf_dir, length):
    return load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", seconds().alias("s")).withColumn("e", F.col("s") + length)


def span_complement(spark, sf_dir):
    gaps = complement(_spans(spark, sf_dir, 3600.0), "user_id", "s", "e", BEGIN, END)
    return gaps.select("user_id", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"))


def span_merge(spark, sf_dir):
    m = islands(_spans(spark, sf_dir, 7200.0), "user_id", "s", "e")
    return m.groupBy("user_id", "island").agg(F.round(F.min("s"), 3).alias("a"), F.round(F.max("e"), 3).alias("b"), F.count(F.lit(1)).alias("n"))


def keyframe_lerp(spark, sf_dir):
    """Each user's values at every time of a grid, the curve by user."""
    e = _spans(spark, sf_dir, 0.0)
    step = 6 * 3600.0
    grid = e.select("user_id").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(int((END - BEGIN) / step) - 1)))).withColumn("t", F.lit(BEGIN) + F.col("t") * step)
    kind = F.when(F.col("user_id") % 3 == 0, "smooth").when(F.col("user_id") % 3 == 1, "in").otherwise("linear")
    out = sample_keyframes(keyframe_spans(e, "user_id", "s", "value", BEGIN, END), grid, "user_id", 4 * step, kind)
    return out.select("user_id", F.col("t").cast("long").alias("t"), F.round("value", 4).alias("value"))


def keyframe_ease(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "in").when(F.col("event_type") == "view", "out").when(F.col("event_type") == "purchase", "smooth").otherwise("linear")
    e = _spans(spark, sf_dir, 0.0).withColumn("p", F.pmod(F.col("s"), F.lit(3600.0)) / 3600.0)
    return e.select("event_id", F.round(ease(F.col("p"), kind), 6).alias("eased"))


def atempo_chain(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 8).alias("speed")).distinct().withColumn("f", tempo_factors(F.col("speed")))
    return d.select("speed", F.size("f").alias("n"), F.round(F.aggregate("f", F.lit(1.0), lambda a, x: a * x), 6).alias("product"), F.round(F.element_at("f", -1), 6).alias("last"))


def phrase_blocks(words: DataFrame, key: str, start: str, end: str, width: str, pause: float, line: int, lines: int, space: int = 1) -> DataFrame:
    """Adds ``block``: a key's words in order; a pause of over ``pause``, or a word that would
    need more than ``lines`` lines of width ``line``, begins a new one."""

    def decide(last, x):
        begin, stop, size = x
        now = (stop, 1, size)
        if last is None or begin - last[0] > pause:
            return True, now
        fits = last[2] + space + size <= line
        if not fits and last[1] == lines:
            return True, now
        return False, (stop, last[1] + (not fits), last[2] + space + size if fits else size)

    d = flag_in_order(words, key, [start], None, decide, [start, end, width], "fresh")
    return d.withColumn("block", F.sum(F.col("fresh").cast("int")).over(Window.partitionBy(key).orderBy(start).rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def caption_blocks(spark, sf_dir):
    """Blocks of at most two lines of 14 characters."""
    b = phrase_blocks(_spans(spark, sf_dir, 60.0).withColumn("width", F.length("event_type").cast("long")), "user_id", "s", "e", "width", 36_000.0, 14, 2)
    return b.groupBy("user_id", "block").agg(F.count(F.lit(1)).alias("words"), F.round(F.min("s"), 3).alias("a"), F.round(F.max("e"), 3).alias("b"))


def caption_hold(spark, sf_dir):
    e = _spans(spark, sf_dir, 60.0)
    following = F.lead("s").over(Window.partitionBy("user_id").orderBy("s"))
    until = F.when(following.isNotNull(), F.least(following, F.col("e") + 0.8)).otherwise(F.col("e") + 0.8)
    return e.select("event_id", F.round(F.when(until > F.col("s"), until).otherwise(F.col("s") + 0.1), 3).alias("hold_to"))


def caption_highlight(spark, sf_dir):
    """Within a block each word is lit until the next one; the last until the block's end."""
    b = islands(_spans(spark, sf_dir, 60.0), "user_id", "s", "e", 1800.0)
    w = Window.partitionBy("user_id", "island")
    return b.select("event_id", F.round(F.coalesce(F.lead("s").over(w.orderBy("s")), F.max("e").over(w)), 3).alias("lit_to"))


def overlay_concurrency(spark, sf_dir):
    e = _spans(spark, sf_dir, 3600.0)
    edges = e.select("user_id", F.col("s").alias("t"), F.lit(1).alias("d")).unionByName(e.select("user_id", F.col("e").alias("t"), F.lit(-1).alias("d")))
    w = Window.partitionBy("user_id").orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    return edges.withColumn("live", F.sum("d").over(w)).groupBy("user_id").agg(F.max("live").alias("peak"))


def overlay_topmost(spark, sf_dir):
    """At each event the overlay on top: the latest in list order of those shown then."""
    e = _spans(spark, sf_dir, 7200.0)
    cell = lambda c: F.floor(F.col(c) / 7200.0)
    over = e.select("user_id", F.col("event_id").alias("o"), F.col("s").alias("os"), F.col("e").alias("oe"), F.explode(F.sequence(cell("s"), cell("e"))).alias("cell"))
    at = e.select("user_id", "event_id", "s", cell("s").alias("cell"))
    shown = at.join(over, ["user_id", "cell"]).where((F.col("s") >= F.col("os")) & (F.col("s") < F.col("oe")))
    return shown.groupBy("event_id").agg(F.max("o").alias("top"), F.count(F.lit(1)).alias("layers"))


def kenburns_frames(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", "p_size").withColumn("on", F.explode(F.sequence(F.lit(0), F.col("p_size") - 1)))
    u = F.when(F.col("p_size") > 1, F.col("on") / (F.col("p_size") - 1)).otherwise(0.0)
    return p.select("p_partkey", "on", F.round(1 + 0.12 * u, 6).alias("z"), F.round(0.5 - 0.08 * u, 6).alias("x"))


# Damping, mass and stiffness of the spring; when it lets go before the end, and the most that it overshoots.
DAMPING, MASS, STIFFNESS, RELEASE, OVERSHOOT = 15.0, 0.9, 140.0, 0.4, 1.2
DECAY = DAMPING / (2 * MASS)
SWING = math.sqrt(STIFFNESS / MASS) * math.sqrt(1 - (DAMPING / (2 * math.sqrt(STIFFNESS * MASS))) ** 2)


def sprung(t: Column, at: Column) -> Column:
    """Progress of an underdamped spring let go at ``at``; 0 before."""
    x = F.greatest(t - at, F.lit(0.0))
    return F.when(t >= at, 1 - F.exp(-DECAY * x) * (F.cos(SWING * x) + DECAY / SWING * F.sin(SWING * x))).otherwise(F.lit(0.0))


def spring_settle(spark, sf_dir):
    """A head that springs down at the start of its beat (two seconds) and up again before its end, at eight times."""
    e = _spans(spark, sf_dir, 2.0).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("t", F.col("k") * 0.3)
    y = sprung(F.col("t"), F.lit(0.0)) - sprung(F.col("t"), F.lit(2.0 - RELEASE))
    return e.select("event_id", "k", F.round(F.greatest(F.lit(0.0), F.least(y, F.lit(OVERSHOOT))), 5).alias("y"))


def shot_frames(spark, sf_dir):
    """Frames of each order's shot, from one rounded end to the other, every fifth."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 10_000).alias("a"))
    first, last = F.bround(F.col("a") * 25).cast("long"), F.bround((F.col("a") + 1.3) * 25).cast("long")
    return o.select("o_orderkey", F.explode(F.sequence(first, last - 1, F.lit(5).cast("long"))).alias("frame"))


QUERIES = [
    timeline_remap, timeline_length, keep_frames, span_complement, span_merge, keyframe_lerp, keyframe_ease, atempo_chain, caption_blocks, caption_hold,
    caption_highlight, overlay_concurrency, overlay_topmost, kenburns_frames, spring_settle, shot_frames,
]

_E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1000000.0::DOUBLE AS s FROM events)"
_ISL = """x AS (SELECT *, s + {len} AS e FROM e), y AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM x),
z AS (SELECT *, sum(CASE WHEN p IS NULL OR s - p > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM y)"""
ORACLES = {
    "timeline_remap": """WITH d AS (SELECT *, l_quantity / (1 + l_discount) AS len FROM lineitem), r AS (SELECT *, sum(len) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS e FROM d)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(e - len, 4) AS start_s, round(e, 4) AS end_s FROM r""",
    "timeline_length": "SELECT l_orderkey, round(sum(l_quantity / (1 + l_discount)), 4) AS body_s, count(*) AS segments FROM lineitem GROUP BY 1",
    "keep_frames": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity / (1 + l_discount) * 30)::BIGINT AS nf FROM lineitem",
    "span_complement": f"""WITH {_E}, x AS (SELECT *, s + 3600.0::DOUBLE AS e FROM e), g AS (SELECT user_id, coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {BEGIN}::DOUBLE) AS a, s AS b FROM x
UNION ALL SELECT user_id, max(e), {END}::DOUBLE FROM x GROUP BY 1) SELECT user_id, round(a, 3) AS a, round(b, 3) AS b FROM g WHERE b > a""",
    "span_merge": f"WITH {_E}, {_ISL.format(len='7200.0::DOUBLE', gap=0)} SELECT user_id, island, round(min(s), 3) AS a, round(max(e), 3) AS b, count(*) AS n FROM z GROUP BY 1, 2",
    "keyframe_lerp": f"""WITH {_E}, k AS (SELECT user_id, s AS t0, value AS v0, lead(s) OVER w AS t1, lead(value) OVER w AS v1, lag(s) OVER w AS p0 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s)),
g AS (SELECT user_id, {BEGIN}::DOUBLE + i * 21600.0::DOUBLE AS t FROM (SELECT DISTINCT user_id FROM e), range(0, 124) r(i)),
j AS (SELECT user_id, t, v0, v1, CASE WHEN t < t0 OR t1 IS NULL THEN 0 ELSE (t - t0) / (t1 - t0) END AS p FROM g JOIN k USING (user_id) WHERE (t >= t0 OR p0 IS NULL) AND (t1 IS NULL OR t < t1))
SELECT user_id, t::BIGINT AS t, round(v0 + (coalesce(v1, v0) - v0) * (CASE user_id % 3 WHEN 0 THEN p * p * (3 - 2 * p) WHEN 1 THEN p * p ELSE p END), 4) AS value FROM j""",
    "keyframe_ease": f"""WITH {_E}, q AS (SELECT *, (s - floor(s / 3600.0::DOUBLE) * 3600.0::DOUBLE) / 3600.0::DOUBLE AS p FROM e)
SELECT event_id, round(CASE event_type WHEN 'click' THEN p * p WHEN 'view' THEN 1 - (1 - p) * (1 - p) WHEN 'purchase' THEN p * p * (3 - 2 * p) ELSE p END, 6) AS eased FROM q""",
    "atempo_chain": """WITH d AS (SELECT DISTINCT l_quantity / 8 AS speed FROM lineitem), k AS (SELECT speed, greatest(ceil(abs(log2(speed))) - 1, 0)::INT AS k, CASE WHEN speed >= 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS b FROM d)
SELECT speed, k + 1 AS n, round(speed, 6) AS product, round(speed / pow(b, k), 6) AS last FROM k""",
    "caption_blocks": f"""WITH RECURSIVE {_E}, d AS (SELECT user_id, s, s + 60.0::DOUBLE AS e, length(event_type) AS w, row_number() OVER (PARTITION BY user_id ORDER BY s) AS rn FROM e),
t AS (SELECT user_id, rn, s, e, w, 1 AS block, 1 AS line, w AS used FROM d WHERE rn = 1
UNION ALL SELECT d.user_id, d.rn, d.s, d.e, d.w, CASE WHEN d.s - t.e > 36000 OR (used + 1 + d.w > 14 AND line = 2) THEN block + 1 ELSE block END, CASE WHEN d.s - t.e > 36000 OR (used + 1 + d.w > 14 AND line = 2) THEN 1 WHEN used + 1 + d.w > 14 THEN 2 ELSE line END,
CASE WHEN d.s - t.e > 36000 OR used + 1 + d.w > 14 THEN d.w ELSE used + 1 + d.w END FROM t JOIN d ON d.user_id = t.user_id AND d.rn = t.rn + 1)
SELECT user_id, block, count(*) AS words, round(min(s), 3) AS a, round(max(e), 3) AS b FROM t GROUP BY 1, 2""",
    "caption_hold": f"""WITH {_E}, x AS (SELECT event_id, s, s + 60.0::DOUBLE AS e, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS n FROM e), u AS (SELECT *, CASE WHEN n IS NOT NULL THEN least(n, e + 0.8::DOUBLE) ELSE e + 0.8::DOUBLE END AS t FROM x)
SELECT event_id, round(CASE WHEN t > s THEN t ELSE s + 0.1::DOUBLE END, 3) AS hold_to FROM u""",
    "caption_highlight": f"WITH {_E}, {_ISL.format(len='60.0::DOUBLE', gap=1800)} SELECT event_id, round(coalesce(lead(s) OVER (PARTITION BY user_id, island ORDER BY s), max(e) OVER (PARTITION BY user_id, island)), 3) AS lit_to FROM z",
    "overlay_concurrency": f"""WITH {_E}, d AS (SELECT user_id, s AS t, 1 AS d FROM e UNION ALL SELECT user_id, s + 3600.0::DOUBLE, -1 FROM e), r AS (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY t, d ROWS UNBOUNDED PRECEDING)::BIGINT AS live FROM d)
SELECT user_id, max(live) AS peak FROM r GROUP BY 1""",
    "overlay_topmost": f"WITH {_E} SELECT a.event_id, max(o.event_id) AS top, count(*) AS layers FROM e a JOIN e o ON a.user_id = o.user_id AND a.s >= o.s AND a.s < o.s + 7200.0::DOUBLE GROUP BY 1",
    "kenburns_frames": """WITH p AS (SELECT p_partkey, p_size, unnest(range(0, p_size))::INT AS "on" FROM part), u AS (SELECT *, CASE WHEN p_size > 1 THEN "on"::DOUBLE / (p_size - 1) ELSE 0 END AS u FROM p)
SELECT p_partkey, "on", round(1 + 0.12::DOUBLE * u, 6) AS z, round(0.5::DOUBLE - 0.08::DOUBLE * u, 6) AS x FROM u""",
    "spring_settle": f"""WITH q AS (SELECT event_id, unnest(range(0, 8))::INT AS k FROM events), t AS (SELECT event_id, k, k * 0.3::DOUBLE AS t, k * 0.3::DOUBLE - {2.0 - RELEASE}::DOUBLE AS u FROM q),
y AS (SELECT *, 1 - exp(-{DECAY}::DOUBLE * t) * (cos({SWING}::DOUBLE * t) + {DECAY / SWING}::DOUBLE * sin({SWING}::DOUBLE * t)) AS a, CASE WHEN u >= 0 THEN 1 - exp(-{DECAY}::DOUBLE * u) * (cos({SWING}::DOUBLE * u) + {DECAY / SWING}::DOUBLE * sin({SWING}::DOUBLE * u)) ELSE 0 END AS b FROM t)
SELECT event_id, k, round(greatest(0.0::DOUBLE, least(a - b, 1.2::DOUBLE)), 5) AS y FROM y""",
    "shot_frames": "SELECT o_orderkey, unnest(range(round_even(o_totalprice / 10000 * 25, 0)::BIGINT, round_even((o_totalprice / 10000 + 1.3::DOUBLE) * 25, 0)::BIGINT, 5)) AS frame FROM orders",
}
