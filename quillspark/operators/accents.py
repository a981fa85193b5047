"""Accents and caption motion: time windows about a cue, zoom and shake curves, overlays, word segments."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import load, seconds
from .intervals import BEGIN

FPS = 30.0
# Canvas, frames of each accent, and the portrait safe zone.
WIDTH, HEIGHT = 1080, 1920
SHAKE_FRAMES, GRAIN_FRAMES, MOSAIC_FRAMES = 9, 24, 10
PUNCH_IN, PUNCH_HOLD, PUNCH_OUT = 4, 2, 6
BLUR_IN, BLUR_OUT = 4, 7
BURN_LEAD, BURN_POST, BURN_FLARE_LEAD, BURN_MOST = 0.42, 0.22, 0.18, 8
SAFE_BOTTOM, SAFE_HEIGHT = 1565, 1920
GROW_MS, OVERSHOOT, SCALE = 90, 120, 110
# Envelopes of the seeded accents, frame by frame, and the ranges of their draws.
GLITCH, FLICKER, GLITCH_DRAWS = (1.0, -0.75, 0.9, -0.55, 0.65, -0.35, 0.18), (0.9, 0.0, 1.0, 0.3, 0.7, 0.0, 0.4), ((0.72, 1.28), (0.8, 1.2))
SPLIT, SPLIT_DRAWS = (1.0, 0.72, 0.46, 0.24, 0.10), ((0.82, 1.18),)


def centred(at: Column, frames: int, fps: float = FPS) -> tuple[Column, Column]:
    """The window of ``frames`` frames about a cue, not before 0."""
    begin = F.greatest(F.lit(0.0), at - frames / fps / 2)
    return begin, begin + frames / fps


def punch_zoom(on: Column, intensity: Column) -> Column:
    """Up to the peak, a hold, and a squared fall."""
    top = 1.06 + 0.16 * intensity
    fall = (on - (PUNCH_IN + PUNCH_HOLD)) / PUNCH_OUT
    return (
        F.when(on < PUNCH_IN, 1 + (top - 1) * on / PUNCH_IN)
        .when(on < PUNCH_IN + PUNCH_HOLD, top)
        .when(on < PUNCH_IN + PUNCH_HOLD + PUNCH_OUT, top - (top - 1) * fall * fall)
        .otherwise(F.lit(1.0))
    )


def blur_zoom(on: Column, intensity: Column) -> Column:
    """A squared push to the cut, and a softer way back."""
    top = 1.10 + 0.30 * intensity
    rise = on / BLUR_IN
    return F.when(on < BLUR_IN, 1 + (top - 1) * rise * rise).when(on < BLUR_IN + BLUR_OUT, top - (top - 1) * F.pow((on - BLUR_IN) / BLUR_OUT, F.lit(1.6))).otherwise(F.lit(1.0))


def burn_windows(cues: DataFrame, key: str, at: str, flares: list[float]) -> DataFrame:
    """Overlay window and clip offset of each of a key's cues; keys of more than the most are refused."""
    w = Window.partitionBy(key)
    d = cues.withColumn("j", F.row_number().over(w.orderBy(at)) - 1).withColumn("k", F.count(F.lit(1)).over(w)).where(F.col("k") <= BURN_MOST)
    flare = F.get(F.array(*map(F.lit, flares)), F.col("j") % len(flares))
    offset = F.round(F.greatest(F.lit(0.0), flare - BURN_LEAD + BURN_FLARE_LEAD), 2)
    return d.withColumns({"begin": F.greatest(F.lit(0.0), F.col(at) - BURN_LEAD), "stop": F.col(at) + BURN_POST, "offset": offset})


def word_segments(line: DataFrame, words: str, begin: str, end: str) -> DataFrame:
    """Rows (word, from, to, active) of a line of words (start, centre, width): where each word
    stands while each of the line's words is spoken. Neighbours give way to the active
    one by half of what it grows. A line is bounded by its width, so the work is linear."""
    grow = SCALE / 100 - 1
    n = F.size(words)
    at = lambda k: F.get(F.col(words), k)
    spoken = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(at(k)["start"].alias("a"), F.coalesce(at(k + 1)["start"], F.col(end)).alias("b"), k.alias("active")))
    lead = F.when(at(F.lit(0))["start"] > F.col(begin) + 0.02, F.array(F.struct(F.col(begin).alias("a"), at(F.lit(0))["start"].alias("b"), F.lit(-1).alias("active"))))
    segments = F.concat(F.coalesce(lead, F.array().cast("array<struct<a:double,b:double,active:int>>")), spoken)
    d = line.withColumn("_segments", segments).withColumn("word", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("_s", F.explode("_segments"))
    push = F.bround(grow * at(F.col("_s.active"))["width"] / 2)
    x = at(F.col("word"))["centre"]
    x = F.when((F.col("_s.active") == F.col("word")) | (F.col("_s.active") < 0), x).when(F.col("word") < F.col("_s.active"), x - push).otherwise(x + push)
    stop = F.when(F.col("_s.b") > F.col("_s.a"), F.col("_s.b")).otherwise(F.col("_s.a") + 0.05)
    return d.withColumns({"a": F.col("_s.a"), "b": stop, "active": F.col("_s.active"), "x": x}).drop("_segments", "_s")


def safe_centre(centre: Column, below: Column, width: Column, height: Column) -> Column:
    """In portrait, a centre whose foot clears the bottom reserve; else the centre as it is."""
    return F.when(height <= width, centre).otherwise(F.least(centre, (F.bround(SAFE_BOTTOM * height / SAFE_HEIGHT) - below) / height))


def draws(seed: Column, ranges: tuple[tuple[float, float], ...], n: int) -> Column:
    """For each of ``n`` frames one draw from each range, by Python's generator of that seed: what
    is drawn is part of the accent's definition, so it can't be the engine's own generator."""

    @F.pandas_udf("array<array<double>>")
    def run(seeds: pd.Series) -> pd.Series:
        def frames(k):
            r = random.Random(int(k))
            return [[r.uniform(a, b) for a, b in ranges] for _ in range(n)]

        return seeds.map(frames)

    return run(seed)


def _seed(at: Column) -> Column:
    return F.bround(at * 1000).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def _cues(spark, sf_dir):
    """Events as cues: seconds into the month, intensity 0..1."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (seconds() - BEGIN).alias("at"), "value")
    return e.withColumn("i", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100)))


def camera_shake(spark, sf_dir):
    """Per frame: a jitter that decays, as a share of the canvas."""
    begin, _ = centred(F.col("at"), SHAKE_FRAMES)
    d = _cues(spark, sf_dir).withColumn("on", F.explode(F.sequence(F.lit(0), F.lit(SHAKE_FRAMES - 1))))
    size = (1 - F.col("on") / SHAKE_FRAMES) * (0.004 + 0.021 * F.col("i"))
    return d.select("event_id", "on", F.round(begin + F.col("on") / FPS, 4).alias("t"), F.round(F.sin(F.col("on") * 2.7) * size, 7).alias("x"), F.round(F.cos(F.col("on") * 3.3) * size, 7).alias("y"))


def grain(spark, sf_dir):
    begin, end = centred(F.col("at"), GRAIN_FRAMES)
    return _cues(spark, sf_dir).select("event_id", F.round(begin, 4).alias("a"), F.round(end, 4).alias("b"), (10 + F.bround(30 * F.col("i"))).cast("long").alias("strength"), F.round(1 + 0.06 * F.col("i"), 6).alias("contrast"))


def zoom_punch(spark, sf_dir):
    d = _cues(spark, sf_dir).withColumn("on", F.explode(F.sequence(F.lit(0), F.lit(PUNCH_IN + PUNCH_HOLD + PUNCH_OUT))))
    return d.select("event_id", "on", F.round(punch_zoom(F.col("on"), F.col("i")), 10).alias("zoom"))


def zoom_blur(spark, sf_dir):
    d = _cues(spark, sf_dir).withColumn("on", F.explode(F.sequence(F.lit(0), F.lit(BLUR_IN + BLUR_OUT))))
    return d.select("event_id", "on", F.round(blur_zoom(F.col("on"), F.col("i")), 10).alias("zoom"), (3 + F.bround(3 * F.col("i"))).cast("long").alias("blur"))


def pixelate(spark, sf_dir):
    begin, end = centred(F.col("at"), MOSAIC_FRAMES)
    d = _cues(spark, sf_dir).withColumn("block", (8 + F.bround(28 * F.col("i"))).cast("long"))
    side = lambda n: F.greatest(F.lit(2), F.bround(n / F.col("block"))).cast("long")
    return d.select("event_id", F.round(begin, 4).alias("a"), F.round(end, 4).alias("b"), "block", side(WIDTH).alias("w"), side(HEIGHT).alias("h"))


def film_burn(spark, sf_dir):
    """Purchases as boundaries; a user of more than eight is refused."""
    d = burn_windows(_cues(spark, sf_dir).where(F.col("event_type") == "purchase"), "user_id", "at", [0.5, 1.1, 1.9])
    return d.select("event_id", "user_id", F.round("begin", 3).alias("a"), F.round("stop", 3).alias("b"), "offset")


def phrase_segments(spark, sf_dir):
    """Lines of six words of a user: each word's place in each segment."""
    w = Window.partitionBy("user_id").orderBy("at")
    d = _cues(spark, sf_dir).withColumn("line", F.floor((F.row_number().over(w) - 1) / 6)).withColumn("width", F.length("event_type") * 20.0)
    word = F.struct(F.col("at").alias("start"), F.col("event_id"), "width")
    line = d.groupBy("user_id", "line").agg(F.array_sort(F.collect_list(word)).alias("w0"))
    # words side by side about the middle, 28 apart
    line = line.withColumn("total", F.aggregate("w0", F.lit(0.0), lambda a, x: a + x["width"]) + 28 * (F.size("w0") - 1))
    left = lambda k: WIDTH // 2 - F.col("total") / 2 + F.aggregate(F.slice("w0", F.lit(1), k), F.lit(0.0), lambda a, x: a + x["width"] + 28)
    words = F.transform("w0", lambda x, k: F.struct(x["start"].alias("start"), F.bround(left(k) + x["width"] / 2).alias("centre"), x["width"].alias("width")))
    line = line.withColumn("words", words).withColumn("begin", F.floor(F.element_at("words", 1)["start"]).cast("double")).withColumn("end", F.element_at("words", -1)["start"] + 0.8)
    return word_segments(line, "words", "begin", "end").select("user_id", "line", "word", "active", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"), F.col("x").cast("long").alias("x"))


def bounce_tags(spark, sf_dir):
    """Scale tags of a word; the way back only if there is time for it."""
    d = _cues(spark, sf_dir).withColumn("ms", F.bround(F.col("value")).cast("long"))
    head = f"\\t(0,{GROW_MS},{OVERSHOOT})\\t({GROW_MS},{2 * GROW_MS},{SCALE})"
    back = F.when(F.col("ms") > 2 * GROW_MS + 80, F.format_string("\\t(%d,%d,100)", F.col("ms") - 80, F.col("ms"))).otherwise("")
    return d.select("event_id", F.concat(F.lit(head), back).alias("tags"))


def caption_safe_zone(spark, sf_dir):
    d = _cues(spark, sf_dir).withColumn("h", F.when(F.col("event_id") % 3 == 0, 1080).otherwise(1920)).withColumn("c", 0.5 + F.col("i") / 2)
    return d.select("event_id", F.round(safe_centre(F.col("c"), F.lit(96), F.lit(WIDTH), F.col("h")), 6).alias("centre"))


def glitch(spark, sf_dir):
    """Per frame: red and blue shifts, a vertical tear that changes sides, and how grey it is."""
    d = _cues(spark, sf_dir).select("event_id", "i", F.posexplode(draws(_seed(F.col("at")), GLITCH_DRAWS, len(GLITCH))).alias("on", "u"))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("on"))
    je = pick(GLITCH) * F.get("u", F.lit(0))
    a, t = 2 + F.bround(14 * F.col("i")), 1 + F.bround(7 * F.col("i"))
    side = F.when(F.col("on") % 2 == 1, 1).otherwise(-1)
    grey = F.least(F.lit(1.0), pick(FLICKER) * (0.4 + 0.6 * F.col("i")) * F.get("u", F.lit(1)))
    whole = lambda c: F.bround(c).cast("long")
    return d.select("event_id", "on", whole(a * je).alias("red"), whole(-a * je * 0.8).alias("blue"), whole(t * side * F.abs(je)).alias("tear"), F.bround(grey, 3).alias("grey"))


def rgb_split(spark, sf_dir):
    """Per frame: how far red and blue tear apart, and snap back."""
    d = _cues(spark, sf_dir).select("event_id", "i", F.posexplode(draws(_seed(F.col("at")), SPLIT_DRAWS, len(SPLIT))).alias("on", "u"))
    far = (3 + F.bround(18 * F.col("i"))) * F.get(F.array(*map(F.lit, SPLIT)), F.col("on")) * F.get("u", F.lit(0))
    whole = lambda c: F.bround(c).cast("long")
    return d.select("event_id", "on", whole(far).alias("red"), whole(-far).alias("blue"), whole(far * 0.35).alias("down"))


QUERIES = [camera_shake, glitch, rgb_split, grain, zoom_punch, zoom_blur, pixelate, film_burn, phrase_segments, bounce_tags, caption_safe_zone]

_C = f"""e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1000000.0::DOUBLE - {BEGIN}::DOUBLE AS t0 FROM events),
c AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 100)) AS i FROM e)"""
_T0 = lambda n: f"greatest(0.0::DOUBLE, t0 - {n / FPS / 2}::DOUBLE)"
ORACLES = {
    "camera_shake": f"""WITH {_C}, f AS (SELECT *, unnest(range(0, {SHAKE_FRAMES}))::INT AS "on" FROM c), g AS (SELECT *, (1 - "on"::DOUBLE / {SHAKE_FRAMES}) * (0.004::DOUBLE + 0.021::DOUBLE * i) AS size FROM f)
SELECT event_id, "on", round({_T0(SHAKE_FRAMES)} + "on" / {FPS}::DOUBLE, 4) AS t, round(sin("on" * 2.7::DOUBLE) * size, 7) AS x, round(cos("on" * 3.3::DOUBLE) * size, 7) AS y FROM g""",
    "grain": f"WITH {_C} SELECT event_id, round({_T0(GRAIN_FRAMES)}, 4) AS a, round({_T0(GRAIN_FRAMES)} + {GRAIN_FRAMES / FPS}::DOUBLE, 4) AS b, (10 + round_even(30 * i, 0))::BIGINT AS strength, round(1 + 0.06::DOUBLE * i, 6) AS contrast FROM c",
    "zoom_punch": f"""WITH {_C}, f AS (SELECT event_id, 1.06::DOUBLE + 0.16::DOUBLE * i AS top, unnest(range(0, 13))::INT AS "on" FROM c)
SELECT event_id, "on", round(CASE WHEN "on" < 4 THEN 1 + (top - 1) * "on" / 4.0::DOUBLE WHEN "on" < 6 THEN top WHEN "on" < 12 THEN top - (top - 1) * pow(("on" - 6) / 6.0::DOUBLE, 2) ELSE 1 END, 10) AS zoom FROM f""",
    "zoom_blur": f"""WITH {_C}, f AS (SELECT event_id, i, 1.1::DOUBLE + 0.3::DOUBLE * i AS top, unnest(range(0, 12))::INT AS "on" FROM c)
SELECT event_id, "on", round(CASE WHEN "on" < 4 THEN 1 + (top - 1) * pow("on" / 4.0::DOUBLE, 2) WHEN "on" < 11 THEN top - (top - 1) * pow(("on" - 4) / 7.0::DOUBLE, 1.6::DOUBLE) ELSE 1 END, 10) AS zoom, (3 + round_even(3 * i, 0))::BIGINT AS blur FROM f""",
    "pixelate": f"""WITH {_C}, p AS (SELECT *, (8 + round_even(28 * i, 0))::BIGINT AS block FROM c) SELECT event_id, round({_T0(MOSAIC_FRAMES)}, 4) AS a, round({_T0(MOSAIC_FRAMES)} + {MOSAIC_FRAMES / FPS}::DOUBLE, 4) AS b, block,
greatest(2, round_even({WIDTH}.0::DOUBLE / block, 0))::BIGINT AS w, greatest(2, round_even({HEIGHT}.0::DOUBLE / block, 0))::BIGINT AS h FROM p""",
    "film_burn": f"""WITH {_C}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t0) - 1 AS j, count(*) OVER (PARTITION BY user_id) AS k FROM c WHERE event_type = 'purchase')
SELECT event_id, user_id, round(greatest(0.0::DOUBLE, t0 - 0.42::DOUBLE), 3) AS a, round(t0 + 0.22::DOUBLE, 3) AS b, round(greatest(0.0::DOUBLE, [0.5::DOUBLE, 1.1, 1.9][(j % 3 + 1)::INT] - 0.42::DOUBLE + 0.18::DOUBLE), 2) AS "offset" FROM p WHERE k <= 8""",
    "phrase_segments": f"""WITH {_C}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t0) - 1 AS rn, length(event_type) * 20.0::DOUBLE AS width FROM c),
l AS (SELECT *, rn // 6 AS line, (rn % 6)::INT AS word FROM r), m AS (SELECT *, sum(width) OVER v + 28 * (count(*) OVER v - 1) AS total, coalesce(sum(width + 28) OVER (PARTITION BY user_id, line ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
lead(t0) OVER (PARTITION BY user_id, line ORDER BY word) AS nxt, floor(min(t0) OVER v) AS b0, min(t0) OVER v AS first, max(t0) OVER v + 0.8::DOUBLE AS b1 FROM l WINDOW v AS (PARTITION BY user_id, line)),
w AS (SELECT *, round_even(540 - total / 2 + before + width / 2, 0) AS cx FROM m),
s AS (SELECT user_id, line, word AS active, t0 AS a, coalesce(nxt, b1) AS b, width AS aw FROM w UNION ALL SELECT user_id, line, -1, b0, first, 0 FROM w WHERE word = 0 AND first > b0 + 0.02::DOUBLE)
SELECT w.user_id, w.line, w.word, s.active, round(s.a, 3) AS a, round(CASE WHEN s.b > s.a THEN s.b ELSE s.a + 0.05::DOUBLE END, 3) AS b,
(CASE WHEN s.active = w.word OR s.active < 0 THEN cx WHEN w.word < s.active THEN cx - round_even({SCALE / 100 - 1}::DOUBLE * aw / 2, 0) ELSE cx + round_even({SCALE / 100 - 1}::DOUBLE * aw / 2, 0) END)::BIGINT AS x FROM w JOIN s ON s.user_id = w.user_id AND s.line = w.line""",
    "bounce_tags": r"""WITH d AS (SELECT event_id, round_even(value, 0)::BIGINT AS ms FROM events) SELECT event_id, '\t(0,90,120)\t(90,180,110)' || CASE WHEN ms > 260 THEN '\t(' || (ms - 80) || ',' || ms || ',100)' ELSE '' END AS tags FROM d""",
    "caption_safe_zone": f"""WITH {_C}, d AS (SELECT event_id, 0.5::DOUBLE + i / 2 AS c, CASE WHEN event_id % 3 = 0 THEN 1080 ELSE 1920 END AS h FROM c)
SELECT event_id, round(CASE WHEN h <= 1080 THEN c ELSE least(c, (round_even(1565.0::DOUBLE * h / 1920, 0) - 96) / h) END, 6) AS centre FROM d""",
}
