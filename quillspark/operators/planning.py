"""Render planning: transitions, presets, inputs, phases, delivery grid and loudness decisions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..sources.tables import load, seconds
from .intervals import BEGIN, END, keyframe_spans, sample_keyframes

# Start and end of the pans (x, then y) of each preset; other presets count as "in".
PRESETS = {
    "in": (0.5, 0.5, 0.5, 0.5),
    "out": (0.5, 0.5, 0.5, 0.5),
    "left": (0.85, 0.15, 0.5, 0.5),
    "right": (0.15, 0.85, 0.5, 0.5),
    "up": (0.5, 0.5, 0.85, 0.15),
    "down": (0.5, 0.5, 0.15, 0.85),
    "in_left": (0.65, 0.35, 0.5, 0.5),
    "in_right": (0.35, 0.65, 0.5, 0.5),
    "out_left": (0.35, 0.65, 0.5, 0.5),
    "out_right": (0.65, 0.35, 0.5, 0.5),
}
# Conventional rates that stand for exact ones.
NTSC = {29.97: "30000/1001", 23.976: "24000/1001", 59.94: "60000/1001"}
SNAP, MOST_DENOMINATOR, SAMPLE_RATE, FRAME_TOLERANCE = 1e-9, 1001, 48_000, 2.0
PHASES = ["signup", "view", "click", "purchase", "error"]


def smoother(p: Column) -> Column:
    return p * p * p * (p * (p * 6 - 15) + 10)


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def ieee_ratio(a: Column, b: Column) -> Column:
    """a / b as IEEE 754 has it, also where ``b`` is zero of either sign (ANSI mode raises an error there)."""
    infinity = F.when(b.cast("string").startswith("-"), float("-inf")).otherwise(float("inf"))
    return F.when(b == 0, a * infinity).otherwise(F.try_divide(a, b))


def slide_offset(t: Column, start: Column, end: Column, dur: Column, phase: str) -> Column:
    """How far off its seat a sliding clip is at ``t``, 1 to 0 at entry and 0 to 1 at return; 0 outside both.
    A return of no length is off at once."""
    d = F.least(dur, end - start)
    begin = start if phase == "entry" else end - d
    p = smoother(clip01(F.try_divide(t - begin, d)))  # at a window of no length 0 / 0, which clips to 1 as null does
    return F.when(t.between(begin, begin + d), 1 - p if phase == "entry" else p).otherwise(F.lit(0.0))


def dissolve_alpha(t: Column, start: Column, end: Column, dur: Column) -> Column:
    """A linear ramp up from the start and down to the end, each as long as ``dur`` or the span; of no length, none."""
    d = F.least(dur, F.greatest(end - start, F.lit(1e-3)))
    return F.least(clip01(ieee_ratio(t - start, d)), clip01(ieee_ratio(end - t, d)))


def declared_grid(fps: Column) -> Column:
    """The exact rational of a declared rate: a conventional alias's, else the nearest of
    denominator 1001 or less; null for rates that are no grid."""
    snapped = F.lit(None).cast("string")
    for alias, exact in NTSC.items():
        snapped = F.when(F.abs(fps - alias) <= SNAP * F.greatest(F.abs(fps), F.lit(alias)), exact).otherwise(snapped)
    tried = F.transform(F.sequence(F.lit(1), F.lit(MOST_DENOMINATOR)), lambda d: F.struct(F.round(F.abs(F.round(fps * d) / d - fps), 12).alias("far"), d.alias("d")))
    best = F.array_min(tried)["d"]
    whole = F.round(fps * best).cast("long").cast("string")
    near = F.when(best == 1, whole).otherwise(F.concat_ws("/", whole, best.cast("string")))
    return F.when(fps.isNull() | F.isnan(fps) | (fps <= 0) | (fps == float("inf")), F.lit(None)).otherwise(F.coalesce(snapped, near))


def renamed_once(text: Column, names: dict[str, str]) -> Column:
    """The bracketed pads of a text renamed all at once, so that a new name is never renamed again."""
    parts = F.regexp_extract_all(text, F.lit(r"\[[^\[\]]*\]|[^\[]+|\["), F.lit(0))
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in (f"[{pair[0]}]", f"[{pair[1]}]")))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.get(F.map_values(F.map_filter(table, lambda k, _: k == p)), F.lit(0)), p)), "")


def fitting_size(fits_at, most: int, least: int, step: int) -> Column:
    """The greatest size of most, most - step, ... that fits; ``least`` if none does."""
    sizes = F.filter(F.sequence(F.lit(most), F.lit(least), F.lit(-step)), fits_at)
    return F.coalesce(F.array_max(sizes), F.lit(least))


def loudness_action(measured: Column, target: Column, attenuate_only: Column) -> Column:
    return F.when(attenuate_only & (measured <= target), "none").when(measured > target, "attenuate").otherwise("normalize")


def _events(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", (seconds() - BEGIN).alias("s"))


def static_crop(spark, sf_dir):
    """The value of each user's first keyframe."""
    return _events(spark, sf_dir).groupBy("user_id").agg(F.min_by("value", F.struct("s", "event_id")).alias("value"))


def input_pruning(spark, sf_dir):
    """Parts that lines consume, numbered in declaration order within their brand."""
    used = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    p = load(spark, sf_dir, "part").select("p_partkey", "p_brand").join(used, "p_partkey", "left_semi")
    return p.select("p_partkey", "p_brand", (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("index"))


def _clips(spark, sf_dir):
    d = _events(spark, sf_dir).withColumn("e", F.col("s") + 120).withColumn("dur", F.col("value"))
    return d.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumn("t", F.col("s") + F.col("k") * 15.0)


def slide_transition(spark, sf_dir):
    """Offsets of a clip that slides in, and out again, at nine times."""
    c = F.col
    out = F.when(c("event_type") == "click", 0.0).otherwise(slide_offset(c("t"), c("s"), c("e"), c("dur"), "return"))
    off = F.greatest(slide_offset(c("t"), c("s"), c("e"), c("dur"), "entry"), out)
    sign = F.when(c("event_type").isin("view", "purchase"), -1).otherwise(1)
    return _clips(spark, sf_dir).select("event_id", "k", F.round(sign * off, 5).alias("x"))


def dissolve(spark, sf_dir):
    c = F.col
    return _clips(spark, sf_dir).select("event_id", "k", F.round(dissolve_alpha(c("t"), c("s"), c("e"), c("dur")), 5).alias("alpha"))


def kenburns_presets(spark, sf_dir):
    """Each part's move: its preset's pans and zooms; an unknown preset is "in"."""
    names = [*PRESETS, "spin", "roll"]
    table = spark.createDataFrame([(k, *v) for k, v in PRESETS.items()], "preset string, x0 double, x1 double, y0 double, y1 double")
    p = load(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*map(F.lit, names)), (F.col("p_size") % len(names)).cast("int")).alias("asked"))
    p = p.withColumn("preset", F.when(F.col("asked").isin(list(PRESETS)), F.col("asked")).otherwise("in"))
    d = p.join(F.broadcast(table), "preset")  # ten rows
    zoom = lambda first: F.when(F.col("preset").startswith("in"), 1.0 if first else 1.12).when(F.col("preset").startswith("out"), 1.12 if first else 1.0).otherwise(1.08)
    return d.select("p_partkey", "preset", "x0", "x1", "y0", "y1", zoom(True).alias("z0"), zoom(False).alias("z1"))


def voice_gate(spark, sf_dir):
    """Whether the noise floor that a measurement's log tells is over -50 dB; a log without one is clean."""
    log = F.when(F.col("event_type") == "error", "no such line").otherwise(F.concat(F.lit("[a] Peak: 1\n[a] Noise floor dB: "), F.round(F.col("value") / 5 - 100, 2).cast("string"), F.lit("\n[a] Noise floor dB: 0")))
    floor = F.regexp_extract(log, r"Noise floor dB:\s*(-?[0-9.]+)", 1).try_cast("double")
    return _events(spark, sf_dir).select("event_id", F.coalesce(floor > -50, F.lit(False)).alias("dirty"))


def sfx_delay(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.bround(F.col("value") * 1000).cast("long").alias("ms"))


def caption_colour_source(spark, sf_dir):
    """Accent: declared, else the brand's, else refused; body: the brand's, else white."""
    declared = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("#11aa33"))
    brand = F.when(F.col("c_nationkey") < 15, F.concat(F.lit("#0000"), F.lpad(F.hex(F.col("c_nationkey")), 2, "0")))
    fg = F.when(F.col("c_acctbal") > 0, F.lit("#eeeeee"))
    return load(spark, sf_dir, "customer").select("c_custkey", F.coalesce(declared, brand, F.lit("refused")).alias("accent"), F.coalesce(fg, F.lit("#ffffff")).alias("fg"))


def phase_order(spark, sf_dir):
    """Steps of a user that come after a later phase has begun."""
    rank = F.array_position(F.array(*map(F.lit, PHASES)), F.col("event_type"))
    w = Window.partitionBy("user_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    d = _events(spark, sf_dir).withColumn("rank", rank)
    return d.withColumn("most", F.max("rank").over(w)).where(F.col("rank") < F.col("most")).select("event_id", "user_id", F.col("rank").cast("long"), F.col("most").cast("long"))


def output_dispatch(spark, sf_dir):
    """What becomes of each output by its kind and what the job has made."""
    kind = F.col("o_orderpriority")
    act = (
        F.when(kind == "4-NOT SPECIFIED", "skipped")
        .when(kind == "3-MEDIUM", F.when(F.col("o_orderstatus") == "F", "presync").otherwise("nothing"))
        .when(kind == "1-URGENT", F.when(F.col("o_totalprice") > 100_000, "cover").otherwise("nothing"))
        .otherwise("master")
    )
    return load(spark, sf_dir, "orders").groupBy(kind.alias("kind"), act.alias("act")).agg(F.count(F.lit(1)).alias("n"))


def pad_renaming(spark, sf_dir):
    """Two pads trade names in one pass."""
    text = F.concat(F.lit("["), F.col("event_type"), F.lit("]split[click][view];[view]trim["), F.col("event_type"), F.lit("]"))
    return _events(spark, sf_dir).select("event_id", renamed_once(text, {"click": "view", "view": "click", "error": "e0"}).alias("graph"))


def encode_budget(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity") / (1 + F.col("l_discount"))).alias("dur"))
    return d.select("l_orderkey", F.round(300 + 60 * F.col("dur"), 3).alias("budget_s"))


def mark_glass(spark, sf_dir):
    """A mark's place: keyframes moved to the section's start, linear, kept inside the frame."""
    e = _events(spark, sf_dir).where(F.col("event_type") == "view").withColumn("t", F.col("s") + 900).withColumn("x", F.col("value") / 250 - 0.5)
    step, stretch = 6 * 3600.0, END - BEGIN
    spans = keyframe_spans(e, "user_id", "t", "x", 0.0, stretch)
    grid = e.select("user_id").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(int(stretch / step) - 1)))).withColumn("t", F.col("t") * step)
    out = sample_keyframes(spans, grid, "user_id", 4 * step)
    return out.select("user_id", F.col("t").cast("long").alias("t"), F.round(F.greatest(F.lit(0.0), F.least(F.col("value"), F.lit(0.8))), 5).alias("x"))


def section_split(spark, sf_dir):
    """Sections: of the catalog, bespoke with a delivered entry, or skipped."""
    entry = load(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_partkey").alias("entry")).distinct()
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name").join(entry, F.col("p_partkey") == F.col("entry"), "left")
    kind = F.when(~F.col("p_name").startswith("small"), "catalog").when(F.col("entry").isNotNull(), "bespoke").otherwise("skipped")
    return p.select("p_partkey", kind.alias("kind"))


def font_fit(spark, sf_dir):
    size = fitting_size(lambda s: s * F.length("p_name") * 0.6 <= 300, 96, 24, 4)
    return load(spark, sf_dir, "part").select("p_partkey", size.alias("size"))


def _rates(spark, sf_dir):
    """Rates declared for the lines: conventional, whole, decimal, and none."""
    fps = F.when(F.col("l_linenumber") == 1, 29.97).when(F.col("l_linenumber") == 2, 23.976).when(F.col("l_linenumber") == 3, 59.94).when(F.col("l_linenumber") == 4, -1.0).otherwise(F.col("l_quantity") + F.col("l_discount"))
    return load(spark, sf_dir, "lineitem").select("l_quantity", "l_tax", "l_discount", fps.alias("fps"))


def declared_grids(spark, sf_dir):
    return _rates(spark, sf_dir).select("fps").distinct().select("fps", declared_grid(F.col("fps")).alias("grid"))


def grid_verdict(spark, sf_dir):
    """Declared against measured: rate, sample rate, and the lengths of picture and sound; rows without a defect don't appear."""
    d = _rates(spark, sf_dir).distinct().where(F.col("fps") > 0)
    d = d.join(d.select("fps").distinct().select("fps", declared_grid(F.col("fps")).alias("declared")), "fps")  # each rate's grid once
    d = d.withColumn("measured", F.when(F.col("l_tax") > 0.06, "25").otherwise(F.col("declared"))).withColumn("rate", F.when(F.col("l_tax") < 0.02, 44_100).otherwise(SAMPLE_RATE))
    delta = F.abs(F.col("l_quantity") - (F.col("l_quantity") + F.col("l_discount") - 0.05)) * 1000
    d = d.select(
        "l_quantity", "l_tax", "l_discount", "fps",
        F.when(F.col("measured") != F.col("declared"), F.concat_ws(" for ", "measured", "declared")).alias("video_rate"),
        F.when(F.col("rate") != SAMPLE_RATE, F.col("rate")).alias("audio_rate"),
        F.when(delta > FRAME_TOLERANCE * 1000 / F.col("fps"), F.round(delta, 1)).alias("av_delta_ms"),
    )
    return d.where(F.col("video_rate").isNotNull() | F.col("audio_rate").isNotNull() | F.col("av_delta_ms").isNotNull())


def logo_window(spark, sf_dir):
    """Until when the logo shows: the end, less the held cover if one was welded."""
    hold = F.when(F.col("o_orderstatus") == "F", 2500.0).otherwise(0.0)
    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(F.greatest(F.lit(0.0), F.col("o_totalprice") / 100 - hold), 5).alias("body_end"))


def delivery_loudness(spark, sf_dir):
    act = loudness_action(F.col("value") / 10 - 30, F.lit(-14.0), F.col("event_type") == "error")
    return _events(spark, sf_dir).groupBy("event_type", act.alias("act")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = [
    static_crop, input_pruning, slide_transition, dissolve, kenburns_presets, voice_gate, sfx_delay, caption_colour_source, phase_order, output_dispatch,
    pad_renaming, encode_budget, mark_glass, section_split, font_fit, declared_grids, grid_verdict, logo_window, delivery_loudness,
]

_E = f"e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1000000.0::DOUBLE - {BEGIN}::DOUBLE AS s FROM events)"
_K = f"{_E}, c AS (SELECT *, s + 120 AS e, least(value, 120.0::DOUBLE) AS d, unnest(range(0, 9))::INT AS k FROM e), q AS (SELECT *, s + k * 15.0::DOUBLE AS t FROM c)"
_CL = lambda x: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"
_SM = lambda p: f"({p} * {p} * {p} * ({p} * ({p} * 6 - 15) + 10))"
_R = """r AS (SELECT DISTINCT l_quantity, l_tax, l_discount, CASE l_linenumber WHEN 1 THEN 29.97::DOUBLE WHEN 2 THEN 23.976::DOUBLE WHEN 3 THEN 59.94::DOUBLE WHEN 4 THEN -1.0::DOUBLE ELSE l_quantity + l_discount END AS fps FROM lineitem),
f AS (SELECT DISTINCT fps FROM r), n AS (SELECT fps, unnest(range(1, 1002)) AS d FROM f WHERE fps > 0), b AS (SELECT fps, arg_min(d, (round(abs(round(fps * d) / d - fps), 12), d)) AS d FROM n GROUP BY 1),
g AS (SELECT f.fps, CASE WHEN f.fps <= 0 THEN NULL WHEN abs(f.fps - 29.97::DOUBLE) <= 1e-9 * f.fps THEN '30000/1001' WHEN abs(f.fps - 23.976::DOUBLE) <= 1e-9 * f.fps THEN '24000/1001' WHEN abs(f.fps - 59.94::DOUBLE) <= 1e-9 * f.fps THEN '60000/1001'
WHEN d = 1 THEN round(f.fps)::BIGINT::VARCHAR ELSE round(f.fps * d)::BIGINT || '/' || d END AS grid FROM f LEFT JOIN b ON b.fps = f.fps)"""
_N = [*PRESETS, "spin", "roll"]
ORACLES = {
    "static_crop": "SELECT user_id, arg_min(value, (ts, event_id)) AS value FROM events GROUP BY 1",
    "input_pruning": "SELECT p_partkey, p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS index FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)",
    "slide_transition": f"""WITH {_K}, p AS (SELECT *, CASE WHEN t BETWEEN s AND s + d THEN 1 - {_SM(_CL('(t - s) / d'))} ELSE 0 END AS a, CASE WHEN event_type <> 'click' AND t BETWEEN e - d AND e - d + d THEN {_SM(_CL('(t - (e - d)) / d'))} ELSE 0 END AS b FROM q)
SELECT event_id, k, round(CASE WHEN event_type IN ('view', 'purchase') THEN -1 ELSE 1 END * greatest(a, b), 5) AS x FROM p""",
    "dissolve": f"WITH {_K} SELECT event_id, k, round(least({_CL('(t - s) / d')}, {_CL('(e - t) / d')}), 5) AS alpha FROM q",
    "kenburns_presets": f"""WITH t(preset, x0, x1, y0, y1) AS (VALUES {', '.join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for k, (a, b, c, d) in PRESETS.items())}),
p AS (SELECT p_partkey, [{', '.join(f"'{n}'" for n in _N)}][p_size % {len(_N)} + 1] AS asked FROM part), q AS (SELECT p_partkey, CASE WHEN asked IN (SELECT preset FROM t) THEN asked ELSE 'in' END AS preset FROM p)
SELECT p_partkey, preset, x0, x1, y0, y1, CASE WHEN preset LIKE 'in%' THEN 1.0::DOUBLE WHEN preset LIKE 'out%' THEN 1.12::DOUBLE ELSE 1.08::DOUBLE END AS z0, CASE WHEN preset LIKE 'in%' THEN 1.12::DOUBLE WHEN preset LIKE 'out%' THEN 1.0::DOUBLE ELSE 1.08::DOUBLE END AS z1 FROM q JOIN t USING (preset)""",
    "voice_gate": "SELECT event_id, event_type <> 'error' AND round(value / 5 - 100, 2) > -50 AS dirty FROM events",
    "sfx_delay": "SELECT event_id, round_even(value * 1000, 0)::BIGINT AS ms FROM events",
    "caption_colour_source": "SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN '#11aa33' WHEN c_nationkey < 15 THEN '#0000' || lpad(upper(to_hex(c_nationkey)), 2, '0') ELSE 'refused' END AS accent, CASE WHEN c_acctbal > 0 THEN '#eeeeee' ELSE '#ffffff' END AS fg FROM customer",
    "phase_order": f"""WITH {_E}, r AS (SELECT *, list_position([{', '.join(f"'{p}'" for p in PHASES)}], event_type)::BIGINT AS rank FROM e), m AS (SELECT *, max(rank) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM r)
SELECT event_id, user_id, rank, most FROM m WHERE rank < most""",
    "output_dispatch": """SELECT o_orderpriority AS kind, CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'skipped' WHEN '3-MEDIUM' THEN CASE WHEN o_orderstatus = 'F' THEN 'presync' ELSE 'nothing' END WHEN '1-URGENT' THEN CASE WHEN o_totalprice > 100000 THEN 'cover' ELSE 'nothing' END ELSE 'master' END AS act, count(*) AS n FROM orders GROUP BY 1, 2""",
    "pad_renaming": """WITH t AS (SELECT event_id, '[' || event_type || ']split[click][view];[view]trim[' || event_type || ']' AS g FROM events)
SELECT event_id, array_to_string(list_transform(regexp_extract_all(g, '\\[[^\\[\\]]*\\]|[^\\[]+|\\['), lambda p: CASE p WHEN '[click]' THEN '[view]' WHEN '[view]' THEN '[click]' WHEN '[error]' THEN '[e0]' ELSE p END), '') AS graph FROM t""",
    "encode_budget": "SELECT l_orderkey, round(300 + 60 * sum(l_quantity / (1 + l_discount)), 3) AS budget_s FROM lineitem GROUP BY 1",
    "mark_glass": f"""WITH {_E}, v AS (SELECT user_id, s + 900 AS t, value / 250 - 0.5::DOUBLE AS x FROM e WHERE event_type = 'view'), k AS (SELECT user_id, t AS t0, x AS v0, lead(t) OVER w AS t1, lead(x) OVER w AS v1, lag(t) OVER w AS p FROM v WINDOW w AS (PARTITION BY user_id ORDER BY t)),
g AS (SELECT user_id, i * 21600.0::DOUBLE AS t FROM (SELECT DISTINCT user_id FROM v), range(0, 124) r(i)),
j AS (SELECT user_id, t, CASE WHEN t < t0 OR t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * ((t - t0) / (t1 - t0)) END AS x FROM g JOIN k USING (user_id) WHERE (t >= t0 OR p IS NULL) AND (t1 IS NULL OR t < t1))
SELECT user_id, t::BIGINT AS t, round(greatest(0.0::DOUBLE, least(x, 0.8::DOUBLE)), 5) AS x FROM j""",
    "section_split": "SELECT p_partkey, CASE WHEN p_name NOT LIKE 'small%' THEN 'catalog' WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') THEN 'bespoke' ELSE 'skipped' END AS kind FROM part",
    "font_fit": "SELECT p_partkey, coalesce(max(s), 24)::INT AS size FROM (SELECT p_partkey, CASE WHEN s * length(p_name) * 0.6::DOUBLE <= 300 THEN s END AS s FROM part, range(24, 97, 4) r(s)) GROUP BY 1",
    "declared_grids": f"WITH {_R} SELECT fps, grid FROM g",
    "grid_verdict": f"""WITH {_R}, x AS (SELECT r.*, grid, CASE WHEN l_tax > 0.06 THEN '25' ELSE grid END AS m, CASE WHEN l_tax < 0.02 THEN 44100 ELSE 48000 END AS rate, abs(l_quantity - (l_quantity + l_discount - 0.05::DOUBLE)) * 1000 AS delta FROM r JOIN g ON g.fps = r.fps WHERE r.fps > 0),
y AS (SELECT l_quantity, l_tax, l_discount, fps, CASE WHEN m <> grid THEN m || ' for ' || grid END AS video_rate, CASE WHEN rate <> 48000 THEN rate END AS audio_rate, CASE WHEN delta > 2000 / fps THEN round(delta, 1) END AS av_delta_ms FROM x)
SELECT * FROM y WHERE video_rate IS NOT NULL OR audio_rate IS NOT NULL OR av_delta_ms IS NOT NULL""",
    "logo_window": "SELECT o_orderkey, round(greatest(0.0::DOUBLE, o_totalprice / 100 - CASE WHEN o_orderstatus = 'F' THEN 2500 ELSE 0 END), 5) AS body_end FROM orders",
    "delivery_loudness": "SELECT event_type, CASE WHEN event_type = 'error' AND value / 10 - 30 <= -14 THEN 'none' WHEN value / 10 - 30 > -14 THEN 'attenuate' ELSE 'normalize' END AS act, count(*) AS n FROM events GROUP BY 1, 2",
}
