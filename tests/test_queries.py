"""Every query of the library against its SQL, and small cases with known results."""

import math

import pytest
from pyspark.sql import functions as F

from quillspark import catalog
from quillspark.functions.text import greedy_lines, redact
from quillspark.operators.cache import prune, retained
from quillspark.operators.intervals import complement, islands, tempo_factors
from quillspark.operators.signals import refractory
from quillspark.operators.stream import settled_prefix_of

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    r = duck.execute(catalog.ORACLES[name])
    at = [[d[0] for d in r.description].index(c) for c in cols]
    assert len(r.description) == len(cols)
    assert ours == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def clips_of_odd_durations(spark, folder):
    """Events whose value, the duration of a transition, is zero of either sign, negative, null, infinite, not a number, or over the span."""
    values = (0.0, -0.0, 5e-324, -3.0, None, float("inf"), float("-inf"), float("nan"), 30.0, 500.0)
    rows = [(i * 10 + j, i, kind, v) for i, kind in enumerate(("click", "view", "purchase", "error")) for j, v in enumerate(values)]
    d = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    d.withColumn("ts", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:11.172425' + make_interval(0, 0, 0, 0, 0, 0, event_id * 7.25)")).write.parquet(f"{folder}/events.parquet")


def agrees_with_sql(spark, folder, name):
    import duckdb

    r = duckdb.connect()
    r.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    ours = sorted((tuple(map(plain, x)) for x in df.collect()), key=str)
    theirs = sorted((tuple(map(plain, x)) for x in r.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES[name]})").fetchall()), key=str)
    assert len(ours) == 360 and ours == theirs


def test_dissolve_of_no_duration(spark, tmp_path):
    clips_of_odd_durations(spark, tmp_path)
    agrees_with_sql(spark, tmp_path, "dissolve")


def test_slide_of_no_duration(spark, tmp_path):
    clips_of_odd_durations(spark, tmp_path)
    agrees_with_sql(spark, tmp_path, "slide_transition")


def test_complement_has_head_and_tail_and_joins_overlaps(spark):
    d = spark.createDataFrame([("a", 2.0, 4.0), ("a", 3.0, 5.0), ("a", 8.0, 9.0)], "k string, s double, e double")
    assert sorted(map(tuple, complement(d, "k", "s", "e", 0.0, 10.0).collect())) == [("a", 0.0, 2.0), ("a", 5.0, 8.0), ("a", 9.0, 10.0)]


def test_islands_keep_an_exact_gap_together(spark):
    d = spark.createDataFrame([("a", 0.0, 1.0), ("a", 3.0, 4.0), ("a", 6.5, 7.0)], "k string, s double, e double")
    assert [r.island for r in islands(d, "k", "s", "e", 2.0).orderBy("s").collect()] == [1, 1, 2]


def test_prune_spares_the_pinned(spark):
    d = spark.createDataFrame([(1, 5, False), (2, 5, True), (3, 5, False), (4, 5, False)], "id int, size int, pin boolean")
    assert [r.id for r in prune(d, F.lit(10), ["id"], "size", "pin").orderBy("id").collect()] == [1, 3]


def test_running_sums_in_two_levels(spark):
    from quillspark.plans.running import running

    rows = [("a" if i % 3 else None, i, i * 7 % 11) for i in range(200)]
    got = {r.i: (r.up, r.every) for r in running(spark.createDataFrame(rows, "k string, i int, v int"), F.col("k"), ["i"], F.floor(F.col("i") / 9), F.col("v"), "up", "every").collect()}
    for k in ("a", None):
        own = [(i, v) for g, i, v in rows if g == k]
        assert all(got[i] == (sum(v for j, v in own if j <= i), sum(v for _, v in own)) for i, _ in own)


def test_refractory_counts_from_the_last_accepted(spark):
    d = spark.createDataFrame([("a", 0.0), ("a", 3.0), ("a", 5.0), ("a", 9.0)], "k string, t double")
    assert sorted(r.t for r in refractory(d, "k", "t", 4.0).collect()) == [0.0, 5.0, 9.0]


def test_retention_goes_on_after_a_refusal_and_starts_anew_for_each_group(spark):
    rows = [("a", 1, 6), ("a", 2, 5), ("a", 3, 4), ("a", 4, 1), ("b", 1, 11), ("b", 2, 10), (None, 1, 10), (None, 2, 1), ("c", 1, None)]
    d = spark.createDataFrame(rows, "g string, id int, size int")
    assert sorted((str(r.g), r.id) for r in retained(d, 10, ["id"], "size", "g").collect()) == [("None", 1), ("a", 1), ("a", 3), ("b", 2)]


def test_retention_keeps_its_state_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        d = spark.range(100).selectExpr("'a' AS g", "id", "3L AS size")
        assert sorted(r.id for r in retained(d, 100, ["id"], "size", "g").collect()) == list(range(33))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tempo_factors_stay_in_range(spark):
    for r in spark.createDataFrame([(0.1,), (0.5,), (1.0,), (3.7,), (50.0,)], "s double").select("s", tempo_factors(F.col("s")).alias("f")).collect():
        assert all(0.5 <= x <= 2.0 for x in r.f) and math.isclose(math.prod(r.f), r.s)


def test_settled_prefix_stops_at_the_head(spark):
    d = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, True)], "s string, q int, ok boolean")
    assert sorted((r.s, r.q) for r in settled_prefix_of(d, "s", "q", "ok").collect()) == [("a", 1), ("b", 1)]


def test_text(spark):
    r = spark.range(1).select(greedy_lines(F.lit("aa bb  cc dddddd e"), 5).alias("l"), redact(F.lit("x Bearer abc https://h/p?q=1 password=z y")).alias("r")).first()
    assert r.l == ["aa bb", "cc", "dddddd", "e"]
    assert r.r == "x Bearer [REDACTED] [redacted-url] password=z y"
    t = "a wss://h/x?token=1 and Authorization=Bearer abc; X-Amz-Signature=9f&b=1 signature=zz"
    assert spark.range(1).select(redact(F.lit(t)).alias("r")).first().r == "a [redacted-url] and Authorization=[REDACTED] [REDACTED]; X-Amz-Signature=[REDACTED]&b=1 signature=[REDACTED]"


def test_keyframes_hold_before_and_after_and_jump_where_two_meet(spark):
    from quillspark.operators.intervals import keyframe_spans, sample_keyframes

    k = spark.createDataFrame([("a", 2.0, 1.0), ("a", 4.0, 3.0), ("a", 4.0, 7.0)], "k string, t double, v double")
    grid = spark.createDataFrame([("a", float(t)) for t in range(11)], "k string, t double")
    got = {r.t: r.value for r in sample_keyframes(keyframe_spans(k, "k", "t", "v", 0.0, 10.0), grid, "k", 3.0).collect()}
    assert {t: got[t] for t in (0, 1, 2, 3)} == {0: 1, 1: 1, 2: 1, 3: 2} and all(got[t] in (3, 7) for t in range(4, 11)) and len(got) == 11
    eased = sample_keyframes(keyframe_spans(k.where("v < 7"), "k", "t", "v", 0.0, 10.0), grid, "k", 3.0, F.lit("in"))
    assert {r.t: r.value for r in eased.collect()}[3.0] == 1.5


def test_refused_restarts_do_not_count(spark):
    from quillspark.operators.stream import allowed_restarts

    d = spark.createDataFrame([("a", t) for t in (0, 10, 20, 30, 40, 3600, 3605, 3611)] + [("b", 5)], "k string, t long")
    assert sorted((r.k, r.t) for r in allowed_restarts(d, "k", "t", 3, 3600).collect()) == [("a", 0), ("a", 10), ("a", 20), ("a", 3600), ("a", 3611), ("b", 5)]


def test_blocks_break_at_pauses_and_at_a_third_line(spark):
    from quillspark.operators.intervals import phrase_blocks

    rows = [(0.0, 1.0, 4), (1.0, 2.0, 4), (2.0, 3.0, 4), (3.0, 4.0, 4), (4.0, 5.0, 4), (9.0, 9.5, 2), (9.7, 9.8, 99), (9.9, 10.0, 1)]
    d = spark.createDataFrame([("a", *r) for r in rows], "k string, s double, e double, w int")
    got = [r.block for r in phrase_blocks(d, "k", "s", "e", "w", 0.7, 9, 2).orderBy("s").collect()]
    assert got == [1, 1, 1, 1, 2, 3, 3, 4]


def test_levels_of_diamonds_and_cycles_end(spark):
    from quillspark.operators.dag import closure, levels

    n = 20  # 2 ** 20 paths
    edges = [(3 * i, 3 * i + j) for i in range(n) for j in (1, 2)] + [(3 * i + j, 3 * i + 3) for i in range(n) for j in (1, 2)]
    steps = spark.createDataFrame([(i, 1.0) for i in range(3 * n + 1)] + [(1000, 1.0), (1001, 1.0), (1002, 5.0)], "step long, cost double")
    e = spark.createDataFrame(edges[: 4 * n] + [(1000, 1001), (1001, 1000), (1001, 1002)], "src long, dst long")
    got = {r.step: (r.level, r.done) for r in levels(steps, e, costs=True).collect()}
    assert got[3 * n] == (2 * n, 2 * n + 1.0) and got[1] == (1, 2.0)
    assert got[1000] == got[1001] == got[1002] == (None, None)
    assert sorted(r.step for r in closure(spark.createDataFrame([(1001,)], "step long"), e).collect()) == [1000, 1001, 1002]


def test_grids_are_the_nearest_rationals(spark):
    from fractions import Fraction

    from quillspark.operators.planning import declared_grid

    values = [25.0, 29.97, 29.9701, 23.976, 59.94, 23.98, 12.5, 1 / 3, 3.14159265358979, 0.001, 1e-9 + 24, 119.88]
    got = {r.f: r.g for r in spark.createDataFrame([(v,) for v in values], "f double").select("f", declared_grid(F.col("f")).alias("g")).collect()}
    snapped = {29.97: "30000/1001", 23.976: "24000/1001", 59.94: "60000/1001"}
    assert got == {v: snapped.get(v, str(Fraction(v).limit_denominator(1001))) for v in values}
    bad = spark.createDataFrame([(0.0,), (-1.0,), (math.inf,), (math.nan,), (None,)], "f double").select(declared_grid(F.col("f")).alias("g"))
    assert all(r.g is None for r in bad.collect())


def test_pads_trade_names_at_once(spark):
    from quillspark.operators.planning import renamed_once

    d = spark.createDataFrame([("[a][b]x[c]=[a;[b]", ), ("", ), (None, )], "t string")
    assert [r.r for r in d.select(renamed_once(F.col("t"), {"a": "b", "b": "a"}).alias("r")).collect()][:2] == ["[b][a]x[c]=[a;[a]", ""]


def test_scalars(spark):
    from quillspark.functions.text import endpoint, head_tail, jid_claim, last_json

    d = spark.createDataFrame([("https://u:p@Host.x:80/a/b?q#f",), ("nothing",), ("ftp://h",)], "u string")
    assert [r.e for r in d.select(endpoint(F.col("u")).alias("e")).collect()] == ["host.x:80/a/b", "[redacted-url]", "h"]
    r = spark.range(1).select(head_tail(F.lit("a" * 5 + "b" * 7), 3).alias("h"), last_json(F.lit("{1} {2} x")).alias("l"), jid_claim(F.lit("!!.x")).alias("j")).first()
    assert (r.h, r.l, r.j) == ("aaa\n... 6 chars omitted ...\nbbb", "{2}", "")


def test_seeded_accents_draw_what_python_draws(spark):
    import random

    from quillspark.operators import accents

    cues = {r.event_id: r for r in accents._cues(spark, SF).collect()}
    glitch = {(r.event_id, r.on): r for r in accents.glitch(spark, SF).collect()}
    split = {(r.event_id, r.on): r for r in accents.rgb_split(spark, SF).collect()}
    assert len(glitch) == 7 * len(cues) and len(split) == 5 * len(cues)
    for k in list(cues)[:200]:
        c = cues[k]
        rng, a = random.Random(int(round(c["at"] * 1000)) & 0xFFFFFFFF), 2 + round(14 * c.i)
        for on, e in enumerate(accents.GLITCH):
            je, grey = e * rng.uniform(0.72, 1.28), rng.uniform(0.8, 1.2)
            g = glitch[k, on]
            assert (g.red, g.blue) == (round(a * je), round(-a * je * 0.8)) and abs(g.tear) == round((1 + round(7 * c.i)) * abs(je)) and (g.tear <= 0) == (on % 2 == 0 or g.tear == 0)
            assert g.grey == pytest.approx(min(1.0, accents.FLICKER[on] * (0.4 + 0.6 * c.i) * grey), abs=1e-3)
        rng = random.Random(int(round(c["at"] * 1000)) & 0xFFFFFFFF)
        for on, e in enumerate(accents.SPLIT):
            assert split[k, on].red == round((3 + round(18 * c.i)) * e * rng.uniform(0.82, 1.18))


def test_handlers_by_name(spark):
    from quillspark.functions import registry

    with pytest.raises(KeyError):
        registry.handler("os:system")
    registry.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM list_port('a.b', '.')").collect()] == [(0, "a"), (1, "b")]


def test_catalog_files_say_what_they_are_named(spark, tmp_path):
    from quillspark.operators.contracts import scan_catalog

    (tmp_path / "cut.json").write_text('{"op": "cut",\n "version": 2, "judgement": false, "needs": ["net"]}')
    (tmp_path / "mix.json").write_text('{"op": "other", "version": 1}')
    (tmp_path / "no.json").write_text('{"version": 1}')
    assert sorted((str(r.op), r.problem) for r in scan_catalog(spark, str(tmp_path)).collect()) == [("None", "no op"), ("cut", None), ("other", "filed as mix")]


@pytest.fixture(scope="module")
def in_parts(spark, tmp_path_factory):
    """The events in eight files that come latest first, and in a stream one to a batch."""
    import os

    at = tmp_path_factory.mktemp("parts")
    e = spark.read.parquet(f"{SF}/events.parquet")
    n = e.count()
    os.mkdir(f"{at}/events.parquet")
    for k in range(8):
        part = e.where((F.col("event_id") >= k * n // 8) & (F.col("event_id") < (k + 1) * n // 8)).coalesce(1)
        part.write.parquet(f"{at}/p{k}")
        (name,) = [f for f in os.listdir(f"{at}/p{k}") if f.endswith(".parquet")]
        to = f"{at}/events.parquet/part-{k}.parquet"
        os.rename(f"{at}/p{k}/{name}", to)
        os.utime(to, (1_700_000_000 + k, 1_700_000_000 + k))
    return str(at)


def test_settlement_over_many_batches_in_any_order(spark, duck, in_parts):
    import os

    from quillspark.streaming.queries import stream_settle

    for order in (1, -1):
        for k in range(8):
            os.utime(f"{in_parts}/events.parquet/part-{k}.parquet", (1_700_000_000 + order * k,) * 2)
        got = sorted((r.user_id, r.seq) for r in stream_settle(spark, in_parts, files=1).collect())
        assert got == sorted(duck.execute(catalog.ORACLES["stream_settle"]).fetchall()) and got


def test_latch_over_many_batches(spark, duck, in_parts):
    import os

    from quillspark.streaming.queries import stream_latch

    for k in range(8):
        os.utime(f"{in_parts}/events.parquet/part-{k}.parquet", (1_700_000_000 + k,) * 2)
    got = sorted((r.user_id, r.event_id, r.open) for r in stream_latch(spark, in_parts, files=1).collect())
    assert got == sorted(duck.execute(catalog.ORACLES["stream_latch"]).fetchall())
