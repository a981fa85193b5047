"""Facts about media objects: digests, sniffed kinds, byte budgets, tags, transfers, windows of samples, lanes, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_caption, timecode
from ..plans.rounds import shared_folder
from ..plans.running import running
from ..sources.tables import load, seconds
from .intervals import BEGIN, running_offsets

# Magic bytes of the kinds that are told apart, in hex.
MAGIC = (("image/jpeg", "^FFD8FF"), ("image/png", "^89504E470D0A1A0A"), ("image/gif", "^474946383[79]61"), ("image/webp", "^52494646.{8}57454250"))
# The least rate of a transfer in bytes a second, and the time that it is measured over; MiB of a lane, of the weights, and kept free.
STALL_RATE, STALL_WINDOW = 256 * 1024, 20.0
LANE_MB, WEIGHTS_MB, RESERVE_MB = 414.0, 2322.0, 512.0


def sniffed(content: Column) -> Column:
    """The media type by the first bytes; unknown ones stay binary."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.lit("application/octet-stream")
    for kind, pattern in reversed(MAGIC):
        out = F.when(head.rlike(pattern), kind).otherwise(out)
    return out


def within_budget(df: DataFrame, key: str, order: list[str], size: str, cap: int, cell: Column) -> DataFrame:
    """The rows of a key, in order, whose running size is within ``cap``; ``cell`` is a range of the first order column."""
    return running(df, F.col(key), order, cell, F.col(size), "read").where(F.col("read") <= cap)


def lanes(free_mb: Column, threads: Column, override: Column) -> Column:
    """Lanes that fit the free memory and the host; an override counts if it is an integer; unknown memory gives one."""
    by_memory = F.greatest(F.lit(1), F.floor((free_mb - RESERVE_MB - WEIGHTS_MB) / LANE_MB))
    derived = F.when(free_mb.isNull(), F.lit(1)).otherwise(F.least(by_memory, F.greatest(F.lit(1), threads)))
    asked = override.try_cast("int")
    return F.when(asked.isNotNull(), F.greatest(F.lit(1), asked)).otherwise(derived).cast("long")


def cell_problem(x: Column, y: Column, w: Column, h: Column, sheet_w: Column, sheet_h: Column, got_w: Column, got_h: Column) -> Column:
    """Why a cell can't be cut from its sheet; null if it can."""
    return (
        F.when(got_w.isNull(), "no sheet")
        .when((F.least(x, y) < 0) | (F.least(w, h, sheet_w, sheet_h) <= 0), "geometry")
        .when((got_w != sheet_w) | (got_h != sheet_h), "sheet size")
        .when((x + w > sheet_w) | (y + h > sheet_h), "outside")
    )


def _events(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", (seconds() - BEGIN).alias("s"))


def welded_timeline(spark, sf_dir):
    """Each order's returned lines as its cold open, cut by half a unit, and the others after it."""
    order = ["part", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    l = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")  # noqa: E741
    cold = l.where(F.col("l_returnflag") == "R").withColumn("part", F.lit(0))
    both = cold.unionByName(l.where(F.col("l_returnflag") != "R").withColumn("part", F.lit(1)))
    d = running_offsets(both, "l_orderkey", order, F.col("l_quantity"))
    has = F.max(F.when(F.col("part") == 0, 1).otherwise(0)).over(Window.partitionBy("l_orderkey"))
    shift = F.when((F.col("part") == 1) & (has == 1), 0.5).otherwise(0.0)
    return d.select("l_orderkey", "part", "l_partkey", "l_suppkey", F.round(F.col("start") - shift, 3).alias("start_s"))


def audio_meta(spark, sf_dir):
    """SHA-1 and byte count of each object."""
    return load(spark, sf_dir, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1"), F.octet_length("text").cast("long").alias("bytes"))


def pcm_meta(spark, sf_dir):
    """SHA-256 of each object, and the 32-bit samples that it holds; a rest of bytes is none."""
    return load(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"), F.floor(F.octet_length("html") / 4).alias("samples"))


def image_tile_cells(spark, sf_dir):
    """Of seven cells asked for in each order's tile, those that were not drawn, and lines drawn beyond them."""
    asked = load(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("cell"))
    drawn = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("cell"), F.lit(True).alias("drawn")).distinct()
    d = asked.withColumn("asked", F.lit(True)).join(drawn, ["o_orderkey", "cell"], "full_outer")
    missing, beyond = F.collect_list(F.when(F.col("drawn").isNull(), F.col("cell"))), F.count_if(F.col("asked").isNull())
    return d.groupBy("o_orderkey").agg(F.array_join(F.array_sort(missing), ",").alias("missing"), beyond.alias("beyond"))


def range_budget(spark, sf_dir):
    """Documents of a source that a byte budget lets read, in order: the receipt."""
    d = within_budget(load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", ["doc_id"], "n_chars", 50_000, F.floor(F.col("doc_id") / 10_000))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("reads"), F.max("read").alias("bytes"))


def range_frames(spark, sf_dir):
    """The same for a list: each document that was read, with the bytes read so far."""
    d = within_budget(load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "lang", ["doc_id"], "n_chars", 30_000, F.floor(F.col("doc_id") / 10_000))
    return d.select("doc_id", "lang", "read")


def merged_tags(spark, sf_dir):
    """Container tags: those of the event, then ours over them."""
    own = F.from_json("props", "map<string,string>")
    ours = F.when(F.col("event_type") == "click", F.create_map(F.lit("k"), F.lit("0"), F.lit("title"), F.lit("t"))).otherwise(F.create_map(F.lit("title"), F.col("event_type")))
    tags = F.map_from_entries(F.concat(F.map_entries(F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(ours), k))), F.map_entries(ours)))
    flat = F.array_join(F.array_sort(F.transform(F.map_entries(tags), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return load(spark, sf_dir, "events").select("event_id", flat.alias("tags"))


def sniffed_kinds(spark, sf_dir):
    head = F.when(F.col("event_type") == "click", "FFD8FFE0").when(F.col("event_type") == "view", "89504E470D0A1A0A00").when(F.col("event_type") == "error", "474946383961").when(F.col("value") > 50, "52494646000000005745425000").otherwise("524946460000000057415645")
    return _events(spark, sf_dir).select("event_type", sniffed(F.unhex(head)).alias("kind")).groupBy("event_type", "kind").agg(F.count(F.lit(1)).alias("n"))


def stalls(spark, sf_dir):
    """Ticks of a transfer at which the rate since the tick before lies under the floor."""
    w = Window.partitionBy("user_id").orderBy("s")
    d = _events(spark, sf_dir).withColumn("bytes", F.sum(F.col("value") * 20_000_000).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("dt", F.col("s") - F.lag("s").over(w)).withColumn("db", F.col("bytes") - F.lag("bytes").over(w))
    return d.where((F.col("dt") >= STALL_WINDOW) & (F.col("value") * 20_000_000 / F.col("dt") < STALL_RATE)).select("event_id", "user_id", F.round("dt", 3).alias("dt"))


def shallowest(spark, sf_dir):
    """Of each host's paths the shallowest, the first by name of several."""
    p = load(spark, sf_dir, "pages").select(F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1).alias("path"))
    return p.groupBy("host").agg(F.min_by("path", F.struct(F.size(F.split("path", "/")), "path")).alias("path"))


def json_round_trip(spark, sf_dir):
    """Payloads written as JSON lines and read again."""
    at = shared_folder(spark, "json")
    load(spark, sf_dir, "nation").select(F.to_json(F.struct("n_nationkey", "n_name", F.array("n_regionkey").alias("regions"))).alias("value")).write.text(at)
    back = spark.read.schema("n_nationkey int, n_name string, regions array<int>").json(at)
    return back.select("n_nationkey", "n_name", F.get("regions", F.lit(0)).alias("region"))


def subtitle_lines(spark, sf_dir):
    """Dialogue lines of a subtitle file."""
    e = _events(spark, sf_dir)
    return e.select("event_id", F.concat_ws(",", F.lit("Dialogue: 0"), timecode(F.col("s")), timecode(F.col("s") + 1.5), F.lit("Cap"), F.lit(""), F.lit("0"), F.lit("0"), F.lit("0"), F.lit(""), clean_caption(F.concat(F.col("event_type"), F.lit(" {now}!")))).alias("line"))


def sample_windows(spark, sf_dir):
    """Samples of a window in seconds: both ends cut to whole samples, the last not included."""
    a, b = F.floor(F.col("value") * 16_000), F.floor((F.col("value") + 0.5) * 16_000)
    return _events(spark, sf_dir).select("event_id", a.alias("first"), (b - a).alias("n"))


def channel_mean(spark, sf_dir):
    """Vectors as two interleaved channels, made one by their mean."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    mono = F.transform(F.sequence(F.lit(0), F.floor(F.size("v") / 2).cast("int") - 1), lambda i: (F.get("v", 2 * i) + F.get("v", 2 * i + 1)) / 2)
    return v.withColumn("m", mono).select("vec_id", F.size("m").alias("n"), F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x), 5).alias("power"))


def lane_sizing(spark, sf_dir):
    free = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") * 2)
    asked = F.when(F.col("c_custkey") % 50 == 0, F.lit("3")).when(F.col("c_custkey") % 50 == 1, F.lit("many"))
    return load(spark, sf_dir, "customer").select("c_custkey", lanes(free, F.col("c_nationkey"), asked).alias("lanes"))


def cell_geometry(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.col("l_partkey").alias("p"), "l_returnflag")  # noqa: E741
    got = F.when(F.col("l_returnflag") != "N", F.when(F.col("p") % 17 == 0, 99).otherwise(100))
    why = cell_problem(F.col("q") * 3 - 9, F.lit(0), F.lit(30), F.col("l_linenumber") - 1, F.lit(100), F.lit(100), got, F.lit(100))
    return l.groupBy(why.alias("why")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = [
    welded_timeline, audio_meta, pcm_meta, image_tile_cells, range_budget, range_frames, merged_tags, sniffed_kinds, stalls, shallowest, json_round_trip,
    subtitle_lines, sample_windows, channel_mean, lane_sizing, cell_geometry,
]

_E = f"e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1000000.0::DOUBLE - {BEGIN}::DOUBLE AS s FROM events)"
_TC = lambda x: f"(round(({x}) * 100)::BIGINT // 360000) || ':' || lpad((round(({x}) * 100)::BIGINT // 6000 % 60)::VARCHAR, 2, '0') || ':' || lpad((round(({x}) * 100)::BIGINT // 100 % 60)::VARCHAR, 2, '0') || '.' || lpad((round(({x}) * 100)::BIGINT % 100)::VARCHAR, 2, '0')"
ORACLES = {
    "welded_timeline": """WITH p AS (SELECT *, (l_returnflag <> 'R')::INT AS part FROM lineitem), r AS (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY part, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) - l_quantity AS a, min(part) OVER (PARTITION BY l_orderkey) AS lo FROM p)
SELECT l_orderkey, part, l_partkey, l_suppkey, round(a - CASE WHEN part = 1 AND lo = 0 THEN 0.5 ELSE 0 END, 3) AS start_s FROM r""",
    "audio_meta": "SELECT doc_id, sha1(text) AS sha1, strlen(text) AS bytes FROM documents",
    "pcm_meta": "SELECT page_id, sha256(html) AS sha256, (strlen(html) // 4)::BIGINT AS samples FROM pages",
    "image_tile_cells": """WITH a AS (SELECT o_orderkey, unnest(range(1, 7))::INT AS cell FROM orders), d AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS cell FROM lineitem), j AS (SELECT coalesce(a.o_orderkey, d.k) AS o_orderkey, a.cell AS ac, d.cell AS dc FROM a FULL JOIN d ON a.o_orderkey = d.k AND a.cell = d.cell)
SELECT o_orderkey, coalesce(string_agg(ac::VARCHAR, ',' ORDER BY ac) FILTER (dc IS NULL), '') AS missing, count(*) FILTER (ac IS NULL) AS beyond FROM j GROUP BY 1""",
    "range_budget": "WITH r AS (SELECT source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS read FROM documents) SELECT source, count(*) AS reads, max(read) AS bytes FROM r WHERE read <= 50000 GROUP BY 1",
    "range_frames": "WITH r AS (SELECT doc_id, lang, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS read FROM documents) SELECT * FROM r WHERE read <= 30000",
    "merged_tags": """SELECT event_id, CASE WHEN event_type = 'click' THEN 'k=0;title=t' ELSE 'k=' || regexp_extract(props, '"k": *([0-9]+)', 1) || ';title=' || event_type END AS tags FROM events""",
    "sniffed_kinds": "SELECT event_type, CASE WHEN event_type = 'click' THEN 'image/jpeg' WHEN event_type = 'view' THEN 'image/png' WHEN event_type = 'error' THEN 'image/gif' WHEN value > 50 THEN 'image/webp' ELSE 'application/octet-stream' END AS kind, count(*) AS n FROM events GROUP BY 1, 2",
    "stalls": f"WITH {_E}, d AS (SELECT *, s - lag(s) OVER (PARTITION BY user_id ORDER BY s) AS dt FROM e) SELECT event_id, user_id, round(dt, 3) AS dt FROM d WHERE dt >= 20 AND value * 20000000 / dt < 262144",
    "shallowest": r"""WITH p AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages) SELECT host, arg_min(path, (len(string_split(path, '/')), path)) AS path FROM p GROUP BY 1""",
    "json_round_trip": "SELECT n_nationkey, n_name, n_regionkey AS region FROM nation",
    "subtitle_lines": f"WITH {_E} SELECT event_id, 'Dialogue: 0,' || {_TC('s')} || ',' || {_TC('s + 1.5')} || ',Cap,,0,0,0,,' || upper(event_type) || ' NOW' AS line FROM e",
    "sample_windows": "SELECT event_id, floor(value * 16000)::BIGINT AS first, (floor((value + 0.5::DOUBLE) * 16000) - floor(value * 16000))::BIGINT AS n FROM events",
    "channel_mean": "WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT vec_id, i // 2 AS k, avg(x) AS m FROM v GROUP BY 1, 2) SELECT vec_id, count(*)::INT AS n, round(sum(m * m), 5) AS power FROM m GROUP BY 1",
    "lane_sizing": "SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 3 WHEN c_acctbal > 0 THEN least(greatest(1, floor((c_acctbal * 2 - 2834) / 414))::BIGINT, greatest(1, c_nationkey)) ELSE 1 END::BIGINT AS lanes FROM customer",
    "cell_geometry": """WITH l AS (SELECT *, l_quantity::INT * 3 - 9 AS x FROM lineitem), w AS (SELECT CASE WHEN l_returnflag = 'N' THEN 'no sheet' WHEN x < 0 OR l_linenumber - 1 <= 0 THEN 'geometry' WHEN l_partkey % 17 = 0 THEN 'sheet size' WHEN x + 30 > 100 THEN 'outside' END AS why FROM l) SELECT why, count(*) AS n FROM w GROUP BY 1""",
}
