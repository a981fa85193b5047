"""Queries over scalar text, layout and capacity functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_caption, greedy_lines, object_key, redact, subtitle_colour, timecode
from ..sources.tables import load, seconds


def object_keys(spark, sf_dir):
    """Two addresses of one object have one key; the slot is the head of the key's digest."""
    p = load(spark, sf_dir, "pages").select("page_id", "url").withColumn("url", F.explode(F.array("url", F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("?sig=1")))))
    p = p.withColumn("key", object_key(F.col("url"))).groupBy("key").agg(F.count(F.lit(1)).alias("addresses"))
    return p.select("key", F.substring(F.sha2("key", 256), 1, 32).alias("slot"), "addresses")


def redact_text(spark, sf_dir):
    t = F.concat(F.lit("Bearer abc.def "), F.col("url"), F.lit(" token=abc123 end"))
    return load(spark, sf_dir, "pages").select("page_id", redact(t).alias("safe"))


def json_props(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def timecodes(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.pmod(seconds(), F.lit(36_000.0)).alias("t"))
    return e.select("event_id", timecode(F.col("t")).alias("tc"))


def caption_colours(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("#"), F.substring(F.sha1(F.col("p_name").cast("binary")), 1, 6)).alias("rgb"))
    return p.select("p_partkey", subtitle_colour(F.col("rgb")).alias("ass"))


def clean_captions(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(clean_caption(F.col("text")), 256).alias("clean_sha"))


def caption_wrap(spark, sf_dir):
    """Greedy wrap at 32 characters: line count, longest line, first line."""
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", greedy_lines(F.col("text"), 32).alias("lines"))
    return c.select("conv_id", "turn", F.size("lines").alias("n_lines"), F.array_max(F.transform("lines", F.length)).alias("longest"), F.get("lines", F.lit(0)).alias("first"))


def sheet_layout(spark, sf_dir):
    """Tiles of an order's lines on a grid of four columns."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    t = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.row_number().over(w) - 1).alias("i"))
    return t.select("l_orderkey", "l_partkey", "l_suppkey", "i", (F.col("i") % 4 * 328).alias("x"), (F.floor(F.col("i") / 4) * 214).cast("int").alias("y"))


def capacity(spark, sf_dir):
    """Parallel steps of a box: half its cores or its memory by 1.5 GiB, one at least; transfers four times that."""
    b = load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("cores"), (F.col("p_retailprice") / 64).alias("gib"))
    n = F.greatest(F.lit(1), F.least(F.floor(F.col("cores") / 2), F.floor(F.col("gib") / 1.5))).cast("long")
    return b.select("p_partkey", n.alias("steps"), (4 * n).alias("transfers"), F.least(n, F.lit(4)).cast("long").alias("credits"))


def fetch_window(spark, sf_dir):
    """What a windowed fetch takes: a filter on time that reaches the scan."""
    e = load(spark, sf_dir, "events").where("ts >= TIMESTAMP_NTZ'2024-01-08 00:00:00' AND ts < TIMESTAMP_NTZ'2024-01-15 00:00:00'")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("bytes"))


def split_parts(spark, sf_dir):
    """Byte ranges of a parallel fetch: six workers, parts of 32 units or more."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("total"))
    part = F.greatest(F.lit(32), F.ceil(F.col("total") / 6)).cast("long")
    d = d.withColumn("part", part).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("total") / F.col("part")) - 1)))
    return d.where("total > 0").select("doc_id", "i", (F.col("i") * F.col("part")).alias("from_byte"), (F.least((F.col("i") + 1) * F.col("part"), F.col("total")) - 1).alias("to_byte"))


def content_dupes(spark, sf_dir):
    d = load(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    return d.where("n > 1")


def presigned(spark, sf_dir):
    """Addresses with a signature among their query keys."""
    p = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"\?([^#]*)", 1).alias("q"))
    keys = F.transform(F.split("q", "&"), lambda x: F.substring_index(x, "=", 1))
    return p.select("page_id", F.arrays_overlap(keys, F.array(F.lit("ref"), F.lit("utm_source"))).alias("signed"))


QUERIES = [
    object_keys, redact_text, json_props, timecodes, caption_colours, clean_captions, caption_wrap, sheet_layout, capacity, fetch_window, split_parts,
    content_dupes, presigned,
]

ORACLES = {
    "caption_wrap": r"""WITH w AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM conversations),
l AS (SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN [] ELSE string_split(list_reduce(w, lambda a, x: a || CASE WHEN length(regexp_extract(a, '[^\x01]*$')) + 1 + length(x) <= 32 THEN ' ' ELSE chr(1) END || x), chr(1)) END AS l FROM w)
SELECT conv_id, turn, len(l)::INT AS n_lines, list_max(list_transform(l, lambda x: length(x)))::INT AS longest, l[1] AS first FROM l""".replace("\\", "\\"[:1]),
    "object_keys": """WITH a AS (SELECT unnest([url, regexp_replace(url, '[?#].*$', '') || '?sig=1']) AS url FROM pages), k AS (SELECT regexp_extract(url, '^https?://([^?#]*)', 1) AS key, count(*) AS addresses FROM a GROUP BY 1)
SELECT key, sha256(key)[1:32] AS slot, addresses FROM k""",
    "redact_text": r"""SELECT page_id, substring('Bearer [REDACTED] ' || regexp_replace(regexp_replace(url, '^https?://[^ "<>]+', '[redacted-url]'), '.*', '[redacted-url]') || ' token=[REDACTED] end', 1, 500) AS safe FROM pages""",
    "json_props": "SELECT (props::JSON ->> '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1",
    "timecodes": """WITH t AS (SELECT event_id, round((epoch_us(ts) / 1000000.0::DOUBLE - floor(epoch_us(ts) / 1000000.0::DOUBLE / 36000) * 36000) * 100)::BIGINT AS c FROM events)
SELECT event_id, format('{:d}:{:02d}:{:02d}.{:02d}', c // 360000, c // 6000 % 60, c // 100 % 60, c % 100) AS tc FROM t""",
    "caption_colours": "WITH c AS (SELECT p_partkey, sha1(p_name) AS h FROM part) SELECT p_partkey, upper('&H00' || h[5:6] || h[3:4] || h[1:2]) AS ass FROM c",
    "clean_captions": "SELECT conv_id, turn, sha256(upper(replace(trim(regexp_replace(text, '[{}.,!?;:]+', '', 'g')), 'ß', 'ss'))) AS clean_sha FROM conversations",
    "sheet_layout": """WITH t AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, i::INT AS i, (i % 4 * 328)::INT AS x, (i // 4 * 214)::INT AS y FROM t""",
    "capacity": """WITH c AS (SELECT p_partkey, greatest(1, least(floor(p_size / 2), floor(p_retailprice / 64 / 1.5::DOUBLE)))::BIGINT AS n FROM part) SELECT p_partkey, n AS steps, 4 * n AS transfers, least(n, 4)::BIGINT AS credits FROM c""",
    "fetch_window": "SELECT event_type, count(*) AS n, round(sum(value), 3) AS bytes FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' GROUP BY 1",
    "split_parts": """WITH d AS (SELECT doc_id, n_chars AS total, greatest(32, ceil(n_chars / 6))::BIGINT AS part FROM documents WHERE n_chars > 0), r AS (SELECT *, unnest(range(0, ceil(total / part)::BIGINT)) AS i FROM d)
SELECT doc_id, i, i * part AS from_byte, least((i + 1) * part, total) - 1 AS to_byte FROM r""",
    "content_dupes": "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    "presigned": r"SELECT page_id, list_has_any(list_transform(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: split_part(x, '=', 1)), ['ref', 'utm_source']) AS signed FROM pages",
}
