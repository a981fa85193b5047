"""Scalar functions as queries: addresses, numbers, clipped text, embedded JSON, claims, times, colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import canonical_json, colour, endpoint, head_tail, jid_claim, last_json, minimal_number
from ..sources.tables import load, micros

COLOURS = {"red": "255,0,0", "green": "0,128,0", "white": "255,255,255"}


def endpoints(spark, sf_dir):
    """Host, port and path of addresses with a user, a port and a query put in."""
    u = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "://([^/?#]*)", "://me:pw@$1:8443")).when(F.col("page_id") % 3 == 1, F.lit("no address")).otherwise(F.col("url"))
    return load(spark, sf_dir, "pages").select("page_id", endpoint(u).alias("endpoint"))


def minimal_numbers(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_quantity", "l_discount").distinct().select("l_quantity", "l_discount", minimal_number(F.col("l_quantity")).alias("whole"), minimal_number(F.col("l_discount") + 1).alias("part"))


def clipped_text(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", head_tail(F.regexp_replace("text", r"\s+", " "), 200).alias("clip"))
    return d.select("doc_id", F.sha2("clip", 256).alias("sha"), F.length("clip").alias("n"))


def embedded_json(spark, sf_dir):
    """A measurement found as the last JSON object of a log."""
    log = F.concat(F.lit('[a] {"x": 1} then\n{"input_i" : "'), F.col("value").cast("decimal(10,2)").cast("string"), F.lit('", "z": 2}\ntail'))
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object(last_json(log), "$.input_i").alias("input_i"))


def canonical_dumps(spark, sf_dir):
    """JSON with sorted keys, whatever the order the fields are given in."""
    j = canonical_json({"op": F.col("n_name"), "a": F.col("n_regionkey"), "k": F.col("n_nationkey")})
    return load(spark, sf_dir, "nation").select("n_nationkey", j.alias("dump"))


def token_claims(spark, sf_dir):
    """The identity that a token's claims hold; nothing from a token that can't be read."""
    claims = F.concat(F.lit('{"jid":" c'), F.col("c_custkey").cast("string"), F.lit('?>"}'))
    body = F.regexp_replace(F.translate(F.base64(claims.cast("binary")), "+/", "-_"), "=+$", "")
    token = F.when(F.col("c_custkey") % 4 == 0, F.lit("broken.sig")).otherwise(F.concat(body, F.lit(".sig")))
    return load(spark, sf_dir, "customer").select("c_custkey", jid_claim(token).alias("jid"))


def utc_times(spark, sf_dir):
    at = F.timestamp_seconds(F.floor(micros() / 1_000_000))
    return load(spark, sf_dir, "events").select("event_id", F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc"))


def colour_lookup(spark, sf_dir):
    """Named colours; unknown names take the default, an unknown default white."""
    name = F.get(F.array(F.lit("red"), F.lit("green"), F.lit("mauve")), (F.col("p_size") % 3).cast("int"))
    default = F.when(F.col("p_partkey") % 2 == 0, "green").otherwise("beige")
    return load(spark, sf_dir, "part").select("p_partkey", colour(name, default, COLOURS).alias("rgb"))


QUERIES = [endpoints, minimal_numbers, clipped_text, embedded_json, canonical_dumps, token_claims, utc_times, colour_lookup]

ORACLES = {
    "endpoints": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_extract(url, '://([^/?#]*)', 1) || ':8443' || regexp_extract(url, '://[^/?#]*([^?#]*)', 1) WHEN 1 THEN '[redacted-url]' ELSE regexp_extract(url, '://([^?#]*)', 1) END AS endpoint FROM pages",
    "minimal_numbers": "SELECT DISTINCT l_quantity, l_discount, l_quantity::BIGINT::VARCHAR AS whole, CASE WHEN l_discount = 0 THEN '1' ELSE (l_discount + 1)::VARCHAR END AS part FROM lineitem",
    "clipped_text": r"""WITH d AS (SELECT doc_id, regexp_replace(text, '[ \t\n\x0b\x0c\r]+', ' ', 'g') AS t FROM documents), c AS (SELECT doc_id, CASE WHEN length(t) <= 400 THEN t ELSE rtrim(left(t, 200)) || chr(10) || '... ' || (length(t) - 400) || ' chars omitted ...' || chr(10) || ltrim(right(t, 200)) END AS clip FROM d)
SELECT doc_id, sha256(clip) AS sha, length(clip)::INT AS n FROM c""",
    "embedded_json": "SELECT event_id, value::DECIMAL(10, 2)::VARCHAR AS input_i FROM events",
    "canonical_dumps": """SELECT n_nationkey, '{"a":' || n_regionkey || ',"k":' || n_nationkey || ',"op":"' || n_name || '"}' AS dump FROM nation""",
    "token_claims": "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN 'c' || c_custkey || '?>' ELSE '' END AS jid FROM customer",
    "utc_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM events",
    "colour_lookup": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '255,0,0' WHEN 1 THEN '0,128,0' ELSE CASE WHEN p_partkey % 2 = 0 THEN '0,128,0' ELSE '255,255,255' END END AS rgb FROM part",
}
