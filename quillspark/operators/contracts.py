"""Checks before a run: catalogs, parameters, ports and bindings of job steps; shapes of requests and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load

# Kinds whose models are not baked in, and the needs that no worker may serve.
NEEDS_WEIGHTS = ("align", "clip_rank")
REFUSED_NEEDS = ("keys", "llm")


def scan_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The JSON declarations under ``path``, with ``problem``: a file named otherwise than what it declares."""
    d = spark.read.option("multiLine", True).option("recursiveFileLookup", True).json(path, schema="op string, version long, judgement boolean, needs array<string>")
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return d.select("*", F.when(F.col("op").isNull(), "no op").when(F.col("op") != stem, F.concat(F.lit("filed as "), stem)).alias("problem"))


def binding(wanted: Column, named: Column, outputs: Column) -> Column:
    """The output that an input reads: the one it names, else that of its own name, else the producer's only one; null if none of these is there."""
    want = F.coalesce(named, wanted)
    return F.when(F.array_contains(outputs, want), want).when(named.isNull() & (F.size(outputs) == 1), F.get(outputs, F.lit(0)))


def destinations(urls: Column, default: str) -> Column:
    """One file name for each address of a list port: its place in four digits, and the address's suffix or a default."""
    suffix = lambda u: F.regexp_extract(F.regexp_replace(u, r"[?#].*$", ""), r"(\.[A-Za-z0-9]{1,5})$", 1)
    return F.transform(urls, lambda u, i: F.concat(F.lpad(i.cast("string"), 4, "0"), F.when(suffix(u) == "", F.lit(default)).otherwise(suffix(u))))


def object_id(*parts: Column) -> Column:
    """SHA-256 of the JSON array of strings and integers."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def _lines(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_returnflag", "l_linestatus")  # noqa: E741
    return l.withColumn("brand_no", F.col("l_partkey") % 25)


def preflight(spark, sf_dir):
    """Chains (orders) refused before they start, with the reason of the first step refused:
    an unknown op, a list port without a list, a list for a single port, or a read of a list port."""
    many, listed = F.col("l_returnflag") == "R", F.col("l_discount") > 0.05
    why = (
        F.when(F.col("l_partkey") % 25 == 7, "unknown op")
        .when(many & ~listed, "list port needs a list")
        .when(~many & listed, "a list for one file")
        .when(many & (F.col("l_linestatus") == "O"), "reads a list port")
    )
    d = _lines(spark, sf_dir).withColumn("why", why).where(F.col("why").isNotNull())
    missing = d.withColumn("rank", F.when(F.col("why") == "unknown op", 0).otherwise(1))  # unknown ops refuse the chain before its steps are looked at
    return missing.groupBy("l_orderkey").agg(F.min_by("why", F.struct("rank", "l_linenumber", "why")).alias("why"), F.count(F.lit(1)).alias("n"))


def param_errors(spark, sf_dir):
    """Parameters against their declaration: closed keys, type and range; of several messages the first by name."""
    p = load(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "map<string,string>").alias("m"))
    p = p.withColumn("m", F.when(F.col("event_type") == "error", F.map_concat("m", F.create_map(F.lit("x"), F.lit("1")))).when(F.col("event_type") == "signup", F.create_map().cast("map<string,string>")).otherwise(F.col("m")))
    k = F.get(F.map_values(F.map_filter("m", lambda key, _: key == "k")), F.lit(0))
    extra = F.array_except(F.map_keys("m"), F.array(F.lit("k")))
    found = F.array(
        F.when(F.size(extra) > 0, F.concat(F.lit("unexpected: "), F.array_join(F.array_sort(extra), ","))),
        F.when(k.isNull(), "k is required"),
        F.when(k.try_cast("int") > 80, F.concat(k, F.lit(" is over the maximum of 80"))),
    )
    return p.select("event_id", F.array_min(F.array_compact(found)).alias("error")).where(F.col("error").isNotNull())


def input_binding(spark, sf_dir):
    """What each order's consumer reads of the ports that its lines produce; null where nothing fits."""
    made = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("outputs"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    named = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("R"))
    wanted = F.when(F.col("o_orderstatus") == "O", "N").when(F.col("o_orderstatus") == "F", "A").otherwise("src")
    d = o.join(made, F.col("o_orderkey") == F.col("l_orderkey"))
    return d.select("o_orderkey", binding(wanted, named, F.col("outputs")).alias("reads"))


def list_outputs(spark, sf_dir):
    """The files of each host's pages as a list port, one row each."""
    p = load(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host"))
    named = p.withColumn("u", F.when(F.col("page_id") % 2 == 0, F.concat(F.col("url"), F.lit("/f.png?x=1"))).otherwise(F.col("url")))
    urls = named.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "u"))), lambda x: x["u"]).alias("urls"))
    return urls.select("host", F.posexplode(destinations(F.col("urls"), ".bin")).alias("place", "file"))


def semantic_ids(spark, sf_dir):
    quoted = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", object_id(quoted(F.col("l_orderkey")), quoted(F.col("l_returnflag")), F.lit('"output"'), F.col("l_linenumber").cast("string")).alias("id")).distinct()


def retained_elsewhere(spark, sf_dir):
    """Reads of retained objects by where they are: here, on another worker, or held by none."""
    held = F.when(F.col("l_returnflag") == "R", F.col("l_suppkey") % 4)
    verdict = F.when(held.isNull(), "not retained").when(held != 0, "retained on another worker").when(F.col("l_tax") > 0.06, "no longer held").otherwise("here")
    return _lines(spark, sf_dir).groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def placement(spark, sf_dir):
    """Catalog entries that a worker must refuse: those that decide, and those that need secrets."""
    needs = F.array_compact(F.array(F.when(F.col("p_size") % 5 == 0, F.lit("keys")), F.when(F.col("p_size") % 7 == 0, F.lit("llm")), F.lit("net")))
    p = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_type") == "PROMO").alias("judgement"), needs.alias("needs"))
    bad = F.array_join(F.array_sort(F.array_intersect("needs", F.array(*map(F.lit, REFUSED_NEEDS)))), ",")
    why = F.when(F.col("judgement"), "decides").when(bad != "", F.concat(F.lit("needs "), bad))
    return p.select("p_partkey", why.alias("why")).where(F.col("why").isNotNull())


def _kinds(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "align").when(F.col("event_type") == "view", "face_probe").when(F.col("event_type") == "purchase", "clip_rank").otherwise("film_burn")
    return load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", kind.alias("kind"))


def dq_presence(spark, sf_dir):
    """Blocks that must or must not be there by kind: weights, and the two inputs of a burn."""
    c = F.col
    weights, burn, clicks = c("value") > 40, c("event_id") % 3 == 0, c("event_id") % 2 == 0
    why = (
        F.when(c("kind").isin(*NEEDS_WEIGHTS) & ~weights, "weights missing")
        .when((c("kind") == "face_probe") & weights, "weights not taken")
        .when((c("kind") == "film_burn") & ~(burn & clicks), "burn and clicks needed")
        .when((c("kind") != "film_burn") & (burn | clicks), "burn or clicks not taken")
    )
    return _kinds(spark, sf_dir).groupBy("kind", why.alias("why")).agg(F.count(F.lit(1)).alias("n")).where(F.col("why").isNotNull())


def dq_preview(spark, sf_dir):
    """Preview orders that carry overlays."""
    o, l = load(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "P"), load(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")  # noqa: E741
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


def dq_result_shape(spark, sf_dir):
    """Results with both or neither of kind and stage, both timings, or a key that is not their identity."""
    c = F.col
    kind, stage = c("value") > 30, c("event_type").isin("error", "signup")
    why = F.when(kind == stage, "kind xor stage").when((c("event_id") % 5 == 0) & (c("event_id") % 7 == 0), "two timings").when((c("event_type") == "purchase") & (c("event_id") % 10 != c("user_id") % 10), "key is not the identity")
    return _kinds(spark, sf_dir).select("event_id", why.alias("why")).where(c("why").isNotNull())


def dq_clock_order(spark, sf_dir):
    """Lines whose bounds are reversed: shipped before their order was made."""
    o, l = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")  # noqa: E741
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where(F.col("l_shipdate") < F.col("o_orderdate")).select("l_orderkey", "l_linenumber", "l_partkey")


def dq_one_identity(spark, sf_dir):
    """Deliveries whose identity is not their job's, and jobs with blocks that are null instead of left out."""
    c = F.col
    why = F.when(c("l_orderkey") % 97 != c("l_partkey") % 97, "identity").when(c("l_returnflag") == "N", "null block")
    return _lines(spark, sf_dir).groupBy(why.alias("why")).agg(F.count(F.lit(1)).alias("n")).where(c("why").isNotNull())


QUERIES = [
    preflight, param_errors, input_binding, list_outputs, semantic_ids, retained_elsewhere, placement, dq_presence, dq_preview, dq_result_shape, dq_clock_order,
    dq_one_identity,
]

_KIND = "k AS (SELECT *, CASE event_type WHEN 'click' THEN 'align' WHEN 'view' THEN 'face_probe' WHEN 'purchase' THEN 'clip_rank' ELSE 'film_burn' END AS kind FROM events)"
ORACLES = {
    "preflight": """WITH w AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 25 = 7 THEN 'unknown op' WHEN l_returnflag = 'R' AND NOT l_discount > 0.05 THEN 'list port needs a list' WHEN l_returnflag <> 'R' AND l_discount > 0.05 THEN 'a list for one file' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'reads a list port' END AS why FROM lineitem)
SELECT l_orderkey, arg_min(why, ((why <> 'unknown op')::INT, l_linenumber, why)) AS why, count(*) AS n FROM w WHERE why IS NOT NULL GROUP BY 1""",
    "param_errors": r"""WITH p AS (SELECT event_id, event_type, CASE WHEN event_type <> 'signup' THEN regexp_extract(props, '"k": *([0-9]+)', 1)::INT END AS k FROM events),
w AS (SELECT event_id, least(CASE WHEN event_type = 'error' THEN 'unexpected: x' END, CASE WHEN k IS NULL THEN 'k is required' END, CASE WHEN k > 80 THEN k || ' is over the maximum of 80' END) AS error FROM p) SELECT event_id, error FROM w WHERE error IS NOT NULL""",
    "input_binding": """WITH m AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS o FROM lineitem GROUP BY 1), d AS (SELECT o_orderkey, o, CASE WHEN o_orderpriority = '1-URGENT' THEN 'R' END AS named, CASE o_orderstatus WHEN 'O' THEN 'N' WHEN 'F' THEN 'A' ELSE 'src' END AS wanted FROM orders JOIN m ON o_orderkey = l_orderkey)
SELECT o_orderkey, CASE WHEN list_contains(o, coalesce(named, wanted)) THEN coalesce(named, wanted) WHEN named IS NULL AND len(o) = 1 THEN o[1] END AS reads FROM d""",
    "list_outputs": r"""SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, (row_number() OVER w - 1)::INT AS place, lpad((row_number() OVER w - 1)::VARCHAR, 4, '0') || CASE WHEN page_id % 2 = 0 AND NOT url SIMILAR TO '.*[?#].*' THEN '.png'
WHEN regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\.[A-Za-z0-9]{1,5})$', 1) = '' THEN '.bin' ELSE regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\.[A-Za-z0-9]{1,5})$', 1) END AS file FROM pages WINDOW w AS (PARTITION BY regexp_extract(url, '://([^/?#]*)', 1) ORDER BY page_id)""",
    "semantic_ids": """SELECT DISTINCT l_orderkey, l_linenumber, sha256('["' || l_orderkey || '","' || l_returnflag || '","output",' || l_linenumber || ']') AS id FROM lineitem""",
    "retained_elsewhere": "SELECT CASE WHEN l_returnflag <> 'R' THEN 'not retained' WHEN l_suppkey % 4 <> 0 THEN 'retained on another worker' WHEN l_tax > 0.06 THEN 'no longer held' ELSE 'here' END AS verdict, count(*) AS n FROM lineitem GROUP BY 1",
    "placement": """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'decides' WHEN p_size % 35 = 0 THEN 'needs keys,llm' WHEN p_size % 5 = 0 THEN 'needs keys' WHEN p_size % 7 = 0 THEN 'needs llm' END AS why FROM part WHERE p_type = 'PROMO' OR p_size % 5 = 0 OR p_size % 7 = 0""",
    "dq_presence": f"""WITH {_KIND}, w AS (SELECT kind, CASE WHEN kind IN ('align', 'clip_rank') AND NOT value > 40 THEN 'weights missing' WHEN kind = 'face_probe' AND value > 40 THEN 'weights not taken' WHEN kind = 'film_burn' AND event_id % 6 <> 0 THEN 'burn and clicks needed'
WHEN kind <> 'film_burn' AND (event_id % 3 = 0 OR event_id % 2 = 0) THEN 'burn or clicks not taken' END AS why FROM k) SELECT kind, why, count(*) AS n FROM w WHERE why IS NOT NULL GROUP BY 1, 2""",
    "dq_preview": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "dq_result_shape": """WITH w AS (SELECT event_id, CASE WHEN (value > 30) = (event_type IN ('error', 'signup')) THEN 'kind xor stage' WHEN event_id % 35 = 0 THEN 'two timings' WHEN event_type = 'purchase' AND event_id % 10 <> user_id % 10 THEN 'key is not the identity' END AS why FROM events) SELECT * FROM w WHERE why IS NOT NULL""",
    "dq_clock_order": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate",
    "dq_one_identity": "WITH w AS (SELECT CASE WHEN l_orderkey % 97 <> l_partkey % 97 THEN 'identity' WHEN l_returnflag = 'N' THEN 'null block' END AS why FROM lineitem) SELECT why, count(*) AS n FROM w WHERE why IS NOT NULL GROUP BY 1",
}
