"""Cache inventories: eviction, retention, supersession, hit rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_json
from ..plans.running import running
from ..sources.tables import load
from .sequential import keep_in_order


def prune(slots: DataFrame, cap: Column, order: list, size: str, pinned: str | None = None, group: str | None = None, cell: Column | None = None) -> DataFrame:
    """Rows to evict, oldest first, until the rest fits ``cap``; pinned rows count but stay.

    A row goes if what is left once all older evictable rows are gone is still too
    much. Totals are per ``group``, over the whole inventory without one. ``cell``, a range of
    the first order column, divides a group of very many slots among tasks.
    """
    key = F.lit(0) if group is None else F.col(group)
    free = F.col(size) if pinned is None else F.when(F.col(pinned), 0).otherwise(F.col(size))
    all_sizes = slots.groupBy(key.alias("_of")).agg(F.sum(size).alias("_all"))
    d = running(slots, key, order, F.lit(0) if cell is None else cell, free, "_free").join(all_sizes, key.eqNullSafe(F.col("_of")))
    gone = F.col("_all") - (F.col("_free") - free) > cap
    return d.where(gone if pinned is None else gone & ~F.col(pinned)).drop("_of", "_all", "_free")


def _slots(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").alias("bytes"), (F.col("lang") != "en").alias("pinned"))


def cache_prune(spark, sf_dir):
    return prune(_slots(spark, sf_dir), F.lit(50_000), ["doc_id"], "bytes", group="source", cell=F.floor(F.col("doc_id") / 10_000)).select("doc_id", "source", "bytes")


def cache_prune_pinned(spark, sf_dir):
    return prune(_slots(spark, sf_dir), F.lit(60_000), ["doc_id"], "bytes", "pinned", "source", F.floor(F.col("doc_id") / 10_000)).select("doc_id", "source", "bytes")


def retained(slots: DataFrame, room: int, order: list[str], size: str, group: str) -> DataFrame:
    """Greedy retention per ``group``: a slot is kept if it still fits ``room``; a refusal takes none of it."""

    def decide(total, n):
        ok = total + n <= room
        return ok, total + n if ok else total

    # what can never fit is dropped before the shuffle
    return keep_in_order(slots.where(F.col(size) <= room), group, order, 0, decide, size)


def cache_retained(spark, sf_dir):
    """By source, half of the cap."""
    return retained(_slots(spark, sf_dir).select("doc_id", "source", "bytes"), 30_000, ["doc_id"], "bytes", "source")


def supersede(spark, sf_dir):
    """Objects with the same last path word under another prefix: the newest stays."""
    p = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^?#]*)", 1).alias("key"))
    p = p.withColumn("base", F.substring_index(F.regexp_replace("key", "/$", ""), "/", -1)).withColumn("prefix", F.substring_index("key", "/", 1))
    newest = p.groupBy("base").agg(F.max_by("prefix", "page_id").alias("holder"))
    return p.join(newest, "base").where(F.col("prefix") != F.col("holder")).select("page_id", "base", "holder")


def cache_get(spark, sf_dir):
    """Retained slots hit; others by matching size; a mismatch heals, and counts as a miss."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("found"), F.col("n_chars").alias("noted"), "lang")
    out = F.when(F.col("lang") != "en", "retained hit").when(F.col("found") == F.col("noted"), "hit").otherwise("heal")
    return d.groupBy(out.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def sentinel_kind(spark, sf_dir):
    """What a sentinel holds: a digest, a size object, or neither."""
    e = load(spark, sf_dir, "events").select(F.when(F.col("event_type") == "click", F.sha2(F.col("event_id").cast("string"), 256)).when(F.col("event_type") == "view", F.col("props")).otherwise(F.lit("{bad")).alias("s"))
    kind = F.when(F.col("s").rlike("^[0-9a-f]{64}$"), "legacy").when(F.get_json_object("s", "$.k").isNotNull(), "size").otherwise("corrupt")
    return e.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def result_key(spark, sf_dir):
    """Result-cache keys: op, version, parameters, input digests by port, suffix, pack, image and
    tool; equal ones share a result. Only ops on the allow-list have one."""
    p = load(spark, sf_dir, "part").withColumn("op", F.when(F.col("p_type") == "PROMO", "media.tag").otherwise("media.scale"))
    fields = {
        "op": F.col("op"), "version": F.lit(4), "params": F.struct(F.col("p_size").alias("height")), "inputs": F.struct(F.sha2("p_brand", 256).alias("src")),
        "suffix": F.lit(".mp4"), "pack": F.lit("p1"), "image": F.lit("i1"), "tool": F.lit("t1"),
    }
    key = F.when(F.col("op").isin("media.scale"), F.sha2(canonical_json(fields), 256))
    return p.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("uses"))


QUERIES = [cache_prune, cache_prune_pinned, cache_retained, supersede, cache_get, sentinel_kind, result_key]

_W = "PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING"
ORACLES = {
    "cache_prune": f"WITH d AS (SELECT doc_id, source, n_chars AS bytes, sum(n_chars) OVER (PARTITION BY source) - (sum(n_chars) OVER ({_W}) - n_chars) AS rest FROM documents) SELECT doc_id, source, bytes FROM d WHERE rest > 50000",
    "cache_prune_pinned": f"""WITH d AS (SELECT doc_id, source, n_chars AS bytes, lang <> 'en' AS pinned, CASE WHEN lang <> 'en' THEN 0 ELSE n_chars END AS f FROM documents),
r AS (SELECT *, sum(bytes) OVER (PARTITION BY source) - (sum(f) OVER ({_W}) - f) AS rest FROM d) SELECT doc_id, source, bytes FROM r WHERE rest > 60000 AND NOT pinned""",
    "cache_retained": """WITH RECURSIVE d AS (SELECT doc_id, source, n_chars AS bytes, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
t AS (SELECT source, rn, doc_id, bytes, bytes <= 30000 AS ok, CASE WHEN bytes <= 30000 THEN bytes ELSE 0 END AS total FROM d WHERE rn = 1
UNION ALL SELECT d.source, d.rn, d.doc_id, d.bytes, total + d.bytes <= 30000, CASE WHEN total + d.bytes <= 30000 THEN total + d.bytes ELSE total END FROM t JOIN d ON d.source = t.source AND d.rn = t.rn + 1)
SELECT doc_id, source, bytes FROM t WHERE ok""",
    "supersede": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS key FROM pages), q AS (SELECT page_id, regexp_extract(regexp_replace(key, '/$', ''), '([^/]*)$', 1) AS base, split_part(key, '/', 1) AS prefix FROM p),
h AS (SELECT base, arg_max(prefix, page_id) AS holder FROM q GROUP BY 1) SELECT page_id, base, holder FROM q JOIN h USING (base) WHERE prefix <> holder""",
    "cache_get": "SELECT CASE WHEN lang <> 'en' THEN 'retained hit' WHEN length(text) = n_chars THEN 'hit' ELSE 'heal' END AS outcome, count(*) AS n FROM documents GROUP BY 1",
    "sentinel_kind": "SELECT CASE event_type WHEN 'click' THEN 'legacy' WHEN 'view' THEN 'size' ELSE 'corrupt' END AS kind, count(*) AS n FROM events GROUP BY 1",
    "result_key": """SELECT CASE WHEN p_type <> 'PROMO' THEN sha256('{"image":"i1","inputs":{"src":"' || sha256(p_brand) || '"},"op":"media.scale","pack":"p1","params":{"height":' || p_size || '},"suffix":".mp4","tool":"t1","version":4}') END AS key, count(*) AS uses FROM part GROUP BY 1""",
}
