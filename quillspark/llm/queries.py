"""One query per corpus operator, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_decode
from .common import read
from .decontaminate import contamination
from .html_extract import extract_pages
from .license_scan import scan_licenses
from .nbsvm import score_quality
from .near_dup import near_duplicates
from .quality_rules import quality_rules
from .secret_scan import secret_digests
from .substring_dedup import remove_repeats
from .url_rules import judge_urls


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(read(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).withColumn("repeats", (F.col("n_removed") > 0) | F.col("shares_passage"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), slack=SLACK)
    ids = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        "n_near", F.array_join(F.col("near_items").cast("array<string>"), ",").alias("near_items"),
    )


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_html_extraction, op3_bpe, op4_url_filters, op5_quality_classifier, op6_minhash_near_dedup,
        op7_secret_scans, op8_suffix_array_dedup, op9_decontamination, op10_license_scans, pipeline,
    )
}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""

OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win
), place AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN lens ON len(w) >= n)
), hit AS (SELECT doc_id, i, place.n, item_id FROM place JOIN win ON place.g = win.g AND place.n = win.n
), covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1
), shape AS (
  SELECT DISTINCT n, g, string_split(g, ' ') AS t FROM win
), exact AS (SELECT DISTINCT doc_id, n, g FROM place JOIN shape USING (n, g)
), tok AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d
), freq AS (SELECT t, count(*) AS f FROM tok GROUP BY 1
), term AS (SELECT n, g, unnest(t) AS x, unnest(range(0, n)) AS j FROM shape
), anchor AS (
  SELECT term.n, term.g, arg_min(x, (coalesce(f, 0), j)) AS x, arg_min(j, (coalesce(f, 0), j)) AS j, min(coalesce(f, 0)) AS f
  FROM term LEFT JOIN freq ON freq.t = term.x GROUP BY 1, 2
), cand AS (
  SELECT DISTINCT tok.doc_id, anchor.n, anchor.g, tok.p - anchor.j + s AS p
  FROM anchor JOIN tok ON tok.t = anchor.x CROSS JOIN (SELECT unnest(range(-__SLACK__, __SLACK__ + 1)) AS s) WHERE anchor.f > 0
), near AS (
  SELECT DISTINCT cand.doc_id, cand.n, cand.g FROM cand JOIN shape ON shape.n = cand.n AND shape.g = cand.g JOIN d ON d.doc_id = cand.doc_id
  WHERE __EACH__
), apart AS (
  SELECT * FROM near WHERE NOT EXISTS (SELECT 1 FROM exact WHERE exact.doc_id = near.doc_id AND exact.g = near.g AND exact.n = near.n)
), nears AS (
  SELECT doc_id, n_near, near_items FROM (SELECT doc_id, count(*) AS n_near FROM apart GROUP BY 1) JOIN (
    SELECT doc_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS near_items
    FROM (SELECT DISTINCT apart.doc_id, item_id FROM apart JOIN win ON win.g = apart.g AND win.n = apart.n) GROUP BY 1
  ) USING (doc_id)
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near, coalesce(near_items, '') AS near_items
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN nears USING (doc_id)
"""
#: Words that a term of a proximity match may stand from its place.
SLACK = 2
OP9_SQL = OP9_SQL.replace("__SLACK__", str(SLACK)).replace(
    "__EACH__", " AND ".join(f"(cand.n <= {j} OR list_contains(d.w[greatest(cand.p + {j - SLACK}, 1):greatest(cand.p + {j + SLACK}, 0)], shape.t[{j + 1}]))" for j in range(10))
)

ORACLES = {"op6_minhash_near_dedup": OP6_SQL, "op9_decontamination": OP9_SQL}
