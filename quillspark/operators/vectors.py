"""Vector scoring over array columns: norms, cosines, log-softmax, gathers, re-alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import load

MISS = -1.0


def doubles(v: str | Column) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalised(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x / n)


def cosine(a: Column, b: Column, places: int = 4) -> Column:
    return F.round(dot(a, b) / (norm(a) * norm(b)), places)


def log_softmax(a: Column) -> Column:
    m = F.array_max(a)
    z = F.ln(F.aggregate(F.transform(a, lambda x: F.exp(x - m)), F.lit(0.0), lambda s, x: s + x))
    return F.transform(a, lambda x: x - m - z)


def gather(a: Column, ids: list[int]) -> Column:
    """The chosen elements, in the order asked for."""
    return F.array(*(F.get(a, F.lit(i)) for i in ids))


def realign(requested: DataFrame, scored: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Scores in request order; what was never scored gets the miss value."""
    return requested.join(scored, keys, "left").withColumn(score, F.coalesce(score, F.lit(MISS)))


def group_heads(images: DataFrame) -> DataFrame:
    """The vector of each group's least position; it stands for the group's intent."""
    return images.groupBy("label").agg(F.min_by("v", "vec_id").alias("q"))


def _images(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", doubles("embedding").alias("v"))


def rank_cosine(spark, sf_dir):
    v = _images(spark, sf_dir)
    return v.join(group_heads(v), "label").select("label", "vec_id", cosine(F.col("v"), F.col("q")).alias("score"))


def rank_realign(spark, sf_dir):
    """Images with a negative first component count as never decoded."""
    v = _images(spark, sf_dir)
    scored = v.where(F.get("v", F.lit(0)) >= 0).join(group_heads(v), "label").select("label", "vec_id", cosine(F.col("v"), F.col("q")).alias("score"))
    return realign(v.select("label", "vec_id"), scored, ["label", "vec_id"])


def rank_unique_sets(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").groupBy("label").agg(F.min("vec_id").alias("first_pos"), F.count(F.lit(1)).alias("n"))


def rank_embed_only(spark, sf_dir):
    """Groups without an intent (an even label) get the miss score and keep their vectors."""
    v = _images(spark, sf_dir)
    s = v.join(group_heads(v), "label")
    score = F.when(F.col("label") % 2 == 0, F.lit(MISS)).otherwise(cosine(F.col("v"), F.col("q")))
    return s.select("vec_id", score.alias("score"), F.size("v").alias("dims"))


def vec_l2norm(spark, sf_dir):
    v = _images(spark, sf_dir)
    return v.select("vec_id", F.round(norm(F.col("v")), 4).alias("norm"), F.round(F.get(l2_normalised(F.col("v")), F.lit(0)), 4).alias("first"))


def vec_log_softmax(spark, sf_dir):
    v = _images(spark, sf_dir).withColumn("p", log_softmax(F.col("v")))
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + F.exp(x))
    return v.select("vec_id", F.round(F.array_max("p"), 4).alias("best"), F.round(F.array_min("p"), 4).alias("worst"), F.round(total, 4).alias("mass"))


def vec_gather(spark, sf_dir):
    g = gather(F.col("v"), [0, 5, 9])
    return _images(spark, sf_dir).select("vec_id", *(F.round(F.get(g, F.lit(i)), 5).alias(f"v{k}") for i, k in enumerate((0, 5, 9))))


QUERIES = [rank_cosine, rank_realign, rank_unique_sets, rank_embed_only, vec_l2norm, vec_log_softmax, vec_gather]

_COS = "round(list_cosine_similarity(v, q), 4)"
_V = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), h AS (SELECT label, arg_min(v, vec_id) AS q FROM v GROUP BY 1)"
ORACLES = {
    "rank_cosine": f"{_V} SELECT label, vec_id, {_COS} AS score FROM v JOIN h USING (label)",
    "rank_realign": f"{_V} SELECT label, vec_id, CASE WHEN v[1] >= 0 THEN {_COS} ELSE -1.0::DOUBLE END AS score FROM v JOIN h USING (label)",
    "rank_unique_sets": "SELECT label, min(vec_id) AS first_pos, count(*) AS n FROM embeddings GROUP BY 1",
    "rank_embed_only": f"{_V} SELECT vec_id, CASE WHEN label % 2 = 0 THEN -1.0::DOUBLE ELSE {_COS} END AS score, len(v)::INT AS dims FROM v JOIN h USING (label)",
    "vec_l2norm": f"{_V} SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 4) AS norm, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 4) AS first FROM v",
    "vec_log_softmax": f"{_V}, s AS (SELECT vec_id, v, list_max(v) AS m, ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))) AS z FROM v) "
    "SELECT vec_id, round(list_max(v) - m - z, 4) AS best, round(list_min(v) - m - z, 4) AS worst, round(list_sum(list_transform(v, lambda x: exp(x - m - z))), 4) AS mass FROM s",
    "vec_gather": f"{_V} SELECT vec_id, round(v[1], 5) AS v0, round(v[6], 5) AS v5, round(v[10], 5) AS v9 FROM v",
}
