"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, c): each vertex of ``links`` (a, b) with the least vertex it reaches.

    Alternating large-star and small-star rounds; each half is an aggregation
    that combines map-side, written to the shared folder, and an equi-join of
    two shuffles, so Spark can split the partition of a vertex with very many
    links. It ends when a round changes nothing. Links may repeat and be in either
    order; self-links give their vertex alone.
    """
    e = cut(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("m")).distinct(),
        "links",
    )
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("m").alias("u"), F.col("u").alias("m")))
        least = cut(both.groupBy("u").agg(F.least(F.min("m"), F.col("u")).alias("r")), "least")
        # large star: each greater neighbour hangs on the least vertex around u
        large = both.join(least, "u").where(F.col("m") > F.col("u")).select(F.col("m").alias("u"), F.col("r").alias("m"))
        large = large.unionByName(e.where(F.col("u") == F.col("m"))).distinct()
        # small star: u and its lesser neighbours hang on the least of them
        large = cut(large, "large")
        low = cut(large.groupBy("u").agg(F.min("m").alias("r")), "low")
        small = large.join(low, "u").select("u", "m", "r")
        hung = small.select(F.col("m").alias("u"), F.col("r").alias("m")).where(F.col("u") > F.col("m"))
        hung = cut(hung.unionByName(low.select("u", F.col("r").alias("m"))).distinct(), "links")
        discard(e, least, large, low)
        e = hung
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "m").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("m").alias("v"), F.col("m").alias("c")).distinct()
    found = cut(e.select(F.col("u").alias("v"), F.col("m").alias("c")).unionByName(roots).distinct(), "components")
    discard(e)
    return found
