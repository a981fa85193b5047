"""A corpus pipeline of five stages, each written as Parquet and read again.

Documents that the quality rules reject go; of each group of near copies one
stays; documents with benchmark passages go; secrets are masked; the rest is
encoded and decoded.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.bpe import encode_decode
from quillspark.llm.common import cut, discard, discard_since, read, written
from quillspark.llm.decontaminate import contamination
from quillspark.llm.near_dup import near_duplicates
from quillspark.llm.quality_rules import quality_rules
from quillspark.llm.secret_scan import redact, scan_secrets

#: SQL cannot say what the stages do; the tests compare them with brute force.
ORACLE_SQL = None


#: Digest of a row's text, by which narrow verdicts meet their rows: equal texts have equal verdicts.
TAG = "_quill_tag"


def _tag() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.withColumn(TAG, _tag())


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected rows go. Null texts have no words and are rejected. Rows with equal or null ids are
    judged each, by text, language and source; an empty table gives none."""
    by = [TAG, *(c for c in ("lang", "source") if c in docs.columns)]
    gone = quality_rules(_tagged(docs), carry=tuple(by)).where(~F.col("kept")).select("row.*").distinct()
    gone = cut(gone.select(*(F.col(c).alias(f"_gone_{c}") for c in by)), "rejected")
    same = [F.col(c).eqNullSafe(F.col(f"_gone_{c}")) for c in by[1:]]
    return _tagged(docs).join(gone, reduce(and_, same, F.col(TAG) == F.col(f"_gone_{TAG}")), "left_anti").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays: that of the least doc_id, nulls last; of several with that
    id that of the least hash of its text, and of rows equal in both that of the least hash of
    all columns. Rows with one id and different texts are rows of their own. Null
    texts are linked with nothing and stay; an empty table gives none."""
    keyed = docs.withColumn(TAG, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    found = near_duplicates(keyed, row=TAG)
    # rows without words are in no component: each stays
    keep = cut(found.where("first").groupBy("doc_id", TAG).agg(F.count(F.lit(1)).alias("_rows"), F.max(F.col("n_shingles") > 0).alias("_linked")), "kept")
    keep = keep.select(F.col("doc_id").alias("_id"), F.col(TAG).alias("_tag"), "_rows", "_linked")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(TAG) == F.col("_tag"))
    once = keyed.join(keep.where((F.col("_rows") == 1) | ~F.col("_linked")), same, "left_semi").select(*docs.columns)
    again = keep.where((F.col("_rows") > 1) & F.col("_linked"))
    if again.isEmpty():
        return once
    rows = keyed.join(again, same, "left_semi").withColumn("_row", F.struct(*docs.columns))
    one = rows.groupBy("doc_id", TAG).agg(F.min_by("_row", F.xxhash64("_row")).alias("_one"))
    return once.unionByName(one.select("_one.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a word inside a benchmark window go, whatever their ids. Null texts stay; an empty table gives none, an empty benchmark takes none."""
    hit = contamination(docs, read(spark, sf_dir, "benchmark")).where(F.col("n_hit") > 0)
    gone = cut(hit.select(F.col("tag").alias("_gone")).distinct(), "contaminated")
    return docs.join(gone, _tag() == F.col("_gone"), "left_anti")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Characters under a secret's span become ``[SECRET]``; n_chars, if there, follows. Null texts stay null. Rows are judged each, by their text; an empty table gives none."""
    found = scan_secrets(_tagged(docs), carry=(TAG,)).select(F.col(f"row.{TAG}").alias("_of"), F.concat("base", "more").alias("_spans"))
    found = cut(found.where(F.size("_spans") > 0).groupBy("_of").agg(F.first("_spans").alias("_spans")), "secrets")
    out = docs.join(found, _tag() == F.col("_of"), "left")
    hit = F.col("_spans").isNotNull()
    out = out.withColumn("_clean", F.when(hit, redact(F.col("text"), F.col("_spans"))).otherwise(F.col("text")))
    new = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every row; null texts count as empty, an empty table gives none."""
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scans", secret_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what a stage has written for itself goes when its result is stored."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, last = written(spark), docs
        docs = cut(stage(spark, docs, sf_dir), name)
        discard_since(spark, before, docs)
        discard(last)
    return docs
