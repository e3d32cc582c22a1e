"""Cleaning of a document table in five stages; each stage's rows are written and read again by the next.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``docs``;
other columns pass through. Null and empty texts have no words, seeds or secrets: the quality
score decides on them, and they stay where a stage finds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.functions.lineage_cut import cut
from cellframe.llm import bpe, decontaminate, neardup, quality, secrets
from cellframe.llm.queries import remainder, table, vocabulary

#: what stands for a secret
MASK = "[SECRET]"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=remainder("doc_id", 4) != 2)
    scored = quality.classify(docs, model, score="_score", predicted="_good")
    return scored.where("_good = 1").select(docs.columns)


def _named(docs: DataFrame) -> DataFrame:
    """Documents with the hashes by which the operators name rows."""
    return docs.withColumns({"_h1": F.xxhash64("doc_id", "text"), "_h2": F.hash("text")})


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8), the document of smallest id stays, once; null ids come last."""
    found = neardup.near_duplicates(docs, n=5, percent=80)
    first = found.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h1", "h2")).alias("row"))
    first = cut(first.select(F.col("row.h1").alias("_h1"), F.col("row.h2").alias("_h2")).distinct())
    worded = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    kept = _named(docs.where(worded)).join(first, ["_h1", "_h2"], "left_semi").dropDuplicates(["_h1", "_h2"])
    return kept.select(docs.columns).union(docs.where(~worded))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item's words in tiles go."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    leaks = cut(found.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).distinct())
    return _named(docs).join(leaks, ["_h1", "_h2"], "left_anti").select(docs.columns)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask; ``n_chars`` follows."""
    masked = secrets.scan(docs, spans="_spans", mask=MASK)
    return masked.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its byte-level BPE ids; a document whose ids do not decode to its text is an error.

    Columns ``ids`` and ``n_tokens`` of the documents are replaced.
    """
    columns = [c for c in docs.columns if c not in ("ids", "n_tokens")]
    coded = bpe.encode(docs, *vocabulary(spark), ids="_ids", decoded="_decoded")
    same = F.coalesce(F.col("text"), F.lit("")).cast("binary") == F.col("_decoded")
    ids = F.when(same, F.col("_ids")).otherwise(F.raise_error(F.lit("ids do not decode to their text")).cast("array<int>"))
    return coded.select(*columns, F.size("_ids").cast("long").alias("n_tokens"), ids.alias("ids"))


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicate_filter), ("decontamination", decontamination),
          ("secrets", secret_masking), ("tokens", tokens)]

#: learned scores, hashing and merges are beyond SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
