"""A corpus pipeline over documents: quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame;
all but the last return the columns of docs. Results are written as Parquet in the shared folder and read
again, so that a lost executor costs the running stage alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from comptoir.llm import packing, pii, quality, simhash
from comptoir.llm.shared import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps (good and not toxic), graded on their whole texts; null texts are graded as empty ones."""
    model = quality.fit(docs, quality.graded(table(spark, sf_dir, "labels")))
    own = {c: f"_own_{c}" for c in quality.MADE if c in docs.columns}
    graded = quality.graded_by(docs.withColumnsRenamed(own), model)
    return graded.where(quality.kept_by(model)).select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id. Of rows with the same doc_id one stays, the smallest by text; rows without a doc_id cannot be named as copies and stay."""
    groups = simhash.near_duplicate_groups(docs)
    ids = groups.where("doc_id = first").groupBy("doc_id").count()
    once = docs.join(ids.where("count = 1").select("doc_id"), "doc_id", "left_semi")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("text", F.xxhash64(*docs.columns)))
    more = docs.join(ids.where("count > 1").select("doc_id"), "doc_id", "left_semi").withColumn("_place", place).where("_place = 1")
    return once.unionByName(more.select(*docs.columns)).unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kind in brackets; n_chars counts the new text."""
    return pii.redact(docs, pii.fit_detector(docs), chars="n_chars" if "n_chars" in docs.columns else None)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4,096 tokens, with their ids."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("personal_data", pii_stage), ("packing", packing_stage)]
#: SQL expresses none of the stages' models; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs.drop("ids")
