"""The corpus pipeline: quality, exact dedup, near dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, the last one their pieces.
All but the last return the columns of documents.  What a stage decides is joined to the documents by
doc_id; documents whose decision is to go are absent from the result.  Repeated rows of one doc_id go or
stay together; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.llm.common import prepared, table, working_folder
from hashloom.llm.contamination import contamination
from hashloom.llm.exact import duplicate_groups
from hashloom.llm.near import near_duplicates
from hashloom.llm.packing import pack
from hashloom.llm.quality import quality_scores


def _kept(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is listed, each row once; null ids match each other."""
    listed = ids.select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(listed, docs["doc_id"].eqNullSafe(listed["_kept_id"]), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    scored = quality_scores(docs, table(prepared(spark), sf_dir, "labels"))
    return _kept(docs, scored.where(F.col("predicted") == 1))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest doc_id."""
    prepared(spark)
    return _kept(docs, duplicate_groups(docs).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    prepared(spark)
    return _kept(docs, near_duplicates(docs).where("kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = contamination(docs, table(prepared(spark), sf_dir, "benchmark"))
    return _kept(docs, found.where(~F.col("contaminated")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    prepared(spark)
    return pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("best_fit_packing", packing),
]

#: A classifier and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again by the next."""
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = working_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
