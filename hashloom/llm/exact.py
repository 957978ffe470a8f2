"""Exact duplicates by an extendible-hash index on shared files.  DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hashloom.llm.common import table, written
from hashloom.llm.registry import query

#: Distinct keys that a bucket of the index may hold before it is split.
BUCKET_KEYS = 4_096


def text_classes(documents: DataFrame, hash_bits: int = 64) -> DataFrame:
    """One row per distinct text: key, text_sha256, keep_id, group_size.

    Equal bytes meet here: the grouping is on the key and the whole text, so two texts with one key
    stay two classes.  Copies are counted in their own task before the exchange, so a text that fills
    a third of all rows leaves every task as one row.
    """
    rows = documents.select("doc_id", _key(hash_bits).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    classes = rows.groupBy("key", "text").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return classes.select("key", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")


def _key(hash_bits: int):
    spare = 64 - hash_bits
    return F.shiftleft(F.shiftright(F.xxhash64(F.coalesce("text", F.lit(""))), spare), spare)


def _cell(depth: int):
    """The first ``depth`` bits of the key, as the directory sees it."""
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def directory(classes: DataFrame, bucket_keys: int = BUCKET_KEYS, hash_bits: int = 64) -> tuple[DataFrame, int]:
    """The directory of the index and its depth: cell, bucket, local_depth.

    The directory starts with as many cells as the number of keys asks for and doubles while a bucket
    is overfull and bits are left.  Only overfull buckets split: all others keep their smaller local
    depth, so several cells of the directory share them.
    """
    keys = classes.select("key").distinct()
    least = min(hash_bits, max(0, math.ceil(math.log2(max(1, keys.count()) / bucket_keys))))
    depth = least
    while True:
        cells = keys.groupBy(_cell(depth).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        most = cells.agg(F.max("n")).first()[0]
        if depth == hash_bits or most is None or most <= bucket_keys:
            break
        depth += 1
    local = F.lit(depth)
    for level in range(depth - 1, least - 1, -1):
        prefix = F.shiftrightunsigned("cell", depth - level)
        fits = F.sum("n").over(Window.partitionBy(prefix)) <= bucket_keys
        local = F.when(fits, F.lit(level)).otherwise(local)
    found = cells.withColumn("local_depth", local)
    bucket = F.expr(f"shiftleft(shiftrightunsigned(cell, {depth} - local_depth), {depth} - local_depth)")
    return found.select("cell", bucket.alias("bucket"), "local_depth"), depth


def build_index(documents: DataFrame, bucket_keys: int = BUCKET_KEYS, hash_bits: int = 64) -> DataFrame:
    """Write the index to the shared folder: bucket, local_depth, key, chain, chain_length and the class.

    Owner tasks take ranges of keys, hence whole buckets in order, and number the classes of one key
    as its chain.  The rows are classes, not documents: as many as there are distinct texts.
    """
    classes = written(text_classes(documents, hash_bits), "classes")
    cells, depth = directory(classes, bucket_keys, hash_bits)
    placed = classes.withColumn("cell", _cell(depth)).join(cells, "cell").drop("cell")
    chain = Window.partitionBy("key")
    owned = placed.repartitionByRange("key").select(
        "bucket",
        "local_depth",
        "key",
        F.row_number().over(chain.orderBy("text_sha256")).alias("chain"),
        F.count(F.lit(1)).over(chain).alias("chain_length"),
        "text_sha256",
        "keep_id",
        "group_size",
    )
    return written(owned, "exact-index")


def duplicate_groups(documents: DataFrame, bucket_keys: int = BUCKET_KEYS, hash_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays.  A null text is the empty text.  A null
    doc_id loses to any other; rows that repeat a doc_id with its text are all kept or all dropped.
    Other columns are not read.  An empty table gives no rows.

    Documents look up their class by key and, within a chain, by the SHA-256 of the bytes that the
    classes were told apart by.  A key with many documents is split by adaptive execution.
    """
    index = build_index(documents, bucket_keys, hash_bits)
    rows = documents.select(
        "doc_id", _key(hash_bits).alias("key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )
    found = rows.join(index.select("key", "text_sha256", "keep_id", "group_size"), ["key", "text_sha256"])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query(SQL)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"))
