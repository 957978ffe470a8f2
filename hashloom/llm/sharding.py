"""Proportional stratified interleaving of documents into shards.  DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hashloom.llm.common import cell_bits, ranked, table
from hashloom.llm.registry import query

SHARDS = 40
SEED = 17
#: Bytes that a record takes beside its text.
OVERHEAD = 16


def shard(documents: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, text_crc32, shard, slot.

    Rows are shuffled within their source by a seeded hash of doc_id and the text's crc and ranked; rank r of n rows gets
    the fraction (2r + 1) / 2n.  All rows sorted by fraction are cut into ``shards`` runs whose row
    counts differ by one at most, so any run, hence any shard, mirrors the mixture of sources.

    Both sorts go by cells: cells of the hash within a source, cells of the fraction overall.  The
    rows before each cell are known from counts, so no task sorts a whole source or the whole table:
    with N rows there are about sqrt(N) cells of about sqrt(N) rows.  The rows before a cell of the fraction follow from
    the sizes of the sources, each distinct size once and never more than min(size, cells) rows for it, so any number of sources
    will do.  Ties of the fraction go by source, hash, doc_id, crc and size; rows equal in all of them are interchangeable.
    Sources of one size have the same fractions; those of few rows cannot be in every shard.
    A null source is a source of its own; a null text has no bytes; a null doc_id is placed as any other; rows
    that repeat a doc_id are placed each.  Long texts are read whole, extra columns are not read.  An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        "doc_id",
        "source",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.lit(seed), "doc_id", F.crc32(text)).alias("_key"),
    )
    sources = documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total = sources.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = cell_bits(total)
    cells = 1 << bits
    within = ranked(rows, "source", "_key", ["doc_id", "text_crc32", "size"], bits)
    # floor((2r + 1) / 2n * cells) is the cell of a row; the rows of a source before cell c follow from n.
    placed = within.withColumn("_cell", F.expr(f"((2 * rank + 1) * {cells}L) div (2 * group_rows)"))
    sizes = sources.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    before = f"(2 * n * {{}} + {cells - 1}L) div {2 * cells}L"
    small = sizes.where(F.col("n") <= cells).select("n", "m", F.explode(F.expr("sequence(0L, n - 1)")).alias("_r"))
    large = sizes.where(F.col("n") > cells).select("n", "m", F.explode(F.expr(f"sequence(0L, {cells - 1}L)")).alias("_at"))
    filled = small.select(F.expr(f"((2 * _r + 1) * {cells}L) div (2 * n)").alias("_at"), F.col("m").alias("_n"))
    filled = filled.union(large.select("_at", F.expr(f"m * ({before.format('(_at + 1)')} - {before.format('_at')})")))
    filled = filled.groupBy("_at").agg(F.sum("_n").alias("_n"))
    # one row per cell, about sqrt(N) in all
    so_far = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = filled.select("_at", (F.sum("_n").over(so_far) - F.col("_n")).alias("_before"))
    fraction = (2 * F.col("rank") + 1) / (2 * F.col("group_rows"))
    inside = Window.partitionBy("_cell").orderBy("_fraction", "source", "_key", "doc_id", "text_crc32", "size")
    position = F.col("_before") + F.row_number().over(inside) - 1
    total = max(1, total)
    return (
        placed.withColumn("_fraction", fraction)
        .join(starts, placed["_cell"] == starts["_at"])
        .withColumn("_position", position)
        .withColumn("shard", F.expr(f"(_position * {shards}L) div {total}L"))
        .select(
            "doc_id",
            "source",
            "size",
            "text_crc32",
            F.col("shard").cast("int").alias("shard"),
            F.expr(f"_position - (shard * {total}L + {shards - 1}L) div {shards}L").cast("long").alias("slot"),
        )
    )


@query()
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )
