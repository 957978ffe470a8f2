"""Streams of triples (hash, feature, value, time) into a database.

Every micro-batch is reduced to its last value per hash and feature, and to its new pairs of
multi-valued features, and lands in a folder named by its batch id.  A repeated batch replaces its
own folder, so the landing table holds every batch once.  ``apply_landed`` merges the landed
batches into a database: the latest event time wins, however late a triple arrived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hashloom.operators.writes import set_values_batch
from hashloom.plans.namespace import Database

def land_triples(
    triples: DataFrame,
    path: str,
    checkpoint: str,
    many: list[str] | None = None,
    available_now: bool = True,
    delay: str | None = None,
) -> StreamingQuery:
    """Start the stream that lands triples (hash, feature, value, time, tie).  ``many`` names the
    multi-valued features, whose pairs are all kept; with a ``delay`` repeated deliveries are dropped."""
    many = many or []
    triples = triples if delay is None else deduplicated(triples, delay, many)

    def land(batch: DataFrame, batch_id: int) -> None:
        _last(batch, many).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = triples.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _last(triples: DataFrame, many: list[str]) -> DataFrame:
    """The last triple per hash and feature; per value, too, for multi-valued features."""
    newest = F.max_by(F.struct("value", "time", "tie"), F.struct("time", "tie")).alias("last")
    pair = F.when(F.col("feature").isin(many), F.col("value")).alias("pair")
    return triples.groupBy("hash", "feature", pair).agg(newest).select("hash", "feature", "last.*")


def deduplicated(triples: DataFrame, delay: str, many: list[str] | None = None) -> DataFrame:
    """Drop triples that a source delivers again within a delay; the state is bounded by the watermark.

    A pair of a multi-valued feature (``many``) is the same whenever it comes.  A value of a single-valued one is
    only the same at the same time and tie: A, B, A are three values, of which the last must win.
    """
    moment = F.when(~F.col("feature").isin(many or []), F.struct("time", "tie"))
    marked = triples.withColumn("__moment", moment).withWatermark("time", delay)
    return marked.dropDuplicatesWithinWatermark(["hash", "feature", "value", "__moment"]).drop("__moment")


def landed(spark: SparkSession, path: str) -> DataFrame:
    """All landed triples."""
    return spark.read.parquet(path).drop("batch")


def apply_landed(database: Database, triples: DataFrame, features: list[str]) -> Database:
    """Merge landed triples into a database; merging them again changes nothing."""
    return set_values_batch(database, triples, features, order=["time", "tie"])


def compact(spark: SparkSession, path: str, target: str, many: list[str] | None = None) -> DataFrame:
    """Write the landed triples that still matter to a new folder, the stream being stopped."""
    _last(landed(spark, path), many or []).write.parquet(target)
    return spark.read.parquet(target)
