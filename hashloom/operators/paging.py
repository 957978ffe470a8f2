"""Sorted results, slices of them, and the lookup of one entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hashloom.plans.namespace import Namespace
from hashloom.plans.query import select
from hashloom.session import written

PAGE_ROWS = 1000
#: Slices that end within this many rows are cut with a top-k; deeper ones are narrowed first.
TOP_ROWS = 100_000
#: Key ranges counted per narrowing step, and keys drawn per range to place their bounds.
RANGES = 64
DRAWN = 20
#: Rows of one stored range: what the read of a page from stored ranges costs.
RANGE_ROWS = 100_000


def page_count(frame: DataFrame, rows: int = PAGE_ROWS) -> DataFrame:
    """Total number of rows and of pages."""
    total = F.count(F.lit(1))
    return frame.agg(total.alias("total"), F.ceil(total / F.lit(rows)).cast("bigint").alias("pages"))


def page(frame: DataFrame, key: str, number: int, rows: int = PAGE_ROWS, top_rows: int = TOP_ROWS) -> DataFrame:
    """Page ``number``, counted from 0, of a frame ordered by a unique key.

    A slice near the start is a top-k.  A deep slice would drag all rows before it through one
    task, so its key range is found first: the keys, written once, are counted in a few dozen
    ranges, exactly, and again inside the ranges that hold the slice, until few rows remain before
    it.  The frame is then filtered to that range of keys, which reaches the scan.
    """
    start = number * rows
    if start + rows > top_rows:
        keys = written(frame.select(key), "keys")
        while start + rows > top_rows:
            inside, skipped = _narrow(keys, key, start, rows)
            if inside is None:
                break
            keys, frame, start = keys.where(inside), frame.where(inside), start - skipped
    return frame.orderBy(key).offset(start).limit(rows)


def _narrow(keys: DataFrame, key: str, start: int, rows: int) -> tuple[Column | None, int]:
    """The key ranges with the rows from start on, as a filter, and the rows before them; None
    instead of a filter if it would keep all rows.  Null keys come first, in the first range."""
    bounds = _bounds(keys, key)
    if not bounds:
        return None, 0
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda edge: edge <= F.col(key)))
    counts = {row["bucket"]: row["count"] for row in keys.groupBy(bucket.alias("bucket")).count().collect()}
    before, index = 0, 0
    while index < len(bounds) and before + counts.get(index, 0) <= start:
        before += counts.get(index, 0)
        index += 1
    end, last = before, index
    while last < len(bounds) and end + counts.get(last, 0) < start + rows:
        end += counts.get(last, 0)
        last += 1
    low = F.col(key) >= F.lit(bounds[index - 1]) if index > 0 else None
    high = F.col(key) < F.lit(bounds[last]) if last < len(bounds) else None
    if low is None and high is not None:
        return high | F.col(key).isNull(), before
    return (low if high is None else low & high), before


def _bounds(frame: DataFrame, key: str) -> list:
    """Ascending bounds of key ranges of similar size, placed by keys drawn evenly by their hash.
    The ranges are counted afterwards, so where the bounds lie does not change the result."""
    drawn = frame.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(RANGES * DRAWN).collect()
    keys = [row[0] for row in drawn]
    keys.sort(key=lambda k: k.encode() if isinstance(k, str) else k)
    return list(dict.fromkeys(keys[DRAWN::DRAWN]))


def store_pages(frame: DataFrame, key: str, path: str, range_rows: int = RANGE_ROWS) -> None:
    """Store a frame for reading pages of it: ``path/rows`` holds a file per key range, sorted, and ``path/fences`` a row per
    file with its lowest and highest key, its rows and the rows before it.

    The keys are unique; null keys come first.  Rows are shuffled once, by range, and no key is read by the driver but those Spark
    draws to place the ranges.  With N rows there are about N / range_rows fences.  They are written last, so a store
    that was not finished has no page.
    """
    spark = frame.sparkSession
    total = frame.count()
    ranges = max(1, -(-total // range_rows))
    frame.repartitionByRange(ranges, key).sortWithinPartitions(key).write.parquet(f"{path}/rows")
    stored = spark.read.schema(frame.schema).parquet(f"{path}/rows")
    fences = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("rows")
    )
    # files are numbered in the order of their ranges
    before = F.sum("rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fences.withColumn("before", before - F.col("rows")).coalesce(1).write.parquet(f"{path}/fences")


def stored_page(spark: SparkSession, path: str, key: str, number: int, rows: int = PAGE_ROWS) -> DataFrame:
    """Page ``number``, counted from 0, of what ``store_pages`` stored, in order.  Only the files whose ranges hold the
    page are read, and nothing is written; a page after the last is empty."""
    start = number * rows
    fences = spark.read.parquet(f"{path}/fences")
    holding = fences.where((F.col("before") < start + rows) & (F.col("before") + F.col("rows") > start))
    found = sorted(holding.select("before", "file").collect())
    if not found:
        return spark.read.parquet(f"{path}/rows").limit(0)
    files = [f"{path}/rows/{row['file']}" for row in found]
    return spark.read.parquet(*files).orderBy(key).offset(start - found[0]["before"]).limit(rows)


def page_after(frame: DataFrame, key: str, last=None, rows: int = PAGE_ROWS) -> DataFrame:
    """The page that follows a key: for walking through a result, the filter reaches the scan."""
    rest = frame if last is None else frame.where(F.col(key) > F.lit(last))
    return rest.orderBy(key).limit(rows)


def lookup_entity(namespace: Namespace, hashes, features=("local", "filename")) -> DataFrame:
    """Smallest value of the path features for given entities."""
    return select(namespace, resolve=list(features), collapse="min", hashes=hashes)
