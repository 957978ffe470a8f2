"""Databases as Parquet: open, save, export.

A database is a folder.  ``data`` holds one folder per written table and save, ``log`` one small folder
per version: one row per table, naming its files, buckets and features.  A file in ``commits``, named
after the version and created only if it does not exist, makes a version visible.  Opening reads the
log of the newest version.  Nothing that a version refers to is ever
overwritten, so a database can be saved while it is being read, and a save that dies before its
last step leaves the version before it in place.  A writer that dies while
it makes its version visible leaves an unfinished commit file, whose number the next writer passes over.  The second of
two writers is refused.  That needs a store that creates a file for one of two callers only, as local disks
and HDFS do; on others writers need a lock of their own.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.functions.text import Contexts, database_name_of
from hashloom.operators import paging, skew
from hashloom.plans.namespace import BASE, ENTITIES, Database, FeatureError, Namespace, Values
from hashloom.session import file_system

_WRITERS = 8
#: Commit files that are looked at first; older ones matter only if none of these is finished.
_RECENT = 8
#: So long a commit file may be unfinished before its writer is taken for dead.
WAIT_SECONDS = 10.0
_LOG_SCHEMA = (
    "version bigint, database string, context string, table string, position int, "
    "defaults string, hot string, files array<string>, buckets int, note string, ranges int"
)
#: Name of the folder column that numbers the ranges of an entity table.
_RANGE = "__range"


class StaleHandleError(FeatureError):
    """Another version was saved since the database was opened."""


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all commit files, finished or not."""
    system, place = file_system(spark, f"{path}/commits")
    if not system.exists(place):
        return []
    names = [entry.getPath().getName() for entry in system.listStatus(place)]
    return sorted(int(name) for name in names if name.isdigit())


def _finished(spark: SparkSession, path: str, numbers: list[int]) -> dict[int, str]:
    """The log folder of each version among the numbers.  A commit file without its whole line is not
    finished: its writer is at work, or died."""
    if not numbers:
        return {}
    rows = spark.read.text([f"{path}/commits/{number:010d}" for number in numbers], wholetext=True)
    rows = rows.select("value", F.col("_metadata.file_name").alias("name")).collect()
    whole = {int(r["name"]): r["value"] for r in rows if r["value"].startswith("log/") and r["value"].endswith("\n")}
    return {number: line.rstrip("\n") for number, line in whole.items()}


def _settled(spark: SparkSession, path: str, numbers: list[int]) -> bool:
    """Whether any of the commit files gets finished; one that isn't after WAIT_SECONDS belongs to a
    writer that died."""
    while numbers and not _finished(spark, path, numbers):
        system, _ = file_system(spark, path)
        places = [file_system(spark, f"{path}/commits/{number:010d}")[1] for number in numbers]
        age = time.time() - max(system.getFileStatus(place).getModificationTime() for place in places) / 1000
        if age >= WAIT_SECONDS:
            return False
        time.sleep(min(0.5, WAIT_SECONDS))
    return bool(numbers)


def _commit(spark: SparkSession, path: str, version: int, log: str, skipped: tuple[int, ...] = ()) -> None:
    """Make a version visible by creating the file named after it, which must not exist yet.

    ``skipped`` are the unfinished numbers since the version that this one follows.  Their writers are taken for dead;
    should one be late instead, either it finds this version when it has finished, or this writer
    finds its file finished before writing its own line.  One of the two is then refused.
    """
    system, place = file_system(spark, f"{path}/commits/{version:010d}")
    try:
        out = system.create(place, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        raise StaleHandleError(f"version {version} of {path} was saved by another writer") from error
    if _finished(spark, path, list(skipped)):
        out.close()
        raise StaleHandleError(f"another writer of {path} came in before version {version}")
    out.write(bytearray(f"{log}\n".encode()))
    out.close()
    later = [number for number in _numbers(spark, path) if number > version]
    if _settled(spark, path, later):
        raise StaleHandleError(f"version {version} of {path} came too late, {max(later)} was saved")


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The registry of all versions, or None before the first save."""
    folders = list(_finished(spark, path, _numbers(spark, path)).values())
    return spark.read.schema(_LOG_SCHEMA).parquet(*[f"{path}/{log}" for log in folders]) if folders else None


def _newest(spark: SparkSession, path: str) -> list:
    """The rows of the newest version: one per table of the database.  No other version's are read."""
    numbers = _numbers(spark, path)
    finished = _finished(spark, path, numbers[-_RECENT:]) or _finished(spark, path, numbers)
    if not finished:
        return []
    log = spark.read.schema(_LOG_SCHEMA).parquet(f"{path}/{finished[max(finished)]}")
    return log.orderBy("position").collect()


def _next_version(spark: SparkSession, path: str, newest: int) -> tuple[int, tuple[int, ...]]:
    """The first free number, and the unfinished ones between it and the newest version, settled."""
    used = [number for number in _numbers(spark, path) if number > newest]
    if _settled(spark, path, used):
        raise StaleHandleError(f"version {max(used)} of {path} was just saved by another writer")
    return max([newest, *used]) + 1, tuple(used)


def open_database(spark: SparkSession, path: str, contexts: Contexts | None = None) -> Database:
    """Open a saved database."""
    rows = _newest(spark, path)
    if not rows:
        raise FeatureError(f"no database at {path}")
    files, many, entities, defaults = {BASE: (path, rows[0].version)}, {}, None, {}
    for row in rows:
        frame = _read(spark, path, row)
        files[row.table] = (path, tuple(row.files))
        if row.table == ENTITIES:
            entities, defaults = frame, json.loads(row.defaults)
        else:
            many[row.table] = Values(frame, unique=True, hot=json.loads(row.hot))
    return Database(rows[0].database, rows[0].context, entities, many, defaults, files, {}, ())


def _read(spark: SparkSession, path: str, row) -> DataFrame:
    paths = [f"{path}/{part}" for part in row.files]
    if not row.buckets:
        return spark.read.parquet(*paths)
    return _bucketed_table(spark, paths[0], row.files[0], row.buckets)


def _bucketed_table(spark: SparkSession, path: str, part: str, buckets: int) -> DataFrame:
    """A bucketed folder as a table of the session's catalogue, so that joins on the hash know it."""
    name = "hashloom_" + part.replace("/", "_").replace("-", "_")
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet "
            f"CLUSTERED BY (hash) SORTED BY (hash) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)


def open_databases(spark: SparkSession, paths: list[str]) -> Namespace:
    """Open databases as one namespace; the order gives the precedence."""
    return Namespace([open_database(spark, path) for path in paths])


def create_views(namespace: Namespace) -> list[str]:
    """Temporary views ``database__table`` for Spark SQL."""
    names = []
    for database in namespace.databases.values():
        tables = {ENTITIES: database.entities} | {n: v.pairs() for n, v in database.many.items()}
        for table, frame in tables.items():
            names.append(f"{database.name}__{table}")
            frame.createOrReplaceTempView(names[-1])
    return names


def save_database(
    database: Database, path: str, buckets: int = 0, note: str = "", ranges: int | None = None
) -> Database:
    """Save a database as a new version and return it as read back.

    Unchanged tables are not written again, inserted pairs are written next to the stored ones.
    With ``buckets`` the tables are bucketed and sorted by hash, so that joins and aggregations on
    the hash need no shuffle; changed tables, and tables stored with another number of buckets, are
    then written as a whole.  Choose buckets only where no entity holds a large share of a table.

    With ``ranges`` the entity table is stored in that many ranges of the hash of its key, a folder each.
    A later save reads and writes only the ranges that hold changed, new or deleted entities and refers to
    the folders of all others again; it is written as a whole only if its columns or the number of ranges change.  None
    keeps the number of the stored version.  An entity is one row, so ranges are even; choose
    their number so that one holds some hundred megabytes.  Buckets and ranges exclude each other.

    A version is saved once: a database that was opened here before the newest version was saved is
    refused (StaleHandleError), and so is the second of two writers that save at the same time.
    """
    spark = database.entities.sparkSession
    rows = _newest(spark, path)
    newest = rows[0].version if rows else 0
    root, base = database.files.get(BASE, (None, 0))
    if root == path and base != newest:
        raise StaleHandleError(f"version {newest} of {path} was saved since version {base} was opened")
    version, skipped = _next_version(spark, path, newest)
    had_buckets = {tuple(row.files): row.buckets for row in rows}
    entity_row = next((row for row in rows if row.table == ENTITIES), None)
    had_ranges = (entity_row.ranges or 0) if entity_row else 0
    if ranges is None:
        ranges = 0 if buckets else had_ranges
    if buckets and ranges:
        raise FeatureError("an entity table is stored in buckets or in ranges, not in both")
    folder = f"data/v{version:08d}-{uuid.uuid4().hex[:12]}"
    tables = {ENTITIES: database.entities} | {name: source.pairs() for name, source in database.many.items()}

    def store(table: str) -> tuple[list[str], dict]:
        """Write what is new of a table; its files and hot keys."""
        if table == ENTITIES and (ranges or had_ranges):
            if root == path and ranges == had_ranges and database.edits is not None:
                return _write_touched(database, path, f"{folder}/{table}", ranges, list(entity_row.files)), {}
            if ranges:
                return _write_ranges(database.entities, path, f"{folder}/{table}", ranges), {}
            _write(database.entities, f"{path}/{folder}/{table}", f"{folder}/{table}", buckets)
            return [f"{folder}/{table}"], {}
        place, stored = database.files.get(table, (None, ()))
        stored = stored if place == path else ()
        fresh = database.added.get(table) if stored else None
        alike = had_buckets.get(tuple(stored)) == buckets
        if stored and alike and fresh is None:
            return list(stored), database.many[table].hot if table != ENTITIES else {}
        part = f"{folder}/{table}"
        if stored and alike and not buckets:
            fresh.write.parquet(f"{path}/{part}")
            stored = (*stored, part)
        else:
            _write(tables[table], f"{path}/{part}", part, buckets)
            stored = (part,)
        return list(stored), _hot(spark, path, stored) if table != ENTITIES else {}

    # tables are independent of each other: small ones fill the cluster together
    with ThreadPoolExecutor(_WRITERS) as pool:
        results = list(pool.map(store, tables))
    log = []
    for position, (table, (stored, hot)) in enumerate(zip(tables, results)):
        defaults = json.dumps(database.defaults if table == ENTITIES else {})
        row = (version, database.name, database.context, table, position, defaults, json.dumps(hot))
        log.append((*row, stored, buckets, note, ranges if table == ENTITIES else 0))
    place = f"log/v{version:08d}-{uuid.uuid4().hex[:12]}"
    spark.createDataFrame(log, _LOG_SCHEMA).coalesce(1).write.parquet(f"{path}/{place}")
    _commit(spark, path, version, place, skipped)
    return open_database(spark, path)


#: A part's summary has its keys with more than this share of the rows that make a key hot.
_SHARE = 64
_SIDES = ("hash", "value")


def _hot(spark: SparkSession, path: str, stored: tuple[str, ...]) -> dict:
    """Hashes and values with very many rows, recorded so that queries need not look for them.

    Each part has a summary beside it, the rows of its keys with more than HOT_ROWS / 64 of them, counted when the part is
    written; the summaries of all parts are added up, so an append reads no stored part.  With P parts a key is
    counted short by P / 64 of HOT_ROWS at most: that delays its salting, and loses no row.
    """
    missing = [part for part in stored if not _exists(spark, _summary(path, part))]
    for part in missing:
        counts = skew.key_counts(spark.read.parquet(f"{path}/{part}"), _SIDES, skew.HOT_ROWS // _SHARE)
        # counted by many tasks; what is left of that, few rows, goes to one file
        counts.repartition(1).write.mode("overwrite").parquet(_summary(path, part))
    return skew.merged_hot(spark.read.parquet(*[_summary(path, part) for part in stored]), _SIDES)


def _summary(path: str, part: str) -> str:
    return f"{path}/hot/{part}"


def _exists(spark: SparkSession, path: str) -> bool:
    system, place = file_system(spark, f"{path}/_SUCCESS")
    return system.exists(place)


def _write(frame: DataFrame, path: str, part: str, buckets: int) -> None:
    if not buckets:
        frame.write.parquet(path)
        return
    name = "hashloom_" + part.replace("/", "_").replace("-", "_")
    writer = frame.hint("rebalance", buckets, "hash").write.format("parquet")
    writer.bucketBy(buckets, "hash").sortBy("hash").option("path", path).saveAsTable(name)


def _range_of(ranges: int):
    """The range of a key: the place of its hash among all 64-bit numbers, from 0 to ranges - 1."""
    return F.shiftright(F.shiftrightunsigned(F.xxhash64("hash"), 33) * F.lit(ranges), 31).cast("int")


def _write_ranges(frame: DataFrame, path: str, part: str, ranges: int, kept: tuple[str, ...] = ()) -> list[str]:
    """Write entities in ranges; the folders of the ranges that have rows, after those that are kept."""
    rows = frame.withColumn(_RANGE, _range_of(ranges)).hint("rebalance", _RANGE)
    rows.write.partitionBy(_RANGE).parquet(f"{path}/{part}")
    system, place = file_system(frame.sparkSession, f"{path}/{part}")
    names = [entry.getPath().getName() for entry in system.listStatus(place) if entry.isDirectory()]
    parts = [*kept, *sorted(f"{part}/{name}" for name in names)]
    if not parts:
        # a table without rows still has columns
        frame.limit(0).write.parquet(f"{path}/{part}-none")
        parts = [f"{part}-none"]
    return parts


def _write_touched(database: Database, path: str, part: str, ranges: int, stored: list[str]) -> list[str]:
    """Write the ranges that the edits of an entity table touch, read from the stored folders of these ranges
    alone; the other folders stay.  Only numbers of ranges reach the driver."""
    if not database.edits:
        return stored
    spark, schema = database.entities.sparkSession, database.entities.schema
    hashes = [edit.hashes.select(F.col("hash").cast(schema["hash"].dataType)) for edit in database.edits]
    numbers = reduce(DataFrame.union, hashes).select(_range_of(ranges).alias("number")).distinct()
    touched = {row["number"] for row in numbers.collect()}
    if not touched:
        return stored
    number_of = {name: re.search(rf"{_RANGE}=(\d+)$", name) for name in stored}
    kept = [name for name, number in number_of.items() if number and int(number[1]) not in touched]
    old = [f"{path}/{name}" for name in stored if name not in set(kept)]
    rows = spark.read.schema(schema).parquet(*old) if old else spark.createDataFrame([], schema)
    rows = reduce(lambda frame, edit: edit.apply(frame), database.edits, rows)
    return _write_ranges(rows, path, part, ranges, tuple(kept))


def _pages(database: Database) -> str:
    path, version = database.files.get(BASE, (None, 0))
    if path is None or database.edits != ():
        raise FeatureError(f"database {database.name!r} is not as it was saved")
    return f"{path}/pages/v{version:08d}"


def store_entity_pages(database: Database, range_rows: int = paging.RANGE_ROWS) -> None:
    """Store the entities of a saved version in order of their hash, for ``entity_page``.  Another version has
    none of its pages until they are stored for it."""
    paging.store_pages(database.entities, "hash", _pages(database), range_rows)


def entity_page(database: Database, number: int, rows: int = paging.PAGE_ROWS) -> DataFrame:
    """A page of the entities of a saved version, defaults filled in; reads the key ranges that hold it."""
    spark, place = database.entities.sparkSession, _pages(database)
    if not _exists(spark, f"{place}/fences"):
        raise FeatureError(f"no pages are stored in {place}")
    rows_of_page = paging.stored_page(spark, place, "hash", number, rows)
    columns = [F.col("hash") if c == "hash" else database.single(c).alias(c) for c in database.entities.columns]
    return rows_of_page.select(*columns)


def export_database(database: Database, path: str) -> Database:
    """A whole copy of a database in another folder."""
    return save_database(database.with_parts(files={}, added={}), path)


def scan_feature_tables(
    spark: SparkSession,
    path: str,
    tables: list[str] | None = None,
    defaults: dict | None = None,
    contexts: Contexts | None = None,
) -> Database:
    """A database from plain Parquet folders ``<path>/<table>``: names with a leading underscore
    are skipped, ``features`` is the entity table, every other table a multi-valued feature.
    Without ``tables`` they are all folders found below the path."""
    contexts = contexts or Contexts()
    if tables is None:
        system, place = file_system(spark, path)
        found = [entry for entry in system.listStatus(place) if entry.isDirectory()]
        tables = sorted(entry.getPath().getName() for entry in found)
    frames = {t: spark.read.parquet(f"{path}/{t}") for t in tables if not t.startswith("_")}
    entities = frames.pop(ENTITIES, None)
    if entities is not None:
        # a column that only mirrors a multi-valued table is not a feature
        entities = entities.drop(*[t for t in frames if t in entities.columns])
    name = database_name_of(path, contexts)
    return Database.of(name, entities, frames, defaults, contexts=contexts)
