"""Profiles of saved databases from sketches that are kept per written part.

A part of a table never changes, so neither do its sketches: HyperLogLog of the values and of the hashes that have
one, KLL quantiles of numbers, and the number of values.  Those of all parts of a version are merged.  After
an append only the new part is read, and parts that a version no longer refers to are left out.  Counts of values are
exact; distinct values and entities are estimated with a standard error of about 1.04 / sqrt(2^BITS), quantiles
by ranks with an error of about 1.3 percent.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashloom.plans.namespace import BASE, ENTITIES, UNSET, Database, FeatureError
from hashloom.session import file_system

#: Logarithm of the registers of a HyperLogLog sketch.
BITS = 14
QUANTILES = (0.25, 0.5, 0.75)

_COUNTABLE = (T.StringType, T.BinaryType, T.IntegerType, T.LongType)
_PART = r".*/(data/v[0-9]+-[0-9a-f]{12}/.+)/[^/]+$"
_SUMMARY = "part string, column string, n bigint, distinct binary, owners binary, numbers binary"


def _hashable(column: Column, data_type: T.DataType) -> Column:
    return column if isinstance(data_type, _COUNTABLE) else column.cast("string")


def _sketched(rows: DataFrame, name: str, value: Column, data_type: T.DataType, owner: Column) -> DataFrame:
    """One row per part: the number of values and the sketches of one column."""
    shown = F.when(value != UNSET, value) if isinstance(data_type, T.StringType) else value
    rows = rows.select("part", shown.alias("shown"), owner.alias("owner")).where(F.col("shown").isNotNull())
    number = F.col("shown").cast("double") if isinstance(data_type, T.NumericType) else None
    return rows.groupBy("part").agg(
        F.lit(name).alias("column"),
        F.count(F.lit(1)).alias("n"),
        F.hll_sketch_agg(_hashable(F.col("shown"), data_type), BITS).alias("distinct"),
        F.hll_sketch_agg("owner", BITS).alias("owners"),
        (F.lit(None).cast("binary") if number is None else F.kll_sketch_agg_double(number)).alias("numbers"),
    )


def summarise(database: Database, table: str, parts: list[str]) -> DataFrame:
    """The sketches of some stored parts of a table, a row per part and column that has values in it."""
    path = database.files[BASE][0]
    frame = database.entities if table == ENTITIES else database.many[table].frame
    spark = frame.sparkSession
    rows = spark.read.schema(frame.schema).parquet(*[f"{path}/{part}" for part in parts])
    rows = rows.withColumn("part", F.regexp_extract(F.col("_metadata.file_path"), _PART, 1))
    owner = _hashable(F.col("hash"), frame.schema["hash"].dataType)
    if table == ENTITIES:
        names = [name for name in frame.columns if name != "hash"]
        columns = {name: (database.single(name), frame.schema[name].dataType) for name in names}
    else:
        columns = {"value": (F.col("value"), frame.schema["value"].dataType)}
    if not columns:
        return spark.createDataFrame([], _SUMMARY)
    return reduce(DataFrame.union, [_sketched(rows, n, value, kind, owner) for n, (value, kind) in columns.items()])


def _kept(spark: SparkSession, place: str) -> DataFrame:
    """All sketches kept of a table; a part that two sessions sketched at once counts once."""
    system, folder = file_system(spark, place)
    if not system.exists(folder):
        return spark.createDataFrame([], _SUMMARY)
    return spark.read.schema(_SUMMARY).parquet(f"{place}/*").dropDuplicates(["part", "column"])


def _merged(database: Database, table: str) -> DataFrame:
    """The merged sketches of the parts of one table, those not kept yet made and kept first."""
    spark, (path, _) = database.entities.sparkSession, database.files[BASE]
    parts = list(database.files[table][1])
    # the marker row of a part without values says that it was read
    place = f"{path}/sketches/{table}"
    known = {row["part"] for row in _kept(spark, place).select("part").distinct().collect()}
    missing = [part for part in parts if part not in known]
    if missing:
        marks = spark.createDataFrame([(part, "", 0, None, None, None) for part in missing], _SUMMARY)
        summaries = summarise(database, table, missing).union(marks)
        summaries.repartition(1).write.parquet(f"{place}/{uuid.uuid4().hex}")
    mine = spark.createDataFrame([(part,) for part in parts], "part string")
    rows = _kept(spark, place).where("column <> ''").join(F.broadcast(mine), "part", "left_semi")
    merged = rows.groupBy("column").agg(
        F.sum("n").alias("n_values"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"),
        F.hll_sketch_estimate(F.hll_union_agg("owners")).alias("n_owners"),
        F.kll_merge_agg_double("numbers").alias("numbers"),
    )
    name = F.col("column") if table == ENTITIES else F.lit(table)
    # an entity has one row, so its values are its owners
    owners = F.col("n_values") if table == ENTITIES else F.col("n_owners")
    has_numbers = F.col("numbers").isNotNull() & (F.kll_sketch_get_n_double("numbers") > 0)
    quantiles = F.array(*[F.kll_sketch_get_quantile_double("numbers", F.lit(q)) for q in QUANTILES])
    return merged.select(
        F.lit(database.name).alias("database"),
        name.alias("feature"),
        F.lit("1:1" if table == ENTITIES else "1:n").alias("cardinality"),
        "n_values",
        "n_distinct",
        owners.alias("n_set"),
        F.when(has_numbers, quantiles).alias("quantiles"),
    )


def sketch_profile(database: Database) -> DataFrame:
    """One row per feature of a saved database that has a value: number of values, distinct values and entities with
    one, quartiles of numbers.  Only parts that have no sketches yet are read.  Bucketed tables work as any others."""
    tables = [ENTITIES, *database.many]
    if BASE not in database.files or any(t not in database.files or t in database.added for t in tables):
        raise FeatureError(f"database {database.name!r} is not as it was saved")
    return reduce(DataFrame.union, [_merged(database, table) for table in tables])
