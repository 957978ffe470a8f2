"""Profiles of features and of the whole catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.functions.numbers import is_number
from hashloom.operators.collapse import concat_sorted
from hashloom.plans.namespace import UNSET, Database, Feature, Namespace
from hashloom.plans.query import select


def _feature_rows(namespace: Namespace, address: str) -> DataFrame:
    """The feature resolved without collapse, its column named ``value``."""
    rows = select(namespace, resolve=[address], collapse=None)
    return rows.withColumnRenamed(rows.columns[1], "value")


def feature_profile(namespace: Namespace, address: str, joined_strings: bool = False) -> DataFrame:
    """One row: rows of the feature, default, smallest and largest value, number of distinct
    values that are not numbers.  ``joined_strings`` adds those values, sorted, as one text; for
    features with many of them ``feature_strings`` keeps them as rows."""
    feature = namespace.find(address)
    default = F.lit(None if feature.default is None else str(feature.default)).cast("string")
    rows = _feature_rows(namespace, address)
    rows = rows.withColumn("text", F.when(~is_number(F.col("value").cast("string")), F.col("value").cast("string")))
    rows = rows.withColumn("text", F.when(F.col("text") != "", F.col("text")))
    stats = [
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.count_distinct("text").alias("n_strings"),
    ]
    if joined_strings:
        stats.append(F.coalesce(concat_sorted("text", " "), F.lit("")).alias("strings"))
    return rows.agg(*stats).select(
        F.lit(feature.name).alias("feature"), default.alias("default"), *[F.col(s) for s in _names(joined_strings)]
    )


def _names(joined_strings: bool) -> list[str]:
    return ["n", "lo", "hi", "n_strings"] + (["strings"] if joined_strings else [])


def feature_strings(namespace: Namespace, address: str) -> DataFrame:
    """The distinct values that are not numbers, in order."""
    text = F.col("value").cast("string")
    rows = _feature_rows(namespace, address).where(text.isNotNull() & (text != "") & ~is_number(text))
    return rows.select(text.alias("value")).distinct().orderBy("value")


def catalogue_profile(namespace: Namespace, exact: bool = True) -> DataFrame:
    """One row per feature of every database: where it lives, how many entities have a value, how
    many distinct values there are and the share of entities without one.

    Distinct values are exact; without ``exact`` they are estimated (about 2 percent) and every table
    is read once.
    """
    totals, parts = [], []
    for database in namespace.databases.values():
        total = F.count(F.lit(1)).alias("entities")
        totals.append(database.entities.agg(total).withColumn("database", F.lit(database.name)))
        parts.extend(_database_profile(database, exact))
    features = reduce(DataFrame.unionByName, parts)
    profile = features.join(reduce(DataFrame.unionByName, totals), "database")
    unset = F.when(F.col("entities") > 0, 1 - F.col("n_set") / F.col("entities"))
    return profile.select(*features.columns, unset.alias("unset_share"))


def _database_profile(database: Database, exact: bool) -> list[DataFrame]:
    """The measures of a database, one frame per table that is read."""
    parts = []
    single = {f: database.single(f.name) for f in database.features.values() if not f.many and not f.is_hash}
    if single:
        parts.append(_measured(database, database.entities, single, exact))
    by_frame: dict[int, dict[Feature, Column]] = {}
    for name, source in database.many.items():
        by_frame.setdefault(id(source.frame), {})[database.features[name]] = F.col(source.column)
    for columns in by_frame.values():
        frame = database.many[next(iter(columns)).name].frame
        parts.append(_measured(database, frame, columns, exact))
    return parts


def _measured(database: Database, frame: DataFrame, columns: dict[Feature, Column], exact: bool) -> DataFrame:
    """Entities with a value and distinct values of some features of one table, a row each."""
    many = next(iter(columns)).many
    values = {f: F.when(c != UNSET, c) if f.is_text else c for f, c in columns.items()}
    having = {f: v.isNotNull() for f, v in values.items()}
    owners = frame
    if many:
        # one row per entity first: the entities of all features are counted with one shuffle
        owners = frame.groupBy("hash").agg(*[F.bool_or(h).alias(f.name) for f, h in having.items()])
        having = {f: F.col(f.name) for f in columns}
    counted = _listed(owners.agg(*[F.count_if(h).alias(f.name) for f, h in having.items()]), columns, "n_set")
    if exact:
        # a scan of one column each, instead of one pass that repeats every row per feature
        sizes = reduce(DataFrame.unionByName, [_distinct(frame, f, v) for f, v in values.items()])
    else:
        estimates = frame.agg(*[F.approx_count_distinct(v).alias(f.name) for f, v in values.items()])
        sizes = _listed(estimates, columns, "n_distinct")
    measured = counted.join(sizes, "feature")
    described = F.create_map(*[part for f in columns for part in (F.lit(f.name), _description(f))])
    return measured.select(
        F.lit(database.name).alias("database"),
        F.lit(database.context).alias("context"),
        "feature",
        described[F.col("feature")].alias("d"),
        "n_set",
        "n_distinct",
    ).select("database", "context", "feature", "d.*", "n_set", "n_distinct")


def _description(feature: Feature) -> Column:
    return F.struct(
        F.lit(feature.name if feature.many else "features").alias("table"),
        F.lit("1:n" if feature.many else "1:1").alias("cardinality"),
        F.lit(None if feature.default is None else str(feature.default)).cast("string").alias("default"),
    )


def _distinct(frame: DataFrame, feature: Feature, value: Column) -> DataFrame:
    values = frame.select(value.alias("value")).where(F.col("value").isNotNull()).distinct()
    return values.agg(F.count(F.lit(1)).alias("n_distinct")).select(F.lit(feature.name).alias("feature"), "n_distinct")


def _listed(measures: DataFrame, columns: dict[Feature, Column], name: str) -> DataFrame:
    """The one row of measures as a row per feature."""
    rows = [F.struct(F.lit(f.name).alias("feature"), F.col(f.name).cast("bigint").alias(name)) for f in columns]
    return measures.select(F.explode(F.array(*rows)).alias("row")).select("row.*")
