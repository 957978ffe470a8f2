"""Joins of rows that may pile up on a few keys with a side that holds a key once.

The adaptive skew join of Spark splits only the preserved side of an outer join, and only where a
join reads both sides straight from a shuffle.  Here the heavy keys are found beforehand, and
their rows are spread over several tasks by a salt:

* every key with more than ``HOT_ROWS`` rows counts as hot; N rows have fewer than N / HOT_ROWS such
  keys, which bounds the table of hot keys that is broadcast, and no key is left out;
* the salt is a hash of the row, so a task that is run again spreads its rows the same way;
* the other side is repeated once per salt, for hot keys only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000

_SALTS = "__salts"
_SALT = "__salt"


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The hot keys of a frame with the number of salts each needs: one narrow aggregation."""
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__rows"))
    return hottest(counted, key, "__rows")


def hottest(counted: DataFrame, key: str, count: str) -> DataFrame:
    """The same from counts that are known already."""
    hot = counted.where(F.col(count) > HOT_ROWS)
    return hot.select(key, _salts(F.col(count)).alias(_SALTS))


def listed_keys(rows: DataFrame, key: str, counts: list) -> DataFrame | None:
    """The hot keys from recorded (key, rows); None without any."""
    hot = [(value, -(-count // HOT_ROWS)) for value, count in counts if count > HOT_ROWS]
    if not hot:
        return None
    listed = rows.sparkSession.createDataFrame(hot, f"`{key}` string, {_SALTS} int")
    return listed.withColumn(key, F.col(key).cast(rows.schema[key].dataType))


def _salts(count: Column) -> Column:
    return F.ceil(count / F.lit(HOT_ROWS)).cast("int")


def key_counts(rows: DataFrame, keys: tuple[str, ...], least: int) -> DataFrame:
    """(column, key, rows) of the keys of several columns with more than ``least`` rows, keys as text."""
    parts = []
    for key in keys:
        known = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
        many = known.where(F.col("rows") > least)
        parts.append(many.select(F.lit(key).alias("column"), F.col(key).cast("string").alias("key"), "rows"))
    return reduce(DataFrame.union, parts)


def merged_hot(counts: DataFrame, keys: tuple[str, ...]) -> dict[str, list]:
    """The hot keys of several columns from the counts (column, key, rows) of parts."""
    found: dict[str, list] = {key: [] for key in keys}
    totals = counts.groupBy("column", "key").agg(F.sum("rows").alias("rows")).where(F.col("rows") > HOT_ROWS)
    for row in totals.collect():
        found[row["column"]].append((row["key"], row["rows"]))
    return found


def spread_join(rows: DataFrame, single: DataFrame, key: str, how: str, hot: DataFrame | None) -> DataFrame:
    """Join rows with a side that holds every key at most once.

    ``how`` is inner, left, left_semi or left_anti, seen from the rows, or right: every row of the
    single side is kept, or full: every row of both.  For right, the hot keys must come from the very rows that are joined.
    Without hot keys (None) this is an ordinary join.
    """
    if hot is None:
        return rows.join(single, key, how)
    if how == "full":
        # what the rows meet, and what no row has met: keys are pre-aggregated before that is asked
        alone = single.join(rows.select(key).distinct(), key, "left_anti")
        met = spread_join(rows, single, key, "left", hot)
        return met.unionByName(alone, allowMissingColumns=True)
    keys = F.broadcast(hot)
    others = [c for c in rows.columns if c != key]
    salt = F.pmod(F.xxhash64(*(others or [key])), F.col(_SALTS)).cast("int")
    salted = rows.join(keys, key, "left").withColumn(_SALT, F.coalesce(salt, F.lit(0))).drop(_SALTS)
    repeats = F.sequence(F.lit(0), F.coalesce(F.col(_SALTS), F.lit(1)) - 1)
    repeated = single.join(keys, key, "left").withColumn(_SALT, F.explode(repeats))
    if how != "right":
        return salted.join(repeated.drop(_SALTS), [key, _SALT], how).drop(_SALT)
    # a hot key has rows, so a repetition that meets none of them is no unmatched row
    marked = salted.withColumn("__matched", F.lit(True))
    joined = repeated.join(marked, [key, _SALT], "left")
    real = F.col(_SALTS).isNull() | F.col("__matched").isNotNull()
    return joined.where(real).drop(_SALT, _SALTS, "__matched")


def grid_join(rows: DataFrame, others: DataFrame, key: str, how: str, hot: DataFrame | None, others_hot: DataFrame) -> DataFrame:
    """Join rows with a side that may hold a key many times as well, ``how`` being inner or right (all others are kept).

    A hot key of both sides makes a grid: its rows are cut into blocks by a hash of the row, as many as its salts, so
    are the others, and every block of rows meets every block of others in a task of its own.  A task then has at most
    about HOT_ROWS of either side, whatever share of them the key has.  For right, the hot keys must come from the very sides
    that are joined.
    """
    joined = _grid(rows, others, key, how, hot, others_hot)
    # a key with rows leaves no other unmatched, though a block of its rows may be empty
    real = (F.col("__rows") <= 1) | F.col("__rows").isNull() | F.col("__matched").isNotNull()
    return joined.where(real).drop("__first", "__second", "__rows", "__others", "__matched")


def _grid(rows, others, key, how, hot, others_hot) -> DataFrame:
    """The joined rows with the cell of the grid they come from."""
    first, second = "__first", "__second"
    hot = rows.select(key).limit(0).withColumn(_SALTS, F.lit(1)) if hot is None else hot
    keys = hot.withColumnRenamed(_SALTS, "__rows")
    grid = keys.join(others_hot.withColumnRenamed(_SALTS, "__others"), key, "full")
    grid = F.broadcast(grid.select(key, *(F.coalesce(c, F.lit(1)).alias(c) for c in ("__rows", "__others"))))

    def block(frame: DataFrame, salts: str) -> Column:
        own = [c for c in frame.columns if c != key]
        return F.coalesce(F.pmod(F.xxhash64(*(own or [key])), F.col(salts)).cast("int"), F.lit(0))

    def every(salts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(salts), F.lit(1)) - 1))

    cut = rows.join(grid, key, "left").withColumn(first, block(rows, "__rows")).withColumn(second, every("__others"))
    met = others.join(grid, key, "left").withColumn(second, block(others, "__others")).withColumn(first, every("__rows"))
    cut = cut.drop("__rows", "__others").withColumn("__matched", F.lit(True))
    return met.join(cut, [key, first, second], "inner" if how == "inner" else "left")
