"""Salted joins give the rows of plain joins and divide the rows of a hot key."""

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from hashloom.operators import skew


@pytest.fixture
def sides(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    rows = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).cast("bigint").alias("k"), F.col("id").alias("v")
    )
    rows = rows.union(spark.createDataFrame([(None, -1)], "k bigint, v bigint"))
    single = spark.range(5, 60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    return rows, single


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti", "right", "full"])
def test_same_rows_as_a_plain_join(sides, how):
    rows, single = sides
    single = single.where("k % 9 <> 1")
    columns = ["k", "v"] + ([] if how in ("left_semi", "left_anti") else ["w"])
    plain = rows.join(single, "k", how).select(columns)
    spread = skew.spread_join(rows, single, "k", how, skew.hot_keys(rows, "k")).select(columns)
    assert rows_of(spread) == rows_of(plain)


def test_hot_rows_are_divided(sides):
    rows, single = sides
    hot = skew.hot_keys(rows, "k")
    (key, salts), *_ = sorted(hot.collect(), key=lambda row: -row[1])
    assert key == 7 and salts == 11
    salted = rows.join(hot, "k", "left").where("k = 7")
    salt = F.pmod(F.xxhash64("v"), F.col("__salts"))
    sizes = [row["count"] for row in salted.groupBy(salt.alias("s")).count().collect()]
    assert len(sizes) == salts and max(sizes) < 30


def test_every_hot_key_is_salted(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 1)
    rows = spark.range(4_000).select((F.col("id") % 2_000).alias("k"), F.col("id").alias("v"))
    hot = skew.hot_keys(rows, "k")
    assert hot.count() == 2_000 and hot.where("__salts = 2").count() == 2_000
    single = spark.range(2_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    joined = skew.spread_join(rows, single, "k", "inner", hot).select("k", "v", "w")
    assert rows_of(joined) == rows_of(rows.join(single, "k").select("k", "v", "w"))


@pytest.mark.parametrize("how", ["inner", "right"])
@pytest.mark.parametrize("hot_rows", [5, 1_000])
def test_hot_keys_of_both_sides_make_a_grid(spark, monkeypatch, how, hot_rows):
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    rows = spark.range(200).select(F.when(F.col("id") < 60, 1).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("v"))
    others = spark.range(150).select(F.when(F.col("id") < 50, 1).otherwise(F.col("id") % 70).alias("k"), F.col("id").alias("w"))
    others = others.union(spark.createDataFrame([(None, -1), (900, -2), (900, -3)], "k long, w long")).union(
        spark.range(20).select(F.lit(901), F.col("id"))  # hot there, without rows here
    )
    hot, others_hot = skew.hot_keys(rows, "k"), skew.hot_keys(others, "k")
    found = skew.grid_join(rows, others, "k", how, hot, others_hot).select("k", "v", "w")
    assert rows_of(found) == rows_of(rows.join(others, "k", how).select("k", "v", "w"))


def test_no_task_of_a_grid_holds_more_than_twice_the_mean(spark, monkeypatch):
    """One key has all of 4,000 rows on either side: each cell of the grid makes about as many pairs."""
    monkeypatch.setattr(skew, "HOT_ROWS", 1_000)
    rows = spark.range(4_000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    others = spark.range(4_000).select(F.lit(1).alias("k"), F.col("id").alias("w"))
    joined = skew._grid(rows, others, "k", "inner", skew.hot_keys(rows, "k"), skew.hot_keys(others, "k"))
    cells = [r["count"] for r in joined.groupBy("__first", "__second").count().collect()]
    assert sum(cells) == 16_000_000 and len(cells) == 16 and max(cells) < 2 * sum(cells) / len(cells)
