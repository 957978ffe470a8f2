"""Equivalence classes: entities with equal digests, by one digest or by several."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.operators.skew import hottest, spread_join
from hashloom.session import discard, working_folder


def equivalence_classes(frame: DataFrame, digest: str = "digest", key: str = "hash") -> DataFrame:
    """One row per class: size and smallest member.  Members are not collected, so a class may
    hold any share of the entities."""
    return frame.groupBy(digest).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("representative"))


def class_members(frame: DataFrame, digest: str = "digest", key: str = "hash") -> DataFrame:
    """One row per entity: its class and the representative of it.  The rows of huge classes, known
    from the class sizes, are spread over tasks.  The frame is read more than once, so the digest
    should be a stored column, not one computed from contents on the way."""
    classes = equivalence_classes(frame, digest, key)
    return spread_join(frame.select(key, digest), classes, digest, "inner", hottest(classes, digest, "n"))


def connected_classes(frame: DataFrame, digests: list[str], key: str = "hash") -> DataFrame:
    """One row per entity: the class it falls into when equal values of any of the digests join two entities,
    through others too; ``representative`` is the smallest member, ``n`` the number of members.

    An entity without a digest (null) is joined by its other digests; rows without key are left out, and an entity
    with several rows has the digests of all of them.  Every digest links its members to the smallest
    one only, so a value shared by a third of all entities costs a link per entity, and the rows of large
    groups are spread over tasks.  The frame is read once per digest.
    """
    known = frame.where(F.col(key).isNotNull())
    links = reduce(DataFrame.unionByName, [_links(known.select(key, digest), digest, key) for digest in digests])
    members = known.select(key).distinct()
    joined = members.join(component_labels(links), F.col(key) == F.col("vertex"), "left")
    labelled = joined.select(key, F.coalesce("label", key).alias("representative"))
    sizes = labelled.groupBy("representative").agg(F.count(F.lit(1)).alias("n"))
    joined = spread_join(labelled, sizes, "representative", "inner", hottest(sizes, "representative", "n"))
    return joined.select(key, "representative", "n")


def _links(rows: DataFrame, digest: str, key: str) -> DataFrame:
    """(above, below): every member of a class but the smallest with the smallest one."""
    rows = rows.where(F.col(digest).isNotNull())
    classes = equivalence_classes(rows, digest, key).where(F.col("n") > 1)
    joined = spread_join(rows, classes, digest, "inner", hottest(classes, digest, "n"))
    return joined.where(F.col(key) != F.col("representative")).select(
        F.col(key).alias("above"), F.col("representative").alias("below")
    )


def component_labels(links: DataFrame) -> DataFrame:
    """(vertex, label): the smallest vertex that the links (above, below), above > below, reach, for all their ends.

    Each round every vertex tells its larger neighbours of the smallest one it knows (large star), then its smaller ones
    (small star); links shrink towards stars, and stay as they are when all components are stars.  A
    chain of n links takes about log n rounds.  A round is one written table, so a lost executor costs no
    more than it, and the table before is removed.  Vertices with very many links are spread over tasks.
    """
    spark, folder, number = links.sparkSession, working_folder(links.sparkSession, "components"), 0
    # the first table is read twice at most, and holds a distinct link once
    current, before = _round(links.select("above", "below").distinct(), f"{folder}/0"), None
    state = _state(current)
    while state != before and state[0]:
        number += 1
        current, before = _round(_small_star(_large_star(current)), f"{folder}/{number}"), state
        discard(spark, f"{folder}/{number - 1}")
        state = _state(current)
    ends = current.select(F.col("above").alias("vertex"), F.col("below").alias("label"))
    return ends.unionByName(ends.select(F.col("label").alias("vertex"), "label").distinct())


def _round(links: DataFrame, path: str) -> DataFrame:
    links.write.parquet(path)
    return links.sparkSession.read.schema(links.schema).parquet(path)


def _state(links: DataFrame) -> tuple:
    """Equal for equal tables of distinct links, in whatever order."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("above", "below").cast("decimal(38,0)"))).first())


def _pointed(rows: DataFrame, least: DataFrame) -> DataFrame:
    """Rows (vertex, other) with the ``least`` of their vertex, hot vertices spread."""
    return spread_join(rows, least.drop("degree"), "vertex", "inner", hottest(least, "vertex", "degree"))


def _least(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vertex").agg(F.min("other").alias("least"), F.count(F.lit(1)).alias("degree"))


def _large_star(links: DataFrame) -> DataFrame:
    """Links of each vertex's larger neighbours to the smallest of it and its neighbours."""
    both = links.select(F.col("above").alias("vertex"), F.col("below").alias("other")).unionByName(
        links.select(F.col("below").alias("vertex"), F.col("above").alias("other"))
    )
    least = _least(both).withColumn("least", F.least("vertex", "least"))
    larger = _pointed(both.where("other > vertex"), least)
    return larger.select(F.col("other").alias("above"), F.col("least").alias("below")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links of each vertex and its smaller neighbours to the smallest of these."""
    rows = links.select(F.col("above").alias("vertex"), F.col("below").alias("other"))
    least = _least(rows)
    moved = _pointed(rows, least).where("other <> least")
    kept = least.select(F.col("vertex").alias("above"), F.col("least").alias("below"))
    return moved.select(F.col("other").alias("above"), F.col("least").alias("below")).unionByName(kept).distinct()
