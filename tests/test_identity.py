"""Equivalence classes over several digests."""

import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from hashloom.operators import identity, skew

SCHEMA = "hash string, a string, b string"


def plain_classes(rows):
    """The smallest member of each entity's class, by joining sets."""
    label = {key: key for key, *_ in rows}
    changed = True
    while changed:
        changed = False
        for column in (1, 2):
            least = {}
            for row in rows:
                if row[column] is not None:
                    least[row[column]] = min(least.get(row[column], "~"), label[row[0]])
            for row in rows:
                if row[column] is not None and least[row[column]] < label[row[0]]:
                    label[row[0]], changed = least[row[column]], True
    sizes = {}
    for key in label:
        sizes[label[key]] = sizes.get(label[key], 0) + 1
    return sorted((key, to, sizes[to]) for key, to in label.items())


def test_chain_and_a_digest_of_a_third(spark, frame):
    """A chain of 1,000 entities whose links alternate between the digests, and 500 entities of one digest."""
    order = [f"c{k:04d}" for k in range(1000)]
    random.Random(1).shuffle(order)
    rows = [(key, f"a{k // 2}", f"b{(k + 1) // 2}") for k, key in enumerate(order)]
    rows += [(f"h{k:04d}", "hot", None) for k in range(500)] + [("h0000", None, "b0")]
    found = rows_of(identity.connected_classes(frame(rows, SCHEMA), ["a", "b"]))
    assert found == sorted([(key, "c0000", 1500) for key in order] + [(f"h{k:04d}", "c0000", 1500) for k in range(500)])


@pytest.mark.parametrize("seed", range(3))
def test_random_classes_equal_joined_sets(frame, monkeypatch, seed):
    monkeypatch.setattr(skew, "HOT_ROWS", 3)  # hot digests and vertices are spread over salts
    rng = random.Random(seed)
    rows = [(f"{rng.randrange(300):03d}", *(rng.choice([None, f"d{rng.randrange(150)}"]) for _ in range(2))) for _ in range(300)]
    got = rows_of(identity.connected_classes(frame(rows, SCHEMA), ["a", "b"]))
    # several rows of an entity join the digests of all of them
    assert got == plain_classes(rows)


def test_nulls_single_rows_and_empty_tables(spark, frame):
    rows = [("x", None, None), ("y", "1", None), ("z", None, "1"), (None, "1", "1")]
    found = rows_of(identity.connected_classes(frame(rows, SCHEMA), ["a", "b"]))
    assert found == [("x", "x", 1), ("y", "y", 1), ("z", "z", 1)]
    assert rows_of(identity.connected_classes(frame([], SCHEMA), ["a", "b"])) == []


def test_rounds_leave_one_table(spark, frame, monkeypatch, tmp_path):
    monkeypatch.setattr(identity, "working_folder", lambda *_: str(tmp_path / "rounds"))
    links = spark.range(1, 200).select(F.col("id").alias("above"), (F.col("id") - 1).alias("below"))
    found = identity.component_labels(links)
    assert found.select("vertex").distinct().count() == 200 and found.where("label <> 0").isEmpty()
    assert len(list((tmp_path / "rounds").iterdir())) == 1
