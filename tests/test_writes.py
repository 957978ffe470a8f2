"""Writes on small databases, single-valued and multi-valued."""

import pytest
from conftest import hashes_of, rows_of

from hashloom import Database, Namespace, feature, select
from hashloom.operators import writes
from hashloom.plans.namespace import FeatureError


def known(database, where):
    return hashes_of(select(Namespace([database]), where, collapse=None))


@pytest.fixture
def many(frame):
    pairs = frame([(h, v) for h in "abc" for v in ("value1", "value2")])
    return Database.of("test", None, {"tag": pairs})


@pytest.fixture
def single(frame):
    return Database.of("test", frame([(h, "value1") for h in "abc"], "hash string, f string"), defaults={"f": "empty"})


def test_many_remove_pair(many):
    left = writes.reset_values(many, "tag", ["value1"], ["a"])
    assert known(left, feature("tag") == "value1") == ["b", "c"]
    assert known(left, feature("tag") == "value2") == ["a", "b", "c"]


def test_many_remove_hash(many):
    left = writes.reset_values(many, "tag", [], ["a"])
    assert known(left, feature("tag") == "value1") == ["b", "c"]
    assert known(left, feature("tag") == "None") == ["a"]
    assert known(left, feature("tag").is_unset()) == ["a"]


def test_many_remove_value(many, frame):
    for values in (["value1"], frame([("value1",)], "value string")):
        left = writes.reset_values(many, "tag", values)
        assert known(left, feature("tag") == "value1") == []
        assert known(left, feature("tag") == "value2") == ["a", "b", "c"]


def test_many_no_such_value(many):
    left = writes.reset_values(many, "tag", ["value1"], ["b", "c"])
    assert known(left, feature("tag") != "value1") == ["b", "c"]


def test_many_rename_and_delete(many):
    renamed = writes.rename_feature(many, "tag", "label")
    assert known(renamed, feature("label") == "value1") == ["a", "b", "c"]
    with pytest.raises(FeatureError):
        known(renamed, feature("tag") == "value1")
    with pytest.raises(FeatureError):
        known(writes.delete_feature(many, "tag"), feature("tag") == "value1")


def test_single_overwrite(single, frame):
    changed = writes.set_values(single, "f", frame([("a", "value2"), ("z", "value3")]))
    assert known(changed, feature("f") == "value1") == ["b", "c"]
    assert known(changed, feature("f") == "value2") == ["a"]
    assert known(changed, feature("f") == "value3") == ["z"]
    again = writes.set_values(changed, "f", frame([("a", "value2"), ("z", "value3")]))
    assert rows_of(again.entities) == rows_of(changed.entities)


@pytest.mark.parametrize(
    "values, hashes, kept", [(["value1"], ["a"], ["b", "c"]), ([], ["a"], ["b", "c"]), (["value1"], [], [])]
)
def test_single_reset(single, values, hashes, kept):
    left = writes.reset_values(single, "f", values, hashes)
    assert known(left, feature("f") == "value1") == kept
    assert known(left, feature("f") == "empty") == sorted(set("abc") - set(kept))


def test_reset_needs_a_restriction(single, many):
    assert writes.reset_values(single, "f") is single
    assert writes.reset_values(many, "tag", [], []) is many


def test_single_rename_and_delete(single):
    renamed = writes.rename_feature(single, "f", "g")
    assert known(renamed, feature("g") == "value1") == ["a", "b", "c"]
    assert renamed.defaults == {"g": "empty"}
    gone = writes.delete_feature(single, "f")
    assert gone.entities.columns == ["hash"]


def test_names(single):
    for name in ("hash", "value", "features", "1a", "a-b", "f"):
        with pytest.raises(FeatureError):
            writes.add_feature(single, name, "x")
    assert writes.add_feature(single, "f", "x", permissive=True) is single
    with pytest.raises(FeatureError):
        writes.rename_feature(single, "f", "value")
    with pytest.raises(FeatureError):
        writes.delete_feature(single, "nothing")


def test_shadowed_features(spark, frame):
    """A feature of the second database is written and read only through its database."""
    hundred = [str(i) for i in range(100)]
    first = writes.add_feature(writes.add_feature(Database.empty(spark, "first"), "A"), "B", "empty")
    second = writes.add_feature(Database.empty(spark, "second"), "A", "empty")
    first = writes.set_values(first, "A", frame([(h, "value1") for h in hundred]))
    both = Namespace([first, second])
    found = rows_of(select(both, feature("A") == "value1", ["A", "B"]))
    assert found == sorted((h, "value1", "empty") for h in hundred)
    first = writes.set_values(first, "A", frame([(h, "value2") for h in hundred[:50]]))
    second = writes.set_values(second, "A", frame([(h, "value3") for h in hundred[:50]]))
    both = Namespace([first, second])
    where = (feature("A") == "value1") | (feature("A") == "value2")
    values = [value for _, value in rows_of(select(both, where, ["A"], collapse=None))]
    assert (values.count("value1"), values.count("value2"), len(values)) == (100, 50, 150)
    assert len(known(second, feature("A") == "value3")) == 50


def test_batch_takes_the_last_value(spark, frame):
    database = writes.add_feature(writes.add_feature(Database.empty(spark, "jobs"), "one", "none"), "many")
    triples = frame(
        [("a", "one", "x", 1), ("a", "one", "y", 2), ("a", "many", "x", 1), ("a", "many", "y", 2), ("b", "many", "x", 1)],
        "hash string, feature string, value string, at int",
    )
    written = writes.set_values_batch(database, triples, ["one", "many"], ["at"])
    for _ in range(2):
        assert rows_of(written.entities) == [("a", "y"), ("b", "none")]
        assert rows_of(written.many["many"].pairs()) == [("a", "x"), ("a", "y"), ("b", "x")]
        written = writes.set_values_batch(written, triples, ["one", "many"], ["at"])


def test_copy_into_first_database(many, single):
    both = Namespace([many, Database("other", many.context, single.entities, {}, single.defaults, {}, {})])
    copied = writes.copy_feature(both, "f", "g", hashes=["a", "b"])
    assert copied.name == "test"
    assert rows_of(copied.many["g"].pairs()) == [("a", "value1"), ("b", "value1")]


def test_delete_entities(many, single, frame):
    doomed = frame([("a",), ("q",)], "hash string")
    assert hashes_of(writes.delete_entities(single, doomed).entities) == ["b", "c"]
    left = writes.delete_entities(many, doomed)
    assert {h for h, _ in rows_of(left.many["tag"].pairs())} == {"b", "c"}
    assert hashes_of(left.entities) == ["b", "c"]
