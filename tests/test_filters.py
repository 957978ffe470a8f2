"""Filters on the small namespaces: precedence, comparisons, sets of values, patterns."""

import random
import re

import pytest
from conftest import hashes_of, rows_of

from hashloom import Database, Namespace, feature, number, select, term
from hashloom.plans.namespace import FeatureError


def known(namespace, where=None, **options):
    return hashes_of(select(namespace, where, collapse=None, **options))


@pytest.fixture
def two(spark, frame):
    """Two databases of one context sharing a multi-valued feature."""
    first = Database.of(
        "test1",
        frame([("a", "1"), ("b", "10"), ("c", "100"), ("d", None)], "hash string, size string"),
        {"tag": frame([(h, "value1") for h in "abc"])},
        {"size": "0"},
    )
    second = Database.of(
        "test2",
        None,
        {
            "tag": frame([("a", "value1")] + [(h, "value2") for h in "abc"]),
            "extra": frame([(h, "value2") for h in "abc"]),
        },
    )
    return Namespace([first, second])


def test_first_database_wins(two):
    assert known(two, feature("tag") == "value1") == ["a", "b", "c"]
    assert known(two, feature("tag") == "value2") == []
    assert known(two, feature("test1:tag") == "value1") == ["a", "b", "c"]
    assert known(two, feature("test2:tag") == "value2") == ["a", "b", "c"]
    assert known(two, feature("extra") == "value2") == ["a", "b", "c"]


def test_text_order(two):
    assert known(two, feature("test2:tag") < "value2") == ["a"]
    assert known(two, feature("tag") > "value1") == []
    # an unset entity reads as the word None, which is less than any lower case word
    assert known(two, feature("tag") < "value2") == ["a", "b", "c", "d"]


def test_numbers_in_text(two):
    assert known(two, feature("size") < 2) == ["a", "d"]
    assert known(two, feature("size") == 10) == ["b"]
    assert known(two, (feature("size") == 1) | (feature("size") == 10)) == ["a", "b"]
    assert known(two, ~(feature("size") == 1)) == ["b", "c", "d"]


def test_set_conditions(two):
    none_of_first = feature("test2:tag") != "value1"
    assert known(two, none_of_first & (feature("test2:tag") == "value2")) == ["b", "c"]
    assert known(two, none_of_first) == ["b", "c"]
    assert known(two, ~none_of_first) == ["a"]
    assert known(two, feature("tag").is_unset()) == ["d"]
    assert known(two, ~feature("tag").is_unset() | (feature("size") > 5)) == ["a", "b", "c"]


def test_unknown_entities_satisfy_nothing(two):
    condition = feature("extra") == "value2"
    assert known(two, condition | ~condition) == ["a", "b", "c"]
    absent = feature("extra") != "value9"
    assert known(two, absent) == ["a", "b", "c"]


def test_hash_lists(two, frame):
    assert known(two, hashes=["a"]) == ["a"]
    assert known(two, feature("size") > 5, hashes=["a", "b"]) == ["b"]
    assert known(two, hashes=frame([("a",), ("z",), ("a",)], "hash string")) == ["a"]
    assert known(two, hashes=[f"x{i}" for i in range(2000)] + ["c"]) == ["c"]
    assert known(two) == ["a", "b", "c", "d"]


def test_collapse(two):
    assert rows_of(select(two, resolve=["test2:tag"], collapse=None)) == [
        ("a", "value1"),
        ("a", "value2"),
        ("b", "value2"),
        ("c", "value2"),
        ("d", None),
    ]
    assert rows_of(select(two, resolve=["tag", "test2:tag"], group_by="test1:hash")) == [
        ("a", "value1", "value1,value2"),
        ("b", "value1", "value2"),
        ("c", "value1", "value2"),
        ("d", "None", None),
    ]
    assert rows_of(select(two, resolve=["tag"], collapse="sum")) == [(h, 0.0) for h in "abcd"]
    assert rows_of(select(two, resolve=["test2:tag"], collapse="count", group_by="size")) == [
        ("0", 0),
        ("1", 2),
        ("10", 1),
        ("100", 1),
    ]


def test_names(two):
    assert select(two, resolve=["test1:tag", "test2:tag"]).columns == ["hash", "tag", "test2__tag"]
    with pytest.raises(FeatureError):
        select(two, resolve=["nothing"])
    with pytest.raises(FeatureError):
        select(two, resolve=["nowhere:tag"])
    with pytest.raises(ValueError):
        select(two, collapse="median")
    with pytest.raises(FeatureError):
        select(two, how="outer")


def test_registry(spark, two):
    assert two.feature_names() == ["size", "tag", "extra"] and two.feature_names("test2") == ["tag", "extra"]
    rows = [(r.database, r.feature, r.cardinality, r.default, r.position) for r in two.registry(spark).collect()]
    assert rows == [
        ("test1", "size", "1:1", "0", 0),
        ("test1", "tag", "1:n", None, 0),
        ("test2", "tag", "1:n", None, 1),
        ("test2", "extra", "1:n", None, 1),
    ]
    assert two.find("tag").database == "test1" and two.find("tag", "test2").database == "test2"
    assert two.find("cnf:size").database == "test1"
    with pytest.raises(FeatureError):
        two.find("test1:tag", "test2")
    with pytest.raises(FeatureError):
        Namespace([two.first, two.first])
    with pytest.raises(FeatureError):
        two.translator("cnf", "kis")


@pytest.fixture
def paths(frame):
    names = ["xorshift", "scheduling", "planning"]
    return Namespace(
        [
            Database.of(
                "files",
                None,
                {
                    "filename": frame([(f"hash_{n}", f"{n}.cnf") for n in names]),
                    "local": frame([(f"hash_{n}", f"/data/{n}.cnf") for n in names]),
                },
            )
        ]
    )


def test_patterns(paths):
    name = feature("filename")
    assert known(paths, name.like("xorshift%")) == ["hash_xorshift"]
    assert known(paths, name.like("XOR%")) == ["hash_xorshift"]
    assert known(paths, name.unlike("xorshift%")) == ["hash_planning", "hash_scheduling"]
    assert len(known(paths, name.like("%cnf"))) == 3
    assert known(paths, name.like("%scheduling%")) == ["hash_scheduling"]
    assert known(paths, name.like("xorshift%") & name.like("%shift%")) == ["hash_xorshift"]
    assert known(paths, name.like("planning.cnf")) == ["hash_planning"]
    assert known(paths, name.like("pl_nning%")) == ["hash_planning"]
    assert known(paths, name.like("doesnotexist%")) == []
    found = select(paths, name.like("xorshift%"), ["local"])
    assert rows_of(found) == [("hash_xorshift", "/data/xorshift.cnf")]


def test_pattern_letters(frame):
    """Only ASCII letters fold, a backslash is an ordinary letter."""
    values = frame([("a", "Ä"), ("b", "ä"), ("c", "x\\y"), ("d", "x%y")])
    namespace = Namespace([Database.of("files", None, {"name": values})])
    assert known(namespace, feature("name").like("ä")) == ["b"]
    assert known(namespace, feature("name").like("X\\Y")) == ["c"]
    assert known(namespace, feature("name").like("x_y")) == ["c", "d"]


def test_terms(frame):
    entities = frame([("a", "6", "2"), ("b", "7", "0"), ("c", "x", "1")], "hash string, n string, k string")
    values = frame([("a", "3"), ("a", "9"), ("b", "5")])
    namespace = Namespace([Database.of("terms", entities, {"v": values})])
    assert known(namespace, feature("n") == term("k") * 3) == ["a"]
    assert known(namespace, feature("n") >= term("k") - 1) == ["a", "b", "c"]
    assert known(namespace, feature("n") > number(7) / number(2) * 2) == ["b"]
    assert known(namespace, feature("n") > 1 / term("k")) == ["a"]
    # no value equals k + 1; the unset entity c has the number 0
    assert known(namespace, feature("v") != term("k") + 1) == ["b", "c"]
    assert known(namespace, feature("v") != term("k") - 1) == ["a", "b"]
    assert known(namespace, ~(feature("v") != number(1) + 2)) == ["a"]
    rows = select(namespace, feature("v") > term("k") + 2, ["v"], collapse=None)
    assert rows_of(rows) == [("a", "9"), ("b", "5")]
    assert rows_of(select(namespace, feature("v") > term("k"), ["v"])) == [("a", "3,9"), ("b", "5")]


# ---- random filters against a plain model ---------------------------------------------------

OPS = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def as_number(text):
    found = re.match(r"\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", text)
    return float(found.group(1)) if found else 0.0


class Model:
    """Entities, single values, sets of values; a truth is True, False or None."""

    def __init__(self, rng):
        words = ["1", "2", "10", "1.5", "ab", "Ab", "b", "None", "2x"]
        self.entities = [f"e{i}" for i in range(30)]
        self.second = set(rng.sample(self.entities, 18)) | {"other"}
        self.single = {e: rng.choice(words + [None]) for e in self.entities}
        self.far = {e: rng.choice(words) for e in sorted(self.second)}
        real = [w for w in words if w != "None"]
        self.many = {e: set(rng.sample(real, rng.choice([0, 1, 2, 3]))) for e in self.entities}
        self.many_far = {e: set(rng.sample(real, rng.choice([0, 1, 2]))) for e in sorted(self.second)}

    def namespace(self, frame):
        def pairs(sets):
            return frame([(e, v) for e, values in sets.items() for v in values])

        one = frame(list(self.single.items()), "hash string, s string")
        two = frame(list(self.far.items()), "hash string, t string")
        return Namespace(
            [
                Database.of("one", one, {"m": pairs(self.many)}, {"s": "empty"}),
                Database.of("two", two, {"n": pairs(self.many_far)}),
            ]
        )

    def truth(self, leaf, e):
        name, kind, op, value = leaf
        if name in "tn" and e not in self.second:
            return None
        if name == "s":
            values = {self.single[e] or "empty"}
        elif name == "t":
            values = {self.far[e]}
        else:
            values = (self.many if name == "m" else self.many_far)[e] or {"None"}
        none_of = op == "!=" and kind != "number" and name in "mn"
        test = "=" if none_of else op
        passed = any(self.passes(v, kind, test, value) for v in values)
        return not passed if none_of else passed

    def passes(self, text, kind, op, value):
        if kind == "number":
            return OPS[op](as_number(text), value)
        if kind == "like":
            form = re.escape(value).replace("%", ".*").replace("_", ".")
            return (re.fullmatch(form, text, re.IGNORECASE | re.DOTALL) is not None) == (op == "=")
        return OPS[op](text, value)

    def evaluate(self, tree, e):
        if tree[0] == "leaf":
            return self.truth(tree[1], e)
        if tree[0] == "not":
            inner = self.evaluate(tree[1], e)
            return None if inner is None else not inner
        left, right = self.evaluate(tree[1], e), self.evaluate(tree[2], e)
        decisive = tree[0] == "or"
        if decisive in (left, right):
            return decisive
        return None if None in (left, right) else not decisive


def random_leaf(rng):
    name = rng.choice("stmn")
    kind = rng.choice(["text", "number", "like"])
    op = rng.choice(list(OPS)) if kind != "like" else rng.choice(["=", "!="])
    value = {
        "text": rng.choice(["1", "ab", "b", "None", "empty", "zz"]),
        "number": rng.choice([0, 1, 1.5, 2, 10]),
        "like": rng.choice(["a%", "%b", "%1%", "none", "_", "zz%"]),
    }[kind]
    return (name, kind, op, value)


def random_tree(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return ("leaf", random_leaf(rng))
    kind = rng.choice(["and", "and", "or", "not"])
    if kind == "not":
        return ("not", random_tree(rng, depth - 1))
    return (kind, random_tree(rng, depth - 1), random_tree(rng, depth - 1))


def predicate(tree):
    if tree[0] == "leaf":
        name, kind, op, value = tree[1]
        if kind == "like":
            return feature(name).like(value) if op == "=" else feature(name).unlike(value)
        return feature(name)._compare(op, value)
    if tree[0] == "not":
        return ~predicate(tree[1])
    left, right = predicate(tree[1]), predicate(tree[2])
    return left & right if tree[0] == "and" else left | right


@pytest.mark.parametrize("seed", range(4))
def test_random_filters(spark, frame, seed):
    rng = random.Random(seed)
    model = Model(rng)
    namespace = model.namespace(frame)
    for _ in range(12):
        tree = random_tree(rng, 3)
        expected = sorted(e for e in model.entities if model.evaluate(tree, e))
        assert known(namespace, predicate(tree)) == expected, tree


@pytest.mark.parametrize(
    "where, pushed, found",
    [
        (feature("s") == "x", "EqualTo(s,x)", "a"),
        (feature("s") == "empty", "Or(And(IsNotNull(s),EqualTo(s,empty)),IsNull(s))", "b"),
        (feature("s") != "empty", "Not(EqualTo(s,empty))", "acd"),
        (~(feature("s") == "x"), "Or(IsNull(s),Not(EqualTo(s,x)))", "bcd"),
        (feature("n") < 2, "Or(And(IsNotNull(n),LessThan(n,2)),IsNull(n))", "acd"),
        ((feature("s") == "x") & (feature("n") > 0.25), "EqualTo(s,x)", "a"),
        ((feature("s") == "y") | (feature("n") == 0.5), "Or(And(IsNotNull(s),EqualTo(s,y))", "cd"),
    ],
)
def test_filters_on_defaulted_features_reach_the_scan(spark, frame, tmp_path, capsys, where, pushed, found):
    """The default of n is wider than its type: it is compared as it is shown."""
    path = str(tmp_path / "entities")
    rows = [("a", "x", 1), ("b", None, 2), ("c", "y", None), ("d", "z", None)]
    frame(rows, "hash string, s string, n int").write.parquet(path)
    stored = Database.of("test", spark.read.parquet(path), {}, {"s": "empty", "n": 0.5})
    for how in ("left", "inner", "full"):
        result = select(Namespace([stored]), where, resolve=["s"], how=how)
        assert hashes_of(result) == list(found)
    select(Namespace([stored]), where, resolve=["s"]).explain("formatted")
    plan = capsys.readouterr().out
    assert pushed in plan[plan.index("PushedFilters") :].splitlines()[0]
