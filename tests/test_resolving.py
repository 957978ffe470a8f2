"""Random resolutions and collapses against a plain model."""

import itertools
import random

import pytest
from conftest import rows_of
from test_filters import Model, as_number

from hashloom import select

COLLAPSES = {
    "concat": lambda values: ",".join(sorted(values)) if values else None,
    "min": lambda values: min(values, default=None),
    "max": lambda values: max(values, default=None),
    "count": len,
    "sum": lambda values: sum(map(as_number, values)) if values else None,
    "avg": lambda values: sum(map(as_number, values)) / len(values) if values else None,
}


def values_of(model, name, e):
    """The values an entity shows; None where its database does not know it."""
    if name in "tn" and e not in model.second:
        return {None}
    if name == "s":
        return {model.single[e] or "empty"}
    if name == "t":
        return {model.far[e]}
    return (model.many if name == "m" else model.many_far)[e] or {"None"}


def expected(model, names, collapse, key, how):
    entities = model.entities
    if how == "inner" and set(names) & set("tn"):
        entities = [e for e in entities if e in model.second]
    keyed = [(k, e) for e in entities for k in ({e} if key == "hash" else values_of(model, key, e)) if k != "None"]
    if collapse is None:
        return {(k, *row) for k, e in keyed for row in itertools.product(*[values_of(model, n, e) for n in names])}
    rows = set()
    for k in {k for k, _ in keyed}:
        members = [e for other, e in keyed if other == k]
        texts = [set().union(*[values_of(model, n, e) for e in members]) - {None} for n in names]
        rows.add((k, *[COLLAPSES[collapse](t) for t in texts]))
    return rows


def rounded(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in rows), key=str)


@pytest.mark.parametrize("collapse", [None, *COLLAPSES])
@pytest.mark.parametrize("key", ["hash", "s", "m"])
def test_random_resolutions(frame, collapse, key):
    rng = random.Random(f"{collapse}{key}")
    model = Model(rng)
    namespace = model.namespace(frame)
    for _ in range(3):
        names = rng.sample([n for n in "stmn" if n != key], rng.randint(1, 3))
        how = rng.choice(["left", "inner"])
        group_by = "one:hash" if key == "hash" else key
        result = select(namespace, resolve=names, collapse=collapse, group_by=group_by, how=how)
        assert rounded(rows_of(result)) == rounded(expected(model, names, collapse, key, how)), (names, how)
