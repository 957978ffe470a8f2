"""Random filters and resolutions across two contexts against a plain model."""

import itertools
import random

import pytest
from conftest import rows_of
from test_filters import Model, as_number, predicate, random_tree

from hashloom import Database, Namespace, select

WORDS = ["1", "2", "10", "ab", "b", "2x"]


class Linked(Model):
    """Entities of context ord with s and m, of context prt with t and n, and links between them."""

    def __init__(self, rng):
        self.entities = [f"e{i}" for i in range(15)]
        self.targets = [f"p{i}" for i in range(12)]
        self.single = {e: rng.choice(WORDS) for e in self.entities}
        self.far = {p: rng.choice(WORDS) for p in self.targets}
        self.many = {e: set(rng.sample(WORDS, rng.choice([0, 1, 2]))) for e in self.entities}
        self.many_far = {p: set(rng.sample(WORDS, rng.choice([0, 1, 2]))) for p in self.targets}
        self.links = {(rng.choice(self.entities), rng.choice(self.targets + ["lost"])) for _ in range(30)}

    def namespace(self, frame, backwards):
        def pairs(sets):
            return frame([(e, v) for e, values in sets.items() for v in values])

        link = frame([(p, e) if backwards else (e, p) for e, p in self.links])
        one = {"m": pairs(self.many)} | ({} if backwards else {"to_prt": link})
        two = {"n": pairs(self.many_far)} | ({"to_ord": link} if backwards else {})
        return Namespace(
            [
                Database.of("ord_a", frame(list(self.single.items()), "hash string, s string"), one, context="ord"),
                Database.of("prt_a", frame(list(self.far.items()), "hash string, t string"), two, context="prt"),
            ]
        )

    def truth(self, leaf, pair):
        name, kind, op, value = leaf
        e, p = pair
        values = {"s": {self.single[e]}, "m": self.many[e] or {"None"}}
        if name in "tn":
            values = {"t": {self.far[p]}, "n": self.many_far[p]}
        none_of = op == "!=" and kind != "number" and name in "mn"
        passed = any(self.passes(v, kind, "=" if none_of else op, value) for v in values[name])
        return not passed if none_of else passed

    def rows(self, tree, names):
        used = set(names) | names_of(tree)
        for e, p in self.links if used & set("tn") else [(e, None) for e in self.entities]:
            if used & set("tn") and (p not in self.targets or ("n" in used and not self.many_far[p])):
                continue
            if not self.evaluate(tree, (e, p)):
                continue
            shown = {"s": {self.single[e]}, "m": self.many[e] or {"None"}}
            if p:
                shown |= {"t": {self.far[p]}, "n": self.many_far[p]}
            for row in itertools.product(*[shown[n] for n in names]):
                yield (e, *row)


def names_of(tree):
    return {tree[1][0]} if tree[0] == "leaf" else set().union(*map(names_of, tree[1:]))


@pytest.mark.parametrize("backwards", [False, True])
@pytest.mark.parametrize("collapse", [None, "concat", "sum"])
def test_across_contexts(frame, backwards, collapse):
    rng = random.Random(f"{backwards}{collapse}")
    model = Linked(rng)
    namespace = model.namespace(frame, backwards)
    for _ in range(5):
        tree = random_tree(rng, 2)
        names = rng.sample("stmn", rng.randint(0, 3))
        rows = set(model.rows(tree, names))
        if collapse:
            groups = {}
            for key, *values in rows:
                sets = groups.setdefault(key, [set() for _ in names])
                for texts, value in zip(sets, values):
                    texts.add(value)
            fold = {"concat": lambda t: ",".join(sorted(t)), "sum": lambda t: sum(map(as_number, t))}[collapse]
            rows = {(key, *map(fold, sets)) for key, sets in groups.items()}
        result = select(namespace, predicate(tree), names, collapse, group_by="ord:hash")
        assert rows_of(result) == sorted(rows, key=str), (tree, names)
