"""Filters: conditions on features, joined by &, | and ~.

A condition on a single-valued feature looks at its value.  A condition on a multi-valued feature
asks something of the set of values of an entity:

======================  =============================================
``== text``, ``like``   some value equals / matches
``!= text``, ``unlike`` no value equals / matches
``< <= > >=``           some value is less / greater
``== != <`` a number    some value, read as a number, satisfies it
``!=`` a term           no value equals the term
other term comparisons  keep the rows whose value satisfies it
======================  =============================================
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashloom.functions.numbers import as_number, fold_text, matches
from hashloom.plans.namespace import UNSET

COMPARE = {
    "=": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
}


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return Both(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Either(self, other)

    def __invert__(self) -> Predicate:
        return Negation(self)

    def conditions(self) -> list[Condition]:
        raise NotImplementedError

    def column(self, of: Callable[[Condition], Column]) -> Column:
        """The filter as a Column, given the Column of every condition."""
        raise NotImplementedError

    def conjuncts(self) -> list[Predicate]:
        return [self]


@dataclass(frozen=True, eq=False)
class Both(Predicate):
    left: Predicate
    right: Predicate

    def conditions(self):
        return self.left.conditions() + self.right.conditions()

    def column(self, of):
        return self.left.column(of) & self.right.column(of)

    def conjuncts(self):
        return self.left.conjuncts() + self.right.conjuncts()


@dataclass(frozen=True, eq=False)
class Either(Predicate):
    left: Predicate
    right: Predicate

    def conditions(self):
        return self.left.conditions() + self.right.conditions()

    def column(self, of):
        return self.left.column(of) | self.right.column(of)


@dataclass(frozen=True, eq=False)
class Negation(Predicate):
    inner: Predicate

    def conditions(self):
        return self.inner.conditions()

    def column(self, of):
        return ~self.inner.column(of)


class Term:
    """Arithmetic over features and constants.  Division of two whole constants drops the
    fraction; division by zero has no value."""

    def __init__(self, build: Callable, addresses: tuple = (), constant=None):
        self.build = build
        self.addresses = addresses
        self.constant = constant

    def _with(self, other, combine: Callable, fold: Callable) -> Term:
        other = other if isinstance(other, Term) else number(other)
        if self.constant is not None and other.constant is not None:
            value = fold(self.constant, other.constant)
            return Term(lambda of: F.lit(value).cast("double"), (), None) if value is None else number(value)
        return Term(
            lambda of: combine(self.build(of), other.build(of)),
            self.addresses + other.addresses,
        )

    def __add__(self, other):
        return self._with(other, operator.add, operator.add)

    def __sub__(self, other):
        return self._with(other, operator.sub, operator.sub)

    def __mul__(self, other):
        return self._with(other, operator.mul, operator.mul)

    def __truediv__(self, other):
        return self._with(other, F.try_divide, _divide_constants)

    def __radd__(self, other):
        return number(other) + self

    def __rsub__(self, other):
        return number(other) - self

    def __rmul__(self, other):
        return number(other) * self

    def __rtruediv__(self, other):
        return number(other) / self


def _divide_constants(a, b):
    if b == 0:
        return None
    if isinstance(a, int) and isinstance(b, int):
        quotient = abs(a) // abs(b)
        return quotient if (a < 0) == (b < 0) else -quotient
    return a / b


def number(value) -> Term:
    """A constant of a term."""
    return Term(lambda of: F.lit(value), (), value)


def term(address: str) -> Term:
    """A feature of a term, read as a double."""
    return Term(lambda of: of(address), (address,))


class feature:
    """A feature in a filter: compare it with a text, a number or a term."""

    __hash__ = None

    def __init__(self, address: str):
        self.address = address

    def _compare(self, op: str, value) -> Condition:
        if isinstance(value, Term):
            return Condition(self.address, "term", op, value)
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return Condition(self.address, "number", op, value)
        return Condition(self.address, "text", op, value)

    def __eq__(self, value):
        return self._compare("=", value)

    def __ne__(self, value):
        return self._compare("!=", value)

    def __lt__(self, value):
        return self._compare("<", value)

    def __le__(self, value):
        return self._compare("<=", value)

    def __gt__(self, value):
        return self._compare(">", value)

    def __ge__(self, value):
        return self._compare(">=", value)

    def like(self, pattern: str):
        return Condition(self.address, "like", "=", pattern)

    def unlike(self, pattern: str):
        return Condition(self.address, "like", "!=", pattern)

    def is_unset(self):
        """Entities known to the feature's database that have no value of it."""
        return Condition(self.address, "unset", "=", None)


@dataclass(frozen=True, eq=False)
class Condition(Predicate):
    address: str
    kind: str
    op: str
    value: object

    def conditions(self):
        return [self]

    def column(self, of):
        return of(self)

    def addresses(self) -> tuple:
        own = (self.address,)
        return own + self.value.addresses if self.kind == "term" else own

    @property
    def about_no_value(self) -> bool:
        """On a multi-valued feature: the condition says that no value passes the test."""
        return self.op == "!=" and self.kind in ("text", "like", "term")

    @property
    def keeps_rows(self) -> bool:
        """On a multi-valued feature: the condition filters rows, not entities."""
        return self.kind == "term" and self.op != "!="

    def test(self, value: Column, data_type: T.DataType, right: Column | None = None) -> Column:
        """The condition on one value; for a multi-valued feature the test that some value passes
        (a condition about no value is the negation of it)."""
        return self._apply(self.op, value, data_type, right)

    def any_test(self, value: Column, data_type: T.DataType, right: Column | None = None) -> Column:
        return self._apply("=" if self.about_no_value else self.op, value, data_type, right)

    def _apply(self, op, value, data_type, right):
        if self.kind == "unset":
            return value.isNull() | (value.cast("string") == UNSET)
        if self.kind == "like":
            found = matches(value, self.value)
            return found if op == "=" else ~found
        if self.kind == "text":
            typed = isinstance(data_type, T.StringType) or not isinstance(self.value, str)
            left = value if typed or isinstance(data_type, T.DatetimeType) else value.cast("string")
            return COMPARE[op](left, F.lit(self.value))
        left = as_number(value, data_type)
        return COMPARE[op](left, F.lit(self.value) if right is None else right)

    def unset_passes(self, data_type: T.DataType, right: Column | None = None) -> bool | Column:
        """Whether an unset entity passes any_test: text features read as the word None, typed
        ones have no value at all."""
        if self.kind == "unset":
            return True
        if not isinstance(data_type, T.StringType):
            return False
        if self.kind == "term":
            return right == F.lit(0.0)
        if self.kind == "like":
            form = "".join({"%": ".*", "_": "."}.get(c) or re.escape(c) for c in fold_text(self.value))
            return re.fullmatch(form, fold_text(UNSET), re.DOTALL) is not None
        op = "=" if self.about_no_value else self.op
        if self.kind == "number":
            return COMPARE[op](0.0, self.value)
        return COMPARE[op](UNSET, str(self.value))
