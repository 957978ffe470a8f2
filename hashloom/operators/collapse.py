"""Collapse aggregates over the distinct values of a key.

Distinct aggregates shuffle on (key, value) before they shuffle on the key, so the rows of one hot
key are spread over all tasks and only its distinct values meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashloom.functions.numbers import as_number
from hashloom.plans.namespace import UNSET

COLLAPSES = ("concat", "min", "max", "avg", "sum", "count")


def check_collapse(collapse: str | None) -> None:
    if collapse not in COLLAPSES + (None, "none"):
        raise ValueError(f"collapse must be one of {COLLAPSES} or None, not {collapse!r}")


def concat_sorted(name: str, separator: str = ",", distinct: bool = True) -> Column:
    """Aggregate: the distinct values in ascending order as one text, null without any."""
    values = F.expr(f"collect_list({'DISTINCT ' if distinct else ''}`{name}`)")
    texts = F.sort_array(values).cast("array<string>")
    return F.when(F.size(values) > 0, F.array_join(texts, separator))


def collapse_single(column: Column, data_type: T.DataType, collapse: str) -> Column:
    """The collapse of a single value."""
    if collapse == "concat":
        return column.cast("string")
    if collapse == "count":
        return F.when(column.isNotNull(), 1).otherwise(0).cast("bigint")
    if collapse in ("sum", "avg"):
        number = as_number(column, data_type)
        return number.cast("double") if collapse == "avg" else number
    return column


def unset_result(column: Column, data_type: T.DataType, collapse: str) -> Column:
    """The collapse of an entity without a value: that of the word None for text features."""
    if not isinstance(data_type, T.StringType):
        return F.coalesce(column, F.lit(0)) if collapse == "count" else column
    if collapse == "count":
        return F.when(F.coalesce(column, F.lit(0)) == 0, F.lit(1)).otherwise(column)
    word = F.lit(0.0) if collapse in ("sum", "avg") else F.lit(UNSET)
    return F.coalesce(column, word)


def collapse_rows(
    frame: DataFrame,
    key: str,
    named: list[tuple[Column, str, T.DataType]],
    collapse: str,
    extra: list[Column] | None = None,
    distinct: bool = True,
) -> DataFrame:
    """Aggregate columns of a frame per key.  ``named`` holds column, name and type of each;
    ``distinct=False`` says that no (key, value) pair repeats.

    Sums and averages of text work on the distinct texts ('1' and '1.0' count twice), so those
    columns are made distinct before they are read as numbers.
    """
    extra = extra or []
    by_text = [collapse in ("sum", "avg") and not _is_numeric(data_type) for _, _, data_type in named]
    texts = [n for n, is_text in zip(named, by_text) if is_text]
    plain = [n for n, is_text in zip(named, by_text) if not is_text]
    aggregates = [_aggregate(name, collapse, distinct) for _, name, _ in plain] + extra
    parts = []
    if aggregates or not texts:
        carried = [c for c in frame.columns if c.startswith("__known_")] if extra else []
        rows = frame.select(key, *[column for column, _, _ in plain], *carried)
        parts.append(rows.groupBy(key).agg(*aggregates) if aggregates else rows.distinct())
    for column, name, data_type in texts:
        values = frame.select(key, column)
        values = values.distinct() if distinct else values
        number = as_number(F.col(name), data_type)
        total = F.sum(number) if collapse == "sum" else F.avg(number)
        parts.append(values.groupBy(key).agg(total.alias(name)))
    return reduce(lambda a, b: a.join(b, key), parts)


def _aggregate(name: str, collapse: str, distinct: bool) -> Column:
    column = F.col(name)
    if collapse == "concat":
        return concat_sorted(name, distinct=distinct).alias(name)
    if collapse == "count":
        return (F.count_distinct(column) if distinct else F.count(column)).alias(name)
    if collapse == "sum":
        return (F.sum_distinct(column) if distinct else F.sum(column)).alias(name)
    if collapse == "avg":
        return (F.expr(f"avg(DISTINCT `{name}`)") if distinct else F.avg(column)).alias(name)
    return (F.min(column) if collapse == "min" else F.max(column)).alias(name)


def _is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)
