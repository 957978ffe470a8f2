"""Digests of normalised content and the expressions computed on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_text(content: Column) -> Column:
    """Bytes as text, one character per byte, so that any file can be read."""
    return F.decode(content, "ISO-8859-1")


def canonical_tokens(text: Column) -> Column:
    """Canonical token text of an instance: numbers separated by one blank, comment and header
    lines dropped from their first letter on, the last clause closed by a zero."""
    numbers = F.regexp_replace(text, r"[^0-9\-\x00-\x20][^\r\n]*", "")
    spaced = F.trim(F.regexp_replace(numbers, r"[\x00-\x20]+", " "))
    closed = (spaced == "") | (spaced == "0") | spaced.endswith(" 0")
    return F.when(closed, spaced).otherwise(F.concat(spaced, F.lit(" 0")))


def content_digest(content: Column) -> Column:
    """Identity of an instance: MD5 of its canonical token text."""
    return F.md5(canonical_tokens(content_text(content)))


def text_digest(text: Column) -> Column:
    """MD5 of a text without regard to case, repeated blanks and blanks at the ends."""
    folded = F.regexp_replace(F.lower(text), r"[ \t\n\f\r]+", " ")
    return F.md5(F.trim(folded))


def clause_count(tokens: Column) -> Column:
    """Number of clauses: tokens that are a lone zero."""
    return F.size(F.filter(F.split(tokens, " "), lambda t: t == "0")).cast("bigint")


def variable_count(tokens: Column) -> Column:
    """Largest absolute token that is a number; 0 without any."""
    sizes = F.transform(F.split(tokens, " "), lambda t: F.abs(t.try_cast("bigint")))
    return F.coalesce(F.array_max(sizes), F.lit(0)).cast("bigint")


def base_features(content: Column) -> dict[str, Column]:
    """Extractor written as expressions: counts over the canonical token text."""
    tokens = canonical_tokens(content_text(content))
    return {"clauses": clause_count(tokens), "variables": variable_count(tokens)}
