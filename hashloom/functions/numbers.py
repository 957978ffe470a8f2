"""Text as number: every value of an untyped feature is text, these read it as a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The numeric text forms that must be recognised for equal results.
NUMERIC_PREFIX = r"^\s*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
INTEGER_TEXT = r"^\s*[+-]?[0-9]+(?:_[0-9]+)*\s*$"
FLOAT_TEXT = (
    r"^\s*[+-]?(?:(?:[0-9]+(?:_[0-9]+)*(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?|\.[0-9]+(?:_[0-9]+)*)"
    r"(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?|(?i:inf|infinity|nan))\s*$"
)
PLAIN_DECIMAL = r"^[+-]?[0-9]+(\.[0-9]+)?$"
PLAIN_INTEGER = r"^[0-9]+$"

NUMERIC_TYPES = (T.NumericType,)


def num_prefix(column: Column) -> Column:
    """Longest numeric prefix after blanks as a double, 0.0 without one; null stays null."""
    prefix = F.regexp_extract(column, NUMERIC_PREFIX, 1)
    return F.when(column.isNotNull(), F.coalesce(prefix.try_cast("double"), F.lit(0.0)))


def as_number(column: Column, data_type: T.DataType) -> Column:
    """A feature column as a number: numeric columns as they are, others through num_prefix."""
    if isinstance(data_type, NUMERIC_TYPES):
        return column
    if isinstance(data_type, T.BooleanType):
        return column.cast("int")
    return num_prefix(column.cast("string"))


def is_number(column: Column) -> Column:
    """Whether the text parses as a number (digits, decimals, exponents, inf, nan); null is not."""
    return F.coalesce(column.rlike(FLOAT_TEXT), F.lit(False))


def parse_number(column: Column) -> Column:
    """The number a text stands for, null where is_number does not hold."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(column, r"[\s_]", "")), r"^\+", "")
    return F.when(is_number(column), plain.try_cast("double"))


def _integer_text(column: Column) -> Column:
    digits = F.regexp_replace(column, r"[\s_+]", "")
    stripped = F.regexp_replace(digits, r"^(-?)0+(?=[0-9])", "$1")
    return F.when(stripped == "-0", F.lit("0")).otherwise(stripped)


def _small_decimal_text(number: Column) -> Column:
    """Text of a double without the switch to exponents that starts at one thousandth."""
    text = number.cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(text, r"E-([0-9]+)$", 1)
    fourth = F.concat(
        F.when(number < 0, F.lit("-")).otherwise(F.lit("")),
        F.lit("0.000"),
        F.regexp_replace(mantissa, r"[-.]", ""),
    )
    return (
        F.when(~text.contains("E-"), text)
        .when(exponent == "4", fourth)
        .otherwise(F.concat(mantissa, F.lit("e-"), F.lpad(exponent, 2, "0")))
    )


def convert_value(column: Column) -> Column:
    """Canonical text of a tool's value: 007 and 4.0 become 7 and 4, other numbers keep their
    shortest decimal form, anything else stays as it is.  Whole numbers beyond 64 bits that are
    written with a point or an exponent stay as they are too."""
    number = parse_number(column)
    whole = number == F.rint(number)
    special = F.lower(F.regexp_replace(F.trim(column), r"^\+", ""))
    return (
        F.when(column.rlike(INTEGER_TEXT), _integer_text(column))
        .when(number.isNull(), column)
        .when(F.isnan(number), F.lit("nan"))
        .when(special.startswith("inf"), F.lit("inf"))
        .when(special.startswith("-inf"), F.lit("-inf"))
        .when(whole & (F.abs(number) < 9.2e18), number.try_cast("bigint").cast("string"))
        .when(whole, column)
        .otherwise(_small_decimal_text(number))
    )


def display_kind(column: Column) -> Column:
    """How a value is shown: link, integer, decimal or text.  Exponents are never numbers, so
    digests such as 9026252821384e97 stay text."""
    return (
        F.when(column.isNull(), F.lit("text"))
        .when(column.startswith("http"), F.lit("link"))
        .when(column.rlike(PLAIN_INTEGER), F.lit("integer"))
        .when(column.rlike(PLAIN_DECIMAL), F.lit("decimal"))
        .otherwise(F.lit("text"))
    )


def display_value(column: Column) -> Column:
    """The shown text: decimals with two places, everything else unchanged."""
    two_places = F.regexp_replace(F.format_number(column.try_cast("double"), 2), ",", "")
    return F.when(display_kind(column) == "decimal", two_places).otherwise(column)


# The proposed semantic types, most specific first.
_TYPE_FORMS = (
    ("int", r"^[+-]?[0-9]+$"),
    ("real", r"^[+-]?[0-9]+(\.[0-9]+)?$"),
    ("bool", r"^(?i:true|false|yes|no)$"),
    ("hash", r"^[0-9a-f]{32}$"),
    ("url", r"^https?://.*$"),
)


def infer_type(column: Column) -> Column:
    """Aggregate: the most specific of int, real, bool, hash, url that every value fits, else
    text.  A column without values is text.  Thirty-two digits are a hash, not an int."""
    text = column.cast("string")
    present = F.count(text) > 0
    fits = {name: F.bool_and(text.rlike(form)) for name, form in _TYPE_FORMS}
    choice = F.when(~present, F.lit("text")).when(fits["hash"], F.lit("hash"))
    for name, _ in _TYPE_FORMS:
        choice = choice.when(fits[name], F.lit(name))
    return choice.otherwise(F.lit("text"))


_PLAIN_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_fold(column: Column) -> Column:
    """Lower case for ASCII letters only."""
    return F.translate(column, _PLAIN_ASCII_UPPER, _PLAIN_ASCII_UPPER.lower())


def fold_text(text: str) -> str:
    return text.translate(str.maketrans(_PLAIN_ASCII_UPPER, _PLAIN_ASCII_UPPER.lower()))


def matches(column: Column, pattern: str) -> Column:
    """Case-insensitive (ASCII) pattern match with % and _; the backslash is an ordinary letter."""
    literal = fold_text(pattern).replace("\\", "\\\\")
    return ascii_fold(column.cast("string")).like(literal)
