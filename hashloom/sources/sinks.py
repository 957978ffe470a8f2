"""Exports of query results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_TEXT = "[None]"


def export_delimited(frame: DataFrame, path: str, delimiter: str = " ", header: bool = False) -> None:
    """Write rows as delimited text, nulls as [None], values as they are: nothing is quoted.  With
    a header every file starts with the column names."""
    lines = frame.select(delimited_line(frame, delimiter).alias(delimiter.join(frame.columns)))
    if not header:
        lines.write.text(path)
        return
    # one column per line, with separators that texts do not hold, so that the writer adds nothing
    writer = lines.write.option("header", True).option("sep", "\x01").option("quote", "\x02").option("emptyValue", "")
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def delimited_line(frame: DataFrame, delimiter: str = " ") -> Column:
    """The exported line of a row."""
    return F.concat_ws(delimiter, *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_TEXT)) for c in frame.columns])


def instance_link(base: str, key: Column, context: str, default_context: str) -> Column:
    """Address of an instance, with its context as a parameter outside the default one."""
    link = F.concat(F.lit(base.rstrip("/") + "/"), F.url_encode(key.cast("string")))
    return link if context == default_context else F.concat(link, F.lit(f"?context={context}"))


def export_links(frame: DataFrame, path: str, base: str, context: str, default_context: str) -> None:
    """Write one address per selected entity."""
    links = frame.select(instance_link(base, F.col("hash"), context, default_context).alias("value"))
    links.write.text(path)
