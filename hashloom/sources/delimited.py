"""Delimited text and line sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.functions.text import Contexts, clean_column_name, database_name_of
from hashloom.plans.namespace import Database, FeatureError, Values
from hashloom.session import qualified
from hashloom.sources.streamed import ToolLines

# The delimiters a file may use.
DELIMITERS = (";", ",", " ", "\t")


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that occurs equally often in the first two lines, the most frequent of
    several; a comma for a single column."""
    lines = [row.value for row in spark.read.text(path).limit(2).collect()]
    if not lines:
        raise FeatureError(f"{path} is empty")
    counts = {d: [line.count(d) for line in lines] for d in DELIMITERS}
    steady = [d for d in DELIMITERS if counts[d][0] and len(set(counts[d])) == 1]
    present = steady or [d for d in DELIMITERS if counts[d][0]]
    return max(present, key=lambda d: counts[d][0], default=",")


def scan_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A delimited file with a header: all values text, header characters outside letters and
    digits replaced, a ``hash`` column required."""
    delimiter = delimiter or sniff_delimiter(spark, path)
    frame = spark.read.csv(path, header=True, sep=delimiter, inferSchema=False)
    if "hash" not in frame.columns:
        raise FeatureError(f"column 'hash' not found in {path}")
    return frame.toDF(*[clean_column_name(c) for c in frame.columns])


def merge_csv(frames: list[DataFrame]) -> DataFrame:
    """Files of one name as one entity table, matched by column name.  Where several rows hold a
    feature of one hash, the first file wins, then the smallest value."""
    marked = [frame.withColumn("__position", F.lit(i)) for i, frame in enumerate(frames)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    features = [c for c in rows.columns if c not in ("hash", "__position")]
    first = [
        F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("__position", c))).alias(c) for c in features
    ]
    return rows.groupBy("hash").agg(*first) if first else rows.select("hash").distinct()


def open_csv(
    spark: SparkSession, paths: list[str], many: bool = False, contexts: Contexts | None = None
) -> list[Database]:
    """Delimited files as databases, files of one name merged.  Features are single-valued;
    ``many`` keeps all values of a hash instead."""
    contexts = contexts or Contexts()
    by_name: dict[str, list[DataFrame]] = {}
    for path in paths:
        by_name.setdefault(database_name_of(path, contexts), []).append(scan_csv(spark, path))
    databases = []
    for name, frames in by_name.items():
        if many:
            rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
            values = {c: Values(rows, c) for c in rows.columns if c != "hash"}
            databases.append(Database.of(name, rows.select("hash").distinct(), values, contexts=contexts))
        else:
            databases.append(Database.of(name, merge_csv(frames), contexts=contexts))
    return databases


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Hashes separated by blanks or line ends."""
    return split_ids(spark.read.text(path), F.col("value"))


def split_ids(frame: DataFrame, text: Column) -> DataFrame:
    """The blank-separated words of a text column as hashes."""
    words = frame.select(F.explode(F.split(text, r"\s+")).alias("hash"))
    return words.where(F.col("hash") != "")


# The line ends and blanks of a tool's output.
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_BLANKS = " \t\x0b\x0c"


def read_tool_lines(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """Files of lines ``<feature> <value>`` as rows (path, feature, value); the last line of a feature wins.

    No file is held as a whole: several tasks read the splits of one, and the byte at which a line starts gives the
    order.  Options ``split`` and ``block`` are the bytes of a split and of a read.
    """
    spark.dataSource.register(ToolLines)
    reader = spark.read.format(ToolLines.name())
    for name, value in options.items():
        reader = reader.option(name, value)
    return _last_values(reader.load(qualified(spark, path)), "path", "offset", F.col("line"))


def tool_values(frame: DataFrame, key: str, output: Column) -> DataFrame:
    """The (feature, value) pairs of a tool's output text: the first word names the feature, the
    rest of the line is the value, which may be empty; the last line of a feature wins."""
    lines = frame.select(key, F.posexplode(F.split(output, _LINE_END)).alias("line", "text"))
    return _last_values(lines, key, "line", F.col("text"))


def _last_values(lines: DataFrame, key: str, position: str, text: Column) -> DataFrame:
    words = lines.select(key, position, F.btrim(text, F.lit(_BLANKS)).alias("text")).where(F.col("text") != "")
    parts = F.split(F.col("text"), r"\s+", 2)
    pairs = words.select(
        key,
        position,
        parts[0].alias("feature"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("value"),
    )
    return pairs.groupBy(key, "feature").agg(F.max_by("value", position).alias("value"))
