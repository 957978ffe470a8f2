"""Instance files."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashloom.functions.text import COMPRESSED, Contexts, has_suffix
from hashloom.session import qualified
from hashloom.sources.streamed import InstanceDigests

#: Bytes of the longest file that is read as one row; a value of a row cannot hold 2 GB.
LONGEST = 2_000_000_000

_OPENERS = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open, ".lzma": lzma.open}
_STEP = 8 << 20


def scan_instances(spark: SparkSession, root: str, context: str, contexts: Contexts | None = None) -> DataFrame:
    """Files of a context below a folder: path, size, time and content, compressed ones unpacked.

    The name pattern is applied while listing.  A file is one row, so files too long for one are not among
    them, and the content of a compressed file that unpacks to more than one row can hold is null:
    ``oversized_instances`` lists both, ``instance_digests`` reads files of any size.  Select only path columns where
    content is not used.
    """
    contexts = contexts or Contexts()
    suffix = contexts.suffix[context]
    plain = _binary(spark, root, f"*{suffix}").where(F.col("length") <= LONGEST)
    other = _packed(spark, root, suffix).where(F.col("length") <= LONGEST)
    return plain.unionByName(other.withColumn("content", unpack(LONGEST)("path", "content")))


def oversized_instances(spark: SparkSession, root: str, context: str, contexts: Contexts | None = None) -> DataFrame:
    """The files without content in ``scan_instances``: path, size and time of those too long for one row, as they
    are or unpacked."""
    suffix = (contexts or Contexts()).suffix[context]
    files = _binary(spark, root, f"*{suffix}{{{','.join(COMPRESSED)}}}").drop("content")
    packed = _packed(spark, root, suffix).where(F.col("length") <= LONGEST)
    packed = packed.where(unpacked_length("path", "content") > LONGEST).drop("content")
    return files.where(F.col("length") > LONGEST).unionByName(packed)


def instance_digests(
    spark: SparkSession, root: str, context: str, contexts: Contexts | None = None, **options: int
) -> DataFrame:
    """Identity and counts of the files of a context, whatever their size: path, length, bytes (unpacked), hash,
    clauses, variables, error.  Tasks read a file block by block, and unpack it as they read; options ``block`` and ``task``
    are the bytes of a block and of a task."""
    spark.dataSource.register(InstanceDigests)
    suffixes = (contexts or Contexts()).suffixes(context)
    reader = spark.read.format(InstanceDigests.name()).option("suffixes", ",".join(suffixes))
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(qualified(spark, root))


def _packed(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    return _binary(spark, root, f"*{suffix}{{{','.join(COMPRESSED[1:])}}}")


def _binary(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.option("pathGlobFilter", pattern).load(root)
    return files.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))


def _opened(path: str, content: bytes):
    opener = _OPENERS.get("." + path.rsplit(".", 1)[-1])
    raw = io.BytesIO(content)
    return opener(raw) if opener else raw


def unpack(longest: int = LONGEST):
    """Content of compressed files by their suffix, null beyond ``longest`` bytes.  Each is given back by itself, so a
    batch of small files is never held unpacked as a whole."""

    @F.pandas_udf(T.BinaryType())
    def unpacked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for paths, contents in batches:
            for path, content in zip(paths, contents):
                with _opened(path, content) as source:
                    made = source.read(longest + 1)
                yield pd.Series([made if len(made) <= longest else None], dtype=object)

    return unpacked


@F.pandas_udf(T.LongType())
def unpacked_length(paths: pd.Series, contents: pd.Series) -> pd.Series:
    """Bytes of the unpacked content, counted without holding it."""
    sizes = []
    for path, content in zip(paths, contents):
        with _opened(path, content) as source:
            sizes.append(sum(iter(lambda: len(source.read(_STEP)), 0)))
    return pd.Series(sizes)


def keep_suffixes(frame: DataFrame, path: Column, suffixes: list[str]) -> DataFrame:
    """The rows of a listing whose path ends with one of the suffixes."""
    return frame.where(has_suffix(path, suffixes))
