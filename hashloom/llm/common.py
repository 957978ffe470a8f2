"""Helpers of the training-data operators: words, packed integers, shared files, distributed ranks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from hashloom.session import configure, working_folder, written

__all__ = ["prepared", "ranked", "cell_bits", "written", "working_folder"]

#: Rows of one Arrow batch.  A row holds a whole document, so batches are cut by few rows.
BATCH_ROWS = 256
#: Settings of Python tasks over whole texts; the zlib level only concerns Spark's own codecs.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the library's settings and small Arrow batches."""
    configure(spark)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null is the empty text."""
    return [value or b"" for value in batch.column(column).cast(pa.binary()).to_pylist()]


def lowered(text: bytes) -> bytes:
    """A-Z to a-z; bytes.lower() leaves all other bytes of UTF-8 alone."""
    return text.lower()


def words(text: bytes) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+``: bytes.split() splits at exactly these six bytes."""
    return text.split()


# -- integers in bytes ---------------------------------------------------------------------------


def packed(values: np.ndarray) -> bytes:
    """Unsigned 64-bit integers as compressed byte planes; sorted ones should be given as differences."""
    planes = np.ascontiguousarray(values.astype("<u8", copy=False)).view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, dtype=np.uint64)
    raw = pa.decompress(data, decompressed_size=8 * count, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(8, count)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def packed_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as packed differences."""
    return packed(np.diff(values.astype(np.uint64, copy=False), prepend=np.uint64(0)))


def unpacked_sorted(data: bytes, count: int) -> np.ndarray:
    return np.cumsum(unpacked(data, count), dtype=np.uint64)


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (finaliser of SplitMix64)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


class WordHashes:
    """64-bit hashes of words, remembered up to a number of words, after which memory starts anew."""

    def __init__(self, remembered: int = 400_000):
        import xxhash

        self._digest, self._known, self._remembered = xxhash.xxh3_64_intdigest, {}, remembered

    def of(self, listed: list[bytes]) -> np.ndarray:
        known = self._known
        if len(known) > self._remembered:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, listed), dtype=np.uint64, count=len(listed))
        except KeyError:
            digest = self._digest
            for word in set(listed).difference(known):
                known[word] = digest(word)
            return np.fromiter(map(known.__getitem__, listed), dtype=np.uint64, count=len(listed))


def rolling(hashes: np.ndarray, width: int, factor: int) -> np.ndarray:
    """One 64-bit value per window of consecutive hashes, a polynomial in an odd factor, then mixed."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    # Doubling: a window of 2w is a window of w times factor^w plus the next one.
    power, have, total, done = np.uint64(factor), hashes, np.zeros(count, dtype=np.uint64), 0
    size, remaining = 1, width
    with np.errstate(over="ignore"):
        while remaining:
            if remaining & 1:
                total = total * power + have[done : done + count]
                done += size
            remaining >>= 1
            if remaining:
                have = have[:-size] * power + have[size:]
                power = power * power
                size *= 2
    return mixed(total)


# -- files that all tasks see ----------------------------------------------------------------------


def filesystem(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if re.match(r"\w+://", path) else (fs.LocalFileSystem(), path)


def put_file(path: str, data: bytes) -> None:
    """Write a file of the shared folder; a retried task writes the same bytes under its own name."""
    from pyarrow import fs

    system, inside = filesystem(path)
    if isinstance(system, fs.LocalFileSystem):
        system.create_dir(inside.rpartition("/")[0], recursive=True)
    with system.open_output_stream(inside) as out:
        out.write(data)


def mapped_file(path: str) -> np.ndarray:
    """The bytes of a shared file: memory-mapped where the folder is mounted, else read."""
    from pyarrow import fs

    system, inside = filesystem(path)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(inside, dtype=np.uint8, mode="r")
    with system.open_input_file(inside) as source:
        return np.frombuffer(source.read(), dtype=np.uint8)


# -- ranks without one task per group --------------------------------------------------------------


def cell_bits(rows: int) -> int:
    """Bits that split rows into about sqrt(rows) cells, so neither cells nor their list get large."""
    return max(1, math.ceil(math.log2(max(2, rows)) / 2))


def cell_of(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits)


def same(left: DataFrame, right: DataFrame, columns: Iterable[str]) -> Column:
    condition = F.lit(True)
    for name in columns:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def ranked(frame: DataFrame, group: str, key: str, ties: list[str], bits: int) -> DataFrame:
    """Add ``rank`` (from 0) and ``group_rows`` within each value of ``group``, ordered by a hash.

    The rows of a group are cut into 2^bits cells of the 64-bit hash ``key``; cells are counted, the
    counts summed up in order of the cells, and rows are only sorted within a cell.  A group of any
    size is thus spread over many tasks, as long as the key tells its rows apart; rows of one key go by ``ties``.  Null is
    a group of its own.
    """
    rows = frame.withColumn("_cell", cell_of(F.col(key), bits))
    counts = rows.groupBy(F.col(group).alias("_group"), F.col("_cell").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    each = Window.partitionBy("_group")
    before = each.orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select(
        "_group",
        "_at",
        (F.sum("_n").over(before) - F.col("_n")).alias("_before"),
        F.sum("_n").over(each).alias("group_rows"),
    )
    joined = rows.join(offsets, rows[group].eqNullSafe(offsets["_group"]) & (rows["_cell"] == offsets["_at"]))
    inside = Window.partitionBy(group, "_cell").orderBy(key, *ties)
    rank = F.col("_before") + F.row_number().over(inside) - 1
    return joined.withColumn("rank", rank.cast("long")).drop("_cell", "_group", "_at", "_before")


#: Bits of the number of words in the bit table of ``thinned``; a word has 64 bits.
THIN_WORDS = 18


def thinned(frame: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows of a frame whose ``column`` may be among the values of the same column of ``wanted``.

    A value hashes to one bit of a table of 2^THIN_WORDS words, which is what is broadcast, however much is
    wanted.  No wanted row is lost; rows that share a bit with a wanted one pass too, more of them the more is
    wanted, so a join must follow.  It saves that join the shuffle of what cannot match.
    """
    hashed = F.xxhash64(column)
    word, bit = F.shiftrightunsigned(hashed, 64 - THIN_WORDS), hashed.bitwiseAND(F.lit(63)).cast("int")
    mask = F.expr("shiftleft(1L, _bit)")
    bits = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(mask).alias("_bits"))
    marked = frame.withColumns({"_at": word, "_bit": bit})
    joined = marked.join(F.broadcast(bits), marked["_at"] == bits["_word"])
    return joined.where(F.col("_bits").bitwiseAND(mask) != 0).select(*frame.columns)


def counted(frame: DataFrame, purpose: str, **sums: Column) -> tuple[DataFrame, dict[str, int]]:
    """A frame written to the shared folder and read back, with its number of ``rows`` and further sums, which the
    writing tasks count on the way."""
    spark, seen, path = frame.sparkSession, Observation(), working_folder(frame.sparkSession, purpose)
    totals = [F.sum(column.cast("long")).alias(name) for name, column in sums.items()]
    frame.observe(seen, F.count(F.lit(1)).alias("rows"), *totals).write.parquet(path)
    found = seen.get
    return spark.read.schema(frame.schema).parquet(path), {name: found.get(name) or 0 for name in ("rows", *sums)}


def batches_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Arrow batches gathered to tables of at least ``rows`` rows (the last may be smaller)."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held)
            held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)
