"""Best-fit packing of tokenized documents into sequences of bounded length."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.llm.common import cell_bits, ranked, table, texts, written
from hashloom.llm.registry import query

#: Tokens of a sequence, and the id that ends every document.
CAPACITY = 2_048
END_ID = 0
#: Words whose ids a task remembers before it starts anew.
REMEMBERED = 500_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    """The vocabulary file of the installed public tokenizers that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Letters whose lower case and normal form are plain, then marks of ASCII but the apostrophe.  The
# tokenizer puts a word of this form into lower case and splits it here; other words it gets whole.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(byte if byte in printable else next(others)) for byte in range(256)]


class WordIds:
    """Ids of texts as little-endian 32-bit integers, word by word.

    The tokenizer splits at white space before anything else and drops it, so the ids of a text are
    those of its words in order.  Words repeat, and so do their letters in other cases and before other
    marks: the ids of both are remembered, up to a number of them, after which memory starts anew.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model, self._remembered = self._tokenizer.model, remembered
        self._known: dict[bytes, bytes] = {}
        self._pieces: dict[str, bytes] = {"": b""}
        self._letters = _byte_letters()

    def _piece(self, piece: str) -> bytes:
        found = self._pieces.get(piece)
        if found is None:
            letters = piece if piece.isascii() else "".join(map(self._letters.__getitem__, piece.encode()))
            found = array("I", [token.id for token in self._model.tokenize(letters)]).tobytes()
            self._pieces[piece] = found
        return found

    def _word(self, word: str) -> bytes:
        match = _SIMPLE.fullmatch(word)
        # A special token is written in letters and marks, too; it is no simple word, as it begins with a mark.
        if match:
            return self._piece(match[1].lower()) + self._piece(match[2])
        return array("I", self._tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def of(self, text: bytes) -> bytes:
        listed, known = text.split(), self._known
        try:
            return b"".join(map(known.__getitem__, listed))
        except KeyError:
            pass
        if len(known) > self._remembered:
            known.clear()
        if len(self._pieces) > self._remembered:
            self._pieces = {"": b""}
        for word in set(listed).difference(known):
            known[word] = self._word(word.decode())
        return b"".join(map(known.__getitem__, listed))


def _cut(path: str, capacity: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task: Spark has the others
        ids = WordIds(path)
        for batch in batches:
            rows, pieces, starts, lengths, sums = [], [], [], [], []
            for row, text in enumerate(texts(batch)):
                data = ids.of(text) + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            columns = [
                batch.column("doc_id").take(pa.array(rows, pa.int64())),
                pa.array(pieces, pa.int32()),
                pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array(sums, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def pieces(
    documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and the end id, cut at the capacity.

    Only documents beyond the capacity are cut.  A null text is the empty text: one piece of length 1.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_cut(path or tokenizer_path(), capacity, end_id), PIECE)


# -- best fit over runs --------------------------------------------------------------------------
#
# Pieces of one length are interchangeable, and so are gaps of one size.  Both are therefore sorted
# as runs: (length, number of pieces) and (size, first sequence, number of sequences).  There are at
# most `capacity` runs of pieces whatever the table holds, so a sweep over all runs is small, while
# ranks within a run and the placing of pieces are work on all rows and are done by Spark.


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Place runs of pieces by bulk best fit: (length, first_rank, count, first_sequence, offset).

    Rounds over sorted runs, longest pieces first.  In one round every unplaced run of pieces that
    can still go into an open sequence is swept against the sorted gaps: a piece asks for its successor,
    the smallest gap that holds it.  Pieces that ask for the same gaps are resolved by rank: longer ones
    first, then by rank in their run; the others ask for the next gap.  Gaps are updated after the
    round, so a gap takes one piece a round, and rounds repeat until nothing fits; then the longest run
    left opens sequences.  To be as tight as best fit in decreasing order, a round only admits pieces
    longer than half of the longest unplaced one: two of those in one gap are two rounds.
    """
    placed: list[tuple[int, int, int, int, int]] = []
    left = {length: [0, count] for length, count in sorted(counts.items(), reverse=True) if count}
    gaps: dict[int, list[list[int]]] = {}  # size: runs of [first sequence, number]
    opened = 0

    def sweep(lengths: list[int]) -> bool:
        """One round: successor matching of runs against gaps as they were when the round began."""
        changed: list[tuple[int, int, int]] = []  # new size, first sequence, number
        sizes, free = sorted(gaps, reverse=True), []  # free: sizes at least as large as the length asked for
        at = 0
        for length in lengths:
            while at < len(sizes) and sizes[at] >= length:
                free.append(sizes[at])
                at += 1
            while left[length][1] and free:
                size = free[-1]
                if not gaps[size]:
                    free.pop()
                    continue
                run = gaps[size][-1]
                rank, count = left[length]
                taken = min(count, run[1])
                placed.append((length, rank, taken, run[0], capacity - size))
                changed.append((size - length, run[0], taken))
                left[length] = [rank + taken, count - taken]
                if taken == run[1]:
                    gaps[size].pop()
                else:
                    run[0] += taken
                    run[1] -= taken
        for size, first, number in changed:
            if size:
                gaps.setdefault(size, []).append([first, number])
        for size in [size for size, runs in gaps.items() if not runs]:
            del gaps[size]
        return bool(changed)

    while True:
        for length in [length for length, (_, count) in left.items() if not count]:
            del left[length]
        if not left:
            return placed
        longest = next(iter(left))
        batch = [length for length in left if 2 * length > longest]
        while sweep([length for length in batch if left[length][1]]):
            pass
        for length in batch:
            rank, count = left[length]
            if not count:
                continue
            # Nothing open holds this run: it opens sequences, as many of its pieces in each as fit.
            each = capacity // length
            full, rest = divmod(count, each)
            for slot in range(each):
                number = full + (slot < rest)
                if number:
                    placed.append((length, rank, number, opened, slot * length))
                    rank += number
            left[length] = [rank, 0]
            for first, number, used in ((opened, full, each * length), (opened + full, 1 if rest else 0, rest * length)):
                if number and used < capacity:
                    gaps.setdefault(capacity - used, []).append([first, number])
            opened += full + (1 if rest else 0)
            break  # the gaps that are left may hold the rest of this batch


def pack(
    documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces are ranked within their length in parallel (``ranked``), the numbers of pieces per length
    (at most ``capacity`` rows) are planned by ``plan_runs``, and each piece finds its place by its rank.
    Equal lengths are ordered by a hash of doc_id, piece and the piece's crc, then by these: rows without doc_id spread as
    any others, and only rows that are equal in all of them are interchangeable.  Null texts are empty, repeated rows
    are packed each, long texts are cut into as many pieces as they need; an empty table gives no rows.  Extra columns are not read.
    """
    spark = documents.sparkSession
    cut = written(pieces(documents, path, capacity, end_id), "pieces")
    counts = {row["length"]: row["n"] for row in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    keyed = cut.withColumn("_key", F.xxhash64("doc_id", "piece", "ids_crc32"))
    places = ranked(keyed, "length", "_key", ["doc_id", "piece", "ids_crc32"], cell_bits(total))
    runs = plan_runs(counts, capacity)
    # The number of runs depends on the lengths that occur, at most `capacity`, not on the rows.
    planned = spark.createDataFrame(
        [(length, rank, rank + count, first, offset) for length, rank, count, first, offset in runs],
        "run_length long, run_from long, run_to long, run_sequence long, offset long",
    )
    inside = (
        (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("run_from")) & (F.col("rank") < F.col("run_to"))
    )
    return places.join(F.broadcast(planned), inside).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("run_sequence") + F.col("rank") - F.col("run_from")).alias("sequence_id"),
        "offset",
    )


@query()
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
