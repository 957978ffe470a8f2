"""Benchmark decontamination by a positional inverted index in document segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.llm.common import BATCH_ROWS, batches_of, filesystem, packed, prepared, table, texts, unpacked
from hashloom.llm.common import working_folder, written
from hashloom.llm.registry import query

#: Consecutive words of an item that make a window.
WINDOW = 10
#: Documents of one segment of the index.
SEGMENT_DOCUMENTS = 512
#: Words of windows of benchmark items that a task holds at a time.
BLOCK_WORDS = 500_000
#: Words between two documents of a segment, more than any window or span is wide.
GAP = 1 << 16

# Separators are all ASCII but letters and digits; A-Z becomes a-z; bytes of other characters stay.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def item_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


# -- the index -----------------------------------------------------------------------------------

SEGMENT = (
    "documents binary, lengths binary, nulls binary, n int, terms array<binary>, counts binary, n_terms int,"
    " postings binary, n_postings int"
)


def _segments(rows: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_of(batches, rows):
            numbers: dict[bytes, int] = {}
            codes, lengths, starts, at = [], [], [], 0
            for batch in part.to_batches():
                for text in texts(batch):
                    listed = item_words(text)
                    fresh = set(listed).difference(numbers)
                    numbers.update(zip(fresh, range(len(numbers), len(numbers) + len(fresh))))
                    codes.append(np.fromiter(map(numbers.__getitem__, listed), dtype=np.int64, count=len(listed)))
                    lengths.append(len(listed))
                    starts.append(at)
                    at += len(listed) + GAP
            code = np.concatenate(codes)
            position = np.concatenate([np.arange(n, dtype=np.int64) + s for n, s in zip(lengths, starts)])
            order = np.argsort(code, kind="stable")
            counts = np.bincount(code, minlength=len(numbers))
            position = position[order]
            # Differences within each term; the first position of a term is kept whole.
            steps = np.diff(position, prepend=0)
            first = (np.cumsum(counts) - counts)[counts > 0]
            steps[first] = position[first]
            doc_id = part.column("doc_id")
            ids = np.array(doc_id.fill_null(0).to_numpy(), dtype=np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "documents": [packed(ids.view(np.uint64))],
                    "lengths": [packed(np.array(lengths, dtype=np.uint64))],
                    "nulls": [np.packbits(doc_id.is_null().to_numpy()).tobytes()],
                    "n": pa.array([len(ids)], pa.int32()),
                    "terms": pa.array([list(numbers)], pa.list_(pa.binary())),
                    "counts": [packed(counts.astype(np.uint64))],
                    "n_terms": pa.array([len(numbers)], pa.int32()),
                    "postings": [packed(steps.astype(np.uint64))],
                    "n_postings": pa.array([len(steps)], pa.int32()),
                }
            )

    return build


def build_index(documents: DataFrame, rows: int = SEGMENT_DOCUMENTS) -> DataFrame:
    """Write the index to the shared folder: one row per segment of documents.

    A segment holds the terms of its documents and, for each term, the ascending positions of all its
    occurrences.  A match lies in one document, hence in one segment: neither building nor asking the
    index moves a posting between tasks, and a frequent term has a bounded list in each segment.
    """
    rows_in = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows_in.mapInArrow(_segments(rows), SEGMENT), "positional-index")


class Segment:
    """A segment read back: ``positions(term)``, and the document of a position."""

    def __init__(self, row: dict):
        n = row["n"]
        self.documents = unpacked(row["documents"], n).view(np.int64)
        self.nulls = np.unpackbits(np.frombuffer(row["nulls"], dtype=np.uint8), count=n).astype(bool)
        self.lengths = unpacked(row["lengths"], n).astype(np.int64)
        self.starts = np.cumsum(self.lengths + GAP) - self.lengths - GAP
        counts = unpacked(row["counts"], row["n_terms"]).astype(np.int64)
        ends = np.cumsum(counts)
        self._bounds = dict(zip(row["terms"], zip((ends - counts).tolist(), ends.tolist())))
        self._steps = unpacked(row["postings"], row["n_postings"]).astype(np.int64)
        self._lists: dict[bytes, np.ndarray] = {}

    def count(self, term: bytes) -> int:
        low, high = self._bounds.get(term, (0, 0))
        return high - low

    def positions(self, term: bytes) -> np.ndarray:
        found = self._lists.get(term)
        if found is None:
            low, high = self._bounds.get(term, (0, 0))
            found = self._lists[term] = np.cumsum(self._steps[low:high])
        return found

    def phrase(self, phrase: tuple[bytes, ...]) -> np.ndarray:
        """Positions where the phrase starts: lists shifted by their offset, rarest term first."""
        terms = sorted(enumerate(phrase), key=lambda pair: self.count(pair[1]))
        if not self.count(terms[0][1]):
            return np.zeros(0, dtype=np.int64)
        starts = self.positions(terms[0][1]) - terms[0][0]
        for offset, term in terms[1:]:
            if not len(starts):
                break
            listed = self.positions(term)
            at = np.searchsorted(listed, starts + offset)
            at[at == len(listed)] = 0
            starts = starts[listed[at] == starts + offset]
        return starts

    def near(self, terms: tuple[bytes, ...], span: int) -> np.ndarray:
        """Positions of the rarest term with every other term within fewer than ``span`` words of it."""
        ordered = sorted(set(terms), key=self.count)
        if not ordered or not self.count(ordered[0]):
            return np.zeros(0, dtype=np.int64)
        centres = self.positions(ordered[0])
        for term in ordered[1:]:
            listed = self.positions(term)
            if not len(listed) or not len(centres):
                return np.zeros(0, dtype=np.int64)
            after = np.searchsorted(listed, centres)
            right = np.abs(listed[np.minimum(after, len(listed) - 1)] - centres)
            left = np.abs(listed[np.maximum(after - 1, 0)] - centres)
            centres = centres[np.minimum(left, right) < span]
        return centres

    def document_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


# -- asking it -----------------------------------------------------------------------------------


WINDOWS, TERMS = "item string, term binary, window binary", "item string, terms binary"


def _windows(width: int, rows: int):
    """The distinct windows of each item, their words joined by a blank, with the longest word of each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for name, text in zip(batch.column("item_id").to_pylist(), texts(batch)):
                listed = item_words(text)
                count = max(1, len(listed) - width + 1) if listed else 0
                for low in range(0, count, rows):
                    found = dict.fromkeys(tuple(listed[at : at + width]) for at in range(low, min(count, low + rows)))
                    held.extend((name, max(window, key=len), b" ".join(window)) for window in found)
                    if len(held) >= rows:
                        yield _table(held, WINDOWS)
                        held = []
        if held:
            yield _table(held, WINDOWS)

    return cut


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each item, joined by a blank."""
    for batch in batches:
        named = zip(batch.column("item_id").to_pylist(), map(item_words, texts(batch)))
        yield _table([(name, b" ".join(dict.fromkeys(listed))) for name, listed in named if listed], TERMS)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "binary": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    arrays = [pa.array([row[at] for row in rows], types[kind]) for at, (_, kind) in enumerate(fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


class _Blocks:
    """The rows of a table of the shared folder in blocks of so many rows; a table of one block is kept."""

    def __init__(self, folder: str, rows: int, parse: Callable[[pa.RecordBatch], list | dict]):
        self._folder, self._rows, self._parse, self._kept = folder, rows, parse, None

    def __iter__(self) -> Iterator[list | dict]:
        if self._kept is not None:
            yield from self._kept
            return
        kept, count = [], 0
        for block in self._read():
            parsed = self._parse(block)
            count += block.num_rows
            if count <= self._rows:
                kept.append(parsed)
            else:
                kept = []
            yield parsed
        if count <= self._rows:
            self._kept = kept

    def _read(self) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs, parquet

        system, inside = filesystem(self._folder)
        names = sorted(info.path for info in system.get_file_info(fs.FileSelector(inside)))
        for name in names:
            if name.rpartition("/")[2].startswith("part-"):
                with system.open_input_file(name) as source:
                    yield from parquet.ParquetFile(source, pre_buffer=False).iter_batches(batch_size=self._rows)


def _by_term(block: pa.RecordBatch) -> dict[bytes, dict[bytes, list[str | None]]]:
    """term -> window -> the items that have it."""
    found: dict[bytes, dict[bytes, list[str | None]]] = {}
    for name, term, window in zip(*(block.column(key).to_pylist() for key in ("item", "term", "window"))):
        found.setdefault(term, {}).setdefault(window, []).append(name)
    return found


def _by_item(block: pa.RecordBatch) -> list[tuple[str | None, bytes]]:
    return list(zip(block.column("item").to_pylist(), block.column("terms").to_pylist()))


_HIT_ROW = "doc_id long, n_words long, start long, length int, items array<string>, near boolean"


def _matches(windows: str, rows: int, terms: str | None, span: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = _Blocks(windows, rows, _by_term)
        items = _Blocks(terms, BATCH_ROWS, _by_item) if terms else ()
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row)
                n = len(segment.documents)  # every document once, with its number of words
                yield _hits(segment, list(range(n)), [0] * n, [0] * n, [[]] * n, False)
                for block in listed:
                    yield from _phrases(segment, block)
                for block in items:
                    for name, joined in block:
                        centres = segment.near(tuple(joined.split(b" ")), span)
                        docs = np.unique(segment.document_of(centres)).tolist()
                        if docs:
                            nothing = [0] * len(docs)
                            yield _hits(segment, docs, nothing, nothing, [[name]] * len(docs), True)

    return ask


def _phrases(segment: Segment, block: dict[bytes, dict[bytes, list[str | None]]]) -> Iterator[pa.RecordBatch]:
    """The occurrences of a block's windows in a segment."""
    docs, at, lengths, names = [], [], [], []
    for term, windows in block.items():
        if not segment.count(term):
            continue  # a window without one of its terms occurs nowhere here
        for window, owners in windows.items():
            phrase = tuple(window.split(b" "))
            starts = segment.phrase(phrase)
            if len(starts):
                doc = segment.document_of(starts)
                docs.extend(doc.tolist())
                at.extend((starts - segment.starts[doc]).tolist())
                lengths.extend([len(phrase)] * len(starts))
                names.extend([owners] * len(starts))
    if docs:
        yield _hits(segment, docs, at, lengths, names, False)


def _hits(segment: Segment, docs: list, starts: list, lengths: list, names: list, near: bool) -> pa.RecordBatch:
    doc = np.array(docs, dtype=np.int64)
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(segment.documents[doc], mask=segment.nulls[doc]),
            "n_words": segment.lengths[doc],
            "start": pa.array(starts, pa.int64()),
            "length": pa.array(lengths, pa.int32()),
            "items": pa.array(names, pa.list_(pa.string())),
            "near": pa.array([near] * len(docs), pa.bool_()),
        }
    )


def matches(
    index: DataFrame, benchmark: DataFrame, width: int = WINDOW, span: int = 0, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Matches of the items' windows in the indexed documents.

    Rows: doc_id, n_words, start, length (a window's occurrence), items (whose windows it is), near.
    Each document has one row of length 0 beside its matches.  With ``span`` there are also rows with
    ``near``: documents where all words of an item lie within ``span`` words of its rarest one.

    Tasks cut the items into windows and write them to the shared folder; no item reaches the driver.
    Segments are asked where they lie, once: their tasks read the windows in blocks of ``block_words``
    words, again for each segment unless all are one block.  A window that lies in several blocks is
    found again with the items of each.
    """
    spark, rows = index.sparkSession, max(1, block_words // width)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    windows = working_folder(prepared(spark), "benchmark-windows")
    items.mapInArrow(_windows(width, rows), WINDOWS).write.parquet(windows)
    terms = working_folder(spark, "benchmark-terms") if span else None
    if terms:
        items.mapInArrow(_terms, TERMS).write.parquet(terms)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    return index.mapInArrow(_matches(windows, rows, terms, span), _HIT_ROW)


def contamination(
    documents: DataFrame, benchmark: DataFrame, width: int = WINDOW, span: int = 0, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items, contaminated, near_items.

    n_hit counts the words inside any occurrence of a window of any item, items lists the items with
    occurring windows sorted as strings, near_items those with a proximity match (``span`` > 0).  A null
    or empty text has no words; a null doc_id is a document as any other; rows that repeat a doc_id are
    counted as one document.  Items of fewer words than the width are one window, items without words
    are left out, equal windows of several items hit for all of them.  Items with a null id are searched
    as any other and are together one item: the null in the first place of items or near_items, counted
    in n_items.  Empty tables give no rows or no hits.  Documents without a match keep their row.
    """
    found = written(matches(build_index(documents), benchmark, width, span, block_words), "benchmark-matches")
    prepared(documents.sparkSession)
    clean = found.groupBy("doc_id").agg(F.max("n_words").alias("n_words"))
    exact = found.where(F.col("length") > 0)
    inside = exact.select("doc_id", F.explode(F.expr("sequence(start, start + length - 1)")).alias("at"))
    hit = inside.distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hit"))
    listed = found.select("doc_id", "near", F.explode("items").alias("item")).distinct()
    # Lists leave nulls out: a null id goes in as a struct.
    held = F.struct("item")
    named = listed.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.when(~F.col("near"), held))["item"]).alias("items"),
        F.sort_array(F.collect_list(F.when(F.col("near"), held))["item"]).alias("near_items"),
    )
    nothing = F.array().cast("array<string>")
    joined = clean
    for side in (hit, named):
        side = side.withColumnRenamed("doc_id", "_doc")
        joined = joined.join(side, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", nothing).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("near_items", nothing).alias("near_items"),
    )


_SPLIT = "string_split_regex(trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',\
 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')), ' ')"

SQL = f"""
WITH d AS (SELECT doc_id, list_filter({_SPLIT.format("coalesce(text, '')")}, lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter({_SPLIT.format("coalesce(text, '')")}, lambda x: x <> '') AS w
      FROM benchmark),
spans AS (SELECT item, w, unnest(range(1, greatest(2, len(w) - {WINDOW} + 2))) AS s FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, list_slice(w, s, s + {WINDOW - 1}) AS p FROM spans),
widths AS (SELECT DISTINCT len(p) AS k FROM wins),
docs AS (SELECT doc_id, w, k, unnest(range(1, greatest(1, len(w) - k + 2))) AS s FROM d, widths),
hits AS (SELECT doc_id, s, k, item FROM docs JOIN wins ON list_slice(w, s, s + k - 1) = p),
cover AS (SELECT doc_id, count(DISTINCT pos) AS n
          FROM (SELECT doc_id, unnest(range(s, s + k)) AS pos FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(cover.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(cover.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query(SQL)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
