"""Removal of passages that repeat across documents, with a count-min prefilter of word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.llm.common import (
    WordHashes,
    filesystem,
    mixed,
    packed,
    packed_sorted,
    rolling,
    table,
    texts,
    unpacked,
    unpacked_sorted,
    words,
    working_folder,
    written,
)
from hashloom.llm.registry import query

#: Consecutive words of a window.
WINDOW = 50
#: Rows of the sketch, and cells of a row per window of the corpus (as a power of two).
SKETCH_ROWS, SPARE_BITS = 2, 6
#: Rows of a file that make a block, and windows that a task merges at a time.
BLOCK_ROWS, SHARD_WINDOWS = 2_048, 1 << 20
#: Windows after which a block is sketched as one more fragment, which bounds a task's memory.
FRAGMENT_WINDOWS = 1 << 21

_FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_NO_ID = np.iinfo(np.int64).max


# -- documents in blocks ---------------------------------------------------------------------------


def _blocked(documents: DataFrame, stored: bool) -> DataFrame:
    """doc_id, text, block, at: a row's block is its file and the number of its row there.

    This name of a row is the same in every pass whatever splits and executors read it, so later passes
    find what earlier ones learnt about the block, and no text has to move to meet it.  A frame that
    isn't a plain scan is written first.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows if stored else written(rows, "substring-documents")
    at = F.col("_metadata.row_index")
    return rows.select(
        "doc_id",
        "text",
        F.xxhash64("_metadata.file_path", F.floor(at / BLOCK_ROWS)).alias("block"),
        (at % BLOCK_ROWS).cast("long").alias("at"),
    )


def _runs(blocks: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(block, first row, end row) of the runs of equal blocks in a batch."""
    edges = np.flatnonzero(np.diff(blocks)) + 1
    for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)]):
        if high > low:
            yield int(blocks[low]), low, high


class _Windows:
    """All windows of some texts: hash values, the text's row and the position of the first word."""

    def __init__(self, listed: list[list[bytes]], hashes: WordHashes):
        lengths = np.array([len(one) for one in listed], dtype=np.int64)
        self.values = np.concatenate([hashes.of(one) for one in listed]) if listed else np.zeros(0, np.uint64)
        count = max(0, len(self.values) - WINDOW + 1)
        row = np.repeat(np.arange(len(listed)), lengths)[:count]
        position = np.arange(count) - (np.cumsum(lengths) - lengths)[row]
        self.inside = np.flatnonzero(position <= lengths[row] - WINDOW)
        self.row, self.position = row[self.inside], position[self.inside]
        self.first = rolling(self.values, WINDOW, _FIRST)[self.inside]

    def second(self) -> np.ndarray:
        return rolling(self.values, WINDOW, _SECOND)[self.inside] >> np.uint64(32)


def _cells(first: np.ndarray, row: int, bits: int) -> np.ndarray:
    spread = first if row == 0 else mixed(first + np.uint64(row))
    return spread >> np.uint64(64 - bits)


# -- pass 1: sketches ----------------------------------------------------------------------------

_PIECE = "shard int, block long, n int, cells binary, repeated binary"


def _sketches(bits: int, shards: int):
    """One sparse count-min sketch per block: in each row the cells that occur, and those that occur twice."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size, current = WordHashes(), [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            first = np.concatenate(held)
            out: dict[str, list] = {name.split()[0]: [] for name in _PIECE.split(", ")}
            for row in range(SKETCH_ROWS):
                cells, counts = np.unique(_cells(first, row, bits), return_counts=True)
                owner = _scaled(cells << np.uint64(64 - bits), shards)
                edges = np.searchsorted(owner, np.arange(shards + 1, dtype=np.uint64))
                for shard in np.flatnonzero(np.diff(edges)).tolist():
                    part = slice(edges[shard], edges[shard + 1])
                    out["shard"].append(row * shards + shard)
                    out["block"].append(current)
                    out["n"].append(int(edges[shard + 1] - edges[shard]))
                    out["cells"].append(packed_sorted(cells[part]))
                    out["repeated"].append(np.packbits(counts[part] > 1).tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=_arrow(_PIECE))

        for batch in batches:
            listed = [words(text) for text in texts(batch)]
            for block, low, high in _runs(batch.column("block").to_numpy()):
                if held and (block != current or size > FRAGMENT_WINDOWS):
                    yield from flush()
                    held, size = [], 0
                current = block
                first = _Windows(listed[low:high], hashes).first
                held.append(first)
                size += len(first)
        if held:
            yield from flush()

    return sketch


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (column.split() for column in schema.split(", "))])


_LEARNT = "block long, kind int, n int, data binary"


def _merge_sketches(pieces: pd.DataFrame) -> pd.DataFrame:
    """Add up one range of cells of all sketches; give each block those of its cells that count 2 or more."""
    cells = [unpacked_sorted(data, n) for data, n in zip(pieces["cells"], pieces["n"])]
    twice = [np.unpackbits(np.frombuffer(bits, np.uint8), count=n) for bits, n in zip(pieces["repeated"], pieces["n"])]
    every, place = np.unique(np.concatenate(cells), return_inverse=True)
    total = np.bincount(place) + np.bincount(place, weights=np.concatenate(twice))
    often = (total > 1)[place]
    kind, out, end = int(pieces["shard"].iloc[0]), [], 0
    for block, own in zip(pieces["block"], cells):
        mine = own[often[end : end + len(own)]]
        end += len(own)
        if len(mine):
            out.append((block, kind, len(mine), packed_sorted(mine)))
    return pd.DataFrame(out, columns=["block", "kind", "n", "data"])


# -- files of a block ----------------------------------------------------------------------------


def _by_block(learnt: DataFrame, purpose: str) -> str:
    """Write rows so that a task finds those of one block in one folder of the shared folder."""
    path = working_folder(learnt.sparkSession, purpose)
    learnt.repartition("block").write.partitionBy("block").parquet(path)
    return path


def _of_block(path: str, block: int) -> list[dict]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, inside = filesystem(f"{path}/block={block}")
    if system.get_file_info(inside).type == fs.FileType.NotFound:
        return []
    found = []
    for entry in system.get_file_info(fs.FileSelector(inside)):
        if entry.path.endswith(".parquet"):
            with system.open_input_file(entry.path) as source:
                found.extend(pq.ParquetFile(source).read().to_pylist())
    return found


# -- pass 2: exact grouping of the windows estimated repeated ------------------------------------

_ENTRY = "shard int, block long, n int, first binary, second binary, ids binary, codes binary, known binary, n_known int"
_CODE_BITS = np.uint64(40)


class _Estimates:
    """The repeated cells of one block, asked for many windows at once."""

    def __init__(self, path: str, block: int, shards: int, bits: int):
        cells: list[list[np.ndarray]] = [[] for _ in range(SKETCH_ROWS)]
        for row in _of_block(path, block):
            cells[row["kind"] // shards].append(unpacked_sorted(row["data"], row["n"]))
        self._bits, self._mask = bits, np.uint64((1 << 20) - 1)
        self._cells = [np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64) for own in cells]
        self._seen = []
        for own in self._cells:
            seen = np.zeros(1 << 20, dtype=bool)
            seen[own & self._mask] = True
            self._seen.append(seen)

    def repeated(self, first: np.ndarray) -> np.ndarray:
        """Indices of the windows whose smallest count over all rows of the sketch is 2 or more."""
        left = np.arange(len(first))
        for row, (own, seen) in enumerate(zip(self._cells, self._seen)):
            cells = _cells(first[left], row, self._bits)
            some = seen[cells & self._mask]
            left, cells = left[some], cells[some]
            if not len(own):
                return left[:0]
            at = np.minimum(np.searchsorted(own, cells), len(own) - 1)
            left = left[own[at] == cells]
        return left


def _candidates(path: str, bits: int, shards: int):
    """Per block, the windows estimated repeated, each with the smallest document of the block that has it.

    Occurrences in other documents of the block are already known to repeat and stay with the block.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, current, estimates = WordHashes(), [], None, None

        def flush() -> Iterator[pa.RecordBatch]:
            first, second, ids, codes = (np.concatenate(part) for part in zip(*held))
            order = np.lexsort((codes, ids, second, first))
            first, second, ids, codes = first[order], second[order], ids[order], codes[order]
            fresh = np.ones(len(first), dtype=bool)
            fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            least = ids[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            known = np.sort(codes[ids > least])
            own = ids == least
            first, second, ids, codes = first[own], second[own], ids[own], codes[own]
            out: dict[str, list] = {name.split()[0]: [] for name in _ENTRY.split(", ")}
            owner = _scaled(first, shards)
            edges = np.searchsorted(owner, np.arange(shards + 1, dtype=np.uint64))
            for shard in np.flatnonzero(np.diff(edges)).tolist():
                part = slice(edges[shard], edges[shard + 1])
                for key, value in (
                    ("shard", shard),
                    ("block", current),
                    ("n", int(edges[shard + 1] - edges[shard])),
                    ("first", packed_sorted(first[part])),
                    ("second", packed(second[part])),
                    ("ids", packed(ids[part].view(np.uint64))),
                    ("codes", packed(codes[part])),
                    ("known", None),
                    ("n_known", 0),
                ):
                    out[key].append(value)
            if len(known):
                row = {"shard": -1, "block": current, "n": 0, "known": packed_sorted(known), "n_known": len(known)}
                for key in out:
                    out[key].append(row.get(key))
            if out["shard"]:
                yield pa.RecordBatch.from_pydict(out, schema=_arrow(_ENTRY))

        for batch in batches:
            listed = [words(text) for text in texts(batch)]
            ids = np.array(batch.column("doc_id").fill_null(_NO_ID).to_numpy())
            at = batch.column("at").to_numpy().astype(np.uint64)
            for block, low, high in _runs(batch.column("block").to_numpy()):
                if block != current:
                    if held:
                        yield from flush()
                    held, current, estimates = [], block, _Estimates(path, block, shards, bits)
                found = _Windows(listed[low:high], hashes)
                some = estimates.repeated(found.first)
                if len(some):
                    row = found.row[some] + low
                    codes = (at[row] << _CODE_BITS) + found.position[some].astype(np.uint64)
                    held.append((found.first[some], found.second()[some], ids[row], codes))
        if held:
            yield from flush()

    return find


def _scaled(values: np.ndarray, shards: int) -> np.ndarray:
    """The shard of 64-bit values: equal ranges of their upper 32 bits."""
    return ((values >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _group(entries: pd.DataFrame) -> pd.DataFrame:
    """Group one range of windows exactly; give each block its occurrences after the first document."""
    counts = entries["n"].to_numpy()
    first = np.concatenate([unpacked_sorted(data, n) for data, n in zip(entries["first"], counts)])
    second = np.concatenate([unpacked(data, n) for data, n in zip(entries["second"], counts)])
    ids = np.concatenate([unpacked(data, n) for data, n in zip(entries["ids"], counts)]).view(np.int64)
    order = np.lexsort((ids, second, first))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)
    least = np.empty_like(ids)
    least[order] = ids[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    later, out, end = ids > least, [], 0
    for block, n, data in zip(entries["block"], counts, entries["codes"]):
        mine = np.sort(unpacked(data, n)[later[end : end + n]])
        end += n
        if len(mine):
            out.append((block, 0, len(mine), packed_sorted(mine)))
    return pd.DataFrame(out, columns=["block", "kind", "n", "data"])


# -- pass 3: what stays ----------------------------------------------------------------------------

_KEPT = "doc_id long, n_words long, n_removed long, kept binary"


def _removed(path: str, digest: bool):
    """Cover the words of the listed windows and keep the others, joined by one space (or their SHA-256)."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, starts = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            at = batch.column("at").to_numpy()
            blocks = batch.column("block").to_numpy()
            totals, gone, kept = [], [], []
            for row, text in enumerate(texts(batch)):
                if blocks[row] != current:
                    current = int(blocks[row])
                    learnt = [unpacked_sorted(x["data"], x["n"]) for x in _of_block(path, current)]
                    codes = np.sort(np.concatenate(learnt)) if learnt else np.zeros(0, np.uint64)
                    rows = (codes >> _CODE_BITS).astype(np.int64)
                    starts = (codes & np.uint64((1 << 40) - 1)).astype(np.int64)
                listed = words(text)
                low, high = np.searchsorted(rows, [at[row], at[row] + 1])
                removed = 0
                if high > low:
                    steps = np.bincount(starts[low:high], minlength=len(listed) + WINDOW + 1)
                    steps[WINDOW:] -= steps[:-WINDOW].copy()
                    covered = np.cumsum(steps)[: len(listed)] > 0
                    removed = int(covered.sum())
                    listed = [word for word, out in zip(listed, covered.tolist()) if not out]
                totals.append(len(listed) + removed)
                gone.append(removed)
                value = b" ".join(listed)
                kept.append(hashlib.sha256(value).hexdigest().encode() if digest else value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(totals, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return remove


def without_repeats(documents: DataFrame, stored: bool = False, digest: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept.

    Words are runs of bytes between ASCII white space, a window is 50 consecutive words of a document.
    A word goes if any window over it also starts in a document with a smaller doc_id; windows are judged
    on the input.  ``kept`` are the words that stay, joined by one space, or with ``digest`` their SHA-256.
    ``stored`` tells that the frame is a plain scan of Parquet files, which need not be written again.

    Pass 1 sketches each block of documents; ranges of cells are added up over all sketches and each
    block gets back its cells with a count of 2 or more.  Counts of a sketch are never too small, so all
    windows that repeat are among those.  Pass 2 groups only these windows exactly, by 96 bits of two
    hash functions.  Pass 3 removes words.  No pass moves a text, and a passage that repeats in a third of all
    documents leaves each block as one entry.

    Null and empty texts have no words.  A document without id comes after all others, and two such, or
    repeated rows of one doc_id, never remove words of each other.  An empty table gives no rows.
    """
    rows = _blocked(documents, stored)
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # A word and its space take six bytes or so; more windows than that only make the estimates coarser.
    windows = max(1, size // 6)
    bits = min(56, max(16, (windows - 1).bit_length() + SPARE_BITS))
    shards = -(-windows // SHARD_WINDOWS)
    pieces = rows.mapInArrow(_sketches(bits, shards), _PIECE)
    estimates = _by_block(pieces.groupBy("shard").applyInPandas(_merge_sketches, _LEARNT), "substring-estimates")
    entries = written(rows.mapInArrow(_candidates(estimates, bits, shards), _ENTRY), "substring-windows")
    grouped = entries.where("shard >= 0").groupBy("shard").applyInPandas(_group, _LEARNT)
    known = entries.where("shard < 0").select(
        "block", F.lit(1).alias("kind"), F.col("n_known").alias("n"), F.col("known").alias("data")
    )
    repeats = _by_block(grouped.unionByName(known), "substring-repeats")
    return rows.mapInArrow(_removed(repeats, digest), _KEPT)


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
wins AS (SELECT doc_id, s, sha256(array_to_string(list_slice(w, s, s + {WINDOW - 1}), ' ')) AS p
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM d WHERE len(w) >= {WINDOW})),
later AS (SELECT doc_id, s FROM (SELECT *, min(doc_id) OVER (PARTITION BY p) AS least FROM wins) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {WINDOW})) AS pos FROM later),
every AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n
         FROM every ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query(SQL)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"), stored=True, digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_sha256"))
