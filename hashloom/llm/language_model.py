"""Language-model scores from a bigram trie of Elias-Fano levels on shared files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.llm import elias_fano
from hashloom.llm.common import (
    lowered,
    mapped_file,
    packed,
    packed_sorted,
    put_file,
    table,
    texts,
    unpacked,
    unpacked_sorted,
    words,
    working_folder,
    written,
)
from hashloom.llm.registry import query

#: Absolute discount of the bigrams.
DISCOUNT = 0.75
#: Added to the count of every word, and of one word that stands for all unknown ones.
ADDED = 0.5
#: Tokens whose n-grams one file of a level holds, about.
SHARD_TOKENS = 1 << 20
#: Tokens that a task counts or scores at a time.
CHUNK_TOKENS = 1 << 20
#: Steps of the quantised probabilities of a file.
STEPS = 255
#: Ids take 32 bits of a bigram's key.
_ID_BITS = 32
#: Stands for the end of a text; no word is empty.
_END = b""


def _tokens(batch_texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of some texts, each text's words and its end, and the number of each.

    A word is hashed each time it occurs: that takes less than to look it up among all words seen.
    """
    import xxhash

    listed = [[*words(lowered(text)), _END] for text in batch_texts]
    lengths = np.array([len(one) for one in listed], dtype=np.int64)
    hashes = map(xxhash.xxh3_64_intdigest, chain.from_iterable(listed))
    return np.fromiter(hashes, dtype=np.uint64, count=int(lengths.sum())), lengths


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Gathers batches to about CHUNK_TOKENS tokens: the rows, their tokens and numbers of tokens."""
    held, size = [], 0

    def give():
        return (
            pa.Table.from_batches([one[0] for one in held]),
            np.concatenate([one[1] for one in held]),
            np.concatenate([one[2] for one in held]),
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch, *_tokens(texts(batch))))
        size += len(held[-1][1])
        if size >= CHUNK_TOKENS:
            yield give()
            held, size = [], 0
    if held:
        yield give()


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs (or the sum of its counts)."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


_COUNTS = "shard int, n int, keys binary, counts binary"


def _shipped(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """Sorted keys and their counts, cut where the shard changes."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]) if len(shard) else np.zeros(1, int)
    out: dict[str, list] = {"shard": [], "n": [], "keys": [], "counts": []}
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        out["shard"].append(int(shard[low]))
        out["n"].append(high - low)
        out["keys"].append(packed_sorted(keys[low:high]))
        out["counts"].append(packed(counts[low:high].astype(np.uint64)))
    kinds = [("shard", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]
    return pa.RecordBatch.from_pydict(out, schema=pa.schema(kinds))


def _summed(pieces: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([unpacked_sorted(data, n) for data, n in zip(pieces["keys"], pieces["n"])])
    counts = np.concatenate([unpacked(data, n) for data, n in zip(pieces["counts"], pieces["n"])])
    return _counted(keys, counts.astype(np.int64))


# -- level 1: words ------------------------------------------------------------------------------


def _hash_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _shard_start(shard: int, shards: int) -> int:
    """The smallest hash of a shard."""
    return -(-(shard << 32) // shards) << 32


def _count_words(shards: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for _, tokens, _ in _chunks(batches):
            new, times = _counted(tokens)
            keys, counts = _counted(np.concatenate([keys, new]), np.concatenate([counts, times]))
            if len(keys) > 4 * CHUNK_TOKENS:
                yield _shipped(keys, counts, _hash_shard(keys, shards))
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield _shipped(keys, counts, _hash_shard(keys, shards))

    return count


_WORD_FILE = "shard int, n long, total long, path string"


def _write_words(folder: str, shards: int):
    def write(pieces: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _summed(pieces)
        shard, path = int(pieces["shard"].iloc[0]), f"{folder}/words-{uuid.uuid4().hex}"
        start = _shard_start(shard, shards)
        sequence = elias_fano.encode(keys - np.uint64(start), _shard_start(shard + 1, shards) - start)
        before = np.cumsum(counts) - counts
        data = elias_fano.to_bytes({}, {"counts": counts.astype("<i8"), "before": before.astype("<i8")}, {"keys": sequence})
        put_file(path, data)
        return pd.DataFrame([(shard, len(keys), int(counts.sum()), path)], columns=["shard", "n", "total", "path"])

    return write


# -- the model as tasks see it ------------------------------------------------------------------


@dataclass
class Model:
    """Where the levels are; files are mapped when they are first asked.

    The driver and every task hold a few numbers per file, and the number of types of contexts that
    begin or end a file.  Word ids are ranks of word hashes; id V is the beginning of a text.
    """

    shards: int
    word_paths: dict[int, str]
    first_ids: np.ndarray  # the first id of each shard of words, then V
    first_mass: np.ndarray  # the tokens before each shard, then N
    texts: int  # training texts
    bigram_shards: int = 1
    bigram_paths: dict[int, str] = field(default_factory=dict)
    cut_types: dict[int, int] = field(default_factory=dict)
    _open: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    @property
    def vocabulary(self) -> int:
        return int(self.first_ids[-1])

    @property
    def tokens(self) -> int:
        return int(self.first_mass[-1])

    def file(self, path: str):
        if path not in self._open:
            self._open[path] = elias_fano.from_bytes(mapped_file(path))
        return self._open[path]

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (-1: unknown), counts and the tokens before them, of ascending distinct word hashes."""
        ids = np.full(len(hashes), -1, dtype=np.int64)
        counts, before = np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        shard = _hash_shard(hashes, self.shards)
        edges = np.searchsorted(shard, np.arange(self.shards + 1))
        for own in np.unique(shard).tolist():
            if own not in self.word_paths:
                continue
            part = slice(edges[own], edges[own + 1])
            _, arrays, sequences = self.file(self.word_paths[own])
            at, equal = sequences["keys"].successors(hashes[part] - np.uint64(_shard_start(own, self.shards)))
            found = np.flatnonzero(equal)
            at = at[found]
            ids[part][found] = at + self.first_ids[own]
            counts[part][found] = arrays["counts"][at]
            before[part][found] = arrays["before"][at] + self.first_mass[own]
        return ids, counts, before

    def bigram_shard(self, before: np.ndarray, counts: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The file of a bigram: contexts lie one after the other, each as long as it is frequent.

        The line is cut into equal pieces, so a context that is more frequent than a piece is long takes
        several files, cut by the id of the following word.  The order is that of (context, word).
        """
        place = before + (counts * (word / max(1, self.vocabulary))).astype(np.int64)
        line = self.tokens + self.texts
        return np.minimum(place * (self.bigram_shards / max(1, line)), self.bigram_shards - 1).astype(np.int64)


def _numbered(model: Model, tokens: np.ndarray, lengths: np.ndarray):
    """Ids and counts of tokens, and of the tokens before them: (ids, counts, contexts, mass before, context counts)."""
    distinct, place = np.unique(tokens, return_inverse=True)
    ids, counts, before = (one[place] for one in model.lookup(distinct))
    starts = np.cumsum(lengths) - lengths

    def shifted(values: np.ndarray, begin: int) -> np.ndarray:
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[starts] = begin
        return out

    return (
        ids,
        counts,
        shifted(ids, model.vocabulary),
        shifted(before, model.tokens),
        shifted(counts, model.texts),
    )


# -- level 2: bigrams -----------------------------------------------------------------------------


def _count_bigrams(model: Model):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def ship():
            keys = np.concatenate([one[0] for one in held])
            shard = np.concatenate([one[2] for one in held])
            counts = np.concatenate([one[1] for one in held])
            order = np.argsort(keys, kind="stable")
            keys, counts, shard = keys[order], counts[order], shard[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return _shipped(keys[first], np.add.reduceat(counts, first), shard[first])

        for _, tokens, lengths in _chunks(batches):
            ids, _, contexts, before, counts = _numbered(model, tokens, lengths)
            keys = (contexts.astype(np.uint64) << np.uint64(_ID_BITS)) | ids.astype(np.uint64)
            distinct, first, times = np.unique(keys, return_index=True, return_counts=True)
            held.append((distinct, times, model.bigram_shard(before[first], counts[first], ids[first])))
            size += len(distinct)
            if size > 4 * CHUNK_TOKENS:
                yield ship()
                held, size = [], 0
        if held:
            yield ship()

    return count


_BIGRAM_FILE = "shard int, n long, low long, low_types long, high long, high_types long, path string"


def _write_bigrams(model: Model, folder: str):
    def write(pieces: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _summed(pieces)
        shard, path = int(pieces["shard"].iloc[0]), f"{folder}/bigrams-{uuid.uuid4().hex}"
        contexts = keys >> np.uint64(_ID_BITS)
        following = keys & np.uint64((1 << _ID_BITS) - 1)
        own, starts = np.unique(contexts, return_index=True)
        place = np.searchsorted(own, contexts)
        types = np.diff(np.append(starts, len(keys)))
        totals = _context_totals(model, own.astype(np.int64))
        share = np.log10(np.maximum(counts - DISCOUNT, 1e-9) / totals[place])
        least, most = float(share.min()), float(share.max())
        step = max(1e-12, (most - least) / STEPS)
        codes = np.rint((share - least) / step).astype(np.uint8)
        width = model.vocabulary + 1
        data = elias_fano.to_bytes(
            {"least": least, "step": step, "width": width},
            {"codes": codes},
            {
                "contexts": elias_fano.encode(own, width),
                "pointers": elias_fano.encode(np.append(starts, len(keys)), len(keys) + 1),
                "children": elias_fano.encode(place.astype(np.uint64) * np.uint64(width) + following, len(own) * width),
            },
        )
        put_file(path, data)
        row = (shard, len(keys), int(own[0]), int(types[0]), int(own[-1]), int(types[-1]), path)
        return pd.DataFrame([row], columns=[name.split()[0] for name in _BIGRAM_FILE.split(", ")])

    return write


def _context_totals(model: Model, contexts: np.ndarray) -> np.ndarray:
    """How often each context id was followed by a token."""
    totals = np.full(len(contexts), model.texts, dtype=np.int64)
    shard = np.searchsorted(model.first_ids, contexts, side="right") - 1
    for own in np.unique(shard).tolist():
        if own < model.shards:
            some = np.flatnonzero(shard == own)
            _, arrays, _ = model.file(model.word_paths[own])
            totals[some] = arrays["counts"][contexts[some] - model.first_ids[own]]
    return totals


def _bigram_scores(model: Model, contexts, before, counts, ids, single: np.ndarray) -> np.ndarray:
    """log10 of the interpolated probability of each distinct (context, word), sorted by both."""
    result = single.copy()
    known = np.flatnonzero(contexts >= 0)
    shard = model.bigram_shard(before[known], counts[known], np.maximum(ids[known], 0))
    for own in np.unique(shard).tolist():
        some = known[shard == own]
        share = np.zeros(len(some))
        types = np.zeros(len(some))
        if own in model.bigram_paths:
            header, arrays, sequences = model.file(model.bigram_paths[own])
            node, present = sequences["contexts"].successors(contexts[some].astype(np.uint64))
            node = np.where(present, node, 0)
            pointers = sequences["pointers"]
            types = np.where(present, pointers.values(node + 1).astype(float) - pointers.values(node), 0.0)
            # The word is searched for relative to its context: children of node k start at k * width.
            word = np.where(ids[some] >= 0, ids[some], header["width"] - 1)
            child, equal = sequences["children"].successors((node * header["width"] + word).astype(np.uint64))
            equal &= present & (ids[some] >= 0)
            found = np.flatnonzero(equal)
            share[found] = 10 ** (header["least"] + header["step"] * arrays["codes"][child[found]])
        if model.cut_types:
            cut = np.array(sorted(model.cut_types), dtype=np.int64)
            sums = np.array([model.cut_types[one] for one in cut.tolist()], dtype=float)
            at = np.minimum(np.searchsorted(cut, contexts[some]), len(cut) - 1)
            types = np.where(cut[at] == contexts[some], sums[at], types)
        weight = DISCOUNT * types / np.maximum(counts[some], 1)
        result[some] = np.log10(share + weight * 10 ** single[some])
    return result


# -- training and scoring --------------------------------------------------------------------------


def train(documents: DataFrame) -> Model:
    """Count words, then bigrams, of all texts of ``documents`` and write both levels to the shared folder.

    Tasks count before they ship; what they ship are sorted keys cut by shard, merged by the task that
    writes the shard's file.  The number of shards grows with the text.  Bigrams are interpolated:
    p(w | c) = max(n(c, w) - D, 0) / n(c) + D * types(c) / n(c) * p(w), p(w) = (n(w) + 0.5) / (N + 0.5 (V + 1)).
    The first part is quantised to 8 bits in each file; n(w) and types(c) are exact.
    """
    spark = documents.sparkSession
    rows = documents.select("text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(1, (size[0] // 6 + size[1]) // SHARD_TOKENS)
    folder = working_folder(spark, "language-model")
    counted = rows.mapInArrow(_count_words(shards), _COUNTS)
    files = written(counted.groupBy("shard").applyInPandas(_write_words(folder, shards), _WORD_FILE), "lm-words").collect()
    numbers, totals = np.zeros(shards, np.int64), np.zeros(shards, np.int64)
    for row in files:
        numbers[row["shard"]], totals[row["shard"]] = row["n"], row["total"]
    model = Model(
        shards,
        {row["shard"]: row["path"] for row in files},
        np.concatenate([[0], np.cumsum(numbers)]),
        np.concatenate([[0], np.cumsum(totals)]),
        size[1],
        shards,
    )
    if model.vocabulary >= 1 << _ID_BITS:
        raise ValueError(f"{model.vocabulary} distinct words are more than ids of {_ID_BITS} bits can name")
    pairs = rows.mapInArrow(_count_bigrams(model), _COUNTS)
    files = written(pairs.groupBy("shard").applyInPandas(_write_bigrams(model, folder), _BIGRAM_FILE), "lm-bigrams")
    for row in files.collect():
        model.bigram_paths[row["shard"]] = row["path"]
        ends = {(row["low"], row["low_types"]), (row["high"], row["high_types"])}
        for context, types in ends:
            model.cut_types[context] = model.cut_types.get(context, 0) + types
    return model


_SCORE = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _score(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.log10(model.tokens + ADDED * (model.vocabulary + 1))
        for rows, tokens, lengths in _chunks(batches):
            ids, own, contexts, before, counts = _numbered(model, tokens, lengths)
            single = np.log10(own + ADDED) - total
            keys = (np.where(contexts < 0, (1 << _ID_BITS) - 1, contexts).astype(np.uint64) << np.uint64(_ID_BITS)) | (
                ids & ((1 << _ID_BITS) - 1)
            ).astype(np.uint64)
            _, first, place = np.unique(keys, return_index=True, return_inverse=True)
            both = _bigram_scores(model, contexts[first], before[first], counts[first], ids[first], single[first])
            starts = np.cumsum(lengths) - lengths
            columns = [
                rows.column("doc_id").combine_chunks(),
                pa.array(lengths),
                pa.array(np.add.reduceat((own > 0).astype(np.int64), starts)),
                pa.array(np.add.reduceat(single, starts)),
                pa.array(np.add.reduceat(both[place], starts)),
            ]
            names = [column.split()[0] for column in _SCORE.split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return score


def _remainder():
    return F.crc32(F.col("doc_id").cast("string")) % 5


def language_model_scores(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on all documents whose crc32 of doc_id as text, mod 5, is not 1.  Tokens are words between
    ASCII white space with A-Z as a-z, then one end.  A null text is the empty text: its end is scored.
    A document without id is scored, not held out and never trained on; repeated rows are trained on
    and scored each.  Without training documents every token has probability 1 (score 0).  An empty
    table gives no rows.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(rows.where(_remainder() != 1))
    scored = rows.mapInArrow(_score(model), _SCORE)
    return scored.select(
        "doc_id",
        F.coalesce(_remainder() == 1, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


@query()
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))
