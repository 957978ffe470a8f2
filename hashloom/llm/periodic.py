"""Periodic runs of words, found through string synchronising sets at dyadic scales."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.llm.common import mixed, table, texts, words
from hashloom.llm.registry import query

#: A run repeats its period at least so often and has at least so many words.
REPEATS, LEAST_WORDS = 4, 6
#: Periods below the first scale are found by comparing words directly.
FIRST_SCALE = 4
#: Words that are searched together; a longer text is searched alone.
GROUP_WORDS = 1_000_000
#: Words whose numbers are remembered between groups.
REMEMBERED = 400_000

_FACTOR, _NEVER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFFFFFFFFFF)


class WordNumbers(dict):
    """Numbers of words, so that equal numbers mean equal words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def of(self, listed: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, listed), dtype=np.int64, count=len(listed))


def _streaks(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each stretch of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _matching(left: np.ndarray, right: np.ndarray) -> int:
    """Length of the common beginning, compared in blocks of growing size."""
    at, size, most = 0, 64, min(len(left), len(right))
    while at < most:
        differing = left[at : min(at + size, most)] != right[at : min(at + size, most)]
        if differing.any():
            return at + int(differing.argmax())
        at += size
        size *= 2
    return most


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, width a power of two."""
    size = 1
    while size < width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return values


def repetitions(numbers: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all maximal repetitions with REPEATS periods or more.

    ``numbers`` holds texts of at most ``longest`` words, each followed by a number that occurs nowhere else,
    so that nothing reaches across.

    Periods below FIRST_SCALE are read off words equal to the one so many before.  At scale t, a power of two,
    positions are selected by the hashes of their t words: position i if the least hash among
    i .. i + t is that of i or that of i + t.  Positions in stretches of period t / 4 or less, known from smaller scales, don't take
    part.  Selection depends on 2t words only, and each stretch of t positions has a selected one unless its 3t - 1 words
    have period t / 4.  A repetition of period p, t <= p < 2t, spans 4p words: one of its first t
    positions is selected, the position p on is too, and no equal context is selected between.  So the
    distance of next selected positions with equal contexts proposes every such period; proposals are
    confirmed by comparing the words themselves.
    """
    found: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()
    for period in range(1, FIRST_SCALE):
        starts, ends = _streaks(numbers[period:] == numbers[:-period])
        enough = ends - starts >= (REPEATS - 1) * period
        for start, end in zip(starts[enough].tolist(), (ends[enough] + period).tolist()):
            if (start, end) not in known:
                known.add((start, end))
                found.append((start, end, period))
    place, names, scale = np.arange(len(numbers)), mixed(numbers.view(np.uint64)), 1
    breaks = np.flatnonzero(numbers < 0)
    sizes = np.diff(np.concatenate([[-1], breaks]))  # words of each text and its mark
    while scale * REPEATS <= longest:
        if scale >= FIRST_SCALE:
            held = np.repeat(sizes > scale * REPEATS, sizes)
            if held.sum() < 0.7 * len(held):  # shorter texts have no repetition at this scale or beyond
                numbers, place, names, sizes = numbers[held], place[held], names[held], sizes[sizes > scale * REPEATS]
            _at_scale(numbers, place, names, scale, found, known)
        longer = names.copy()
        with np.errstate(over="ignore"):
            longer[:-scale] = names[:-scale] * _FACTOR + names[scale:]
        names, scale = mixed(longer), 2 * scale
    return found


def _at_scale(numbers, place, names, scale, found, known) -> None:
    count = len(numbers) - 2 * scale + 1
    if count <= 0:
        return
    hashes = names[: len(numbers) - scale + 1]
    periodic = [(s, e) for s, e, p in found if 4 * p <= scale and e - s >= scale]
    if periodic:
        starts = np.searchsorted(place, [s for s, _ in periodic])
        there = place[np.minimum(starts, len(place) - 1)] == [s for s, _ in periodic]
        ends = starts + [e - s - scale + 1 for s, e in periodic]
        marks = np.zeros(len(numbers) + 1, dtype=np.int64)
        np.add.at(marks, starts[there], 1)
        np.add.at(marks, ends[there], -1)
        hashes = np.where(np.cumsum(marks)[: len(hashes)] > 0, _NEVER, hashes)
    least = _window_min(hashes, scale)
    least = np.minimum(least[:count], least[1 : count + 1])
    chosen = (least != _NEVER) & ((least == hashes[:count]) | (least == hashes[scale : scale + count]))
    at = np.flatnonzero(chosen)
    with np.errstate(over="ignore"):
        contexts = names[at] * _FACTOR + names[at + scale]
    order = np.argsort(contexts, kind="stable")
    same = contexts[order[1:]] == contexts[order[:-1]]
    first, period = at[order[:-1]][same], (at[order[1:]] - at[order[:-1]])[same]
    fits = (period >= scale) & (period < 2 * scale) & (first + 3 * period <= len(numbers))
    first, period = first[fits], period[fits]
    # From one of the first positions of a repetition three whole periods follow.
    fits = (numbers[first + 3 * period - 1] == numbers[first + 2 * period - 1]) & (
        numbers[first + 2 * period] == numbers[first + period]
    )
    first, period = first[fits], period[fits]
    order = np.lexsort((first, period))
    last = (0, 0, 0)
    for start, step in zip(first[order].tolist(), period[order].tolist()):
        if step == last[0] and last[1] <= start < last[2]:
            continue
        right = _matching(numbers[start:], numbers[start + step :])
        left = _matching(numbers[:start][::-1], numbers[: start + step][::-1])
        last = (step, start - left, start + right + step)
        if last[2] - last[1] >= REPEATS * step:
            span = (int(place[last[1]]), int(place[last[2] - 1]) + 1)
            if span not in known:  # a known one has a smaller period
                known.add(span)
                found.append((*span, step))


def runs_of(listed: list[list[bytes]], numbers: WordNumbers | None = None) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, smallest period), by start, then period."""
    numbers = WordNumbers() if numbers is None else numbers
    parts, starts, at = [], [], 0
    for k, own in enumerate(listed):
        parts += [numbers.of(own), np.array([-1 - k])]
        starts.append(at)
        at += len(own) + 1
    runs: list[list[tuple[int, int, int]]] = [[] for _ in listed]
    if not listed:
        return runs
    for start, end, period in repetitions(np.concatenate(parts), max(map(len, listed))):
        if end - start >= max(LEAST_WORDS, REPEATS * period):
            k = int(np.searchsorted(starts, start, side="right")) - 1
            runs[k].append((start - starts[k], end - start, period))
    for own in runs:
        own.sort(key=lambda run: (run[0], run[2]))
    return runs


def without_repeats(own: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not runs:
        return own
    kept = np.ones(len(own), dtype=bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [own[at] for at in np.flatnonzero(kept).tolist()]


RUNS = "array<struct<start:long,length:long,period:long>>"


def collapse_runs(documents: DataFrame, words_of: Callable[[object, bytes], list[bytes]] | None = None) -> DataFrame:
    """One row per row of documents: doc_id, runs (start, length, period in words), text without their repeats.

    A run is a stretch of words with smallest period p, as long as it can be, of LEAST_WORDS words and REPEATS
    periods at least.  Of each run the first period is kept; kept words are joined by one space.
    ``words_of`` cuts (doc_id, text) into words, by default at ASCII white space.  A null or empty text has no
    words, no runs and an empty result; a null doc_id is passed on; repeated rows are searched each; other
    columns are not read; an empty table gives no rows.  A text is searched whole by one task, in memory of
    about 100 bytes a word, texts beyond GROUP_WORDS words one at a time.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    cut = words_of or (lambda doc_id, text: words(text))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        schema = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

        def finished(doc_ids, held):
            if len(numbers) > REMEMBERED:
                numbers.clear()
            runs = runs_of(held, numbers)
            rows = [[dict(zip(("start", "length", "period"), run)) for run in own] for own in runs]
            kept = [b" ".join(without_repeats(own, each)) for own, each in zip(held, runs)]
            arrays = [doc_ids, pa.array(rows, schema), pa.array(kept, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "runs", "text"])

        for batch in batches:
            doc_ids, held, count, start = batch.column(0), [], 0, 0
            for doc_id, text in zip(doc_ids.to_pylist(), texts(batch)):
                own = cut(doc_id, text)
                if held and count + len(own) > GROUP_WORDS:
                    yield finished(doc_ids.slice(start, len(held)), held)
                    start, held, count = start + len(held), [], 0
                held.append(own)
                count += len(own) + 1
            if held:
                yield finished(doc_ids.slice(start, len(held)), held)

    found = documents.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, runs {RUNS}, text binary")
    return found.withColumn("text", F.col("text").cast("string"))


def planted_words(doc_id, text: bytes) -> list[bytes]:
    """The words of a document; in a tenth of them, by a hash of doc_id, the end repeats a stretch of words."""
    own = words(text)
    if doc_id is None or not own:
        return own
    chance = zlib.crc32(str(doc_id).encode())
    if chance % 10:
        return own
    n, seed = len(own), chance // 10
    start = seed % n
    period = 1 + (n - start) // (3 + seed % 8)
    return own[:start] + [own[start + (i - start) % period] for i in range(start, n)]


@query()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(table(spark, sf_dir, "documents"), planted_words)
    # Runs come by start, then period; only a greater exponent takes the place of the one before.
    best = F.expr(
        """reduce(runs, cast(null AS struct<start:bigint,length:bigint,period:bigint>), (best, run) ->
           CASE WHEN best IS NULL OR run.length * best.period > best.length * run.period THEN run ELSE best END)"""
    )
    lines = F.expr("transform(runs, run -> concat(run.start, ',', run.length, ',', run.period, '\\n'))")
    named = found.withColumn("best", best)
    return named.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
