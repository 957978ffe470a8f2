"""Quality classifier: regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.llm.common import batches_of, table, texts, words, written
from hashloom.llm.registry import query

#: Weight of the pooled covariance in each class covariance, and of the diagonal in the result.
POOLED, DIAGONAL = 0.1, 0.05
#: Smallest score of a predicted 1.
THRESHOLD = 0.7
#: Bytes of ordinary prose that every text is taken to have besides its own: a short text has too few
#: bytes for its shares to say much, so they are drawn towards those of prose.
DAMPING = 100

NAMES = (
    "letters",
    "upper",
    "digits",
    "spaces",
    "marks",
    "symbols",
    "word_length",
    "long_words",
    "ends_in_mark",
    "marked_words",
    "doubled_words",
    "words",
)

# Kinds of bytes: 0 other (of them all bytes of letters beyond ASCII), 1 a-z, 2 A-Z, 3 digits, 4 white space,
# 5 marks of prose, 6 other ASCII.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[33:127] = 6
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 5


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one text: damped shares as square roots, sizes as logarithms."""
    size = max(1, len(text))
    counts = np.bincount(_KIND[np.frombuffer(text, dtype=np.uint8)], minlength=7)
    listed = words(text)
    n = max(1, len(listed))
    cased = max(1, counts[1] + counts[2])
    ends = bytes(word[-1] for word in listed)
    ending = np.bincount(_KIND[np.frombuffer(ends, dtype=np.uint8)], minlength=7)
    shares = [
        (counts[0] + counts[1] + counts[2] + 0.8 * DAMPING) / (size + DAMPING),
        (counts[2] + 0.02 * DAMPING) / (cased + DAMPING),
        (counts[3] + 0.005 * DAMPING) / (size + DAMPING),
        (counts[4] + 0.15 * DAMPING) / (size + DAMPING),
        (counts[5] + 0.02 * DAMPING) / (size + DAMPING),
        (counts[6] + 0.005 * DAMPING) / (size + DAMPING),
    ]
    few = DAMPING / 5
    return [
        *np.sqrt(shares),
        np.log((size - counts[4] + 5 * few) / (n + few) + 1),
        np.sqrt((sum(len(word) > 20 for word in listed) + 0.02 * few) / (n + few)),
        np.sqrt((ending[5] + 0.1 * few) / (n + few)),
        np.sqrt((ending[6] + 0.01 * few) / (n + few)),
        np.sqrt((sum(map(eq, listed, listed[1:])) + 0.01 * few) / (n + few)),
        np.log(n + few),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([statistics(text) for text in texts(batch)]).reshape(-1, len(NAMES))
        columns = [pa.array(np.ascontiguousarray(values[:, i])) for i in range(len(NAMES))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *NAMES])


def document_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text; null is the empty text."""
    schema = "doc_id long, " + ", ".join(f"{name} double" for name in NAMES)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measured, schema)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors, log determinants and the log prior ratio of classes 0 and 1."""

    means: tuple[np.ndarray, np.ndarray]
    whiteners: tuple[np.ndarray, np.ndarray]
    log_dets: tuple[float, float]
    log_prior: float
    only: float | None = None

    def scores(self, values: np.ndarray) -> np.ndarray:
        """Probability of class 1: the logistic of the difference of the log densities."""
        if self.only is not None:
            return np.full(len(values), self.only)
        density = []
        for mean, whitener, log_det in zip(self.means, self.whiteners, self.log_dets):
            z = (values - mean) @ whitener.T
            density.append(-0.5 * (np.einsum("ij,ij->i", z, z) + log_det))
        margin = np.clip(density[1] - density[0] + self.log_prior, -500, 500)
        return 1 / (1 + np.exp(-margin))


def fit(labelled: DataFrame, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
    """Fit from all rows with a label: one aggregation gives the moments of both classes.

    The driver gets two rows of sums.  With S_k the covariance of class k and S that of both, the
    class covariance is (1 - diagonal) T + diagonal * diag(T), T = (1 - pooled) S_k + pooled S.  A class
    without rows leaves the score at the other class; without any rows the score is 0.5.
    """
    size = len(NAMES)
    sums = [F.sum(name).alias(f"s{i}") for i, name in enumerate(NAMES)]
    products = [
        F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p{i}_{j}") for i in range(size) for j in range(i, size)
    ]
    found = {
        row["quality"]: row
        for row in labelled.where(F.col("quality").isin(0, 1))
        .groupBy(F.col("quality").cast("int").alias("quality"))
        .agg(F.count(F.lit(1)).alias("n"), *sums, *products)
        .collect()
    }
    if len(found) < 2:
        only = 0.5 if not found else float(next(iter(found)))
        return Discriminant((), (), (), 0.0, only)  # type: ignore[arg-type]
    counts, means, scatters = [], [], []
    for label in (0, 1):
        row = found[label]
        n = row["n"]
        mean = np.array([row[f"s{i}"] for i in range(size)]) / n
        second = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)]) / n
        counts.append(n)
        means.append(mean)
        scatters.append(second - np.outer(mean, mean))
    both = (counts[0] * scatters[0] + counts[1] * scatters[1]) / sum(counts)
    whiteners, log_dets = [], []
    for scatter in scatters:
        mixed = (1 - pooled) * scatter + pooled * both
        shrunk = (1 - diagonal) * mixed + diagonal * np.diag(np.diag(mixed)) + 1e-6 * np.eye(size)
        factor = np.linalg.cholesky(shrunk)
        whiteners.append(np.linalg.inv(factor))
        log_dets.append(2 * float(np.log(np.diag(factor)).sum()))
    return Discriminant(tuple(means), tuple(whiteners), tuple(log_dets), float(np.log(counts[1] / counts[0])))


def scored(measured: DataFrame, model: Discriminant) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_of(batches, 4_096):
            values = np.column_stack([part.column(name).to_numpy() for name in NAMES])
            doc_id = part.column("doc_id").combine_chunks()
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(model.scores(values))], names=["doc_id", "score"])

    return measured.mapInArrow(score, "doc_id long, score double")


def held_out(doc_id: str = "doc_id"):
    return (F.crc32(F.col(doc_id).cast("string")) % 4 == 2).alias("held_out")


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Texts are read once: their statistics are written to the shared folder (a narrow table) and used
    for the fit and the scores.  Rows without a label, or with one other than 0 and 1, don't train, nor
    do held-out rows (crc32 of doc_id as text, mod 4, is 2).  A null text is the empty text, which is
    scored as any other; a null doc_id is scored and never trains.  Repeated rows are scored each, and
    count as often as documents and labels join.  An empty table gives no rows.
    """
    measured = written(document_statistics(documents), "quality-statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    training = measured.join(known, "doc_id").where(~held_out())
    model = fit(training)
    return scored(measured, model).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


@query()
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
