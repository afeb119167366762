"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader updates.

A text's words are its runs of letters and digits and its runs of other signs. Each word gives a hashed feature, each pair
of neighbours another, and a pair of equal words between white space one more that all such pairs share, since no text
repeats the very words that another one does. A feature's value is its count over the square root of all counts. Training
sees a bounded sample of labelled rows in one task, in a fixed order; scoring is a sparse dot product per document and
reads nothing but its text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from doclake.llm.common import text_slices, trimmed

#: Hashed features are this many; the last slot is the bias.
DIMENSIONS = 1 << 18
#: Labelled rows that training uses at most: those whose ids hash lowest.
TRAIN_ROWS = 8_192
EPOCHS = 3

_WORD = re.compile(r"\w+|[^\w\s]+")
_SAME = zlib.crc32(b"\0same word")


def indices(text: str | None, same: bool = True) -> np.ndarray:
    """The feature of every word, pair and, with ``same``, repeated word of a text, with repeats; empty for empty and null texts."""
    if not text:
        return np.empty(0, np.int64)
    words = np.fromiter(map(zlib.crc32, map(_bytes, _WORD.findall(text))), np.uint64)
    pairs = (words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)
    runs = text.split() if same else []
    repeats = np.full(sum(map(str.__eq__, runs, runs[1:])), _SAME, np.uint64)
    return (np.concatenate([words, pairs, repeats]) % np.uint64(DIMENSIONS - 1)).astype(np.int64)


def _bytes(word: str) -> bytes:
    return word.encode("utf-8", "surrogatepass")


class Ftrl:
    """Follow-the-regularised-leader, proximal, with a rate per coordinate."""

    def __init__(self, dimensions: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(dimensions), np.zeros(dimensions)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def held_out(id_col: str, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds``; a null id counts as empty text, so it is."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights learnt from at most ``rows`` labelled documents outside the held-out fold.

    Rows without id or label are left out; where an id has several labels the least counts. Features are made where the
    texts are; only the chosen rows' features meet in the one task that trains. Without labelled rows all weights are zero.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1):
                found = [np.unique(indices(t.as_py()), return_counts=True) for t in part.column(1)]
                at, n = ([x[k].astype("<i4").tobytes() for x in found] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["id", "y", "at", "n"])

    kind = StructType([StructField("id", docs.schema[id_col].dataType), StructField("y", DoubleType())])
    made = texts.select("id", "text", "y").mapInArrow(trimmed(features), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind) + ", at binary, n binary")
    sample = made.orderBy(F.xxhash64("id"), "id", F.xxhash64("at")).limit(rows).coalesce(1)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for y, at, n in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                n = np.frombuffer(n, "<i4").astype(np.float64)
                rows.append((np.append(np.frombuffer(at, "<i4"), np.int32(DIMENSIONS - 1)), np.append(n / np.sqrt(max(n.sum(), 1)), 1.0), y))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([learnt(rows, epochs).astype("<f8").tobytes()], pa.binary())], ["w"])

    found = sample.mapInArrow(trimmed(fit), "w binary").collect()
    return np.frombuffer(found[0].w, "<f8") if found else np.zeros(DIMENSIONS)


def learnt(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS) -> np.ndarray:
    """The weights after ``epochs`` passes over (places, values, label) in the order given."""
    model = Ftrl(DIMENSIONS)
    for _ in range(epochs):
        for row in rows:
            model.learn(*row)
    return model.weights()


def with_score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` from 0 to 1, made from each whole text alone; empty and null texts get the bias's score.

    ``keep`` names the columns that stay, if not all of them; texts that go needn't come back from the workers.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c != score_col]
    out = StructType([*(docs.schema[c] for c in names), StructField(score_col, DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, len(names)):
                scores = np.full(part.num_rows, weights[DIMENSIONS - 1])
                for k, text in enumerate(part.column(len(names))):
                    at = indices(text.as_py())
                    if len(at):
                        scores[k] += weights[at].sum() / np.sqrt(len(at))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(scores, -35, 35))))], out.names)

    # Numbered names, as a column of the documents may have any name.
    numbered = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]
    return docs.select(*numbered, F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(work), out)


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with held_out, score and predicted (1 where score >= threshold); columns of these names are replaced.

    ``keep`` names the columns that stay, if not all of them; the id must be one of them.

    Every row is scored, repeated ones alike, whatever its other columns hold; an empty table stays empty.
    """
    scored = with_score(docs, train(docs, labels, label_col, id_col, text_col, rows), text_col, keep=keep)
    return scored.withColumns({"held_out": held_out(id_col), "predicted": (F.col("score") >= threshold).cast("int")})
