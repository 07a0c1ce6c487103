"""Ordinal cumulative-link regression on graded ratings.

P(grade > j) = sigmoid(w . x - t_j) with one weight vector and ordered thresholds t_0 < t_1 < ...
x are hashed relative frequencies of folded words, byte trigrams and distances between repeated
words, so whole texts are scored as means of gathered weights. Gives the expected grade and the
tail probability of reaching a chosen grade, by which documents are selected.

Edge cases: null and empty texts have x = 0 and get the score of the thresholds alone; null
ratings, and ratings without a document, are left out of the fit; a table with fewer than two
grades gives the constant observed grade (0 without any). Repeated label rows, and document rows
that repeat an id, count once in the fit and each get a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared, _text

BITS, MAX_TRAIN_ROWS, GRADES, PARTS = 18, 5_000, 3, 3
SCALE = 12.0  # weights act on SCALE * relative frequency


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature its hashed ids in text order and the first of each document."""
    shift, part = np.uint64(64 - BITS), 1 << BITS
    begin, end, first = _text.words(data, offsets)
    hashes = _text.span_hash(data, begin, end, _text.FOLDED_CODES[0])
    word_ids = (hashes >> shift).astype(np.int32)
    left = np.diff(offsets)
    if len(data) >= 3:
        d = data.astype(np.uint64)
        tri = ((d[:-2] | d[1:-1] << np.uint64(8) | d[2:] << np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15)) >> shift
        ok = np.arange(len(data) - 2) + 3 <= np.repeat(offsets[1:], left)[:-2]
        tri_ids = tri[ok].astype(np.int32) + part
        tri_first = np.concatenate([[0], np.cumsum(np.maximum(left - 2, 0))])
    else:
        tri_ids, tri_first = np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    # how far back the same word stands (log2 steps; none: 31), which shows repetition
    owner = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    key = hashes ^ _text.mix(owner + np.uint64(3))
    order = np.argsort(key, kind="stable")
    gap = np.full(len(key), 31, np.int32)
    same = np.flatnonzero(key[order][1:] == key[order][:-1]) if len(key) else np.zeros(0, np.int64)
    gap[order[same + 1]] = np.log2(order[same + 1] - order[same]).astype(np.int32)
    return [(word_ids, first), (tri_ids, tri_first), (gap + 2 * part, first)]


@dataclass
class Ordinal:
    """Shared weights and ordered thresholds; grades are 0 .. len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        for ids, first in features(data, offsets):
            total = np.concatenate([[0.0], np.cumsum(self.weights[ids], dtype=np.float64)])
            out += SCALE * (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)
        return out

    def tails(self, margins: np.ndarray) -> np.ndarray:
        """P(grade >= j + 1) for each threshold."""
        return _sigmoid(margins[:, None] - self.thresholds[None, :])


def train(texts: list[str] | pa.Array, grades: np.ndarray, n_grades: int = GRADES, epochs: int = 30, seed: int = 5) -> Ordinal:
    y = np.asarray(grades, np.int64)
    size = (PARTS - 1) * (1 << BITS) + 64
    if len(y) == 0 or y.min() == y.max():
        level = int(y[0]) if len(y) else 0
        return Ordinal(np.zeros(size, np.float32), np.array([-40.0 if j < level else 40.0 for j in range(n_grades - 1)]))
    rows, cols, vals, at = [], [], [], 0
    texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
    for _, _, data, off in _text.slices(texts, 200_000):
        for ids, first in features(data, off):
            n = np.diff(first)
            key, count = np.unique(np.repeat(np.arange(len(n)), n) * np.int64(size) + ids, return_counts=True)
            r = key // size
            rows.append(r + at), cols.append(key % size), vals.append(SCALE * count / n[r])
        at += len(off) - 1
    rows, cols, vals = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals).astype(np.float64)
    used, cols = np.unique(cols, return_inverse=True)
    w, n = np.zeros(len(used)), len(y)
    share = np.array([(y > j).mean() for j in range(n_grades - 1)]).clip(0.01, 0.99)
    t = np.sort(-np.log(share / (1 - share)))
    above = (y[:, None] > np.arange(n_grades - 1)[None, :]).astype(float)
    balance = np.where(above == 1, 0.5 / np.maximum(above.mean(0), 0.02), 0.5 / np.maximum(1 - above.mean(0), 0.02))
    g_w, g_t = np.full(len(used), 1e-8), np.full(len(t), 1e-8)
    for _ in range(epochs):
        margin = np.bincount(rows, vals * w[cols], minlength=n)
        err = balance * (_sigmoid(margin[:, None] - t[None, :]) - above)
        grad = np.bincount(cols, vals * err.sum(1)[rows], minlength=len(used)) / n + 1e-5 * w
        step = -err.mean(0)
        g_w += grad**2
        g_t += step**2
        w -= 0.5 * grad / np.sqrt(g_w)
        t = np.maximum.accumulate(t - 0.3 * step / np.sqrt(g_t) + 1e-6 * np.arange(len(t)))
    weights = np.zeros(size, np.float32)
    weights[used] = w
    return Ordinal(weights, t)


def grade_of_labels() -> Column:
    """The three grades in the label table: 0 poor, 1 well-formed but toxic, 2 good."""
    return F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2)).when(F.col("quality") == 0, 0)


def fit(docs: DataFrame, labels: DataFrame, grade: Column | None = None, max_rows: int = MAX_TRAIN_ROWS) -> Ordinal:
    labels = labels.withColumn("grade", grade_of_labels() if grade is None else grade)
    rows = _shared.labelled_sample(docs.select("doc_id", "text"), labels, ["grade"], max_rows)

    def learn(rows: pa.Table | None) -> Ordinal:
        if rows is None:
            return train([], np.zeros(0, np.int64))
        rows = rows.sort_by([("doc_id", "ascending")])
        return train(rows.column("text").combine_chunks(), rows.column("label_grade").to_numpy())

    return _shared.trained(rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label_grade"), learn)


def score(docs: DataFrame, model: Ordinal, select_grade: int = 1, min_tail: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_prob = P(grade >= select_grade), predicted_grade, kept."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # the model's size is fixed
    rows = docs.select("doc_id", "text", F.coalesce(_shared.fold() == 1, F.lit(False)).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            tails = np.zeros((batch.num_rows, len(model.thresholds)))
            for a, b, data, off in _text.slices(batch.column(1), 1_000_000):
                tails[a:b] = model.tails(model.margins(data, off))
            tail = tails[:, select_grade - 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(tails.sum(1)), pa.array(tail.copy()), pa.array((tails >= 0.5).sum(1).astype(np.int32)), pa.array(tail >= min_tail)],
                ["doc_id", "held_out", "expected_grade", "tail_prob", "predicted_grade", "kept"],
            )

    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, expected_grade double, tail_prob double, predicted_grade int, kept boolean")


def select(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    return score(docs, fit(docs, labels, max_rows=max_rows))
