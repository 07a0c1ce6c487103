"""Convolutional text classifier: hashed word embeddings, several filter widths, max pooling.

A word's embedding is the sum of hashed rows for the word itself and for its first 5 and 7 bytes,
so words that share a stem share what is learned.

Trained in numpy on a bounded labelled sample, in one executor task; scored over whole texts on the executors. Cutoffs
are calibrated by language on a part of the sample that the weights never saw.

Edge cases: null and empty texts get the score of a document without words; null labels, and labels
without a document, are left out of the fit; repeated label rows, and document rows that repeat an id,
count once in the fit and each get a score. An empty label table
gives a model that scores everything 0. Columns other than the documented ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared, _text

BUCKETS, DIM, WIDTHS, FILTERS, STEMS = 1 << 19, 8, (1, 2, 3), 8, (5, 7)
MIN_DOCS = 4  # rarer words and stems stay at zero
MAX_TRAIN_ROWS = 8_000
SCORE_CUT = 0.7
_EDGE = np.zeros(256, bool)
for _b in (*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)):
    _EDGE[_b] = True


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (word, stems) of every run of letters and digits (A-Z folded); first run of each document."""
    begin, end, first = _text.runs(_EDGE[data], offsets)
    ids = np.empty((len(begin), 1 + len(STEMS)), np.int32)
    for k, stem in enumerate((None, *STEMS)):
        stop = end if stem is None else np.minimum(end, begin + stem)
        hashes = _text.mix(_text.span_hash(data, begin, stop, _text.FOLDED_CODES[0]) + np.uint64(k))
        ids[:, k] = (hashes >> np.uint64(64 - 19)).astype(np.int32)
    return ids, first


@dataclass
class ConvNet:
    """Weights of the network and the cutoffs by language."""

    emb: np.ndarray
    conv: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    conv_b: np.ndarray
    out: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        """Rows of unseen words are zero and are not sent."""
        used = np.flatnonzero(self.emb.any(axis=1))
        return self.__dict__ | {"emb": (used.astype(np.int32), self.emb[used])}

    def __setstate__(self, state: dict) -> None:
        used, rows = state["emb"]
        emb = np.zeros((BUCKETS, DIM), np.float32)
        emb[used] = rows
        self.__dict__ = state | {"emb": emb}

    def pooled(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Max over positions of each filter's response: (documents, filters); zeros without words."""
        n, docs = len(ids), len(first) - 1
        result = np.zeros((docs, len(self.conv_b)), np.float32)
        full = np.flatnonzero(np.diff(first))
        if not n:
            return result
        rows = self.emb[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            rows += self.emb[ids[:, k]]
        for k, w in enumerate(WIDTHS):
            total = np.zeros((n, FILTERS), np.float32)
            for j in range(w):
                part = rows @ self.conv[k][j]
                if j:
                    part[: n - j] = part[j:]
                    part[max(0, n - j):] = 0
                    for back in range(1, j + 1):  # words beyond a document's end count as zeros
                        at = first[1:][full] - back
                        part[at[at >= first[:-1][full]]] = 0
                total += part
            result[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(total, first[:-1][full], axis=0)
        return np.maximum(result + self.conv_b, 0) * (np.diff(first) > 0)[:, None]

    def margins(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(ids, first) @ self.out + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * margins.astype(np.float64) + self.shift)


def _best_cut(score: np.ndarray, y: np.ndarray) -> float:
    """The cutoff of largest F1, midway between neighbouring scores."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    f1[np.append(s[1:] == s[:-1], False)] = -1
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k]) - 1e-3


def train(texts: list[str] | pa.Array, labels: np.ndarray, langs: list, seed: int = 7, epochs: int = 4) -> ConvNet:
    """Fit on four fifths of the rows, calibrate on the rest; deterministic for given rows."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float64)
    conv = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    net = ConvNet(np.zeros((BUCKETS, DIM), np.float32), conv, np.zeros(FILTERS * len(WIDTHS), np.float32), np.zeros(FILTERS * len(WIDTHS), np.float32), 0.0)
    if len(y) < 10 or y.min() == y.max():
        net.bias = 20.0 * (1 if len(y) and y.min() == 1 else -1)
        return net
    docs = []
    texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
    for _, _, data, off in _text.slices(texts, 200_000):
        ids, first = word_ids(data, off)
        docs += [ids[a:b] for a, b in zip(first[:-1], first[1:])]
    del texts
    calib = np.arange(len(y)) % 5 == 4
    fit = np.flatnonzero(~calib)
    seen, hits = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    for i in fit:
        u = np.unique(docs[i])
        seen[u] += 1
        hits[u] += y[i]
    prior = y[fit].mean()
    p = (hits + 5 * prior) / (seen + 5)
    # the first embedding component starts from shrunken log odds, the others near zero; unseen words stay at zero
    known = seen >= MIN_DOCS
    net.emb[known] = rng.normal(0, 0.02, (int(known.sum()), DIM))
    net.emb[known, 0] = 0.5 * (np.log(p / (1 - p)) - np.log(prior / (1 - prior)))[known]
    for k in range(len(WIDTHS)):
        net.conv[k][:, 0, : FILTERS // 2] += 1.0
    net.out[:] = rng.normal(0, 0.05, len(net.out))
    for k in range(len(WIDTHS)):
        net.out[k * FILTERS : k * FILTERS + FILTERS // 2] += 0.5 / len(WIDTHS)
    net.bias = -3.0
    grads = [np.full_like(x, 1e-2) for x in (net.conv_b, net.out, *net.conv)]
    g_emb, g_bias = np.full((BUCKETS, 1), 1e-2, np.float32), 1e-2
    weight = np.where(y == 1, min(3.0, (1 - prior) / prior), 1.0)
    lr, pad = 0.03, max(WIDTHS)
    for _ in range(epochs):
        for i in rng.permutation(fit):
            ids = docs[i]
            if not len(ids):
                continue
            x = np.zeros((len(ids) + pad, DIM), np.float32)
            x[: len(ids)] = net.emb[ids].sum(1)
            n = len(ids)
            best, value, col = [], [], 0
            flat = np.concatenate([c for cs in net.conv for c in cs], axis=1)
            r = x @ flat
            for w in WIDTHS:
                t = sum(r[j : j + n, col + j * FILTERS : col + (j + 1) * FILTERS] for j in range(w))
                a = t.argmax(0)
                best.append(a)
                value.append(t[a, np.arange(FILTERS)])
                col += w * FILTERS
            z = np.concatenate(value) + net.conv_b
            h = np.maximum(z, 0)
            err = float(weight[i] * (_sigmoid(h @ net.out + net.bias) - y[i]))
            if abs(err) < 0.02:
                continue
            d_out, d_z = err * h, err * net.out * (z > 0)
            g_bias += err * err
            net.bias -= lr * err / g_bias**0.5
            grads[0] += d_z**2
            net.conv_b -= lr * d_z / np.sqrt(grads[0])
            grads[1] += d_out**2
            net.out -= lr * d_out / np.sqrt(grads[1])
            for k, w in enumerate(WIDTHS):
                d = d_z[k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    at = best[k] + j
                    d_w = x[at].T * d
                    d_x = net.conv[k][j].T * d[:, None]
                    grads[2 + k][j] += d_w**2
                    net.conv[k][j] -= lr * d_w / np.sqrt(grads[2 + k][j])
                    ok = at < n
                    for part in ids[at[ok]].T:
                        np.add.at(g_emb, part, (d_x[ok] ** 2).mean(1, keepdims=True))
                        np.add.at(net.emb, part, -lr * d_x[ok] * known[part, None] / np.sqrt(g_emb[part]))
    held = np.flatnonzero(calib)
    margin = np.zeros(len(held))
    for at in range(0, len(held), 100):
        ids = [docs[i] for i in held[at : at + 100]]
        margin[at : at + 100] = net.margins(np.concatenate(ids), np.cumsum([0, *map(len, ids)]))
    _calibrate(net, margin, y[held], [langs[i] for i in held])
    return net


def _calibrate(net: ConvNet, margin: np.ndarray, y: np.ndarray, langs: list) -> None:
    """Platt slope with the best pooled cutoff put at SCORE_CUT; then a cutoff for each language."""
    if y.min() == y.max():
        return
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * margin + b)
        w, g = p * (1 - p) + 1e-9, p - y
        h11, h12, h22 = (w * margin**2).sum() + 1e-3, (w * margin).sum(), w.sum()
        g1, g2, det = (g * margin).sum() + 1e-3 * (a - 1), g.sum(), h11 * h22 - h12**2
        a, b = a - (h22 * g1 - h12 * g2) / det, b - (h11 * g2 - h12 * g1) / det
    net.scale = float(np.clip(a, 0.2, 5))
    net.shift = float(np.log(SCORE_CUT / (1 - SCORE_CUT)) - net.scale * _best_cut(margin, y))
    score = net.scores(margin)
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        if y[own].sum() >= 20 and (1 - y[own]).sum() >= 20:
            net.thresholds[lang] = min(0.9, max(0.5, _best_cut(score[own], y[own])))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> ConvNet:
    """Train on at most max_rows labelled documents outside the held-out fold, in one executor task."""
    rows = _shared.labelled_sample(docs.select("doc_id", "text", "lang"), labels, ["toxic"], max_rows)

    def learn(rows: pa.Table | None) -> ConvNet:
        if rows is None:
            return train([], np.zeros(0), [])
        rows = rows.sort_by([("doc_id", "ascending")])
        return train(rows.column("text").combine_chunks(), rows.column("label_toxic").to_numpy(), rows.column("lang").to_pylist())

    return _shared.trained(rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "label_toxic"), learn)


def score(docs: DataFrame, net: ConvNet) -> DataFrame:
    """doc_id, held_out, score, predicted; threshold is the language's cutoff, flagged applies it."""
    held = docs.sparkSession.sparkContext.broadcast(net)  # the model's size is fixed
    rows = docs.select("doc_id", "text", "lang", F.coalesce(_shared.fold() == 1, F.lit(False)).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, data, off in _text.slices(batch.column(1), 1_000_000):
                out[a:b] = net.scores(net.margins(*word_ids(data, off)))
            cut = np.array([net.thresholds.get(x, SCORE_CUT) for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(out), pa.array((out >= SCORE_CUT).astype(np.int32)), pa.array(cut, pa.float64()), pa.array(out >= cut)],
                ["doc_id", "held_out", "score", "predicted", "threshold", "flagged"],
            )

    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, threshold double, flagged boolean")


def filter_clean(docs: DataFrame, net: ConvNet) -> DataFrame:
    """The rows of docs, all columns, that are not flagged at their language's cutoff."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, data, off in _text.slices(batch.column(text), 1_000_000):
                out[a:b] = net.scores(net.margins(*word_ids(data, off)))
            cut = np.array([net.thresholds.get(x, SCORE_CUT) for x in batch.column(lang).to_pylist()])
            yield batch.filter(pa.array(out < cut))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    return score(docs, fit(docs, labels, max_rows))
