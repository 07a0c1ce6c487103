"""Quality rules with risk-controlled cutoffs.

measure() takes per-document statistics over whole texts. control() chooses, for each stratum (language),
a joint setting: one cutoff of a fixed grid, or none, for each rule. What is tested is the verdict itself,
that any rule rejects: with k of n labelled good documents rejected by a joint setting, it is proved safe if
P(X <= k | n, alpha) <= delta / (joint settings * strata), an exact binomial (Clopper-Pearson) bound under a
Bonferroni correction. So with probability 1 - delta no stratum loses more than `alpha` of its good
documents, whichever proved setting is taken; the one that rejects most labelled poor documents is. A
stratum with too few labels proves nothing, so nothing is rejected there.

Labelled good documents of equal text count as one trial, and so do repeated rows. Each document falls into
one cell of the grid (at most 7 ** 4 for a stratum); only the counts of cells are grouped by stratum.

Edge cases: null and empty texts have no words and fail the base rules; a null language is a stratum of
its own; null labels and labels without a document prove nothing; without labels only the base rules apply.
A repeated document row is judged each time; an id with contradictory labels proves nothing. Other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared, _text

MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
ALPHA, DELTA = 0.01, 0.05
SYMBOLS = b"#*$%&|<>"
#: rule -> cutoffs in rising order; a document is rejected if its statistic is above the cutoff
GRID = {
    "symbols": (0.005, 0.01, 0.02, 0.05, 0.1, 0.2),
    "dup_lines": (0.001, 0.002, 0.005, 0.01, 0.02, 0.05),
    "repeats": (0.02, 0.05, 0.1, 0.15, 0.2, 0.25),
    "long_words": (6.5, 7.0, 8.0, 9.0, 10.0, 12.0),
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs at least twice."""
    order = np.argsort(keys)
    s = keys[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.empty(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """STATS of each document of a slice."""
    docs = len(offsets) - 1
    begin, end, first = _text.words(data, offsets)
    n_words = np.diff(first)
    separator = _text._SEP[data]
    chars = _sums(~separator & ((data & 0xC0) != 0x80), offsets)
    symbols = _sums(_SYMBOL[data], offsets)
    owner = np.repeat(np.arange(docs, dtype=np.uint64), n_words)
    hashes = _text.span_hash(data, begin, end, _text.BYTE_CODES[0])
    starts = _text.window_starts(first, REPEAT_WINDOW)
    keys = _text.window_hash(hashes, starts, REPEAT_WINDOW) ^ _text.mix(owner[starts] + np.uint64(1))
    again = starts[repeated(keys)]
    n_repeat = _sums(_text.covered(len(begin), again, REPEAT_WINDOW), first)
    # lines: from a document's start or a line feed up to the next line feed or the document's end
    feeds = np.flatnonzero(data == 10)
    l_begin = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    doc_of = np.searchsorted(offsets[1:], np.concatenate([offsets[:-1], feeds]), side="right")
    doc_of[:docs] = np.arange(docs)
    order = np.argsort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    l_begin, l_doc = np.concatenate([offsets[:-1], feeds + 1])[order], doc_of[order]
    next_feed = np.append(feeds, len(data))[np.searchsorted(feeds, l_begin)]
    l_end = np.maximum(np.minimum(next_feed, offsets[l_doc + 1]), l_begin)
    has_word = np.searchsorted(begin, l_end) > np.searchsorted(begin, l_begin)
    l_begin, l_end, l_doc = l_begin[has_word], l_end[has_word], l_doc[has_word]
    l_key = _text.span_hash(data, l_begin, l_end, _text.BYTE_CODES[1], 1) ^ _text.mix(l_doc.astype(np.uint64) + np.uint64(7))
    dup = np.zeros(docs, np.int64)
    if len(l_key):
        o = np.argsort(l_key, kind="stable")
        later = np.append(False, l_key[o][1:] == l_key[o][:-1])
        np.add.at(dup, l_doc[o][later], 1)
    return [n_words, chars, symbols, dup, n_repeat]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text_key (a hash of the text) and STATS of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((len(STATS), batch.num_rows), np.int64)
            for a, b, data, off in _text.slices(batch.column(2), 1_000_000):
                out[:, a:b] = statistics(data, off)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *[pa.array(x) for x in out]], ["doc_id", "lang", "text_key", *STATS])

    return docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id bigint, lang string, text_key bigint, " + ", ".join(f"{x} bigint" for x in STATS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def values() -> dict[str, Column]:
    """The statistic that each rule compares with its cutoff; null (never rejected) without words."""
    words, chars = F.nullif("n_words", F.lit(0)), F.nullif("word_chars", F.lit(0))
    return {"symbols": F.col("n_symbols") / chars, "dup_lines": F.col("n_dup_lines") / words, "repeats": F.col("n_repeat_words") / words, "long_words": F.col("word_chars") / words}


def log_cdf(k: int, n: int, p: float) -> float:
    """log P(X <= k) of a binomial: the incomplete beta function by its continued fraction, for any n."""
    if k >= n:
        return 0.0

    def log_beta(a: float, b: float, x: float) -> float:
        """log I_x(a, b), for x below the mean."""
        tiny, c = 1e-300, 1.0
        d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
        h = d
        for m in range(1, 10_000_000):
            for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + t * d
                c = 1 + t / c
                d = 1 / (d if abs(d) > tiny else tiny)
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x) - math.log(a) + math.log(h)

    a, b, x = n - k, k + 1, 1 - p
    if x <= (a + 1) / (a + b + 2):
        return min(0.0, log_beta(a, b, x))
    return math.log1p(-min(1.0, math.exp(log_beta(b, a, p))))


def most_rejected(n: int, alpha: float, log_level: float) -> int:
    """The largest k of n with log P(X <= k | n, alpha) <= log_level; -1 if there is none."""
    low, high = -1, int(alpha * n)
    while low < high:
        k = (low + high + 1) // 2
        low, high = (k, high) if log_cdf(k, n, alpha) <= log_level else (low, k - 1)
    return low


def choose(cells: np.ndarray, good: np.ndarray, poor: np.ndarray, shape: tuple[int, ...], alpha: float, log_level: float) -> tuple[int, ...]:
    """The proved joint setting that rejects most poor documents; of those the one that rejects fewest good ones, then the loosest.

    cells: for each row the number of cutoffs exceeded, by rule. A setting s rejects where cells > s in any rule.
    """

    def kept(count: np.ndarray) -> np.ndarray:
        grid = np.zeros(shape, np.int64)
        np.add.at(grid, tuple(cells.T), count)
        for axis in range(len(shape)):
            grid = np.cumsum(grid, axis=axis)
        return grid

    lost, caught = good.sum() - kept(good), poor.sum() - kept(poor)
    proved = lost <= most_rejected(int(good.sum()), alpha, log_level)
    proved[tuple(x - 1 for x in shape)] = True  # no rule at all
    loose = np.indices(shape).sum(0)
    best = np.lexsort([-loose[proved], lost[proved], -caught[proved]])[0]
    return tuple(int(x[best]) for x in np.nonzero(proved))


def control(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, grid: dict = GRID) -> DataFrame:
    """(cut_lang, cut_<rule>): one row for each stratum with labels; a null cutoff rejects nothing."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most").select("label_id", "quality")
    rules = list(grid)
    levels = [sum((F.coalesce(values()[r] > c, F.lit(False)).cast("int") for c in grid[r]), F.lit(0)).alias(r) for r in rules]
    own = stats.filter(~base_failed()).select("doc_id", "lang", "text_key", *levels).join(known, F.col("doc_id") == F.col("label_id"))
    cells = own.select("lang", "text_key", "quality", *rules).distinct().groupBy("lang", *rules).agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("poor"))
    cells = _shared.stored(cells, "rule-cells")
    shape = tuple(len(grid[r]) + 1 for r in rules)
    log_level = math.log(delta / (math.prod(shape) * max(1, cells.select("lang").distinct().count())))

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        at = choose(own[rules].to_numpy(np.int64), own["good"].to_numpy(np.int64), own["poor"].to_numpy(np.int64), shape, alpha, log_level)
        return pd.DataFrame({"cut_lang": [own["lang"].iloc[0]]} | {f"cut_{r}": [grid[r][k] if k < len(grid[r]) else None] for r, k in zip(rules, at)}).astype({f"cut_{r}": float for r in rules})

    return cells.groupBy("lang").applyInPandas(solve, "cut_lang string, " + ", ".join(f"cut_{r} double" for r in rules))


def judge(stats: DataFrame, cutoffs: DataFrame, grid: dict = GRID) -> DataFrame:
    """doc_id, STATS, base_failed, kept."""
    rows = stats.join(cutoffs, F.col("lang").eqNullSafe(F.col("cut_lang")), "left")
    rejected = F.lit(False)
    for rule in grid:
        rejected = rejected | F.coalesce(values()[rule] > F.col(f"cut_{rule}"), F.lit(False))
    return rows.select("doc_id", *STATS, base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"))


def apply(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    stats = _shared.stored(measure(docs), "rule-stats")  # narrow rows, read twice
    return judge(stats, _shared.stored(control(stats, labels, alpha, delta), "rule-cutoffs"))
