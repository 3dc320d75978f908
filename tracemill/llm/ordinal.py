"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade <= k) = sigmoid(threshold[k] - score), thresholds ascending, one weight vector shared by all
grades. A text's features are the hashed set of its words, of word beginnings, of the punctuation runs at their ends, and of
bucketed shares (capitals, symbols, repeated words). Expected grade and the tail probability
P(grade >= top) select documents.

The model is fitted in one task on a bounded sample of rated rows: the SAMPLE_ROWS rated ids that come
first by hash (a documented parameter, the same at every input size). Scoring covers every row and shuffles
nothing; the model (two arrays of at most BUCKETS numbers) travels with the task.

Defined results: null text counts as empty; a text without features has score 0; rows without a rating are
scored like others; repeated ratings of a document all count; with no ratings at all every document gets
equal probabilities of all grades and is kept; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import bound_batches, derive, stored

BUCKETS = 1 << 20
SAMPLE_ROWS = 12_000
#: Features seen in fewer rated texts carry no weight.
MIN_TEXTS = 5
STEPS, STEP = 160, 0.15
#: Strength of the Gaussian prior on weights, against one text each.
PRIOR = 2.4
#: Word beginnings of these lengths (bytes) are features too: inflected words share them.
STEMS = (4, 5)
GRADES = 3
CACHE_ENTRIES = 150_000
_TAIL = re.compile(rb"[^\w\s]+$")


def grade(quality: Column, toxic: Column) -> Column:
    """Graded rating of a label row: 0 toxic, 1 poor, 2 good; null where nothing is known."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


class Features:
    """Hashed features of a text; remembers words."""

    def __init__(self) -> None:
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def _of_word(self, raw: bytes) -> tuple[int, ...]:
        tail = _TAIL.search(raw)
        mark = tail.group() if tail else b""
        word = raw[: len(raw) - len(mark)].strip(b"\"'(").lower()
        out = [zlib.crc32(word) % BUCKETS] if word else []
        out += [zlib.crc32(b"\0stem%d" % k + word[:k]) % BUCKETS for k in STEMS if len(word) >= k]
        if mark:
            out.append(zlib.crc32(b"\0tail" + mark[:4]) % BUCKETS)
        return tuple(out)

    def of(self, text: str) -> np.ndarray:
        words = text.encode().split()
        distinct = set(words)
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        cache, found = self.cache, set()
        for w in distinct:
            x = cache.get(w)
            if x is None:
                x = cache[w] = self._of_word(w)
            found.update(x)
        if text:
            n, k = len(text), len(words) or 1
            letters = sum(map(text.count, "etaoinsrhl"))
            capitals = sum(map(text.count, "ETAOINSRHL"))
            symbols = sum(map(text.count, "#$%&*|!{}<>=;_\\"))
            for name, share in ((b"capitals", capitals / (letters + capitals + 1)), (b"symbols", symbols / n), (b"distinct", len(distinct) / k)):
                found.add(zlib.crc32(b"\0" + name + b"%d" % int(20 * share)) % BUCKETS)
            found.add(zlib.crc32(b"\0length%d" % n.bit_length()) % BUCKETS)
        return np.fromiter(found, np.int64, len(found))


@dataclass
class Model:
    index: np.ndarray  # buckets that carry weight, ascending
    weight: np.ndarray
    thresholds: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS, np.float32)
        out[self.index] = self.weight
        return out


def _cumulative(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade <= k) for k = -1 .. top."""
    inner = 1 / (1 + np.exp(-np.clip(thresholds[None, :] - score[:, None], -30, 30)))
    return np.hstack((np.zeros((len(score), 1)), inner, np.ones((len(score), 1))))


def fit(flat: np.ndarray, lengths: np.ndarray, grades: np.ndarray, n_grades: int = GRADES) -> Model:
    """Maximum likelihood by full-batch Adam on weights and ordered thresholds.

    flat: the features of all texts in a row, lengths: how many each text has. The sparse matrix is held by
    rows and by columns as 32-bit numbers, about 16 bytes a feature with what a step needs.
    """
    if not len(lengths):
        return Model(np.empty(0, np.int64), np.empty(0), np.log(np.arange(1, n_grades) / np.arange(n_grades - 1, 0, -1)))
    n = len(lengths)
    index = np.flatnonzero(np.bincount(flat, minlength=BUCKETS) >= MIN_TEXTS)
    place = np.full(BUCKETS, -1, np.int32)
    place[index] = np.arange(len(index), dtype=np.int32)
    col = place[flat]
    row = np.repeat(np.arange(n, dtype=np.int32), lengths)[col >= 0]
    col = col[col >= 0]
    per_row = np.bincount(row, minlength=n)
    by_col = row[np.argsort(col, kind="stable")]
    per_col = np.bincount(col, minlength=len(index))
    del row

    def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sums of consecutive groups, some of which may be empty."""
        out = np.zeros(len(counts))
        some = counts > 0
        if len(values):
            starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
            out[some] = np.add.reduceat(values, starts[some])
        return out

    share = np.cumsum(np.bincount(grades, minlength=n_grades) + 1.0)[:-1] / (n + n_grades)
    base = np.log(share / (1 - share))
    # thresholds: the first one free, then positive gaps (as logarithms), so they stay ordered
    params = np.concatenate((np.zeros(len(index)), base[:1], np.log(np.maximum(np.diff(base), 1e-2))))
    first, second, w = np.zeros(len(params)), np.zeros(len(params)), len(index)
    every = np.arange(n)
    for t in range(1, STEPS + 1):
        cuts = np.cumsum(np.concatenate((params[w : w + 1], np.exp(params[w + 1 :]))))
        cum = _cumulative(sums(params[:w].astype(np.float32)[col], per_row), cuts)
        low, high = cum[every, grades], cum[every, grades + 1]
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        g_score = d_high - d_low  # of the negative log likelihood
        g_cuts = np.array([(-d_high[grades == k].sum() + d_low[grades == k + 1].sum()) for k in range(n_grades - 1)]) / n
        gaps = np.cumsum(g_cuts[::-1])[::-1]  # a gap moves every threshold after it
        g_weight = sums(g_score.astype(np.float32)[by_col], per_col) / n + PRIOR / n * params[:w]
        g = np.concatenate((g_weight, gaps[:1], gaps[1:] * np.exp(params[w + 1 :])))
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        params -= STEP * (1 - t / (STEPS + 1)) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Model(index, params[:w], np.cumsum(np.concatenate((params[w : w + 1], np.exp(params[w + 1 :])))))


def train(docs: DataFrame, ratings: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the sample_rows rated documents that come first by hash of their id.

    docs: doc_id, text; ratings: doc_id, grade.
    """
    rated = ratings.filter(F.col("grade").isNotNull() & F.col("doc_id").isNotNull())
    chosen = rated.select("doc_id", F.col("grade").cast("int").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample_rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample_rows small rows
    featured = stored(derive(joined, _featuring, "features array<int>", ["doc_id", "grade"]), "rated").orderBy("doc_id", "grade").coalesce(1)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, lengths, grades = [np.empty(0, np.int32)], [np.empty(0, np.int64)], []
        for b in batches:
            lists = b.column("features")
            flat.append(lists.flatten().to_numpy().copy())
            lengths.append(np.diff(lists.offsets.to_numpy()))
            grades += b.column("grade").to_pylist()
        m = fit(np.concatenate(flat), np.concatenate(lengths), np.array(grades, np.int64))
        yield pa.RecordBatch.from_pydict({"index": [m.index.astype(np.int32)], "weight": [m.weight], "thresholds": [m.thresholds]}, schema=pa.schema([("index", pa.list_(pa.int32())), ("weight", pa.list_(pa.float64())), ("thresholds", pa.list_(pa.float64()))]))

    solved = bound_batches(featured).mapInArrow(solve, "index array<int>, weight array<double>, thresholds array<double>").collect()
    if not solved:
        return fit(np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))
    return Model(np.array(solved[0]["index"], np.int64), np.array(solved[0]["weight"]), np.array(solved[0]["thresholds"]))


def _featuring():
    features = Features()
    return lambda batch: {"features": [features.of(t.as_py() or "").tolist() for t in batch.column("text")]}


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns with expected_grade and tail_probability, P(grade is the highest)."""

    def make():
        features, weight = Features(), model.dense()

        def work(batch: pa.RecordBatch) -> dict:
            scores = np.array([float(weight[np.sort(features.of(t.as_py() or ""))].sum(dtype=np.float64)) for t in batch.column(text_col)])
            cum = _cumulative(scores, model.thresholds)
            return {"expected_grade": (1 - cum[:, 1:-1]).sum(axis=1).tolist(), "tail_probability": (1 - cum[:, -2]).tolist()}

        return work

    return derive(docs, make, "expected_grade double, tail_probability double", keep)
