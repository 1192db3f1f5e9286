"""Ordinal quality classifier: cumulative-link regression on graded ratings.

A text's score is one linear function of hashed words and beginnings of words (log counts, length 1 over a text) and of a few hashed shares
(capitals, symbols, digits, repeated words). Ordered thresholds turn the score into the chances of all grades:
P(grade <= k) = sigmoid(threshold_k - score). The same weights serve all thresholds, so every rating teaches them.
From the chances come the expected grade and the tail probability of the best grades, for selection.

The fit uses at most about ``fit_rows`` rated documents, drawn by a hash of doc_id; scoring covers all.

Defined results: null text is empty and is scored by the thresholds alone; a document with several ratings has the
lowest; ratings of unknown documents and null ratings are not used; without ratings all grades are equally likely;
equal texts have equal scores; empty tables stay empty; extra columns pass through if carried. Memory follows the
longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.blocks import ALNUM, U64, blocks, find_words, hash_words, mix, per_batch

LOG2_FEATURES = 18
FIT_ROWS = 8000
STEPS = 300
#: Beginnings of words, in bytes, that are features beside the words.
STEMS = (5, 7)
#: What a hashed share counts for beside a text's words, whose length is 1.
SHARE_VALUE = 0.25
UPPER, DIGIT = np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91], DIGIT[48:58] = True, True
SYMBOL = np.array([chr(b) in "#$%&*+/<=>@[\\]^_`{|}~!" for b in range(256)])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """(texts, thresholds): the chance of a grade above each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, value, bounds) of each text of a block."""
    rows, size = len(bounds) - 1, 1 << LOG2_FEATURES
    folded, starts, ends, firsts = find_words(data, bounds, ALNUM)
    owner = np.repeat(np.arange(rows), np.diff(firsts))
    hashes, owners = [hash_words(folded, starts, ends)], [owner]
    for stem in STEMS:
        long = np.flatnonzero(ends - starts > stem)
        hashes.append(mix(hash_words(folded, starts[long], starts[long] + stem) + U64(stem)))
        owners.append(owner[long])
    key = (np.concatenate(owners) << LOG2_FEATURES) + (np.concatenate(hashes) & U64(size - 1)).astype(np.int64)
    found, count = np.unique(key, return_counts=True)
    owner, value = found >> LOG2_FEATURES, np.log1p(count)
    norm = np.sqrt(np.bincount(owner, value * value, rows))
    value = value / np.maximum(norm, 1e-9)[owner]
    length = np.maximum(np.diff(bounds), 1)
    share = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags[data])])[bounds]) / length
    shares = [share(UPPER), share(SYMBOL), share(DIGIT), repeats(folded, starts, ends, firsts)]
    extra = [(mix((np.sqrt(np.clip(s, 0, 1)) * 12).astype(np.int64).view(U64) + U64(1000 * (k + 1))) & U64(size - 1)).astype(np.int64) for k, s in enumerate(shares)]
    feature = np.concatenate([found & (size - 1), *extra])
    owner = np.concatenate([owner, *[np.arange(rows)] * len(extra)])
    value = np.concatenate([value, np.full(rows * len(extra), SHARE_VALUE)])
    order = np.argsort(owner, kind="stable")
    return feature[order], value[order], np.searchsorted(owner[order], np.arange(rows + 1))


def repeats(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The share of each text's words that stood in it before."""
    rows = len(firsts) - 1
    key = (np.repeat(np.arange(rows), np.diff(firsts)) << 32) + (hash_words(folded, starts, ends) >> U64(32)).astype(np.int64)
    return 1 - np.bincount(np.unique(key) >> 32, minlength=rows) / np.maximum(np.diff(firsts), 1) - (np.diff(firsts) == 0)


def train(feature: np.ndarray, value: np.ndarray, bounds: np.ndarray, grade: np.ndarray, grades: int, steps: int = STEPS, rate: float = 1.0, decay: float = 1e-6) -> Model:
    """Adam on the mean log-likelihood; thresholds are a first one and positive gaps."""
    size, n = 1 << LOG2_FEATURES, len(grade)
    start = np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(grades - 1)
    if not n:
        shares = np.arange(1, grades) / grades
        return Model(np.zeros(size), np.log(shares / (1 - shares)))
    used, place = np.unique(feature, return_inverse=True)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    theta = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    w = len(used)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for step in range(1, steps + 1):
        gaps = np.exp(theta[w + 1 :])
        cuts = np.concatenate([[-np.inf], theta[w] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(owner, value * theta[place], n)
        high, low = sigmoid(cuts[grade + 1] - score), sigmoid(cuts[grade] - score)
        chance = np.maximum(high - low, 1e-12)
        up, down = high * (1 - high) / chance, low * (1 - low) / chance
        grad = np.zeros_like(theta)
        grad[:w] = np.bincount(place, value * ((up - down) / n)[owner], w) + decay * theta[:w]
        by_cut = np.bincount(grade, -up / n, grades)[: grades - 1] + np.bincount(grade, down / n, grades)[1:]
        grad[w] = by_cut.sum()
        grad[w + 1 :] = np.cumsum(by_cut[::-1])[::-1][1:] * gaps
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(size)
    weights[used] = theta[:w]
    return Model(weights, theta[w] + np.concatenate([[0], np.cumsum(np.exp(theta[w + 1 :]))]))


def fit(docs: DataFrame, ratings: DataFrame, *, grades: int = 3, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from ``docs(doc_id, text)`` and ``ratings(doc_id, grade)`` with grades 0 to ``grades`` - 1."""
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    share = min(1.0, fit_rows / max(rated.count(), 1))
    drawn = rated.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)  # about fit_rows rows, so small enough to broadcast
    given = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in blocks(batch.column(1)):
                feature, value, at = features(data, bounds)
                parts = list(zip(at[:-1], at[1:], strict=True))
                packed = [pa.array([x[i:j].astype(kind).tobytes() for i, j in parts], pa.binary()) for x, kind in ((feature, np.int32), (value, np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *packed], ["grade", "feature", "value"])

    rows = per_batch(given, run, "grade int, feature binary, value binary").toArrow().to_pydict()
    feature = [np.frombuffer(x, np.int32) for x in rows["feature"]]
    value = [np.frombuffer(x, np.float32) for x in rows["value"]]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in feature])]).astype(np.int64)
    join = lambda parts: np.concatenate([*parts, np.zeros(0)])
    return train(join(feature).astype(np.int64), join(value), bounds, np.array(rows["grade"], np.int64), grades)


def grade(docs: DataFrame, model: Model, *, tail: int, threshold: float = 0.5, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with ``expected_grade``, ``tail_probability`` (of grade ``tail`` or more) and ``selected``."""
    shared, width = docs.sparkSession.sparkContext.broadcast(model), len(carry)
    given = docs.select(*carry, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a, b, data, bounds in blocks(batch.column(width)):
                feature, value, at = features(data, bounds)
                total = np.concatenate([[0.0], np.cumsum(value * model.weights[feature])])
                above = model.above(total[at[1:]] - total[at[:-1]])
                chance = above[:, tail - 1]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(above.sum(axis=1)), pa.array(chance), pa.array(chance >= threshold)], [*batch.schema.names[:width], "expected_grade", "tail_probability", "selected"])

    schema = given.select(*carry).schema.add("expected_grade", "double").add("tail_probability", "double").add("selected", "boolean")
    return per_batch(given, run, schema)


def graded(labels: DataFrame) -> DataFrame:
    """Ratings of the label table: toxic is 0, poor is 1, good is 2."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))
