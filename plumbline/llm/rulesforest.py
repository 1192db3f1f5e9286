"""Quality rules: an isolation forest over rule statistics.

Each text gets counts that quality rules look at (words, symbols, repeated lines and words, ...). Two base rules decide
first; the rest is judged by an isolation forest over ratios of the counts. A tree splits its share of the labelled
documents at random features and values until each stands alone; odd documents are alone after few splits. The score is
2 ** (-mean path length / expected length), near 1 for odd documents and below 0.5 for common ones. A cut for each band of
lengths (short texts have odder ratios) is set from labelled rows: the cut that tells poor from good best among those that
lose at most ``good_loss`` of the good.

All labelled documents take part: each is dealt to a tree, and to several where trees would else have fewer than ``DRAW``
rows. All trees grow by a level in a pass over the counts, in which tasks keep the least and largest values of each node.
Cuts come from how many good and poor rows have each score, in steps of 1 / ``STEPS``. What the driver gets is of fixed size.

Defined results: null text is empty, has no words and fails; equal texts have equal scores; of several labels of a
document the lowest quality holds; null labels and labels of unknown documents are not used; a band without good or
without poor labelled rows takes the cut of all of them, and without any labels no document fails but by the base rules;
rows that repeat a doc_id are judged one by one; an empty table stays empty; extra columns are ignored. Words, lines and
8-word windows are compared by 64-bit hashes. Memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.blocks import CASED, U64, blocks, find_words, hash_words, mix, per_batch, shingles, totals
from plumbline.session import discard, durable

TREES, DRAW, DEPTH = 100, 256, 8
#: Scores are between 0 and 1; cuts are looked for in so many steps.
STEPS = 1 << 16
WINDOW = 8
#: Cuts are set apart for texts of fewer words than these, and for the rest.
BANDS = (50, 200, 1000)
GOOD_LOSS = 0.01
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_lines", "n_upper", "n_digits"]
SYMBOL, UPPER, DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")], UPPER[65:91], DIGIT[48:58] = True, True, True


def groups(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts by owner and value, number of the run of equals in that order)."""
    order = np.lexsort((values, owner))
    new = np.ones(len(order), bool)
    new[1:] = (values[order][1:] != values[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    return order, np.cumsum(new) - 1


def repeated_words(hashes: np.ndarray, firsts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """How many words of each text stand in a window that the text holds twice or more."""
    found, bounds = shingles(hashes, firsts, window)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order, run = groups(found, owner)
    again = np.zeros(len(found), bool)
    again[order] = np.bincount(run)[run] > 1 if len(run) else False
    at = np.flatnonzero(again)
    start = at - bounds[owner[at]] + firsts[owner[at]]
    edge = np.bincount(start, minlength=len(hashes) + 1) - np.bincount(start + window, minlength=len(hashes) + 1)[: len(hashes) + 1]
    return totals(np.cumsum(edge)[: len(hashes)] > 0, firsts)


def repeated_lines(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, those of them that equal an earlier line) of each text."""
    rows, size = len(bounds) - 1, len(data)
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(bounds[:-1], breaks + 1)
    starts = starts[starts < size]
    ends = np.concatenate([starts[1:], [size]])[: len(starts)]
    ends = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10))
    owner = np.searchsorted(bounds, starts, "right") - 1
    sums = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    own = sums[ends] > sums[starts]
    starts, ends, owner = starts[own], ends[own], owner[own]
    lines = np.bincount(owner, minlength=rows)
    order, run = groups(hash_words(data, starts, ends), owner)
    first = np.ones(len(run), bool)
    first[1:] = run[1:] != run[:-1]
    return lines, lines - np.bincount(owner[order][first], minlength=rows)


def counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """``COUNTS`` of each text of a block."""
    folded, starts, ends, firsts = find_words(data, bounds, CASED)
    hashes, inside = hash_words(folded, starts, ends), folded != 0
    lines, again = repeated_lines(data, bounds, inside)
    return {
        "n_words": np.diff(firsts),
        "word_chars": totals(inside & ((data & 0xC0) != 0x80), bounds),
        "n_symbols": totals(SYMBOL[data], bounds),
        "n_dup_lines": again,
        "n_repeat_words": repeated_words(hashes, firsts),
        "n_lines": lines,
        "n_upper": totals(UPPER[data], bounds),
        "n_digits": totals(DIGIT[data], bounds),
    }


def base_failed(found: dict[str, np.ndarray]) -> np.ndarray:
    return (found["n_words"] < 20) | (100 * found["n_repeat_words"] > 30 * found["n_words"])


def ratios(found: dict[str, np.ndarray]) -> np.ndarray:
    """The forest's features, (texts, features). Marks and capitals, of which common texts have few, count at two scales."""
    words, chars = np.maximum(found["n_words"], 1), np.maximum(found["word_chars"], 1)
    symbols, upper = found["n_symbols"] / chars, found["n_upper"] / chars
    repeats = [found["n_dup_lines"] / np.maximum(found["n_lines"], 1), found["n_repeat_words"] / words]
    columns = [found["word_chars"] / words, found["n_symbols"] / words, symbols, np.sqrt(symbols), *repeats, upper, np.sqrt(upper), found["n_digits"] / chars]
    return np.stack(columns, axis=1).astype(np.float64)


def expected_length(n: np.ndarray) -> np.ndarray:
    """Mean length of an unsuccessful search in a random binary tree of n leaves."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Complete trees in arrays: node i has the children 2i + 1 and 2i + 2; a node without a split has feature -1 and sends
    everything left. ``lengths`` are the path lengths of the deepest nodes. ``cuts`` are by band."""

    feature: np.ndarray
    value: np.ndarray
    lengths: np.ndarray
    draw: int
    cuts: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.zeros(len(x))
        total, rows, inner = np.zeros(len(x)), np.arange(len(x)), self.feature.shape[1]
        for feature, value, lengths in zip(self.feature, self.value, self.lengths, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (x[rows, f] >= value[node]))
            total += lengths[node - inner]
        return 2.0 ** (-total / len(self.feature) / max(float(expected_length(self.draw)), 1e-9))

    def kept(self, found: dict[str, np.ndarray], score: np.ndarray) -> np.ndarray:
        return ~base_failed(found) & (score < self.cuts[band(found["n_words"])])


def band(n_words: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(BANDS), n_words, "right")


class Growing:
    """Trees that grow by a level at a time, in the arrays of a ``Forest``, from the extents of their nodes."""

    def __init__(self, trees: int, depth: int = DEPTH):
        inner = (1 << depth) - 1
        self.depth, self.feature, self.value = depth, np.full((trees, inner), -1), np.zeros((trees, inner))
        self.lengths = np.full((trees, inner + 1), np.nan)

    def nodes(self, x: np.ndarray, tree: np.ndarray, level: int) -> np.ndarray:
        """The node of ``level`` that each row reaches in its tree."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(level):
            f = self.feature[tree, node]
            node = 2 * node + 1 + ((f >= 0) & (x[rows, f] >= self.value[tree, node]))
        return node

    def split(self, level: int, tree: np.ndarray, node: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> None:
        """Split the nodes of a level, of ``n`` rows each, or end them where all rows are equal or the tree is deep enough."""
        wide = high > low
        ended = ~wide.any(axis=1) | (level == self.depth)
        first = ((node + 1) << (self.depth - level)) - 1 - self.feature.shape[1]  # the leftmost of the deepest nodes below
        new = ended & np.isnan(self.lengths[tree, first])  # a node below one that has ended changes nothing
        self.lengths[tree[new], first[new]] = level + expected_length(n[new])
        drawn, at = np.where(wide, rng.random(wide.shape), -1.0), rng.random(len(node))
        f, row = np.argmax(drawn, axis=1), np.arange(len(node))
        low, high = low[row, f], high[row, f]
        cut = np.maximum(low + (high - low) * (1 - at), np.nextafter(low, np.inf))  # both sides have rows
        self.feature[tree[~ended], node[~ended]], self.value[tree[~ended], node[~ended]] = f[~ended], cut[~ended]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.feature, self.value, np.nan_to_num(self.lengths)


class Extents:
    """Number of rows, least and largest values of the nodes of a level; of fixed size."""

    def __init__(self, nodes: int, width: int):
        self.n = np.zeros(nodes, np.int64)
        self.low, self.high = np.full((nodes, width), np.inf), np.full((nodes, width), -np.inf)

    def add(self, x: np.ndarray, at: np.ndarray) -> None:
        if len(at):
            order = np.argsort(at, kind="stable")
            there, start, n = np.unique(at[order], return_index=True, return_counts=True)
            self.n[there] += n
            self.low[there] = np.minimum(self.low[there], np.minimum.reduceat(x[order], start))
            self.high[there] = np.maximum(self.high[there], np.maximum.reduceat(x[order], start))


def grow(x: np.ndarray, rng: np.random.Generator, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree over the rows of ``x``."""
    growing, own = Growing(1, depth), np.zeros(len(x), np.int64)
    for level in range(depth + 1):
        first, extents = (1 << level) - 1, Extents(1 << level, x.shape[1])
        extents.add(x, growing.nodes(x, own, level) - first)
        there = np.flatnonzero(extents.n)
        growing.split(level, there * 0, there + first, extents.n[there], extents.low[there], extents.high[there], rng)
    return tuple(part[0] for part in growing.arrays())


def dealt(ids: np.ndarray, copies: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, tree): ``copies`` different trees for each row, by a hash of its id."""
    hashes = mix(ids.astype(np.int64).view(U64))
    strides = np.array([s for s in range(1, TREES) if np.gcd(s, TREES) == 1])
    stride = strides[(hashes >> U64(32)) % U64(len(strides))]
    trees = (hashes % U64(TREES)).astype(np.int64)[:, None] + stride[:, None] * np.arange(copies)
    return np.repeat(np.arange(len(ids)), copies), (trees % TREES).ravel()


def best_cut(step: np.ndarray, good: np.ndarray, poor: np.ndarray, good_loss: float) -> float:
    """Scores from it on are rejected: the cut with the largest share of poor minus share of good rows above it, among those
    that lose ``good_loss`` of the good at most. ``good`` and ``poor`` count the rows of each ``step``, which ascend."""
    above = lambda n: np.cumsum(n[::-1])[::-1] / max(n.sum(), 1)
    lost, caught = above(good), above(poor)
    gain = np.where(lost <= good_loss, caught - lost, -1.0)
    k = int(np.argmax(gain))
    if gain[k] <= 0:
        return np.inf
    below = step[k - 1] + 1 if k else step[k]
    return float((step[k] + below) / 2 / STEPS)  # halfway to the next score that is kept


def statistics(docs: DataFrame) -> DataFrame:
    """The given columns but ``text``, with ``COUNTS``."""
    carry = [c for c in docs.columns if c != "text"]
    given, width = docs.select(*carry, "text"), len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in blocks(batch.column(width)):
                found = counts(data, bounds)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:width], *[pa.array(found[c], pa.int64()) for c in COUNTS]], [*carry, *COUNTS])

    schema = given.select(*carry).schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    return per_batch(given, run, schema)


def fit(docs: DataFrame, labels: DataFrame, *, good_loss: float = GOOD_LOSS, seed: int = 7) -> Forest:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``."""
    return fit_counted(statistics(docs.select("doc_id", "text")), labels, good_loss=good_loss, seed=seed)


def fit_counted(counted: DataFrame, labels: DataFrame, *, good_loss: float = GOOD_LOSS, seed: int = 7) -> Forest:
    """``fit`` from ``counted(doc_id, COUNTS)``."""
    rated = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = durable(counted.select("doc_id", *COUNTS).join(rated, "doc_id"))
    n, rng = rows.count(), np.random.default_rng(seed)
    growing = Growing(TREES if n else 0)
    copies = min(TREES, max(1, -(-TREES * DRAW // max(n, 1))))
    for level in range(DEPTH + 1 if n else 0):
        found = _extents(rows, growing, level, copies)
        growing.split(level, *found, rng)
    forest = Forest(*growing.arrays(), max(1, n * copies // TREES), np.full(len(BANDS) + 1, np.inf))
    steps = judge_counted(rows, forest).where("not base_failed").select(
        "quality", _band(F.col("n_words")).alias("band"), F.floor(F.col("anomaly") * STEPS).alias("step")
    )
    good = F.col("quality") == 1
    cells = steps.groupBy("band", "step").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("poor")).orderBy("step").toArrow()  # of fixed size
    band_of, step, good, poor = (cells.column(c).to_numpy() for c in ("band", "step", "good", "poor"))
    both = good.any() and poor.any()
    every, at = np.unique(step, return_inverse=True)
    overall = best_cut(every, np.bincount(at, good), np.bincount(at, poor), good_loss) if both else np.inf
    for k in range(len(BANDS) + 1):
        own = band_of == k
        forest.cuts[k] = best_cut(step[own], good[own], poor[own], good_loss) if good[own].any() and poor[own].any() else overall
    discard(rows)
    return forest


def _band(n_words: Column) -> Column:
    return sum(((n_words >= b).cast("int") for b in BANDS), F.lit(0))


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return ratios({c: batch.column(c).to_numpy() for c in COUNTS})


def _extents(rows: DataFrame, growing: Growing, level: int, copies: int) -> tuple[np.ndarray, ...]:
    """(tree, node, n, low, high) of the nodes of a level that have rows."""
    shared, size, first = rows.sparkSession.sparkContext.broadcast(growing), 1 << level, (1 << level) - 1
    width = len(ratios({c: np.zeros(0) for c in COUNTS}).T)
    lows, highs = [f"low{k}" for k in range(width)], [f"high{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        growing, extents = shared.value, Extents(TREES * size, width)
        for batch in batches:
            x, ids = _features(batch), batch.column("doc_id").to_numpy()
            row, tree = dealt(ids, copies)
            extents.add(x[row], tree * size + growing.nodes(x[row], tree, level) - first)
        there = np.flatnonzero(extents.n)
        columns = [there, extents.n[there], *extents.low[there].T, *extents.high[there].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["at", "n", *lows, *highs])

    schema = "at long, n long, " + ", ".join(f"{c} double" for c in [*lows, *highs])
    parts = per_batch(rows.select("doc_id", *COUNTS), run, schema)
    whole = parts.groupBy("at").agg(F.sum("n").alias("n"), *[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs]).orderBy("at").toArrow()  # of fixed size
    at, n = whole.column("at").to_numpy(), whole.column("n").to_numpy()
    stack = lambda names: np.stack([whole.column(c).to_numpy() for c in names], axis=1)
    return at // size, at % size + first, n, stack(lows), stack(highs)


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    """The given columns but ``text``, with ``COUNTS``, ``base_failed``, ``anomaly`` and ``kept``."""
    return judge_counted(statistics(docs), forest)


def judge_counted(counted: DataFrame, forest: Forest) -> DataFrame:
    """The given columns, among them ``COUNTS``, with ``base_failed``, ``anomaly`` and ``kept``."""
    shared = counted.sparkSession.sparkContext.broadcast(forest)  # of fixed size
    names = [*counted.columns, "base_failed", "anomaly", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            found = {c: batch.column(c).to_numpy() for c in COUNTS}
            score = forest.score(ratios(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base_failed(found)), pa.array(score), pa.array(forest.kept(found, score))], names)

    schema = counted.select("*").schema  # of its own, as ``add`` changes it
    return per_batch(counted, run, schema.add("base_failed", "boolean").add("anomaly", "double").add("kept", "boolean"))
