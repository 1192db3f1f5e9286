"""Benchmark decontamination with an FM-index per training shard.

A shard is a block of whole texts of one task. Its words are numbered by the benchmark's vocabulary (all other words
are one stop symbol, which no window contains, so a run without a whole window's length of known words is left out of
the index). Over the numbered runs stand a suffix array, its Burrows-Wheeler transform in a wavelet matrix with
popcount ranks, and suffix positions sampled by text position. All windows of the benchmark go through backward search
at once, their occurrences are located by walking to the next sample, and the spans of a text are merged.

The benchmark is the broadcast side. It is collected in hash blocks of about ``block_windows`` windows; with more than
one block, the passes run one after the other over a table in the shared folder, each with one block in memory.

Defined results: null text has no words; items without words have no window; an item of fewer words than the window is
one window of its own length; null item ids read as ``""``; repeated items each count once by id; rows are never joined
to each other, so repeated doc_ids are separate rows; an empty benchmark leaves every text clean; extra columns pass
through, output columns replace columns of the same name. Memory follows the longest text, at least a block.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.blocks import ALNUM, U64, blocks, find_words, per_batch
from plumbline.session import durable

WINDOW = 10
SAMPLE = 8
#: Fixed value: the contract's words, after A-Z became a-z.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
SPANS = "array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Patterns:
    """Distinct windows as rows of word numbers, right-aligned; ``owners[first[k]:first[k + 1]]`` are the items of window k."""

    vocabulary: dict[bytes, int]
    rows: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    owners: np.ndarray
    items: tuple[str, ...]


def compile_patterns(items: list[tuple[str, str | None]], window: int = WINDOW) -> Patterns:
    vocabulary: dict[bytes, int] = {}
    windows: dict[tuple[int, ...], set[int]] = defaultdict(set)
    names = tuple(sorted({name for name, _ in items}))
    number = {name: k for k, name in enumerate(names)}
    for name, text in items:
        words = [vocabulary.setdefault(w.encode(), len(vocabulary) + 1) for w in WORD.findall((text or "").translate(LOWER))]
        width = min(window, len(words))
        for k in range(len(words) - width + 1 if words else 0):
            windows[tuple(words[k : k + width])].add(number[name])
    rows = np.zeros((len(windows), window), np.int32)
    for k, w in enumerate(windows):
        rows[k, window - len(w) :] = w
    owners = [sorted(o) for o in windows.values()]
    first = np.concatenate([[0], np.cumsum([len(o) for o in owners])]).astype(np.int64)
    return Patterns(vocabulary, rows, np.array([len(w) for w in windows], np.int64), first, np.array([x for o in owners for x in o], np.int64), names)


class WaveletMatrix:
    """Ranks of symbols below 2**depth: one bit vector a level, counted in words of 64 bits."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.depth, self.size, self.levels = depth, len(symbols), []
        for level in range(depth - 1, -1, -1):
            bits = (symbols >> level) & 1
            padded = np.zeros(-(-(self.size + 1) // 64) * 64, np.uint8)
            padded[: self.size] = bits
            words = np.packbits(padded, bitorder="little").view(U64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((words, before, self.size - int(bits.sum())))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        words, before, _ = self.levels[level]
        mask = (U64(1) << (at & 63).astype(U64)) - U64(1)
        return before[at >> 6] + np.bitwise_count(words[at >> 6] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low = np.zeros_like(at)
        for k in range(self.depth):
            bit = (symbol >> (self.depth - 1 - k)) & 1 == 1
            one_a, one_b, zeros = self.ones(k, low), self.ones(k, at), self.levels[k][2]
            low, at = np.where(bit, zeros + one_a, low - one_a), np.where(bit, zeros + one_b, at - one_b)
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for k in range(self.depth):
            words, _, zeros = self.levels[k]
            bit = ((words[at >> 6] >> (at & 63).astype(U64)) & U64(1)) == 1
            one = self.ones(k, at)
            out = out * 2 + bit
            at = np.where(bit, zeros + one, at - one)
        return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order by prefix doubling; only suffixes that still share a rank are sorted again."""
    size = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(size, np.int64)
    heads = np.concatenate([[True], symbols[order][1:] != symbols[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(size), 0))
    step = 1
    while True:
        group = rank[order]
        open_ = np.zeros(size, bool)
        open_[1:] = group[1:] == group[:-1]
        open_[:-1] |= open_[1:]
        slots = np.flatnonzero(open_)
        if not len(slots):
            return order
        at = order[slots]
        after = at + step
        second = np.where(after < size, rank[np.minimum(after, size - 1)], -1)
        sort = np.lexsort((second, rank[at]))
        at, second = at[sort], second[sort]
        order[slots] = at
        same = rank[at]
        new = np.concatenate([[True], (same[1:] != same[:-1]) | (second[1:] != second[:-1])])
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        step *= 2


class FMIndex:
    """Backward search and location over one shard's symbols; symbol 0 separates runs."""

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = SAMPLE):
        suffixes = suffix_array(symbols)
        bwt = symbols[suffixes - 1]
        self.size = len(symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet))])
        self.tree = WaveletMatrix(bwt.astype(np.int64), max(1, int(alphabet - 1).bit_length()))
        marked = (suffixes % sample == 0) | (bwt == 0)  # a walk never steps over a separator
        self.marked, self.marks_before = marked, np.cumsum(marked) - marked
        self.samples = suffixes[marked]

    def back(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.tree.rank(symbol, at)

    def search(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row number, first suffix, end suffix) of each pattern that occurs."""
        live = np.arange(len(rows))
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), self.size, np.int64)
        width = rows.shape[1]
        for k in range(width - 1, -1, -1):
            step = width - k <= lengths[live]
            symbol = rows[live, k].astype(np.int64)
            low = np.where(step, self.back(symbol, low), low)
            high = np.where(step, self.back(symbol, high), high)
            on = low < high
            live, low, high = live[on], low[on], high[on]
        return live, low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back to a sampled one are added up."""
        steps, out, rest = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.arange(len(at))
        while len(rest):
            done = self.marked[at]
            out[rest[done]] = self.samples[self.marks_before[at[done]]] + steps[rest[done]]
            rest, at = rest[~done], at[~done]
            steps[rest] += 1
            at = self.back(self.tree.access(at), at)
        return out


def runs_of(known: np.ndarray, firsts: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with a 0 after each run, word number of each symbol) for runs of known words of one text, long enough for a window."""
    inside = known > 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = firsts[:-1][firsts[:-1] < len(known)]
    opens[heads] = inside[heads]
    starts = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    tails = firsts[1:][firsts[1:] > 0] - 1
    closes[tails] = inside[tails]
    ends = np.flatnonzero(closes) + 1
    long = ends - starts >= shortest
    starts, ends = starts[long], ends[long]
    sizes = ends - starts + 1
    place = np.concatenate([[0], np.cumsum(sizes)])
    number = np.arange(place[-1]) - np.repeat(place[:-1], sizes) + np.repeat(starts, sizes)
    symbols = known[np.minimum(number, len(known) - 1)] if len(known) else known[:0]
    symbols = symbols.copy()
    symbols[place[1:] - 1] = 0
    return symbols, number


def occurrences(known: np.ndarray, firsts: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(word number, window) of every occurrence in a shard, by its FM-index."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(patterns.rows):
        return none
    symbols, number = runs_of(known, firsts, int(patterns.lengths.min()))
    if not len(symbols):
        return none
    index = FMIndex(symbols, len(patterns.vocabulary) + 1)
    found, low, high = index.search(patterns.rows, patterns.lengths)
    if not len(found):
        return none
    sizes = high - low
    place = np.concatenate([[0], np.cumsum(sizes)])
    rows = np.arange(place[-1]) - np.repeat(place[:-1] - low, sizes)
    return number[index.locate(rows)], np.repeat(found, sizes)


def scan(data: np.ndarray, bounds: np.ndarray, patterns: Patterns):
    """For each text of a shard: (number of words, merged word spans, byte spans, items)."""
    folded, starts, ends, firsts = find_words(data, bounds, ALNUM)
    get, joined = patterns.vocabulary.get, folded.tobytes()
    words = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    known = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
    at, window = occurrences(known, firsts, patterns)
    total = len(known)
    cover = np.zeros(total + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + patterns.lengths[window], -1)
    hit = np.cumsum(cover)[:total] > 0
    text = np.searchsorted(firsts, at, "right") - 1
    items: dict[int, set[int]] = defaultdict(set)
    pairs = np.unique(np.stack([text, window]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
    for t, w in pairs.T.tolist():
        items[t].update(patterns.owners[patterns.first[w] : patterns.first[w + 1]].tolist())
    for t in range(len(bounds) - 1):
        a, b = int(firsts[t]), int(firsts[t + 1])
        if t not in items:
            yield b - a, [], [], []
            continue
        flags = np.concatenate([[False], hit[a:b], [False]])
        edges = np.flatnonzero(flags[1:] != flags[:-1])
        spans = edges.reshape(-1, 2)
        bytes_ = [(int(starts[a + x] - bounds[t]), int(ends[a + y - 1] - bounds[t])) for x, y in spans]
        yield b - a, [(int(x), int(y)) for x, y in spans], bytes_, sorted(patterns.items[k] for k in items[t])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, block_windows: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark, collected in hash blocks of about ``block_windows`` words."""
    given = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    words = given.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) / 4)).first()[0] or 0
    parts = max(1, -(-int(words) // block_windows))
    for k in range(parts):
        yield [(r["item"], r["text"]) for r in given.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k).collect()]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
    block_windows: int = 2_000_000, carry: list[str] | None = None,
) -> DataFrame:
    """The carried columns (all, unless named) with ``n_words``, ``hit_spans`` (word numbers), ``removal_spans`` (bytes of
    the UTF-8 text) and ``hit_items`` (item ids as strings, sorted); spans are merged, start included and end not."""
    added = ("n_words", "hit_spans", "removal_spans", "hit_items")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in added]
    state = docs.select(*carry, F.col(text).alias("__text"), F.lit(0).cast("long").alias("n_words"), *(F.array().cast(SPANS).alias(c) for c in added[1:3]), F.array().cast("array<string>").alias("hit_items"))
    width, spark = len(carry), docs.sparkSession
    for number, items in enumerate(benchmark_blocks(benchmark, item_id, item_text, block_windows)):
        if number:
            state = durable(state)
        shared = spark.sparkContext.broadcast(compile_patterns(items, window))
        state = per_batch(state, _pass(shared, width, first=not number), state.schema)
    return state.drop("__text")


def _pass(shared, width: int, first: bool):
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = shared.value
        for batch in batches:
            for a, b, data, bounds in blocks(batch.column(width)):
                rows = list(scan(data, bounds, patterns))
                part = batch.slice(a, b - a)
                if not first:
                    rows = [
                        (n, merged(s + [(x["start"], x["end"]) for x in s0]), merged(r + [(x["start"], x["end"]) for x in r0]), sorted({*i, *i0}))
                        for (n, s, r, i), s0, r0, i0 in zip(rows, *(part.column(width + k).to_pylist() for k in (2, 3, 4)), strict=True)
                    ]
                spans = [pa.array([[{"start": x, "end": y} for x, y in row[k]] for row in rows], spans_type) for k in (1, 2)]
                out = [*part.columns[: width + 1], pa.array([row[0] for row in rows], pa.int64()), *spans, pa.array([row[3] for row in rows], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(out, batch.schema.names)

    return run


def digest(found: DataFrame, *keep: str) -> DataFrame:
    """The contract's columns from ``find_contamination``."""
    return found.select(
        *keep, "n_words", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"),
    )


def remove_spans(found: DataFrame, text: str = "text", spans: str = "removal_spans") -> DataFrame:
    """``text`` without its removal spans; texts without any stay as they are."""
    raw = F.col(text).cast("binary")
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(text)))
    kept = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda p: F.substring(raw, p["a"] + 1, p["b"] - p["a"]).cast("string"))
    return found.withColumn(text, F.when(F.size(spans) > 0, F.array_join(kept, "")).otherwise(F.col(text)))
