"""Texts as byte blocks: vectorised word splitting and hashing inside Arrow tasks.

A block is a run of whole texts laid end to end with their bounds. All helpers work on blocks of about
``BLOCK_BYTES``, so a task's memory follows the longest single text and not the number of rows of a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from plumbline.session import ship

BLOCK_BYTES = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 3)
U64 = np.uint64


def give_back() -> None:
    """Return what a task has freed to the system, so that a reused worker does not keep the peak of each task before."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def per_batch(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package present on the executors."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def fold_table(separators: Callable[[int], bool], *, cased: bool = False) -> np.ndarray:
    """Byte to byte: A-Z to a-z unless ``cased``, separators to 0; NUL is 0xFF, which UTF-8 does not use, unless it separates."""
    table = np.arange(256, dtype=np.uint8)
    table[0] = 0 if separators(0) else 0xFF
    if not cased:
        table[65:91] += 32
    for code in range(1, 256):
        if separators(int(table[code])):
            table[code] = 0
    return table


#: Words of letters, digits and every non-ASCII character.
ALNUM = fold_table(lambda b: b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F)
#: Words between ASCII white space.
SPACED = fold_table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
CASED = fold_table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D, cased=True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string column; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) for runs of whole texts of about ``limit`` bytes."""
    data, bounds = utf8(column)
    start, rows = 0, len(bounds) - 1
    while start < rows:
        end = int(np.searchsorted(bounds, bounds[start] + limit, "right")) - 1
        end = min(rows, max(start + 1, end))
        yield start, end, data[bounds[start] : bounds[end]], bounds[start : end + 1] - bounds[start]
        start = end


def find_words(data: np.ndarray, bounds: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, word starts, word ends, first word of each text and the total)."""
    folded = fold[data]
    size = len(folded)
    inside = np.zeros(size + 1, bool)
    inside[:size] = folded != 0
    opens = inside[:size].copy()
    opens[1:] &= ~inside[: size - 1]
    heads = bounds[:-1][bounds[:-1] < size]
    opens[heads] = inside[heads]
    starts = np.flatnonzero(opens)
    closes = inside[:size] & ~inside[1:]
    tails = bounds[1:][bounds[1:] > 0] - 1
    closes[tails] = inside[tails]
    ends = np.flatnonzero(closes) + 1
    return folded, starts, ends, np.searchsorted(starts, bounds)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


_state: dict[str, np.ndarray] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random value per byte, powers of the multiplier and of its inverse. Those of a block are kept by the worker; those
    of a longer text go with it."""
    if not _state:
        _state["byte"] = mix(np.arange(1, 257, dtype=U64) * MULTIPLIER)
        _state["up"], _state["down"] = steps(BLOCK_BYTES + (BLOCK_BYTES >> 2))
    up, down = (_state["up"], _state["down"]) if size < len(_state["up"]) else steps(size + 1)
    return _state["byte"], up, down


def steps(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse."""
    out = []
    for factor in (MULTIPLIER, U64(pow(int(MULTIPLIER), -1, 1 << 64))):
        power = np.full(count, factor, U64)
        power[0] = 1
        out.append(np.cumprod(power, dtype=U64))
    return tuple(out)


def byte_sums(folded: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes, from which words are hashed."""
    byte, up, _ = _powers(len(folded))
    sums = np.zeros(len(folded) + 1, U64)
    np.cumsum(byte[folded] * up[: len(folded)], dtype=U64, out=sums[1:])
    return sums


def hash_from(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    down = _powers(len(sums) - 1)[2]
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def hash_words(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial over its bytes from prefix sums, then mixed with its length."""
    return hash_from(byte_sums(folded), starts, ends)


def shingles(words: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first shingle of each text and the total): runs of ``width`` words of one text; a shorter text is one shingle."""
    counts = np.diff(firsts)
    per_text = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(per_text)])
    text_of = np.repeat(np.arange(len(counts)), per_text)
    at = np.arange(bounds[-1]) - bounds[:-1][text_of] + firsts[:-1][text_of]
    length = np.minimum(counts[text_of], width)
    total = np.zeros(len(at), U64)
    factors = mix(np.arange(11, 11 + width, dtype=U64) * MULTIPLIER) | U64(1)
    padded = np.concatenate([words, np.zeros(width, U64)])
    for k in range(width):
        total += np.where(k < length, padded[at + k] * factors[k], U64(0))
    return mix(total + length.astype(U64)), bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text in ascending order, and their bounds."""
    parts = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def totals(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set within each text."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


class Recent:
    """Which ids a task has met before: one slot for each value of the last bits, so of fixed size. ``fresh`` says which
    ids to send; an id is sent again only if it has lost its slot to another."""

    def __init__(self, log2: int = 17):
        self.slots, self.mask = np.zeros(1 << log2, np.int64), np.int64((1 << log2) - 1)

    def fresh(self, ids: np.ndarray) -> np.ndarray:
        _, once = np.unique(ids, return_index=True)
        slot = ids[once] & self.mask
        new = (self.slots[slot] != ids[once]) | (ids[once] == 0)
        self.slots[slot[new]] = ids[once][new]
        return np.sort(once[new])
