"""Filter interaction audit: what each of five filters removes in each of the 120 orders in which they can run.

A document's failures are five bits. ``FIRST``, 32 masks by 120 orders, says at which step a mask is removed, so one
look-up a mask replaces 120 runs of the filters. Documents fold to counts by part, mask and label before they leave their
task; the look-up's steps are added up by part, order and step with ``np.bincount`` in ``mapInArrow``, and Spark sums the
partial arrays.

Filters: A under 50 words; B 100 * distinct words < 65 * words; C 100 * capitals (A-Z) > 5 * code points; D any of
``#$%&*|``; E the same text as a smaller doc_id, removed or not. Distinct words go by 64-bit hashes, texts by 128-bit ones.

A text's first doc_id is found by a grouped minimum, and documents meet it on (text, doc_id); a text of which there are
many copies never comes together in one task.

Defined results: null text is empty, so it fails A and is a copy of other empty texts; null source is the part ''; rows
without a doc_id have no smaller doc_id and no label, so they never fail E; rows that repeat a doc_id count one by one and
none is a copy of the other; of several labels of a document any that says good or toxic holds; labels of unknown documents
and null labels are not used; extra columns are ignored; an empty table gives no row. Memory follows the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.blocks import CASED, blocks, distinct, find_words, hash_words, per_batch, totals
from plumbline.session import durable

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: The filter's number at each step: orders by steps.
AT_STEP = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
#: Masks by filters: which filters a mask fails.
FAILS = (np.arange(1 << STEPS)[:, None] >> np.arange(STEPS)[None, :]) & 1
_in_order = FAILS[:, AT_STEP]
#: Masks by orders: the step (from 0) that removes the mask; STEPS if none does.
FIRST = np.where(_in_order.any(axis=2), _in_order.argmax(axis=2), STEPS)
COPY = 1 << FILTERS.index("E")
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
UPPER, MARKS = np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91] = True
MARKS[list(b"#$%&*|")] = True
#: Parts whose arrays a task holds at a time: 600 cells of a few numbers each.
PARTS_AT_ONCE = 64


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) a document, with the bits of A to D and a digest of the text."""
    given = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in blocks(batch.column(2)):
                folded, starts, ends, firsts = find_words(data, bounds, CASED)
                n_words, n_chars = np.diff(firsts), totals((data & 0xC0) != 0x80, bounds)
                n_distinct = np.diff(distinct(hash_words(folded, starts, ends), firsts)[1])
                failed = [
                    n_words < 50,
                    100 * n_distinct < 65 * n_words,
                    100 * totals(UPPER[data], bounds) > 5 * n_chars,
                    totals(MARKS[data], bounds) > 0,
                ]
                mask = sum(f.astype(np.int32) << k for k, f in enumerate(failed))
                view = memoryview(np.ascontiguousarray(data))
                digest = [hashlib.blake2b(view[i:j], digest_size=16).digest() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                part = batch.slice(a, b - a)
                columns = [part.column(0), part.column(1), pa.array(mask, pa.int32()), pa.array(digest, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "mask", "digest"])

    schema = given.select("doc_id", "part").schema.add("mask", "integer").add("digest", "binary")
    return per_batch(given, run, schema)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part and label fail just the filters of the mask."""
    rows = durable(failures(docs).groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")))
    named = rows.where("doc_id is not null")
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    known = named.join(firsts, ["doc_id", "digest"], "left").join(said, "doc_id", "left").select(
        "part",
        F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask").bitwiseOR(COPY)).alias("mask"),
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
        "n",
    )
    nameless = rows.where("doc_id is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n")
    return known.unionByName(nameless).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def tally(part: np.ndarray, mask: np.ndarray, good: np.ndarray, toxic: np.ndarray, n: np.ndarray, parts: int) -> list[np.ndarray]:
    """``MEASURES``, each (parts, orders, steps), of counted masks; ``part`` numbers the parts from 0."""
    cells = len(ORDERS) * (STEPS + 1)
    at = part[:, None] * cells + np.arange(len(ORDERS))[None, :] * (STEPS + 1) + FIRST[mask]

    def removals(weight: np.ndarray) -> np.ndarray:
        """Documents by part, order and step; the last step is that of the kept ones. Counts are below 2**53, so exact."""
        found = np.bincount(at.ravel(), np.repeat(weight, len(ORDERS)), parts * cells)
        return found.astype(np.int64).reshape(parts, len(ORDERS), STEPS + 1)

    def by_filter(flags: np.ndarray) -> np.ndarray:
        """Documents by part and filter whose flag is set."""
        return np.stack([np.bincount(part, n * flags[:, f], parts) for f in range(STEPS)], axis=1).astype(np.int64)

    gone = removals(n)
    removed, rest = gone[:, :, :STEPS], gone.sum(axis=2, keepdims=True)
    alone = by_filter(FAILS[mask] * (FAILS[mask].sum(axis=1, keepdims=True) == 1))
    filters = (np.arange(parts)[:, None] * STEPS + AT_STEP.reshape(1, -1)).ravel()
    shapley = np.bincount(filters, removed.ravel(), parts * STEPS).astype(np.int64).reshape(parts, STEPS)
    return [
        rest - np.cumsum(removed, axis=2),
        removed,
        by_filter(FAILS[mask])[:, AT_STEP] - removed,
        alone[:, AT_STEP],
        removals(n * good)[:, :, :STEPS],
        removals(n * toxic)[:, :, :STEPS],
        shapley[:, AT_STEP],
    ]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, *MEASURES): a row for each part, order and step of ``docs(doc_id, source, text)`` with
    ``labels(doc_id, quality, toxic)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, number = np.unique(np.array(batch.column(0).to_pylist(), dtype=object), return_inverse=True)
            mask, good, toxic, n = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(1, 5))
            for low in range(0, len(names), PARTS_AT_ONCE):
                some = names[low : low + PARTS_AT_ONCE]
                own = np.flatnonzero((number >= low) & (number < low + len(some)))
                found = tally(number[own] - low, mask[own], good[own], toxic[own], n[own], len(some))
                label = pa.array(np.repeat(some, len(ORDERS) * STEPS), pa.string())
                order = pa.array(np.tile(np.repeat(ORDERS, STEPS), len(some)), pa.string())
                step = pa.array(np.tile(np.arange(1, STEPS + 1), len(some) * len(ORDERS)), pa.int32())
                columns = [label, order, step, *[pa.array(x.ravel(), pa.int64()) for x in found]]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *MEASURES])

    counts = mask_counts(docs, labels).repartition("part")  # at most 128 rows a part
    schema = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES)
    partial = per_batch(counts, run, schema)
    return partial.groupBy("part", "filter_order", "step").agg(*[F.sum(m).alias(m) for m in MEASURES])
