"""Language identification with bit-sliced n-gram filters.

One Bloom filter per language holds the byte n-grams that are characteristic of it. The filters are stored
bit-sliced: a slot keeps one bit per language, so ANDing the slots of a gram's hashes returns the bitmask of all
languages that contain it. A text's score for a language is the popcount of that bit over the text's grams,
corrected for the false positives that the filter's fill predicts.

Defined results: null text or text without a letter gives ``und`` and score 0; whole texts are read, and memory
follows the longest one; equal texts get equal answers; ties go to the language with more training rows, then to the
smaller name; without training rows every text is ``und``; repeated rows repeat their answer; an empty table stays empty.
Extra columns pass through ``predict`` untouched (``carry``
names those to return) except that the output columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.blocks import U64, blocks, fold_table, mix, per_batch, signed

UNKNOWN = "und"
#: Byte n-gram lengths; accented letters are two bytes.
ORDERS = (4, 6)
#: Bytes of a block of texts here: each byte takes two n-grams, several numbers each.
SMALL = 1 << 18
LETTERS = fold_table(lambda b: not 0x61 <= b <= 0x7A and b < 0x80)


@dataclass(frozen=True)
class Model:
    """Bit-sliced filters: ``slots[plane]`` holds 64 languages a word."""

    languages: tuple[str, ...]
    slots: np.ndarray
    hashes: int

    def false_positive(self) -> np.ndarray:
        """For each language, the chance that a gram it lacks looks present."""
        fill = [np.bitwise_count(self.slots[k // 64] & U64(1 << (k % 64))).mean() for k in range(len(self.languages))]
        return np.array(fill) ** self.hashes

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """(planes, grams): the languages that contain each gram."""
        out = np.full((len(self.slots), len(grams)), ~U64(0))
        for at in slot_numbers(grams, self.hashes, self.slots.shape[1]):
            out &= self.slots[:, at]
        return out


def slot_numbers(grams: np.ndarray, hashes: int, size: int) -> list[np.ndarray]:
    first = mix(grams)
    return [((first + U64(k) * (mix(first + U64(77)) | U64(1))) % U64(size)).astype(np.int64) for k in range(hashes)]


def grams_of(data: np.ndarray, bounds: np.ndarray, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """(gram, text number) of all n-grams that hold a letter; each text stands between spaces."""
    rows, lengths = len(bounds) - 1, np.diff(bounds)
    pad = max(orders)
    text_of = np.repeat(np.arange(rows, dtype=np.int32), lengths + pad)
    line = np.zeros(len(text_of), np.uint8)
    line[np.arange(len(data)) + np.repeat(np.arange(rows) * pad + 1, lengths)] = LETTERS[data]
    wide, grams, owners = line.astype(U64), [], []
    for order in orders:
        count = len(line) - order + 1
        if count <= 0:
            continue
        gram = np.zeros(count, U64)
        for k in range(order):
            gram |= wide[k : k + count] << U64(8 * k)
        ok = (gram & U64(0xFFFF)) != 0
        ok &= (text_of[:count] == text_of[order - 1 :]) | (line[order - 1 :] == 0)
        grams.append(gram[ok] + (U64(order) << U64(56)))
        owners.append(text_of[:count][ok])
    return np.concatenate(grams), np.concatenate(owners)


def fit(docs: DataFrame, *, rows_per_language: int = 2500, min_count: int = 3, min_share: float = 0.25, log2_slots: int = 20, hashes: int = 2) -> Model:
    """Learn filters from ``docs(doc_id, text, lang)``.

    ``rows_per_language`` bounds the sample: about so many labelled rows of each language, chosen by a hash of doc_id.
    A gram enters a language's filter when it was seen ``min_count`` times there and its relative frequency is at
    least ``min_share`` of the highest among all languages.
    """
    spark = docs.sparkSession
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    seen = sorted(((r["lang"], r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()), key=lambda x: (-x[1], x[0]))
    languages = tuple(name for name, _ in seen)
    planes, size = max(1, -(-len(languages) // 64)), 1 << log2_slots
    slots = np.zeros((planes, size), U64)
    if not languages:
        return Model((), slots, hashes)
    shares = spark.createDataFrame([(name, k, min(1.0, rows_per_language / n)) for k, (name, n) in enumerate(seen)], "lang string, language int, share double")
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = labelled.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("text", "language")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, data, bounds in blocks(batch.column(0), SMALL):
                gram, owner = grams_of(data, bounds)
                language = tags[a:b][owner]
                for k in np.unique(language):
                    values, n = np.unique(gram[language == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(signed(values)), pa.array(n)], ["language", "gram", "n"])

    counts = per_batch(sample, count, "language int, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("language").agg(F.sum("n").alias("total"))
    rated = counts.join(F.broadcast(totals), "language").withColumn("rate", F.col("n") / F.col("total"))
    best = F.max("rate").over(Window.partitionBy("gram"))
    kept = rated.withColumn("best", best).where((F.col("n") >= min_count) & (F.col("rate") >= min_share * F.col("best"))).select("language", "gram")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language = batch.column(0).to_numpy(zero_copy_only=False)
            gram = batch.column(1).to_numpy(zero_copy_only=False).view(U64)
            for at in slot_numbers(gram, hashes, size):
                yield pa.RecordBatch.from_arrays([pa.array(language // 64), pa.array(at), pa.array(np.left_shift(np.int64(1), (language % 64).astype(np.int64)))], ["plane", "slot", "bits"])

    # At most planes * 2**log2_slots rows reach the driver, whatever the input.
    filled = per_batch(kept, place, "plane int, slot long, bits long").groupBy("plane", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    slots[filled.column("plane").to_numpy(), filled.column("slot").to_numpy()] = filled.column("bits").to_numpy().view(U64)
    return Model(languages, slots, hashes)


def tally(model: Model, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, languages) popcounts and grams per text."""
    rows = len(bounds) - 1
    gram, owner = grams_of(data, bounds)
    total = np.bincount(owner, minlength=rows)
    masks, counts = model.masks(gram), np.zeros((rows, len(model.languages)), np.int64)
    for k in range(len(model.languages)):
        hit = (masks[k // 64] >> U64(k % 64)) & U64(1) != 0
        counts[:, k] = np.bincount(owner[hit], minlength=rows)
    return counts, total


def decide(model: Model, wrong: np.ndarray, counts: np.ndarray, total: np.ndarray, lettered: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Best language by corrected popcount; the score is its share of the text's grams."""
    if not model.languages:
        return [UNKNOWN] * len(total), np.zeros(len(total))
    n = np.maximum(total, 1)[:, None]
    found = np.clip((counts - total[:, None] * wrong) / np.maximum(1 - wrong, 1e-9), 0, None)
    best = found.argmax(axis=1)
    score = np.clip(found[np.arange(len(best)), best] / n[:, 0], 0, 1)
    known = lettered & (total > 0)
    return [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def predict(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all, unless named) with ``lang_pred`` and ``lang_score``; only ``text`` is looked at."""
    docs = docs.drop("lang_pred", "lang_score")
    carry = docs.columns if carry is None else carry
    kept = docs.select(*carry)
    docs = docs.select(*carry, F.col(text).alias("__text"))
    shared, place = docs.sparkSession.sparkContext.broadcast(model), len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        wrong = model.false_positive() if model.languages else None
        for batch in batches:
            column = batch.column(place)
            lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            names, scores = [], [np.zeros(0)]
            for a, b, data, bounds in blocks(column, SMALL):
                counts, total = tally(model, data, bounds)
                said, score = decide(model, wrong, counts, total, lettered[a:b])
                names += said
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], pa.array(names, pa.string()), pa.array(np.concatenate(scores))], [*batch.schema.names[:place], "lang_pred", "lang_score"])

    schema = kept.schema.add("lang_pred", "string").add("lang_score", "double")
    return per_batch(docs, run, schema)


def held_out(doc_id: str = "doc_id"):
    """The contract's fold: rows never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
