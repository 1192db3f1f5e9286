"""Document fingerprints by consistent weighted sampling.

A text is the multiset of its words. For each of ``SAMPLES`` draws every (word, weight) gets gamma variates that depend
on the word and the draw only (Ioffe's scheme: r, c ~ Gamma(2, 1), beta ~ U(0, 1)); with t = floor(ln w / r + beta) the
word that minimises ln c - r (t - beta + 1) is the sample, together with its t. Two texts agree on a sample with the
probability of their generalised Jaccard similarity, so the share of equal samples estimates it. A fingerprint keeps 16
bits a sample, as hexadecimal.

``successors`` pairs every document with the next one in descending doc_id without one global partition: ids are cut
into ranges at sampled ids, and the first document of a range is copied to the range before it.

Defined results: null is the empty text; texts without words are one term, the text itself; empty texts are alike only
to empty texts; rows equal in doc_id follow each other in the order of their texts; null doc_ids come last; the only
document is its own next; an empty table stays empty; extra columns are not read. A task's memory follows its longest
text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.blocks import ALNUM, U64, find_words, hash_words, mix, per_batch

SAMPLES = 64
#: Code points of a block of documents; their common words are drawn for once.
BLOCK_CHARS = 3_000_000
STEP = U64(0x9E3779B97F4A7C15)


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, weight, bounds): the distinct words of each text and how often they occur."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    folded, starts, ends, firsts = find_words(data, bounds, ALNUM)
    words, owner = hash_words(folded, starts, ends), np.repeat(np.arange(len(texts)), np.diff(firsts))
    bare = [k for k in np.flatnonzero(np.diff(firsts) == 0).tolist() if texts[k]]
    if bare:
        words = np.concatenate([words, np.array([int.from_bytes(hashlib.sha256(texts[k]).digest()[:8], "little") for k in bare], U64)])
        owner = np.concatenate([owner, bare])
    order = np.lexsort((words, owner))
    words, owner = words[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])])) if len(words) else np.zeros(0, np.int64)
    weight = np.diff(np.concatenate([new, [len(words)]]))
    return words[new], weight, np.searchsorted(owner[new], np.arange(len(texts) + 1))


def unit(bits: np.ndarray) -> np.ndarray:
    """32 random bits to (0, 1)."""
    return (bits.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32)


def sample(texts: list[bytes], samples: int = SAMPLES) -> np.ndarray:
    """(texts, samples) of 16-bit samples; empty texts have zeros."""
    word, weight, bounds = terms(texts)
    out = np.zeros((len(texts), samples), np.uint16)
    filled = np.flatnonzero(np.diff(bounds))
    if not len(filled):
        return out
    _, first, inverse = np.unique(mix(word + weight.astype(U64) * STEP), return_index=True, return_inverse=True)
    word, log_weight = word[first], np.log(weight[first]).astype(np.float32)
    heads, low = bounds[:-1][filled], U64(0xFFFFFFFF)
    for k in range(samples):
        a = mix(word + U64((3 * k + 1) * int(STEP) % (1 << 64)))
        b = mix(a + STEP)
        beta = unit((mix(b + STEP) >> U64(32)))
        r = -np.log(np.maximum(unit(a & low) * unit(a >> U64(32)), np.float32(1e-30)))
        c = -np.log(np.maximum(unit(b & low) * unit(b >> U64(32)), np.float32(1e-30)))
        t = np.floor(log_weight / np.maximum(r, np.float32(1e-9)) + beta)
        key = np.log(np.maximum(c, np.float32(1e-30))) - r * (t - beta + 1)
        bits = key.view(np.uint32)
        ordered = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(U64)  # the order of the floats
        said = mix(word + t.astype(np.int64).view(U64) * STEP + U64(k)) >> U64(32)
        out[filled, k] = np.minimum.reduceat(((ordered << U64(32)) | said)[inverse], heads) & U64(0xFFFF)
    return out


def likeness(a: np.ndarray, b: np.ndarray, a_empty: np.ndarray, b_empty: np.ndarray) -> np.ndarray:
    same = (a == b).mean(axis=1)
    return np.where(a_empty | b_empty, (a_empty & b_empty).astype(float), same)


def fingerprints(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with ``fingerprint`` of every whole text."""
    given = docs.select(*carry, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    width = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, width):
                found = sample([t.encode() for t in part.column(width).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array([f.tobytes().hex() for f in found], pa.string())], [*batch.schema.names[:width], "fingerprint"])

    return per_batch(given, run, given.select(*carry).schema.add("fingerprint", "string"))


def portions(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + BLOCK_CHARS, "right")))
        yield batch.slice(start, end - start)
        start = end


def successors(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(part, copied, doc_id, text), dealt by part and sorted so that each row's next document is the row after it;
    rows marked as copied only serve as the next document of the row before."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 8 * tasks
    ids = docs.select("doc_id").where("doc_id is not null")
    total = ids.count()
    share = min(1.0, 20 * ranges / max(total, 1))
    drawn = sorted({r[0] for r in ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003).collect()}, reverse=True)
    cuts = drawn[:: max(1, len(drawn) // ranges)][1:]  # about 20 ids a range were looked at
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[k : k + width] for k in range(0, len(cuts), width)] or [[]]
    listed = lambda values: F.array(*[F.lit(v).cast("long") for v in values]) if values else F.array().cast("array<bigint>")
    coarse = F.size(F.filter(listed([g[0] for g in groups[1:]]), lambda c: c >= F.col("doc_id")))
    fine = F.size(F.filter(F.element_at(F.array(*map(listed, groups)), coarse + 1), lambda c: c >= F.col("doc_id")))
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + width + 1)).otherwise(coarse * width + fine)
    dealt = docs.withColumn("part", part)
    heads = sorted((r["part"], r["head"]) for r in dealt.groupBy("part").agg(F.max("doc_id").alias("head")).collect())
    before = [(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)]
    copies = spark.createDataFrame(before, "head long, target int").where("target is not null") if before else spark.createDataFrame([], "head long, target int")
    own = F.struct(F.col("part").cast("int").alias("part"), F.lit(False).alias("copied"))
    both = dealt.join(F.broadcast(copies), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    placed = F.when(F.col("target").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("target").alias("part"), F.lit(True).alias("copied"))))
    rows = both.select(F.explode(placed).alias("at"), "doc_id", "text").select("at.part", "at.copied", "doc_id", "text")
    return rows.repartition(tasks, "part").sortWithinPartitions("part", "copied", F.col("doc_id").desc_nulls_last(), "text")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document."""

    def describe(rows: list[tuple], following: str):
        """Rows of one block and the text after its last."""
        texts = [*[r[3] for r in rows], following]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:], strict=False)]
        encoded, other = [t.encode() for t in texts], [t.encode() for t in edited]
        found = sample(encoded + other)
        own, changed = found[: len(texts)], found[len(texts) :]
        empty, void = np.array([not t for t in texts]), np.array([not t for t in edited])
        near, after = likeness(own[:-1], changed, empty[:-1], void), likeness(own[:-1], own[1:], empty[:-1], empty[1:])
        keep = [k for k, r in enumerate(rows) if not r[1]]
        columns = [
            pa.array([rows[k][2] for k in keep], pa.int64()), pa.array([len(texts[k]) for k in keep], pa.int64()),
            pa.array([hashlib.sha256(other[k]).hexdigest() for k in keep], pa.string()), pa.array([own[k].tobytes().hex() for k in keep], pa.string()),
            pa.array([changed[k].tobytes().hex() for k in keep], pa.string()), pa.array(near[keep], pa.float64()), pa.array(after[keep], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > BLOCK_CHARS and held:
                    yield describe(held, row[3])
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield describe(held, "")  # the last row of a part is a copy

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return per_batch(successors(docs), run, schema)
