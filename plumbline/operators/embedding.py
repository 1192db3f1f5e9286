"""Embedders as pluggable stages, a cache of their vectors, and ranking by dense dot products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from plumbline.functions import text as X
from plumbline.operators import retrieval
from plumbline.session import durable, ship
from plumbline.sources.stores import KeyedStore, Lookup, looked_up, vector_key

#: Rules of more bytes of vectors than this are ranked in several passes over the chunks.
RULE_BYTES = 64 << 20
#: A vocabulary of at most so many tokens goes to all tasks with its frequencies (tens of MB); for a larger one, tokens are dealt.
VOCABULARY = 1_000_000


class Embedder(Protocol):
    """``fit`` learns from a corpus (text), ``encode`` turns (id, text) into (id, vector) of length 1, or 0 for empty texts."""

    name: str

    def fit(self, corpus: DataFrame) -> Embedder: ...

    def encode(self, texts: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class HashingEmbedder:
    """TF-IDF of tokens hashed to ``dimensions`` buckets. ``bucket`` gives a token's; None is by BLAKE2b, worked out once for
    each token of the vocabulary. Its vectors depend on the corpus, so they are not stored."""

    dimensions: int = retrieval.DIMENSIONS
    bucket: Callable[[Column, int], Column] | None = None
    frequency: DataFrame | None = None
    total: int = 0
    vocabulary: int = 0

    @property
    def name(self) -> str:
        return f"hashing-{self.dimensions}"

    def fit(self, corpus: DataFrame) -> HashingEmbedder:
        frequency = X.distinct_tokens(corpus, []).groupBy("token").agg(F.count("*").alias("df"))
        if self.bucket is not None:  # worked out once for each token of the vocabulary
            frequency = frequency.withColumn("bucket", self.bucket(F.col("token"), self.dimensions))
        frequency = durable(frequency)
        return HashingEmbedder(self.dimensions, self.bucket, frequency, corpus.count(), frequency.count())

    def encode(self, texts: DataFrame) -> DataFrame:
        texts = retrieval.dealt(texts.select("id", "text"), ["id"], texts.count())  # texts move once, their tokens stay
        terms = X.token_rows(texts, ["id"])
        if self.frequency is None:
            known = terms.withColumn("df", F.lit(0))
        else:
            known = terms.join(F.broadcast(self.frequency) if self.vocabulary <= VOCABULARY else self.frequency, "token", "left")
        weight = (1 + F.log("n")) * retrieval.idf(F.lit(self.total), F.col("df"))
        if self.bucket is None:
            buckets = retrieval.blake_buckets(terms, self.dimensions)
            placed = known.join(buckets, "token").select("id", "bucket", weight.alias("w"))
        else:
            bucket = self.bucket(F.col("token"), self.dimensions)
            placed = known.select("id", (bucket if self.frequency is None else F.coalesce("bucket", bucket)).alias("bucket"), weight.alias("w"))
        added = placed.groupBy("id", "bucket").agg(F.sum("w").alias("w"))
        sparse = added.groupBy("id").agg(F.collect_list(F.struct("bucket", "w")).alias("parts"))  # at most ``dimensions`` a text
        return dense(texts.select("id").join(sparse, "id", "left"), self.dimensions)


def dense(rows: DataFrame, dimensions: int) -> DataFrame:
    """(id, parts of bucket and weight) to (id, vector)."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                parts = pa.concat_arrays([part.column(1)])
                owner = np.repeat(np.arange(len(parts)), parts.value_lengths().fill_null(0).to_numpy())
                flat = parts.flatten()
                out = np.zeros((len(parts), dimensions))
                out[owner, flat.field(0).to_numpy(zero_copy_only=False)] = flat.field(1).to_numpy(zero_copy_only=False)
                norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
                out = out / np.where(norm == 0, 1, norm)
                yield pa.RecordBatch.from_arrays([part.column(0), rows_of(out)], ["id", "vector"])

    return rows.select("id", "parts").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, vector array<double>")


def rows_of(x: np.ndarray) -> pa.Array:
    """A matrix as lists of its rows."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


class Encoder(Protocol):
    """A model: texts to a matrix of their vectors."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class ModelEmbedder:
    """A model, made by ``make()`` in each task, behind a store of its vectors: a text is encoded once for a model's name."""

    name: str
    make: Callable[[], Encoder]
    store: KeyedStore
    counts: dict[str, int] = field(default_factory=dict)

    def fit(self, corpus: DataFrame) -> ModelEmbedder:
        return self

    def encode(self, texts: DataFrame) -> DataFrame:
        keyed = texts.select("id", "text", vector_key(self.name, F.col("text")).alias("key"))
        found: Lookup = looked_up(self.store, keyed.select("key", "text"), self._made)
        self.counts.update(hits=self.counts.get("hits", 0) + found.hits, misses=self.counts.get("misses", 0) + found.misses)
        return keyed.select("id", "key").join(found.rows.select("key", "vector"), "key").select("id", "vector")

    def _made(self, missing: DataFrame) -> DataFrame:
        make = self.make
        ship(missing.sparkSession)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = None
            for frame in frames:
                if len(frame):
                    model = model or make()
                    x = np.asarray(model.encode(list(frame["text"])), np.float64)
                    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                    yield pd.DataFrame({"key": frame["key"], "vector": list((x / np.where(norm == 0, 1, norm)).astype(np.float32))})

        return missing.select("key", "text").mapInPandas(run, "key string, vector array<float>")


def dense_top(rules: DataFrame, chunks: DataFrame, k: int, decimals: int = 6, rule_bytes: int = RULE_BYTES) -> DataFrame:
    """(rule_id, rank, chunk_id, score): the ``k`` best chunks of each rule by dot product, ties by chunk id.

    ``rules`` and ``chunks`` have (id, vector). Vectors of rules go to all tasks, in blocks of at most ``rule_bytes``; a task
    multiplies batches of chunks with them and keeps ``k`` a rule, so what is shuffled is ``k`` rows a rule and task."""
    spark = rules.sparkSession
    ship(spark)
    rule_type, chunk_type = dict(rules.dtypes)["id"], dict(chunks.dtypes)["id"]
    batch_type = to_arrow_type(chunks.schema["id"].dataType)
    stored = durable(rules.select("id", "vector"))
    size = stored.agg(F.sum(F.size("vector").cast("long"))).first()[0] or 0
    blocks = max(1, -(-8 * size // rule_bytes))
    parts = []
    for block in range(blocks):
        own = stored.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(blocks)) == block).toArrow()  # of checked size
        if not own.num_rows:
            continue
        names = own.column("id").combine_chunks()
        shared = spark.sparkContext.broadcast((names, np.stack([np.asarray(v, np.float64) for v in own.column("vector").to_pylist()])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            best = [pd.DataFrame({"rule": pd.Series(dtype=int), "chunk": pd.Series(dtype=object), "score": pd.Series(dtype=float)})]
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, x = batch.column(0).to_pylist(), np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1)
                scores = np.round(x @ matrix.T, decimals)
                # Whatever is not among the k best of its batch, ties included, is not among the k best.
                least = np.partition(scores, len(x) - min(k, len(x)), axis=0)[len(x) - min(k, len(x))]
                row, rule = np.nonzero(scores >= least)
                found = pd.DataFrame({"rule": rule, "chunk": [ids[r] for r in row], "score": scores[row, rule]})
                best = [pd.concat([*best, found]).sort_values(["score", "chunk"], ascending=[False, True]).groupby("rule").head(k)]
            out = best[0]
            if len(out):
                columns = [names.take(pa.array(out["rule"].to_numpy())), pa.array(list(out["chunk"]), batch_type), pa.array(out["score"].to_numpy())]
                yield pa.RecordBatch.from_arrays(columns, ["rule_id", "chunk_id", "score"])

        parts.append(chunks.select("id", "vector").mapInArrow(run, f"rule_id {rule_type}, chunk_id {chunk_type}, score double"))
    if not parts:
        return spark.createDataFrame([], f"rule_id {rule_type}, rank int, chunk_id {chunk_type}, score double")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("rule_id").orderBy(F.col("score").desc(), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("rule_id", "rank", "chunk_id", "score")


def embedded_top(embedder: Embedder, rules: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The ``k`` best chunks of each rule with any embedder, fitted on both sides: ``rules`` (rule_id, text), ``chunks`` (chunk_id, text)."""
    fitted = embedder.fit(rules.select("text").unionByName(chunks.select("text")))
    sides = [fitted.encode(side.select(F.col(name).alias("id"), "text")) for side, name in ((rules, "rule_id"), (chunks, "chunk_id"))]
    return dense_top(sides[0], sides[1], k)
