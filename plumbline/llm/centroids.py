"""Centroid clustering in exact integers.

Vectors become integers, floor(1024 * x), and are packed into blocks of rows, written once. Each round, a task gives the
vectors of its blocks to their nearest centroids by the expansion |x|^2 - 2 x.c + |c|^2, one matrix product a block in
float64; as long as 64 (max|x| + max|c|)^2 is below 2**53 every partial sum is a whole number that float64 holds, so the
product is exact in any order. Rows beyond that bound are worked out in Python's integers. Tasks return sums and counts by
centroid, which ``treeAggregate`` combines; the driver holds the centroids alone.

Defined results: vectors of another length, or with a null or non-finite component, and null vectors are left out; with
fewer kept vectors than clusters each starts one; equal vectors share a cluster; of rows with the same vec_id (whose hashes
tie) the smaller vector starts first, null vec_ids start last; distances and inertias beyond a long are null; a table
without kept vectors gives no row; extra columns are ignored. Rounds end early once no centroid moves, which changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.blocks import per_batch
from plumbline.session import durable

SCALE, DIMENSIONS, CLUSTERS, ROUNDS = 1024, 64, 8, 10
EXACT = 2**53
LONG = 2**63
#: Vectors of a block.
BLOCK = 4096
Centroids = list[list[int]]


def usable(vector: str, dimensions: int = DIMENSIONS):
    """Whether a column holds ``dimensions`` finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(vector) == dimensions) & F.forall(vector, finite), F.lit(False))


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as float64, which holds it exactly as ``scale`` is a power of two; as Python's integers where the
    product is beyond float64."""
    with np.errstate(over="ignore"):
        out = np.floor(x * scale)
    if np.isfinite(out).all():
        return out
    return np.array([[int(v) * scale if abs(v) >= EXACT else int(np.floor(v * scale)) for v in row] for row in x.tolist()], dtype=object)


def packed(x: np.ndarray) -> tuple[str, bytes]:
    if x.dtype == object:
        return "text", "\n".join(",".join(map(str, row)) for row in x).encode()
    kind = next((k for k in ("<i2", "<i4") if abs(x).max(initial=0) < np.iinfo(k).max), "<f8")
    return kind, x.astype(kind).tobytes()


def unpacked(kind: str, data: bytes, dimensions: int) -> np.ndarray:
    if kind == "text":
        return np.array([[int(v) for v in row.split(",")] for row in data.decode().split("\n")], dtype=object)
    return np.frombuffer(data, kind).astype(np.float64).reshape(-1, dimensions)


def packed_blocks(vectors: DataFrame, id_column: str, vector: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(ids, kind, data): the usable vectors, many a row."""
    kept = vectors.where(usable(vector, dimensions)).select(id_column, F.transform(vector, lambda x: x.cast("double")).alias("vector"))
    id_type = kept.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                x = whole(part.column(1).flatten().to_numpy().reshape(-1, dimensions))
                kind, data = packed(x)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column(0)]))
                yield pa.RecordBatch.from_arrays([ids, pa.array([kind]), pa.array([data], pa.binary())], ["ids", "kind", "data"])

    return per_batch(kept, run, f"ids array<{id_type}>, kind string, data binary")


def plain_distances(x: np.ndarray, centroids: Centroids) -> np.ndarray:
    """Squared distances in Python's integers."""
    c = np.array(centroids, dtype=object)
    rows = np.array([[int(v) for v in row] for row in x], dtype=object).reshape(len(x), -1)
    return np.stack([((rows - row) ** 2).sum(axis=1) for row in c], axis=1) if len(rows) else np.zeros((0, len(c)), object)


def nearest(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row; ties go to the smaller number. Distances are int64 if all rows fit the
    bound, else Python's integers."""
    largest, width = max(abs(v) for row in centroids for v in row), len(centroids[0])
    size = abs(x).max(axis=1, initial=0)
    root = (EXACT / width) ** 0.5 * (1 - 1e-9)
    small = np.array(size + largest < root, bool) if largest < root else np.zeros(len(x), bool)
    if small.all():
        c = np.array(centroids, np.float64)
        d = np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64))[:, None] - 2 * (x.astype(np.float64) @ c.T) + np.einsum("ij,ij->i", c, c)[None, :]
        cluster = d.argmin(axis=1)
        return cluster, d[np.arange(len(x)), cluster].astype(np.int64)
    cluster, distance = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    if small.any():
        cluster[small], distance[small] = nearest(x[small].astype(np.float64), centroids)
    d = plain_distances(x[~small], centroids)
    cluster[~small] = d.argmin(axis=1)
    distance[~small] = d.min(axis=1)
    return cluster, distance


def sums_of(x: np.ndarray, cluster: np.ndarray, clusters: int) -> dict[int, list]:
    """{cluster: [count, sum of each component]} in Python's integers."""
    exact = x.dtype == object or len(x) * float(abs(x).max(initial=0)) >= EXACT
    rows = np.array([[int(v) for v in row] for row in x], dtype=object).reshape(len(x), -1) if exact else x
    found = {}
    for k in range(clusters):
        own = rows[cluster == k]
        if len(own):
            found[k] = [len(own), [int(v) for v in own.sum(axis=0)]]
    return found


def merged(a: dict[int, list], b: dict[int, list]) -> dict[int, list]:
    out = dict(a)
    for k, (n, total) in b.items():
        out[k] = [out[k][0] + n, [x + y for x, y in zip(out[k][1], total, strict=True)]] if k in out else [n, total]
    return out


def starts(vectors: DataFrame, id_column: str, vector: str, clusters: int, seed: int, dimensions: int) -> Centroids:
    """The first centroids: ``clusters`` usable vectors by the hash of their id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")), 256)
    found = vectors.where(usable(vector, dimensions)).orderBy(key.asc_nulls_last(), vector).limit(clusters).select(vector).collect()
    return [[int(v) for v in row] for row in whole(np.array([r[0] for r in found], np.float64).reshape(-1, dimensions))]


def rounds(blocks: RDD, centroids: Centroids, count: int, dimensions: int) -> Centroids:
    """``count`` rounds of assigning and averaging, over an RDD of (kind, data)."""

    def add(found: dict, block: tuple[str, bytes], centroids: Centroids) -> dict:
        x = unpacked(block[0], bytes(block[1]), dimensions)
        return merged(found, sums_of(x, nearest(x, centroids)[0], len(centroids)))

    for _ in range(count):
        found = blocks.treeAggregate({}, lambda a, b, c=centroids: add(a, b, c), merged)
        moved = [[v // found[k][0] for v in found[k][1]] if k in found else row for k, row in enumerate(centroids)]
        if moved == centroids:
            break
        centroids = moved
    return centroids


def cluster(
    vectors: DataFrame, *, id_column: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, count: int = ROUNDS, seed: int = 3, dimensions: int = DIMENSIONS
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each usable vector."""
    table = durable(packed_blocks(vectors, id_column, vector, dimensions))
    centroids = starts(vectors, id_column, vector, clusters, seed, dimensions)
    blocks = table.select("kind", "data").rdd.map(tuple)
    if centroids:
        centroids = rounds(blocks, centroids, count, dimensions)

    def inertia(found: dict, block: tuple[str, bytes]) -> dict:
        x = unpacked(block[0], bytes(block[1]), dimensions)
        own, distance = nearest(x, centroids)
        return merged(found, {int(k): [0, [sum(distance[own == k].tolist())]] for k in np.unique(own)})

    spread = {k: total[0] for k, (_, total) in blocks.treeAggregate({}, inertia, merged).items()} if centroids else {}
    whole_spread = sum(spread.values())
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids]
    long = lambda v: v if v < LONG else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = unpacked(batch.column(1)[row].as_py(), batch.column(2)[row].as_py(), dimensions)
                own, distance = nearest(x, centroids)
                columns = [
                    batch.column(0)[row].values,
                    pa.array(own, pa.int32()),
                    pa.array([long(v) for v in distance.tolist()], pa.int64()),
                    pa.array([long(spread[k]) for k in own.tolist()], pa.int64()),
                    pa.array([long(whole_spread)] * len(own), pa.int64()),
                    pa.array([digests[k] for k in own.tolist()]),
                ]
                yield pa.RecordBatch.from_arrays(columns, [id_column, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    id_type = vectors.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    return per_batch(table, run, schema)
