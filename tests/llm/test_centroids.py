import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from plumbline.llm import centroids


def brute(rows, clusters=8, rounds=10):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(Fraction(x) * 1024) for x in v] for _, v in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, hashlib.sha256(f"3:{kept[k][0]}".encode()).hexdigest(), kept[k][1]))
    c = [whole[k] for k in order[:clusters]]

    def assign():
        out = []
        for v in whole:
            d = [sum((a - b) ** 2 for a, b in zip(v, row, strict=True)) for row in c]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        of = assign()
        for k in range(len(c)):
            own = [v for v, (j, _) in zip(whole, of, strict=True) if j == k]
            if own:
                c[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    of = assign()
    inertia = [sum(d for j, d in of if j == k) for k in range(len(c))]
    long = lambda v: v if v < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c]
    return sorted(((i, j, long(d), long(inertia[j]), long(sum(inertia)), digest[j]) for (i, _), (j, d) in zip(kept, of, strict=True)), key=repr)


def clustered(spark, rows, kind="double"):
    given = spark.createDataFrame([(*r, 1) for r in rows], f"vec_id long, embedding array<{kind}>, cluster int").repartition(3)
    return sorted((tuple(r) for r in centroids.cluster(given).collect()), key=repr)


def vectors(n, size, seed):
    rng = random.Random(seed)
    middles = [[rng.uniform(-size, size) for _ in range(64)] for _ in range(5)]
    return [(k, [x + rng.gauss(0, size / 3) for x in middles[k % 5]]) for k in range(n)]


@pytest.mark.parametrize("size", [0.2, 3e4, 1e9, 1e300])
def test_equals_plain_integers(spark, size):
    rows = vectors(150, size, 2)
    assert clustered(spark, rows) == brute(rows)


def test_edge_rows(spark):
    good = vectors(20, 0.2, 5)
    odd = [(100, None), (101, [1.0] * 63), (102, [None] + [1.0] * 63), (103, [float("nan")] + [1.0] * 63), (104, [float("inf")] * 64), (105, [])]
    again = [(1, good[1][1]), (1, good[2][1]), (None, good[3][1]), (200, good[4][1]), (201, [1e30] + good[4][1][1:])]
    rows = good + odd + again
    assert clustered(spark, rows) == brute(rows)
    assert clustered(spark, odd) == []
    assert clustered(spark, good[:3]) == brute(good[:3])


def test_the_bound_parts_the_ways():
    rng = np.random.default_rng(0)
    near = np.floor(rng.uniform(-1, 1, (40, 64)) * 2**22)
    far = near.copy()
    far[::2] *= 2**20
    c = [[int(v) for v in row] for row in near[:8]]
    for x in (near, far):
        cluster, distance = centroids.nearest(x, c)
        plain = centroids.plain_distances(x, c)
        assert (cluster == plain.argmin(axis=1)).all() and [int(d) for d in distance] == [int(d) for d in plain.min(axis=1)]
    assert centroids.nearest(near, c)[1].dtype == np.int64 and centroids.nearest(far, c)[1].dtype == object
