from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import centroids as C


@pytest.mark.parametrize("low, high", [(-700, 700), (-1, 1), (0, 1), (0, 5), (-8, 0), (-(2**26), 2**26)])
def test_planes_are_exact(low, high):
    r = np.random.default_rng(high)
    v, m = r.integers(low, high, (300, 64)), r.integers(low, high, (8, 64))
    planes = C.to_planes(v)
    assert (C.from_planes(planes) == v).all() and (C.from_planes(C.widened(planes, 40)) == v).all()
    best, far = C.nearest(planes, m)
    want = ((v[:, None] - m[None]) ** 2).sum(axis=2)
    assert (best == want.argmin(axis=1)).all() and (far == want.min(axis=1)).all()


def brute(rows):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    v = np.array([x for _, x in kept])
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, hashlib.sha256(f"3:{kept[k][0]}".encode()).hexdigest(), C.to_planes(v[k : k + 1]).tobytes()))
    m = v[order[:8]].copy()
    near = lambda: ((v[:, None] - m[None]) ** 2).sum(axis=2)
    for _ in range(10):
        a = near().argmin(axis=1)
        for c in range(len(m)):
            if (a == c).any():
                m[c] = v[a == c].sum(axis=0) // (a == c).sum()
    d = near()
    a, d = d.argmin(axis=1), d.min(axis=1)
    h = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in m.tolist()]
    return sorted(((i, int(c), int(x), int(d[a == c].sum()), int(d.sum()), h[c]) for (i, _), c, x in zip(kept, a, d, strict=True)), key=repr)


def got(spark, rows, kind="float"):
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").select("*", *[F.lit("own").alias(n) for n in ("Cluster", "planes", "c0", "X", "n")])
    return sorted(map(tuple, C.digests(C.cluster(table)).collect()), key=repr)


def random_rows(n, seed, scale=1.0):
    r = np.random.default_rng(seed)
    return [(i, [float(x) for x in row]) for i, row in enumerate((r.normal(size=(n, 64)) * scale).astype(np.float32))]


def test_random_vectors(spark):
    rows = random_rows(400, 1, 0.2)
    assert got(spark, rows) == brute(rows)


def test_edges(spark):
    rows = random_rows(40, 2)
    odd = [(100, None), (101, []), (102, [0.5] * 63), (103, [0.5] * 65), (104, [None] + [0.1] * 63), (105, [math.nan] + [0.1] * 63), (106, [math.inf] + [0.1] * 63), (107, [-math.inf] + [0.1] * 63)]
    same = [(i, [0.25, -0.25] * 32) for i in range(200, 240)]
    rows += odd + same + same[:5] + [(None, [0.0] * 64), (None, [-1e-9] * 64), (300, [1000.5] * 64)]
    assert got(spark, rows) == brute(rows)
    assert {r[0] for r in got(spark, rows)}.isdisjoint(range(100, 108))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5] * 64)], [(i, [0.5] * 64) for i in range(20)], random_rows(5, 3)], ids=["empty", "none kept", "one", "equal", "few"])
def test_fewer_than_the_centroids(spark, rows):
    assert got(spark, rows, "double") == brute(rows)


def test_too_large_for_a_long(spark):
    with pytest.raises(Exception, match="component"):
        got(spark, [(1, [1e30] * 64)], "double")
