"""Clustering over a VA-file, against plain rounds over all vectors."""

import hashlib
import math
import random

import numpy as np
from verimill.llm import va_file


def plain(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = lambda c: sum(d for _, o, d in found if c in (o, None))
    return sorted([(i, c, d, inertia(c), inertia(None), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found], key=str)


def test_clustering(spark):
    rng = random.Random(6)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in rng.choice(centres)]) for i in range(300)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (None, None), (500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 63 + [None]), (504, [math.nan] + [0.0] * 63), (505, [math.inf] + [0.0] * 63), (506, [1e3] * 64)]
    rows += [(k, [0.0] * 64) for k in range(600, 620)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    want = plain(rows)
    assert sorted(map(tuple, va_file.op11_clustering(vectors).collect()), key=str) == want
    few = [r for r in rows if r[0] in (1, 2, 502, 3)]
    assert sorted(map(tuple, va_file.op11_clustering(spark.createDataFrame(few, vectors.schema)).collect()), key=str) == plain(few)
    assert va_file.op11_clustering(vectors.filter("vec_id = 502")).count() == 0
    assert va_file.op11_clustering(vectors.filter("vec_id = 506"), bits=2).count() == 1


def test_cells_bound_the_distances():
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.integers(-300, 300, (400, 16)), np.full((50, 16), 7)])
    centroids = v[:6]
    exact = ((v[:, None] - centroids) ** 2).sum(axis=2)
    for bits in (1, 4, 8):
        edge = np.array([[v[:, d].min(), *np.quantile(v[:, d], [k / (1 << bits) for k in range(1, 1 << bits)]).astype(int), v[:, d].max() + 1] for d in range(16)])
        cells = va_file.cells_of(v, edge)
        assert (va_file.unpacked(va_file.packed(cells, bits), 16, bits) == cells).all()
        among = va_file.possible(cells, edge, centroids)
        best, far = va_file.nearest(v, centroids, among)
        assert (best == exact.argmin(axis=1)).all() and (far == exact.min(axis=1)).all()
    assert among.sum() < 2 * len(v)
