"""Exact k-means against plain Python integers and SQL; the screen's intervals against exact distances."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from varigrid.llm import centroids as cl

SCHEMA = "VEC_ID long, embedding array<float>, cluster string"


def brute(rows, k, rounds, dim, seed=2):
    kept = []
    for vec, values, *_ in rows:
        if values is not None and len(values) == dim and all(v is not None and math.isfinite(v) for v in values):
            kept.append((vec, [math.floor(256 * int(v)) if abs(v) > 2**60 else math.floor(256 * float(np.float32(v))) for v in map(lambda x: float(np.float32(x)), values)]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    means = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(means))
    for _ in range(rounds):
        groups: dict[int, list] = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        means = [[sum(x) // len(groups[i]) for x in zip(*groups[i], strict=True)] if i in groups else c for i, c in enumerate(means)]
    out = [(vec, *reversed(near(v))) for vec, v in kept]
    inertia = {c: sum(d for _, l, d in out if l == c) for _, c, _ in out}
    most = (1 << 63) - 1
    return sorted((str(vec), c, min(d, most), min(inertia[c], most), min(sum(inertia.values()), most), hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for vec, c, d in out)


def told(frame):
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in frame.collect())


def vectors(n, dim, seed, scale=1.0):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0, scale) for _ in range(dim)], "x") for i in range(n)]


def test_equals_python_integers(spark):
    dim = 4
    rows = vectors(120, dim, 1)
    rows += [(i, [1.0, 0.0, 0.0, 0.0], None) for i in range(200, 260)]  # a third of all rows are one vector
    rows += [(300, [1.0, None, 0.0, 0.0], None), (301, None, None), (302, [], None), (303, [1.0] * 5, None), (304, [math.inf, 0.0, 0.0, 0.0], None), (305, [math.nan, 0.0, 0.0, 0.0], None), (None, [0.5] * 4, None), (7, [0.25] * 4, None), (8, rows[8][1], None)]
    assert told(cl.clustered(spark.createDataFrame(rows, SCHEMA), k=7, rounds=3, dim=dim)) == brute(rows, 7, 3, dim)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 3), 0.0], None) for i in range(40)]
    assert told(cl.clustered(spark.createDataFrame(rows, SCHEMA), k=9, rounds=2, dim=2)) == brute(rows, 9, 2, 2)


def test_components_of_any_size(spark):
    draw = random.Random(4)
    rows = [(i, [draw.choice([-1, 1]) * 10.0 ** draw.randrange(-3, 39) * draw.random() for _ in range(3)], None) for i in range(40)]
    assert told(cl.clustered(spark.createDataFrame(rows, SCHEMA), k=5, rounds=3, dim=3)) == brute(rows, 5, 3, 3)


def test_few_and_no_vectors(spark):
    rows = vectors(3, 2, 2)
    assert told(cl.clustered(spark.createDataFrame(rows, SCHEMA), k=10, rounds=2, dim=2)) == brute(rows, 10, 2, 2)
    empty = cl.clustered(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert cl.clustered(spark.createDataFrame([(1, None, None)], SCHEMA)).count() == 0


@pytest.mark.parametrize("scale", [40, 3000, cl.SMALL // 8])
def test_screen_settles_most_and_computes_the_rest_exactly(scale):
    draw = np.random.Generator(np.random.Philox(key=scale))
    x = np.clip(draw.normal(0, scale, (2000, 64)).astype(np.int64), -cl.SMALL, cl.SMALL)
    c = np.concatenate([x[:30] + draw.integers(-1, 2, (30, 64)), x[:10] + 1, x[:10] - 1, x[5:8]])  # near ties and equal centroids
    exact = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    screen = cl.Screen(np.clip(c, -cl.SMALL, cl.SMALL).tolist())
    label, distance = screen(x)
    assert (label == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert 0 < screen.compared < 0.2 * exact.size


def test_intervals_hold_the_exact_scores():
    draw = np.random.Generator(np.random.Philox(key=9))
    x, c = draw.integers(-(1 << 27), 1 << 27, (300, 64)), draw.integers(-(1 << 27), 1 << 27, (40, 64))
    screen = cl.Screen(c.tolist())
    product = (x.astype(np.float32) @ screen.floats).astype(np.float64)
    norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    for i in range(300):
        for k in range(40):
            true = sum(int(a) * int(b) for a, b in zip(x[i], c[k], strict=True))
            assert abs(2 * (int(product[i, k]) - true)) <= norms[i] * screen.slack[k]


def test_sql_gives_the_same_rows(spark):
    rows = vectors(150, 6, 3) + [(500, [1.0] * 5, None), (501, [0.5, -0.5, 0.25, None, 1.0, 2.0], None), (502, None, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [r[:2] for r in rows])
    want = con.execute(cl.oracle_sql(8, 4, 6))
    names = [d[0] for d in want.description]
    got = cl.clustered(spark.createDataFrame(rows, SCHEMA), k=8, rounds=4, dim=6).select(names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
