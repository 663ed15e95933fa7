"""Near-duplicate embeddings against all pairs."""

from __future__ import annotations

import numpy as np

from varigrid.llm import embeddings


def brute(rows, least=embeddings.COSINE):
    good = {i: np.array(v, float) / np.abs(v).max() for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links, root = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(good)
    for a in ids:
        for b in ids:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= least:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return links, {i: find(i) for i in root}


def corpus():
    draw = np.random.default_rng(1)
    rows = []
    for _ in range(12):
        base = draw.normal(0, 1, 16)
        rows += [(len(rows) * 2 + i * 2, (base * draw.uniform(0.1, 9) + draw.normal(0, 0.1, 16) * i / 10).tolist()) for i in range(15)]
    rows += [(len(rows) * 2 + i * 2, draw.normal(0, 1, 16).tolist()) for i in range(150)]
    n = len(rows) * 2
    middle = np.eye(16)[0]
    chain = [(n + 100 + 2 * i, (middle * np.cos(a) + np.eye(16)[1] * np.sin(a)).tolist()) for i, a in enumerate((0.6, 0.0, 0.3, 0.9))]  # links of neighbours only
    rows += chain
    return rows + [(n, rows[0][1]), (n + 1, rows[0][1]), (n + 2, None), (n + 3, [0.0] * 16), (n + 4, [None] + [1.0] * 15), (n + 5, [float("nan")] * 16), (n + 6, []), (n + 7, [1.0, 2.0]), (n + 8, [2.0, 4.0]), (n + 9, [1e200] * 16), (n + 10, [1e-200] * 16), (n + 11, [float("inf")] * 16)]


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, component_id string")
    return {r["vec_id"]: r for r in embeddings.near_vectors(frame, **options).collect()}


def check(got, rows):
    links, root = brute(rows)
    assert {i: r["n_links"] for i, r in got.items()} == links
    assert {i: r["component_id"] for i, r in got.items()} == root
    assert all(r["kept"] == (i == root[i]) for i, r in got.items())


def test_links_equal_brute_force(spark):
    rows = corpus()
    check(run(spark, rows), rows)


def test_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SHARD", 40)
    monkeypatch.setattr(embeddings, "LARGEST", 50)
    rows = corpus()
    check(run(spark, rows), rows)


def test_pairs_that_share_no_shard(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SHARD", 40)
    draw = np.random.default_rng(3)
    a = draw.normal(0, 1, (1500, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    aside = draw.normal(0, 1, a.shape)
    aside -= (aside * a).sum(1, keepdims=True) * a
    b = a * 0.952 + aside / np.linalg.norm(aside, axis=1, keepdims=True) * np.sqrt(1 - 0.952**2)
    vectors = np.concatenate([a, b])
    want = (vectors @ vectors.T / np.linalg.norm(vectors, axis=1) / np.linalg.norm(vectors, axis=1)[:, None] >= embeddings.COSINE).sum(1) - 1
    for block in (embeddings.BLOCK, 32 * 8 * 60):
        monkeypatch.setattr(embeddings, "BLOCK", block)
        got = run(spark, list(enumerate(vectors.tolist())))
        assert [got[i]["n_links"] for i in range(len(vectors))] == want.tolist()
        assert all(got[i]["component_id"] == got[i + 1500]["component_id"] == i for i in range(1500)) and want.sum() == 3000


def test_audit_binds_and_copies_do_not_outweigh(spark, monkeypatch):
    draw = np.random.default_rng(4)
    a = draw.normal(0, 1, (60, 16))
    rows = list(enumerate([*a.tolist(), *(a + draw.normal(0, 0.02, a.shape)).tolist()]))
    rows += [(1000 + i, rows[0][1]) for i in range(4000)]  # one vector copied into nearly all rows
    found = embeddings.in_range

    def poor(vectors, neighbours, entries, query, *options):  # finds the links of the copied vector and its near copy only
        hits = found(vectors, neighbours, entries, query, *options)
        copied = directions[0] @ vectors[query] > 0.95
        return hits if copied else hits[:0]

    directions = embeddings.directions(np.array([rows[0][1]])).astype(np.float32)
    monkeypatch.setattr(embeddings, "in_range", poor)
    got = run(spark, rows)
    assert all(got[i]["component_id"] == i % 60 and got[i]["n_links"] == (4001 if i % 60 == 0 else 1) for i in range(120))
    assert got[5]["audited_recall"] == 1


def test_empty_table_and_no_good_vector(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_vectors(frame).count() == 0
    got = run(spark, [(1, None), (2, [0.0, 0.0])])
    assert all(r["n_links"] == 0 and r["component_id"] == i and r["kept"] for i, r in got.items())
