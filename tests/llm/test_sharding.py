"""Shards against a brute-force partition, and the SQL on a table with hot, null and repeated rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from varigrid.llm import sharding

SCHEMA = "doc_id long, text string, KEY string, Shard int"


def key(text: str | None) -> int:
    return int(hashlib.sha256((text or "").encode()).hexdigest()[:15], 16)


def least_capacity(sizes: list[int], shards: int) -> int:
    """By dynamic programming over all contiguous partitions."""
    upto = [0]
    for s in sizes:
        upto.append(upto[-1] + s)
    best = upto[:]
    for _ in range(shards - 1):
        best = [min((max(best[j], upto[i] - upto[j]) for j in range(i + 1)), default=0) for i in range(len(upto))]
    return best[-1]


def rows_of(kind: str) -> list[tuple]:
    draw = random.Random(kind)
    texts = ["".join(draw.choice("abß ") for _ in range(draw.randrange(1, 40))) for _ in range(90)]
    if kind == "hot":
        texts += ["one text that a third of all rows repeat"] * 50
    if kind == "huge":
        texts.append("é" * 20_000)
    rows = [(i, t, "x", 9) for i, t in enumerate(texts)]
    return [*rows, (None, "no id", None, None), (5, None, None, None), (6, "", None, None), (0, texts[0], "y", 1), (0, texts[0], "y", 1), (0, "other", "y", 1)]


@pytest.mark.parametrize("kind", ["plain", "hot", "huge"])
@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_as_small_as_possible(spark, kind, shards):
    rows = rows_of(kind)
    out = [r.asDict() for r in sharding.sharded(spark.createDataFrame(rows, SCHEMA), shards).collect()]
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    groups: dict[int, int] = defaultdict(int)
    for _, t, *_ in rows:
        groups[key(t)] += len((t or "").encode()) + 1
    loads = [sum(r["size"] for r in out if r["shard"] == s) for s in range(shards)]
    assert max(loads) == least_capacity([groups[k] for k in sorted(groups)], shards)
    for s in range(shards):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    by_id = defaultdict(set)
    for d, t, *_ in rows:
        by_id[key(t)] |= {r["shard"] for r in out if r["doc_id"] == d and r["text_crc32"] == zlib.crc32((t or "").encode())}
    assert all(len(s) == 1 for s in by_id.values())
    assert {(r["law"], r["grown_shard"]) for r in out} == {("bytes", None)}


@pytest.mark.parametrize("kind", ["plain", "hot", "huge"])
def test_sql_gives_the_same_rows(spark, kind):
    rows = rows_of(kind)
    out = sharding.sharded(spark.createDataFrame(rows, SCHEMA))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    want = con.execute(sharding.ORACLE_SQL)
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, out.select(columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_segments_are_split_until_the_answer_is_exact(spark, monkeypatch):
    """Few bits a round: many rounds, the same capacity and cuts."""
    rows = rows_of("hot")
    sizes: dict[int, int] = defaultdict(int)
    for _, t, *_ in rows:
        sizes[key(t)] += len((t or "").encode()) + 1
    groups = spark.createDataFrame(sorted(sizes.items()), "key long, bytes long").cache()
    whole = sharding.planned(groups, 8)
    monkeypatch.setattr(sharding, "FIRST_BITS", 2)
    monkeypatch.setattr(sharding, "MORE_BITS", 2)
    monkeypatch.setattr(sharding, "AT_ONCE", 3)
    assert sharding.planned(groups, 8)[0] == whole[0] == least_capacity([sizes[k] for k in sorted(sizes)], 8)
    cut = lambda firsts: [sum(v for k, v in sizes.items() if k < f) for f in firsts]
    assert cut(sharding.planned(groups, 8)[1]) == cut(whole[1])


def test_empty_table_and_fewer_groups_than_shards(spark):
    assert sharding.sharded(spark.createDataFrame([], SCHEMA)).count() == 0
    out = sharding.sharded(spark.createDataFrame([(1, "a", None, None), (2, "a", None, None), (3, "b", None, None)], SCHEMA)).collect()
    assert len({r["shard"] for r in out}) == 2 and all(0 <= r["shard"] < 8 for r in out)


def test_no_python_in_the_plan(spark):
    plan = sharding.sharded(spark.createDataFrame(rows_of("plain"), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
