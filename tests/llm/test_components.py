"""Components against union-find: long paths, stars, cycles, repeats and nulls."""

from __future__ import annotations

import random

import pytest

from varigrid.llm.common import bounded
from varigrid.llm.components import components


def brute(links):
    root = {x: x for ab in links if None not in ab and ab[0] != ab[1] for x in ab}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


DRAW = random.Random(1)
PATH = list(range(100))
DRAW.shuffle(PATH)


@pytest.mark.parametrize("links", [[], [(1, 1), (None, 2), (3, None)], [(i, i + 1) for i in range(60)], list(zip(PATH, PATH[1:], strict=False)), [(0, i) for i in range(1, 50)] + [(49, 200), (3, 0)], [(DRAW.randrange(300), DRAW.randrange(300)) for _ in range(200)] * 2])
def test_components(spark, links):
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(rows) == len({r["a"] for r in rows})
    assert {r["a"]: r["root"] for r in rows} == brute(links)


def test_samples_of_any_share_hold_rows(spark):
    """Ten of forty million rows, and a share that is told for a table of a million million."""
    many = spark.range(40_000_000)
    assert 1 <= bounded(many, 10, "id", total=40_000_000).count() <= 40
    told = bounded(many, 500_000, "id", total=10**12)  # one in two million
    assert 4 <= told.count() <= 60
    assert bounded(many.limit(5), 10, "id").count() == 5
