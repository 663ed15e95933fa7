"""Decontamination against a plain version in Python, over texts of numbers, names, units and words."""

from __future__ import annotations

import random
import time
from collections import defaultdict
from math import ceil

import pytest
from pyspark.sql import functions as F

from varigrid.llm import decontamination as D

FIRST = {D.NAME, D.NUMBER, D.UNIT}


def raws(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", D.tokens(F.col("t"), raw=True).alias("raw")).collect()
    return {r["i"]: r["raw"] for r in rows}


def brute(docs, items, window=D.WINDOW, coverage=D.COVERAGE):
    """``docs`` and ``items`` are (id, words with values)."""
    short = lambda w: w[0] if w[0] in FIRST else w
    best = {}
    for item, iraw in items:
        iw = [short(w) for w in iraw]
        n, k = len(iw), min(window, len(iw))
        literal = any(w not in FIRST for w in iw)
        if not n:
            continue
        half = max(D.LEAST_BAND, ceil(n * D.BAND))
        for doc, raw in docs:
            w = [short(x) for x in raw]
            hits = set()
            for i in range(len(w) - k + 1):
                for j in range(n - k + 1):
                    alone = all(x in FIRST for x in iw[j : j + k])
                    if (raw[i : i + k] == iraw[j : j + k]) if alone else (w[i : i + k] == iw[j : j + k]):
                        hits.add((j, i - j))
            parts = defaultdict(set)
            for j, d in hits:
                for part in ((0, d), (1, d // half), (1, d // half - 1)):
                    parts[part].add((j, d))
            for at in parts.values():
                if literal:
                    for d in {d for _, d in at}:
                        for j in range(n - k + 1):
                            if all(x in FIRST for x in iw[j : j + k]) and j + d >= 0 and w[j + d : j + d + k] == iw[j : j + k]:
                                at = at | {(j, d)}
                share = round(len({p for j, _ in at for p in range(j, j + k)}) / n, 6)
                if share < coverage:
                    continue
                full = defaultdict(int)
                for _, d in at:
                    full[d] += 1
                pairs = []
                for p in range(n):
                    if iraw[p][0] in FIRST:
                        d = max((-max(0, j - p, p - j - k + 1), full[d], d) for j, d in at)[2]
                        if 0 <= p + d < len(raw) and raw[p + d][0] in FIRST:
                            pairs.append((iraw[p], raw[p + d]))
                changed = sum(a != b for a, b in pairs)
                if len(set(pairs)) != len({a for a, _ in pairs}) or len(set(pairs)) != len({b for _, b in pairs}) or (not literal and changed):
                    continue
                told = (share, -changed, len(pairs))
                best[doc, item] = max(best.get((doc, item), told), told)
    return {key: (share, slots, -unchanged) for key, (share, unchanged, slots) in best.items()}


def told(frame):
    return {(r["doc_id"], r["item_id"]): (r["coverage"], r["n_slots"], r["changed"]) for r in frame.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_plain_version(spark, seed):
    draw = random.Random(seed)
    word = lambda: draw.choice(["sum", "of", "all", "and", "then", "says", "find", "the", "it", "is", "half"])
    slot = lambda: draw.choice([str(draw.randrange(9)), f"{draw.randrange(1, 40)} km", f"{draw.random():.2f}", draw.choice(["Ann", "Bob Lee", "Eva"])])
    item = lambda n, slots: " ".join(slot() if draw.random() < slots else word() for _ in range(n))
    items = [item(draw.randrange(3, 30), draw.choice([0.0, 0.3, 0.7, 0.95])) for _ in range(14)] + ["3 1 4 1 5 9 2 6", "0 0 0 0 0 0 0", "7", "find the half of 2 3 5 7 11 13 17 19 23 29 31"]
    texts = []
    for t in items:
        words = t.split(" ")
        texts += [t, " ".join([item(5, 0.4), t, item(6, 0.4)]), " ".join(str(draw.randrange(9)) if w.isdigit() else w for w in words), " ".join(w for w in words if draw.random() < 0.93)]
        swap = {str(i): str(j) for i, j in zip(range(40), draw.sample(range(100, 200), 40), strict=True)}
        texts.append("so " + " ".join(swap.get(w, w) for w in words) + " then")
    own, theirs = raws(spark, texts), raws(spark, items)
    got = told(D.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")))
    want = brute(list(own.items()), list(theirs.items()))
    assert got == want and len(got) > 40 and sum(c for _, _, c in got.values()) > 20 and sum(n for _, n, _ in got.values()) > 100


def test_numbers_meet_only_their_own_values(spark):
    draw = random.Random(1)
    lists = [" ".join(str(draw.randrange(1000)) for _ in range(40)) for _ in range(10)]
    docs = [(i, " ".join(str(draw.randrange(1000)) for _ in range(2000))) for i in range(4)] + [(9, "x " + lists[3] + " y")]
    docs += [(10, "0 " * 100), (11, "1 " * 500 + lists[4].replace(" ", ", "))]
    items = spark.createDataFrame([*enumerate(lists), (50, "0 " * 40)], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    told(D.leaks(frame.limit(1), items))
    began = time.monotonic()
    got = told(D.leaks(frame, items))
    assert time.monotonic() - began < 20
    assert got == {(9, 3): (1.0, 40, 0), (10, 50): (1.0, 40, 0), (11, 4): (1.0, 40, 0)}


def test_rows_are_not_stitched_together(spark):
    left, right = "alpha beta gamma delta epsilon", "zeta eta theta iota kappa"
    items = spark.createDataFrame([(1, f"{left} {right}")], "item_id long, text string")
    docs = [(None, f"{left} x x x x x"), (None, f"y y y y y {right}"), (5, f"{left} x"), (5, f"y {right}"), (None, f"so {left} {right}"), (None, None), (None, "")]
    rows = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert [(r["doc_id"], r["coverage"]) for r in rows] == [(None, 1.0)]
    kept = D.cleaned(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert kept.count() == 6 and kept.where("text like 'so %'").count() == 0
