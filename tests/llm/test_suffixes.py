"""Repeats against a brute force over all strings of a small size."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from varigrid.llm import suffixes


def brute(docs: list[tuple[int, str | None]], size: int) -> dict[int, tuple]:
    texts = [(t or "").encode("utf-8", "surrogatepass") for _, t in docs]
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = {}
    for (key, _), t in zip(docs, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[key] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def compare(spark, docs, **options):
    rows = suffixes.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), **options).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert got == brute(docs, options.get("size", suffixes.SIZE))


def test_near_copies_in_large_buckets(spark, monkeypatch):
    """Near copies of one text in buckets far larger than a suffix array may hold."""
    draw = random.Random(5)
    base = "".join(draw.choice("abcdefgh ") for _ in range(900))
    docs = []
    for i in range(60):
        t = list(base)
        for _ in range(draw.randrange(1, 5)):
            t[draw.randrange(len(t))] = draw.choice("ÄßXYZ")
        docs.append((i, "".join(t)))
    monkeypatch.setattr(suffixes.groups, "__defaults__", (suffixes.SIZE, 4))
    compare(spark, docs)


def test_edges(spark):
    """Null, empty, short, repeated within one text, equal texts, and a run of one letter."""
    draw = random.Random(6)
    some = "".join(draw.choice("abcdefgh ") for _ in range(500))
    docs = [(1, None), (2, ""), (3, some[:199]), (4, some), (5, some), (6, "x" * 700), (7, some[100:320] + "|" + some[100:320]), (8, "é" * 150 + some[:250]), (9, some[50:400] + "end"), (10, "begin" + some[90:480])]
    compare(spark, docs)
    assert suffixes.without_repeats(spark.createDataFrame([], "doc_id long, text string, extra int")).count() == 0


def occurrences(docs: list[tuple[int, str]], size: int) -> dict[bytes, set[tuple[int, int]]]:
    out: dict[bytes, set[tuple[int, int]]] = {}
    for key, text in docs:
        data = text.encode()
        for i in range(len(data) - size + 1):
            out.setdefault(data[i : i + size], set()).add((key, i))
    return {s: places for s, places in out.items() if len(places) > 1}


def test_groups_have_all_occurrences(spark):
    """Every group is one string at all its places; every repeated string of the size lies in a group that has all its places."""
    draw = random.Random(8)
    word = lambda n: "".join(draw.choice("abcd ") for _ in range(n))
    base = word(420)
    docs = [(1, word(40) + base + word(60)), (2, base[:300] + word(90)), (3, word(30) + base[60:] + word(20)), (4, base), (5, base), (6, word(500)), (7, base[100:330] + "#" + base[100:330])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("th", F.xxhash64("text"))
    text = {k: t.encode() for k, t in docs}
    found: dict[bytes, set] = {}
    for r in suffixes.groups(frame).collect():
        found.setdefault(bytes(r["group"]), set()).add((r["doc_id"], r["begin"], r["end"]))
    for places in found.values():
        assert len(places) > 1 and len({text[d][a:b] for d, a, b in places}) == 1 and all(b - a >= suffixes.SIZE for _, a, b in places)
    covered = {(d, i) for places in found.values() for d, a, b in places for i in range(a, b - suffixes.SIZE + 1)}
    wanted = occurrences(docs, suffixes.SIZE)
    assert covered == {p for places in wanted.values() for p in places}
    whole: dict[bytes, set] = {}
    for places in found.values():
        d, a, b = next(iter(places))
        for i in range(b - a - suffixes.SIZE + 1):
            whole.setdefault(text[d][a + i : a + i + suffixes.SIZE], set()).update({(d2, a2 + i) for d2, a2, _ in places})
    assert whole == wanted


def test_maximal_repeats_by_brute_force():
    draw = random.Random(9)
    for _ in range(200):
        left = ["".join(draw.choice("ab") for _ in range(draw.randrange(6))).encode() for _ in range(6)]
        right = ["x" + "".join(draw.choice("ab") for _ in range(draw.randrange(6))) for _ in range(6)]
        right = [x.encode() for x in right]
        want = set()
        for a in range(6):
            for r in range(len(left[a]) + 1):
                for d in range(1, len(right[a]) + 1):
                    who = [i for i in range(6) if left[i].endswith(left[a][len(left[a]) - r :]) and right[i].startswith(right[a][:d])]
                    more_left = {left[i][: len(left[i]) - r][-1:] for i in who}
                    more_right = {right[i][d : d + 1] for i in who}
                    if len(who) > 1 and r + d >= 4 and (len(more_left) > 1 or b"" in more_left) and (len(more_right) > 1 or b"" in more_right):
                        want.add((r, d, tuple(who)))
        assert {(r, d, tuple(sorted(m))) for r, d, m in suffixes.maximal(left, right, 4)} == want


def test_anchors_do_not_depend_on_blocks():
    draw = random.Random(10)
    texts = ["".join(draw.choice("abc ") for _ in range(n)).encode() for n in (900, 0, 199, 200, 1500)]
    one = suffixes.anchors(texts)
    for block in (64, 301):
        other = suffixes.anchors(texts, block=block)
        assert all(list(one[k]) == list(other[k]) for k in one)
    assert all(len(x) == 0 for x in suffixes.anchors([]).values())
