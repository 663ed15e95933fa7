"""Collocations against a plain count of all phrases, whatever the bitmaps hold back."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from varigrid.llm import phrases

SCHEMA = "doc_id long, text string, lang string, PHRASE string, n int"


def brute(rows, least, longest=5, top=2000, whole=100):
    f, totals = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i : i + n])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = defaultdict(int)
    for (lang, w), a in cand.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                longer[lang, w[i : i + n]] = max(longer[lang, w[i : i + n]], a)
    out = defaultdict(list)
    for (lang, w), a in cand.items():
        if 100 * longer[lang, w] >= whole * a and longer[lang, w]:
            continue
        score, _, l, r = min((1000 * a * totals[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, totals[lang], -s) for lang, some in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(some)[:top], 1))


def told(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(13)
    words = ["the", "The", "of", "New", "York", "é", "ÉA", "naïve", "a\tb", "x y", "日本", "l'un", "-", "\x1c", "stop.", "no,", "way!", "line\nnext", "tab\x0bbed", "'s"]
    out = []
    for i in range(200):
        text = (" " * draw.randrange(1, 3)).join(draw.choice(words) for _ in range(draw.randrange(0, 60)))
        if i % 3 == 0:
            text += " the same five words again and again"
        out.append((i, text, draw.choice(["en", "fr", None]), "p", 1))
    return [*out, (1, None, "en", None, None), (2, "", "xx", None, None), (3, " .,;", "xx", None, None), (4, "ha " * 3000, "fr", None, None), (4, "ha " * 3000, "fr", None, None)]


@pytest.mark.parametrize("least", [2, 7, 60])
def test_equals_a_plain_count(spark, rows, least):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert told(phrases.collocations(frame, least=least)) == brute(rows, least)


@pytest.mark.parametrize("buckets", [16, 1 << 17])
def test_the_number_of_buckets_changes_nothing(spark, rows, buckets):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert told(phrases.collocations(frame, least=5, buckets=buckets, top=7, whole=80)) == brute(rows, 5, top=7, whole=80)


def test_many_languages_and_thresholds_above_a_byte(spark, rows):
    more = [(i, t, f"l{i % 40}" if i > 60 else lang, *rest) for i, (_, t, lang, *rest) in enumerate(rows)]
    assert told(phrases.collocations(spark.createDataFrame(more, SCHEMA), least=300)) == brute(more, 300)


def test_empty_tables(spark):
    for some in ([], [(1, None, None, None, None)], [(1, "one two", "en", None, None)]):
        assert phrases.collocations(spark.createDataFrame(some, SCHEMA)).count() == 0


def test_words_and_pieces():
    data = phrases.read(["One\ttwo, ÉA  one.", None, "One"])
    begin, end, hashes, piece = phrases.words_of(data)
    assert [data[a:b].decode() for a, b in zip(begin, end, strict=True)] == ["one", "two", "Éa", "one", "one"]
    assert hashes[0] == hashes[3] == hashes[4] != hashes[1]
    assert piece[0] == piece[1] != piece[2] == piece[3] != piece[4]
    assert len(phrases.words_of(b"")[0]) == len(phrases.words_of(b" \xff ")[0]) == 0


def test_buckets_hold_back_the_rare_and_let_the_frequent_through():
    draw = np.random.Generator(np.random.Philox(key=3))
    common, rare = draw.integers(0, 1 << 63, 50, dtype=np.uint64), draw.integers(0, 1 << 63, 3000, dtype=np.uint64)
    counters = phrases.Counters(1 << 16, 100)
    for _ in range(120):
        counters.add(common)
    counters.add(rare)
    bits = np.packbits(counters.cells >= 100, bitorder="little")
    assert phrases.lit(bits, common).all() and phrases.lit(bits, rare).mean() < 0.01
