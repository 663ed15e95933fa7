"""Near duplicates against all pairs compared exactly."""

from __future__ import annotations

import random

import numpy as np

from varigrid.llm import minhash, shingles
from varigrid.llm.shingles import shingle_sets


def brute(docs: list[tuple[int | None, str | None]], least: float = minhash.SIMILARITY) -> list[int]:
    """The smallest id of each row's group, by all pairs."""
    sets = shingle_sets([t for _, t in docs])
    root = list(range(len(docs)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if docs[a] == docs[b] or len(sets[a][0]) and len(sets[b][0]) and (sets[a][2] == sets[b][2] or minhash.probability_jaccard(sets[a][:2], sets[b][:2]) >= least):
                root[find(a)] = find(b)
    groups: dict[int, list] = {}
    for i, (k, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(k)
    return [min((k for k in groups[find(i)] if k is not None), default=None) for i in range(len(docs))]


def corpus() -> list[tuple[int | None, str | None]]:
    """Groups of near copies at many distances, chains, a shared passage, exact copies, and edges."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 8)))
    docs: list[tuple[int | None, str | None]] = []
    passage = [word() for _ in range(120)]
    for _ in range(6):
        base = [word() for _ in range(draw.randrange(30, 300))]
        for _ in range(12):
            copy = list(base)
            for _ in range(draw.randrange(0, 1 + len(base) // 25)):
                copy[draw.randrange(len(copy))] = word()
            docs.append((len(docs) * 3 + 1, " ".join(copy)))
    for _ in range(30):
        docs.append((len(docs) * 3 + 1, " ".join(passage + [word() for _ in range(draw.randrange(15, 60))])))
    chain = [word() for _ in range(100)]
    for _ in range(10):
        chain = chain[2:] + [word(), word()]
        docs.append((len(docs) * 3 + 1, " ".join(chain)))
    docs += [(2000, docs[0][1]), (2001, docs[0][1].upper() + "!"), (2002, None), (2003, ""), (2004, "..."), (2005, "one two"), (2006, "One, two"), (2007, "go " * 500), (2008, "go " * 900), (None, docs[0][1])]
    return docs


def test_groups_equal_brute_force(spark, monkeypatch):
    docs = corpus()
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, component_id string")
    want = sorted((-1 if i is None else i, g) for (i, _), g in zip(docs, brute(docs), strict=True))
    for block, salted in ((256, 1024), (5, 3)):  # small ones: buckets are dealt in blocks and by salt
        monkeypatch.setattr(minhash.of_band, "__defaults__", (salted,))
        rows = minhash.near_duplicates(frame.select("doc_id", "text", "component_id"), block=block).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["component_id"]) for r in rows) == want
        assert {r["component_id"] for r in rows} == {r["doc_id"] for r in rows if r["kept"]}
        assert len({(r["doc_id"], bytes(r["text_key"] or b"")) for r in rows if r["kept"]}) == len({g for _, g in want})


def test_one_row_of_each_group_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, a), (2, b), (2, a), (3, c), (None, c), (None, "alone here"), (None, "alone here"), (4, None), (4, None), (5, None), (6, ""), (7, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, k % 2, "z") for k, (i, t) in enumerate(rows)], "doc_id long, text string, kept int, c0 string")
    out = minhash.deduplicated(docs)
    assert out.columns == docs.columns
    got = sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=str)
    assert got == sorted([(1, a), (2, b), (3, c), (None, "alone here"), (4, None), (5, None), (6, ""), (7, ""), (None, None)], key=str)
    assert minhash.deduplicated(docs.where("false")).count() == 0


def test_long_texts_are_read_in_pieces(monkeypatch):
    texts = ["One two three, four five six. " * 3, "a\nb c\td", "", None, "nothing-to-cut" * 5]
    whole = shingle_sets(texts)
    monkeypatch.setattr(shingles, "LONG", 7)
    monkeypatch.setattr(shingles.pieces, "__defaults__", (7,))
    cut = shingle_sets(texts)
    assert all((x[0] == y[0]).all() and (x[1] == y[1]).all() and x[2] == y[2] for x, y in zip(whole, cut, strict=True))
    assert list(shingles.pieces("one two", 4)) == ["one", " two"]


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_estimate_probability_jaccard():
    docs = corpus()[:60]
    sets = shingle_sets([t for _, t in docs])
    signed = minhash.signatures(sets)
    error = [np.mean(signed[a] == signed[b]) - minhash.probability_jaccard(sets[a][:2], sets[b][:2]) for a in range(60) for b in range(a)]
    assert abs(np.mean(error)) < 0.01 and np.max(np.abs(error)) < 0.2
    alone = minhash.signatures(sets[7:8])
    assert (alone[0] == signed[7]).all()  # a batch's other texts don't matter


def test_pairs_in_doubt_are_told_without_comparing_each(monkeypatch):
    """Near copies of a text that are not near copies of each other: a bound rules out those of sets, most others, and none that links."""
    draw = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(60):
        copy = list(base)
        for at in draw.sample(range(150), 1 + k % 4):
            copy[at] = f"own{k}at{at}"
        texts.append(" ".join(copy if k % 9 else copy + copy[:40]))  # some with repeated shingles
    sets = [(h, w) for h, w, _ in shingle_sets([*texts, "one two", "three four five six seven eight"])]
    i, j = np.triu_indices(len(sets), 1)
    exact = np.array([minhash.probability_jaccard(sets[a], sets[b]) for a, b in zip(i, j, strict=True)])
    plain = np.array([(w == 1).all() for _, w in sets])
    for least in (0.8, *exact[exact > 0][:20]):  # limits that some pairs meet exactly
        out, below = minhash.ruled_out(sets, i, j, least), exact < least - 1e-9
        assert not (out & ~below).any() and (out | ~below | ~(plain[i] & plain[j])).all()
    odd = [(np.array(sorted(draw.sample(range(40), n)), np.uint64), np.array([draw.choice([1, 1, 2, 7, 300]) for _ in range(n)], np.uint32)) for n in range(3, 40)]
    i2, j2 = np.triu_indices(len(odd), 1)
    exact = np.array([minhash.probability_jaccard(odd[a], odd[b]) for a, b in zip(i2, j2, strict=True)])
    for least in (0.05, 0.2, 0.5, 0.8):
        out = minhash.ruled_out(odd, i2, j2, least)
        assert (exact[out] < least).all() and (out.any() or not (exact < 0.9 * least).any())
    monkeypatch.setattr(minhash, "SHINGLES", 10)
    assert not minhash.ruled_out(sets, i, j, 0.8).any()


def test_likely_pairs_equal_all_pairs():
    draw = np.random.default_rng(2)
    n, m, rows = 150, minhash.REGISTERS, minhash.ROWS
    signed = np.where(draw.random((n, m)) < 0.15, draw.integers(1, 9, (n, m)), 0).astype("<u2")
    signed[:, :rows] = 0
    root, halves = draw.integers(0, 60, n), np.where(draw.random(n) < 0.5, -1, 3)
    for block in (np.full(n, 2), halves):
        for band in (0, 1):
            want = set()
            for a in range(n):
                for b in range(a + 1, n):
                    same = signed[a] == signed[b]
                    first = same.reshape(-1, rows).all(1).argmax()
                    if same.mean() >= minhash.LIKELY and root[a] != root[b] and first == band and (block[a] != block[b] or block is not halves):
                        want.add((a, b))
            got = list(zip(*(x.tolist() for x in minhash.likely(signed, root, band, block)), strict=True))
            assert len(set(got)) == len(got) and {(min(x), max(x)) for x in got} == want
            assert band or want
