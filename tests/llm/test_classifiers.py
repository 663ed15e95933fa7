"""Language, quality and toxicity: held-out accuracy, edges, and the chain's marginals by enumeration."""

from __future__ import annotations

import itertools
import os
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from varigrid.llm import language, quality, shingles, toxicity

SF = "/root/testdata/sf0.01"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
EDGES = [(-1, None), (-2, ""), (-3, "   \n\n "), (-4, "123 !!!"), (-5, "a"), (-6, "word " * 30_000), (-7, "日本語\n" * 3), (-5, "a"), (None, "some text")]


def edges(spark):
    return spark.createDataFrame([(i, t, "en", 3, "q") for i, t in EDGES], "doc_id long, text string, lang string, score int, n_lines string")


@data
def test_language_of_held_out_texts(spark):
    rows = language.op7_language(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "n_chars")
    both = rows.join(docs, "doc_id").where("held_out and n_chars > 40")
    assert both.count() > 100 and both.where("lang = lang_pred").count() / both.count() > 0.95


def test_language_edges(spark):
    teach = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "nobody", None), (4, None, "fr")], "doc_id long, text string, lang string")
    docs = edges(spark).unionByName(teach, allowMissingColumns=True)
    told = language.predicted(docs, F.col("doc_id") > 0)
    assert told.columns == ["doc_id", "text", "lang", "n_lines", "lang_pred", "score", "n_letters"]  # the result's names win
    rows = told.collect()
    assert len(rows) == len(EDGES) + 4
    for r in rows:
        blank = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == blank and 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und")
    assert {r["lang_pred"] for r in language.predicted(docs, F.lit(False)).collect()} == {"und"}
    assert language.predicted(docs.where("false"), F.lit(True)).count() == 0


def test_bundles_do_not_depend_on_the_batch():
    texts = ["The cat sat.", "Der Hund läuft", "", "日本語のテキスト", "a b c"]
    together, _ = language.Space().bundle(texts)
    for i, t in enumerate(texts):
        assert np.array_equal(language.Space().bundle([t])[0][0], together[i])


@data
@pytest.mark.parametrize("run, label, least", [(quality.op2_quality, "quality", 0.95), (toxicity.op6_toxicity, "toxic", 0.93)])
def test_held_out_accuracy(spark, run, label, least):
    rows = run(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("label"))
    both = rows.join(labels, "doc_id").where("held_out")
    assert rows.count() == 1000 and rows.where("score < 0 or score > 1 or score is null").count() == 0
    assert both.where("predicted = label").count() / both.count() > least


@pytest.mark.parametrize("labels", [[], [(-1, 1), (-5, 1)], [(-4, 0), (-5, 1), (-6, 0), (-7, 1), (1, None)]])
def test_quality_edges(spark, labels):
    docs = edges(spark)
    taught = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = quality.scored(docs, quality.trained(docs, taught)).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"]: r["n_lines"] for r in rows}[-7] == 3 and {r["doc_id"]: r["quality"] for r in rows}[-3] == 0


@pytest.mark.parametrize("labels", [[], [(-1, 1), (-5, 1)], [(-4, 0), (-5, 1), (-6, 0), (-7, 1), (1, None)]])
def test_toxicity_edges(spark, labels):
    docs = edges(spark).withColumnsRenamed({"lang": "_raw"}).withColumn("c0", F.lit(1))
    rows = toxicity.scored(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in rows) and rows[0]["n_lines"] == "q"


def slow_bundle(text):
    """A text's vector, trigram by trigram."""
    letters = [" "]
    for c in (text or "").lower():
        if c.isalpha():
            letters.append(c)
        elif letters[-1] != " ":
            letters.append(" ")
    if letters[-1] != " ":
        letters.append(" ")
    vector = lambda c: 2 * np.random.Generator(np.random.Philox(key=ord(c))).integers(0, 2, language.DIMENSIONS) - 1
    out = np.zeros(language.DIMENSIONS)
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        out += vector(a) * np.roll(vector(b), 1) * np.roll(vector(c), 2)
    return out


def test_bundles_and_cosines_by_brute_force(spark, monkeypatch):
    texts = ["The cat sat, on 2 mats!", "Der Hund läuft", "", None, "a", "ab", "日本語 のテキスト", "x1y2z3", "  lead", "the cat " * 40]
    for chars in (1 << 20, 16):
        monkeypatch.setattr(language, "BLOCK_CHARS", chars)
        got, letters = language.Space().bundle(texts)
        assert np.array_equal(got, np.stack([slow_bundle(t) for t in texts]))
        assert letters.tolist() == [sum(c.isalpha() for c in (t or "").lower()) for t in texts]
    teach = {"en": ["the cat and the dog", "a cat on the mat"], "de": ["der hund und die katze"]}
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    prototypes = {g: unit(sum(unit(slow_bundle(t)) for t in ts)) for g, ts in teach.items()}
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(100 + i, t, g) for i, (g, t) in enumerate((g, t) for g, ts in teach.items() for t in ts)], "doc_id long, text string, lang string")
    for r in language.predicted(docs, F.col("doc_id") >= 100).where("n_letters > 0").collect():
        cosines = {g: float(unit(slow_bundle(r["text"])) @ p) for g, p in prototypes.items()}
        assert r["score"] == pytest.approx(max(0, max(cosines.values())), abs=1e-5) and cosines[r["lang_pred"]] == pytest.approx(max(cosines.values()), abs=1e-5)


def test_memory_of_a_bundle_is_bounded():
    draw = np.random.default_rng(3)
    texts = ["".join(chr(97 + x) for x in draw.integers(0, 26, 500)) for _ in range(4096)]
    tracemalloc.start()
    language.Space().bundle(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 130 << 20


def slow_lines(text):
    """Line features, letter by letter; in the order of :data:`quality.OWN`."""
    lines = [x for x in (text or "").split("\n")]
    marks = set(".,;:'\"()-?")
    rows = []
    for line in lines:
        words = line.split()
        if not words:
            continue
        kind = lambda c: "loud" if c == "!" else "mark" if c in marks else "space" if c.isspace() else "digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.isalpha() else "symbol"
        n = {k: sum(kind(c) == k for c in line) for k in ("loud", "mark", "digit", "upper", "lower", "symbol")}
        letters, size = n["lower"] + n["upper"], max(len(line), 1)
        odd = [any(kind(c) in ("symbol", "loud") for c in w) for w in words]
        shout = [sum(kind(c) == "upper" for c in w) > 1 and not any(kind(c) == "lower" for c in w) for w in words]
        stripped = line.rstrip()
        rows.append([
            1, np.log1p(size) / 8, letters / size, n["upper"] / max(letters, 1), n["digit"] / size, n["symbol"] / size, min(1, 10 * n["loud"] / size), n["mark"] / size, min(2, np.mean([len(w) for w in words]) / 10), 1 - len(set(words)) / len(words),
            sum(a == b for a, b in itertools.pairwise(words)) / len(words), np.mean(odd), np.mean(shout), lines.count(line) > 1, stripped[-1] in ".!?:;\"')", kind(words[0][0]) == "lower",
        ])
    return rows, [len(x) for x in lines if x.split()]


def test_line_features_by_brute_force(monkeypatch):
    texts = ["One line. Two TWO two!\nsmall 12 start $$ here\n\nOne line. Two TWO two!\n", "ab ab ab\n  \nЖя жя ǧ", "", None, "\u0141 A\nA \u0141 \u0241", "x\ny\nx\nz"]
    for long in (1 << 20, 9):
        monkeypatch.setattr(quality, "LONG", long)
        own, length, sizes = quality.line_features(texts)
        want = [slow_lines(t) for t in texts]
        assert sizes.tolist() == [len(w[0]) for w in want] and length.tolist() == [x for w in want for x in w[1]]
        assert np.allclose(own, np.array([r for w in want for r in w[0]], float), atol=1e-6)
    field = quality.Field(np.random.default_rng(2).normal(0, 1, 3 * len(quality.OWN)), np.array([[0.5, -0.5], [-0.2, 0.3]]), (1.0, 0.0))
    marginal = field.marginals(quality.with_neighbours(own, sizes), sizes)
    cuts = np.cumsum(sizes)
    means = [float((marginal[b - n : b] * length[b - n : b]).sum() / max(length[b - n : b].sum(), 1)) if n else 0.0 for b, n in zip(cuts, sizes, strict=True)]
    assert np.allclose(field.quality(own, length, sizes), means)


def test_rows_of_any_length_teach(spark):
    docs = spark.createDataFrame([(1, "A good line of words.\n" * 400), (2, "$$$ !!! ###\n" * 900), (3, "Another good line here.\n" * 3), (4, "### $$$\n" * 2)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    rows = {r["doc_id"]: r["score"] for r in quality.scored(docs, quality.trained(docs, labels)).collect()}
    assert rows[1] > 0.5 > rows[2] and rows[3] > rows[4]
    short = quality.trained(docs, labels, lines=500)  # no row is short enough
    assert len({r["score"] for r in quality.scored(docs, short).collect()}) == 1
    long = spark.createDataFrame([(i, "$ # !\n" * 16_000) for i in range(50, 60)], docs.schema)  # none of these ends the sample
    every = labels.unionByName(long.selectExpr("doc_id", "1 as quality"))
    rows = {r["doc_id"]: r["score"] for r in quality.scored(docs, quality.trained(docs.unionByName(long), every)).collect()}
    assert rows[1] > 0.5 > rows[2] and rows[3] > rows[4]


def test_toxicity_counts_by_brute_force(monkeypatch):
    keys = toxicity.hashes_of(["table", "chair"])
    weights = np.stack([np.array([1.0, 2.0])] * 3)
    texts = ["You are an idiot, IDIOT! the table", "no one here; chair chair TABLE", "", None, "a $tupid 1d10t said: why??", "you " + "word " * 5 + "idiot"]
    names = toxicity.COUNTS
    got = [dict(zip(names, r, strict=True)) for r in toxicity.counted(texts, keys, weights, np.full(len(texts), 2))]
    by_key = {int(k): w for k, w in zip(keys, weights[2], strict=True)}
    for text, c in zip(texts, got, strict=True):
        t = text or ""
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
        insult = [i for i, w in enumerate(words) if w in toxicity.INSULTS]
        second = [i for i, w in enumerate(words) if w in toxicity.SECOND]
        learned = [by_key.get(int(toxicity.hashes_of([w])[0]), 0.0) for w in words]
        assert c["words"] == len(words) and c["insults"] == len(insult) and c["second"] == len(second) and c["near"] == sum(any(abs(i - j) <= toxicity.NEAR for j in second) for i in insult)
        assert c["weight"] == sum(learned) and c["most"] == max(learned, default=0) and c["upper"] == sum("A" <= x <= "Z" for x in t) and c["letters"] == sum(x.isalpha() for x in t)
        assert c["tokens"] == len(t.split()) and c["loud"] == t.count("!") and c["asked"] == t.count("?") and c["bytes"] == len(t.encode())
    assert got[4]["hidden"] == 2 and got[0]["shouted"] == 1 and got[5]["near"] == 0
    whole = toxicity.features(texts, keys, weights, np.full(len(texts), 2))
    monkeypatch.setattr(toxicity, "LONG", 10)
    monkeypatch.setattr(shingles.pieces, "__defaults__", (10,))
    near = toxicity.NAMES.index("near_second")  # words on both sides of a cut are not near each other
    assert np.allclose(np.delete(toxicity.features(texts, keys, weights, np.full(len(texts), 2)), near, 1), np.delete(whole, near, 1))


def test_toxicity_features():
    none = np.zeros(0, np.uint64)
    texts = ["you are an idiot", "an 1d10t, they say", "THE TABLE! IS HERE!!", "", None, "idiot " * 3]
    rows = dict(zip(toxicity.NAMES, toxicity.features(texts, none, np.zeros((3, 0)), np.full(len(texts), 2)).T, strict=True))
    assert rows["near_second"].tolist() == [1, 0, 0, 0, 0, 0] and rows["hidden_insults"].tolist() == [0, 1, 0, 0, 0, 0]
    assert rows["shouted"][2] == 1 and rows["insult_rate"][5] == 100 and rows["insult_rate"][1] == 0


def test_marginals_by_enumeration():
    draw = np.random.default_rng(7)
    sizes = np.array([3, 0, 5, 1])
    unary, transition = draw.normal(0, 2, sizes.sum()), draw.normal(0, 1, (2, 2))
    got, expected = quality.forward_backward(unary, transition, sizes)
    want, pairs, at = [], np.zeros((2, 2)), 0
    for n in sizes:
        total, good, moves = 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(sum(unary[at + i] for i in range(n) if labels[i]) + sum(transition[a, b] for a, b in itertools.pairwise(labels)))
            total += weight
            good += weight * np.array(labels)
            for a, b in itertools.pairwise(labels):
                moves[a, b] += weight
        want += list(good / total)
        pairs += moves / total
        at += n
    assert np.allclose(got, want) and np.allclose(expected, pairs)
