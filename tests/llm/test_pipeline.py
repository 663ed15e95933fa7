"""The pipeline's stages: what each decides, and rows that are null, empty, repeated, long or named like working columns."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from varigrid.llm import decontamination, language, minhash, packing  # noqa: E402

SF = "/root/testdata/sf0.01"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
EN = "the cat and the dog went over the hill to see what there was on the other side of it, and came home again. "
DE = "der hund und die katze gingen heute über den hügel, um zu sehen, was es auf der anderen seite gab, und kamen heim. "
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, _row string, c1 string, spans string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, len(t or ""), 7, "r", "c", "x") for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame([(1, "Which of these seven words is never said twice in any book of rules?")], "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path


def counts(df):
    out = {}
    for r in df.collect():
        out[r["doc_id"], r["text"]] = out.get((r["doc_id"], r["text"]), 0) + 1
    return out


def test_language_stage(spark, folder):
    other = "".join(chr(0x430 + (i * 7 + i // 5) % 32) + (" " if i % 6 == 0 else "") for i in range(400))
    rows = [(1, EN * 3, "en", "s"), (2, DE * 3, "de", "s"), (3, EN, None, None), (3, EN, None, None), (4, None, "en", "s"), (5, "", "en", "s"), (6, "123 !!", "de", "s"), (7, "ox", "en", "s"), (8, other, None, "s"), (9, EN * 20_000, "en", "s"), (None, DE, "de", "s"), (10, other[:60], None, "s")]
    docs = frame(spark, rows)
    out = corpus_pipeline.language_stage(spark, docs, folder)
    assert out.schema == docs.schema
    assert {k[0] for k in counts(out)} == {1, 2, 3, 7, 9, None, 10} and counts(out)[3, EN] == 2
    assert corpus_pipeline.language_stage(spark, docs.where("false"), folder).count() == 0


def test_minhash_stage(spark, folder):
    a, b = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    rows = [(1, a), (1, a), (2, b), (2, a), (None, b), (None, None), (None, None), (4, ""), (5, ""), (6, "word " * 300_000), (7, "word " * 300_000)]
    docs = frame(spark, [(i, t, "en", "s") for i, t in rows])
    out = corpus_pipeline.minhash_stage(spark, docs, folder)
    assert out.schema == docs.schema
    assert counts(out) == {(1, a): 1, (2, b): 1, (None, None): 1, (4, ""): 1, (5, ""): 1, (6, "word " * 300_000): 1}
    assert corpus_pipeline.minhash_stage(spark, docs.where("false"), folder).count() == 0


def test_decontamination_stage(spark, folder):
    leak = EN + "Which of these seven words is never said twice in any book of rules?"
    rows = [(1, EN), (2, leak), (2, leak), (2, EN), (None, leak), (None, EN), (4, None), (5, ""), (6, EN * 5000 + leak), (7, EN), (7, EN)]
    docs = frame(spark, [(i, t, "en", "s") for i, t in rows])
    out = corpus_pipeline.decontamination_stage(spark, docs, folder)
    assert out.schema == docs.schema
    assert counts(out) == {(1, EN): 1, (2, EN): 1, (None, EN): 1, (4, None): 1, (5, ""): 1, (7, EN): 2}
    assert corpus_pipeline.decontamination_stage(spark, docs.where("false"), folder).count() == 0


def test_secrets_stage(spark, folder):
    key = "password = hunter2hunter2"
    rows = [(1, key, "a/x"), (1, key, "a/x"), (None, EN + key, None), (3, None, "a/x"), (4, "", None), *((10 + i, "token: copied-example", f"o{i}/r") for i in range(5)), (20, EN * 5000 + key, "a/y")]
    docs = frame(spark, [(i, t, "en", s) for i, t, s in rows])
    out = corpus_pipeline.secrets_stage(spark, docs, folder)
    assert out.schema == docs.schema and out.count() == len(rows)
    got = counts(out)
    assert got[1, "password = <SECRET>"] == 2 and (None, EN + "password = <SECRET>") in got and (10, "token: copied-example") in got and (20, EN * 5000 + "password = <SECRET>") in got
    assert out.where("text is not null and n_chars <> length(text)").count() == 0
    assert corpus_pipeline.secrets_stage(spark, docs.where("false"), folder).count() == 0


def test_packing_stage(spark, folder):
    docs = frame(spark, [(1, EN, "en", "s"), (1, EN, "en", "s"), (None, None, "en", "s"), (3, "", None, None), (4, EN * 500, "en", "s")])
    rows = corpus_pipeline.packing_stage(spark, docs, folder).collect()
    assert sum(r["length"] == 1 for r in rows) == 2 and max(r["length"] for r in rows) == 1024 and sum(r["doc_id"] == 1 for r in rows) == 2
    assert corpus_pipeline.packing_stage(spark, docs.where("false"), folder).count() == 0


@data
def test_run_over_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, before, SF).collect(), before.schema)
        sizes.append(docs.count())
        gone = before.select("doc_id").subtract(docs.select("doc_id"))
        if name.startswith("language"):
            told = language.predicted(before, F.col("doc_id") >= 0).join(gone, "doc_id")
            assert told.where("n_letters > 0 and (n_letters < 200 or score > 0.12)").count() == 0
        if name.startswith("MinHash"):
            assert {r[0] for r in gone.collect()} == {r["doc_id"] for r in minhash.near_duplicates(before).where("not kept").collect()}
        if name.startswith("benchmark"):
            assert decontamination.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert sizes[0] > 900 and sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2]
    out = corpus_pipeline.run(spark, SF)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    digest = lambda df: hashlib.sha256(str(sorted(map(tuple, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))).encode()).hexdigest()
    assert digest(out) == digest(last) and out.where("length > 1024").count() == 0
    assert packing.packed(docs, public.path("byte_bpe_50k.json")).count() == out.count()
