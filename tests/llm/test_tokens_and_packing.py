"""Token files and packing against the tokenizers library and direct checks."""

from __future__ import annotations

import random
import tempfile
import zlib

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")

from varigrid.llm import packing, token_files, tokens  # noqa: E402

PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs():
    draw = random.Random(8)
    words = ["the", "über", "don't", "x1y2", "naïve", "a b", "...", "42", "'ll", "日本", "🙂", "\t\n", "<|endoftext|>"]
    rows = [(i * 5, " ".join(draw.choice(words) for _ in range(draw.randrange(0, 60)))) for i in range(80)]
    return [*rows, (1001, None), (1002, ""), (1003, "long " * 9000), (1004, "  lead\n\n\n  trail  "), (1005, "x" * 5000), (1003, "again"), (None, "no id")]


@pytest.fixture(scope="module")
def ids(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4") for _, text in docs]


def test_encoder_equals_the_library(docs, ids):
    flat, sizes = tokens.with_end(*tokens.encoder(PATH)([t for _, t in docs]), 2)
    assert [x.tolist() for x in tokens.each(flat, sizes)] == [x.tolist() for x in ids]


def test_encoder_forgets_without_changing_results(docs, ids, monkeypatch):
    for remembered in (5, 20_000):
        monkeypatch.setattr(tokens, "REMEMBERED", remembered)
        encoder = tokens.Encoder(PATH)
        for (_, text), want in zip(docs, ids, strict=True):
            flat, _ = encoder([text])
            assert flat.tolist() == want[:-1].tolist()
        assert encoder.weight <= remembered + 60 * (tokens.WORD_BYTES + 9000)


def test_an_added_token_is_one_id():
    flat, sizes = tokens.Encoder(PATH)(["hello <|endoftext|> world", "plain"])
    assert flat[: sizes[0]].tolist() == [31373, 220, 50256, 995]


def test_long_texts_are_cut_without_changing_ids(docs, ids, monkeypatch):
    monkeypatch.setattr(tokens, "AT_ONCE", 7)
    flat, sizes = tokens.with_end(*tokens.Encoder(PATH)([t for _, t in docs]), 2)
    assert [x.tolist() for x in tokens.each(flat, sizes)] == [x.tolist() for x in ids]
    text = "one two's\nthree,\nFour  five\n\nsix don't 1 2"
    assert "".join(tokens.cut(text)) == text and len(list(tokens.cut(text))) > 2


def test_files_round_trip(spark, docs, ids):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, payload string, part int")
    folder = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/files"
    token_files.write_files(frame, PATH, 2, folder, file_ids=3000)
    rows = token_files.read_files(spark, folder).collect()
    assert spark.read.parquet(f"{folder}/data").select("part").distinct().count() > 2
    want = sorted((-1 if i is None else i, x.tobytes()) for (i, _), x in zip(docs, ids, strict=True))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], bytes(r["ids"])) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert order == sorted(order)


@pytest.mark.parametrize("one", [None, 7])
def test_rows_of_one_id_fill_several_files(spark, one):
    """Rows that share an id, or have none, are dealt like others; starts run through all files and each text comes back."""
    texts = [f"{'word ' * (k % 40)}{k % 9}" for k in range(900)]
    frame = spark.createDataFrame([(one, t) for t in texts] + [(9, "the last")], "doc_id long, text string").repartition(3)
    folder = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/files"
    token_files.write_files(frame, PATH, 2, folder, file_ids=2000)
    files = spark.read.parquet(f"{folder}/data").groupBy("part").count().collect()
    assert len(files) > 4 and max(r["count"] for r in files) < 450
    rows = sorted(token_files.read_files(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1]]
    assert [r["doc_id"] for r in rows] == [one] * 900 + [9]
    ids, sizes = tokens.with_end(*tokens.encoder(PATH)([*texts, "the last"]), 2)
    assert sorted(bytes(r["ids"]) for r in rows) == sorted(x.astype("<u4").tobytes() for x in tokens.each(ids, sizes))


def test_files_of_an_empty_table(spark):
    folder = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/files"
    token_files.write_files(spark.createDataFrame([], "doc_id long, text string"), PATH, 2, folder)
    assert token_files.read_files(spark, folder).count() == 0


@pytest.mark.parametrize("limit", [8, 18])
def test_code_is_a_limited_prefix_code(limit):
    draw = np.random.default_rng(9)
    counts = (1e6 / np.arange(1, 201) ** 2).astype(np.int64) + draw.integers(0, 2, 200)
    bits = token_files.code_lengths(counts, limit)
    assert bits.max() <= limit and np.isclose((0.5 ** bits[bits > 0]).sum(), 1)
    code = token_files.Code(bits)
    sizes = np.array([0, 1, 255, 256, 257, 3000])
    values = draw.choice(np.flatnonzero(bits), sizes.sum())
    assert (code.decode(*code.encode(values, sizes), sizes) == values).all()
    words = sorted(f"{int(c):0{b}b}" for c, b in zip(code.codes[bits > 0], bits[bits > 0], strict=True))
    assert not any(b.startswith(a) for a, b in zip(words, words[1:], strict=False))


@pytest.mark.parametrize("group_rows", [50_000, 7])
def test_packing(spark, docs, ids, group_rows):
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, offset int")
    rows = packing.packed(frame, PATH, size=64, group_rows=group_rows).collect()
    pieces = {}
    for (i, _), x in zip(docs, ids, strict=True):
        many = -(-len(x) // 64)
        first = len(x) - 64 * (many - 1)
        starts = [0, *(first + 64 * k for k in range(many - 1))]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(x)], strict=True)):
            pieces.setdefault((i, k, a, b - a, zlib.crc32(x[a:b].tobytes())), []).append(1)
    got = {}
    for r in rows:
        got.setdefault((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]), []).append(1)
    assert got == pieces
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    lengths = sorted((r["length"] for r in rows), reverse=True)
    room: list[int] = []  # best fit, piece by piece
    for n in lengths:
        fit = min((r for r in room if r >= n), default=None)
        if fit is None:
            room.append(64 - n)
        else:
            room[room.index(fit)] -= n
    assert len(by) <= len(room)


def test_packing_an_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
