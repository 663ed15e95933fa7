"""Language identification with hyperdimensional profiles (operator 7 and a pipeline stage).

A letter is a fixed random vector of +1 and -1 drawn from its code point; a trigram binds the vectors of its
letters, each permuted by its place; a text bundles its trigrams. A language's prototype bundles the unit
vectors of its texts, and a text gets the language whose prototype has the largest cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrid.llm.common import bounded, fold, numbered, quoted, steps, without

DIMENSIONS = 1024
#: Bound on the rows that prototypes are bundled from, chosen by hash.
TRAINING_ROWS = 20_000
#: A text of so many letters is like none of the learned languages if its cosine with each is less: more than three standard
#: deviations of the cosine of two unrelated vectors, 1 / sqrt(1024). Shorter texts have too few trigrams to tell.
ALIKE, ENOUGH_LETTERS = 0.1, 200
UNKNOWN = "und"
#: Bounds of a block: rows, characters, cells of its matrix of counts; letters remembered; code points with a place of their own.
BLOCK_ROWS, BLOCK_CHARS, CELLS, LETTERS, PLACES = 512, 1 << 20, 1 << 21, 4096, 0x3000


class Space:
    """Vectors of texts; letters already met are remembered."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.letter = np.frombuffer(bytes(map(str.isalpha, map(chr, range(0x110000)))), np.uint8).astype(bool)
        self.vectors: dict[int, np.ndarray] = {}

    def of_letter(self, code: int) -> np.ndarray:
        if code not in self.vectors:
            if len(self.vectors) >= LETTERS:
                self.vectors.clear()
            bits = np.random.Generator(np.random.Philox(key=code)).integers(0, 2, self.dimensions)
            self.vectors[code] = (2 * bits - 1).astype(np.float32)
        return self.vectors[code]

    def bundle(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A row per text (zero without a trigram), and its number of letters. Words are set off by a gap.

        Texts are taken in blocks of at most ``BLOCK_ROWS`` and ``BLOCK_CHARS``, and a longer text in pieces that share
        two letters or gaps, so the memory does not grow with the step or the text.
        """
        parts = [" " + (t or "").lower() + " " for t in texts]
        out, letters = np.zeros((len(parts), self.dimensions), np.float32), np.zeros(len(parts), np.int64)
        a = 0
        while a < len(parts):
            b, size = a + 1, len(parts[a])
            while b < len(parts) and b - a < BLOCK_ROWS and size + len(parts[b]) <= BLOCK_CHARS:
                size, b = size + len(parts[b]), b + 1
            whole = "".join(parts[a:b])
            doc = np.repeat(np.arange(b - a), [len(p) for p in parts[a:b]]) if size <= BLOCK_CHARS else None
            before, tail = False, np.zeros(0, np.uint32)
            for at in range(0, size, BLOCK_CHARS):
                code = np.frombuffer(whole[at : at + BLOCK_CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
                of = np.zeros(len(code), np.int64) if doc is None else doc
                is_letter = self.letter[code]
                letters[a:b] += np.bincount(of[is_letter], minlength=b - a)
                keep = is_letter.copy()
                keep[1:] |= is_letter[:-1]
                keep[0] |= before
                keep[np.flatnonzero(np.diff(of, prepend=0 if at else -1))] = True
                before = bool(is_letter[-1])
                code = np.concatenate([tail, np.where(is_letter, code, 32)[keep].astype(np.uint32)])
                of = np.concatenate([np.zeros(len(tail), np.int64), of[keep]])
                tail = code[-2:]
                self.add(out[a:b], code, of)
            a = b
        return out, letters

    def permuted(self, letters: np.ndarray, shift: int) -> np.ndarray:
        return np.roll(np.stack([self.of_letter(int(c)) for c in letters]), shift, 1)

    def add(self, out: np.ndarray, code: np.ndarray, doc: np.ndarray) -> None:
        """Add to each row of ``out`` the trigrams of the letters ``code`` of its text."""
        if len(code) < 3:
            return
        letters, at = np.unique(code, return_inverse=True) if int(code.max()) >= PLACES else (None, None)
        if letters is None:
            seen = np.zeros(PLACES, bool)
            seen[code] = True
            letters = np.flatnonzero(seen)
            place = np.zeros(PLACES, np.int64)
            place[letters] = np.arange(len(letters))
            at = place[code]
        k = len(letters)
        gram = ((at[:-2] * k + at[1:-1]) * k + at[2:])[doc[:-2] == doc[2:]]
        of = doc[:-2][doc[:-2] == doc[2:]]
        if k**3 <= 1 << 20:
            flags = np.zeros(k**3, bool)
            flags[gram] = True
            grams = np.flatnonzero(flags)
            number = np.zeros(k**3, np.int32)
            number[grams] = np.arange(len(grams), dtype=np.int32)
            gram = number[gram].astype(np.int64)
        else:
            grams, gram = np.unique(gram, return_inverse=True)
        width = max(1, min(4096, CELLS // len(out)))
        permuted = [self.permuted(letters, shift) for shift in range(3)] if k <= 256 else []
        for a in range(0, len(grams), width):
            g = grams[a : a + width]
            here = (gram >= a) & (gram < a + width) if len(grams) > width else slice(None)
            bound = None
            for shift, which in enumerate((g // (k * k), g // k % k, g % k)):
                if permuted:
                    vectors = permuted[shift][which]
                else:  # of very many letters only the slice's
                    used, back = np.unique(which, return_inverse=True)
                    vectors = self.permuted(letters[used], shift)[back]
                bound = vectors if bound is None else np.multiply(bound, vectors, out=bound)
            counts = np.bincount(of[here] * len(g) + gram[here] - a, minlength=len(out) * len(g)).reshape(len(out), len(g))
            out += counts.astype(np.float32) @ bound


_SPACE: dict[int, Space] = {}


def space() -> Space:
    return _SPACE.setdefault(DIMENSIONS, _SPACE.get(DIMENSIONS) or Space())


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def prototypes(docs: DataFrame, rows: int = TRAINING_ROWS, total: int | None = None) -> tuple[list[str], np.ndarray]:
    """Learned languages and a unit vector of each, from at most about ``rows`` rows with ``text`` and a non-null ``lang``.

    ``total`` is a number of rows that ``docs`` does not exceed, if one is known."""

    def summed(batches):
        total: dict[str, np.ndarray] = {}
        for batch in steps(batches):
            vectors, letters = space().bundle(batch.column("text").to_pylist())
            has, langs = letters > 0, np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs[has]):
                total[lang] = total.get(lang, 0) + unit(vectors[has & (langs == lang)]).sum(0, dtype=np.float64)
        for lang, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(vector)], ["lang", "d", "v"])

    learn = bounded(docs.where("text is not null and lang is not null").select("doc_id", "text", "lang"), rows, "doc_id", total=total)
    got = learn.select("text", "lang").mapInArrow(summed, "lang string, d int, v double").groupBy("lang", "d").agg(F.sum("v").alias("v")).toPandas()
    wide = got.pivot(index="lang", columns="d", values="v").sort_index()
    return list(wide.index), unit(wide.to_numpy(np.float64)).astype(np.float32) if len(wide) else np.zeros((0, DIMENSIONS), np.float32)


def predicted(docs: DataFrame, train: Column, lang_column: str = "lang") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the cosine, 0 at least) and ``n_letters``; rows where ``train`` holds teach.

    Null texts and texts without a letter are ``und`` with score 0, as is every text when no row teaches; texts of
    any length are read whole. Ties go to the language that sorts first. Repeated rows and rows without an id stay;
    an empty table gives no rows. Columns of ``docs`` that have a result's name give way to it; others stay as they are.
    """
    langs, vectors = prototypes(docs.where(train).select("doc_id", "text", F.col(lang_column).alias("lang")), total=docs.count())
    docs = without(docs, "lang_pred", "score", "n_letters")

    def judged(batches):
        for batch in steps(batches):
            got, letters = space().bundle(batch.column("text").to_pylist())
            has = letters > 0
            best, score = [UNKNOWN] * len(has), np.zeros(len(has))
            if langs:
                cosine = unit(got) @ vectors.T
                top = cosine.argmax(1)
                score = np.where(has, np.clip(cosine[np.arange(len(top)), top], 0, 1), 0).astype(np.float64)
                best = [langs[i] if h else UNKNOWN for i, h in zip(top.tolist(), has.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score), pa.array(letters)], [*batch.schema.names, "lang_pred", "score", "n_letters"])

    return docs.mapInArrow(judged, f"{ddl(docs)}, lang_pred string, score double, n_letters long")


def known(docs: DataFrame, train: Column) -> DataFrame:
    """``docs`` without the rows that are in none of the learned languages: texts without a letter (null and empty ones too),
    and texts of at least ``ENOUGH_LETTERS`` letters whose cosine with every language is below ``ALIKE``. Rows
    keep all their columns and repeated rows stay; without a row that teaches, only texts without a letter go.
    """
    row = numbered(docs, F.coalesce(train, F.lit(False)).alias("_train"), keep=("doc_id", "text", "lang"))
    told = predicted(row, F.col("_train"))
    alike = (F.col("n_letters") < ENOUGH_LETTERS) | (F.col("score") >= ALIKE) | (F.col("lang_pred") == UNKNOWN)
    return told.where((F.col("n_letters") > 0) & alike).select(*(F.col(n).alias(c) for n, c in zip(row.columns, docs.columns, strict=False)))


def ddl(df: DataFrame) -> str:
    return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    out = predicted(docs, ~held).select("doc_id", held.alias("held_out"), "lang_pred", "score")
    return out
